"""Keyed state tables: upsert, delete, constraint audit."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_state(current: DataFrame, updates: DataFrame, key="key_id",
                 order=("last_updated_us", "seq")) -> DataFrame:
    """Current rows replaced by the last update of their key.

    Updates are reduced per key with map-side combine before they meet the table.
    """
    cols = [c for c in current.columns]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_n"))
    joined = current.select(F.struct(*cols).alias("_o"), F.col(key)).join(last, key, "full_outer")
    picked = joined.select(F.coalesce("_n", "_o").alias("r"))
    return picked.select(*[F.col(f"r.{c}").alias(c) for c in cols])


def delete_state(state: DataFrame, keys: DataFrame, key="key_id"):
    """(remaining rows, requested keys that had none)."""
    wanted = keys.select(key).distinct()
    return state.join(wanted, key, "left_anti"), wanted.join(state.select(key), key, "left_anti")


# Allowed status words.
APPROVAL_STATUSES = ("PENDING", "APPROVED", "REJECTED", "EXECUTING", "EXECUTED")


def not_null(*columns):
    """Rules that columns are never missing."""
    return [(f"{c} is null", F.col(c).isNull()) for c in columns]


def non_negative(column):
    return [(f"{column} is negative", F.col(column) < 0)]


def in_domain(column, values):
    return [(f"{column} is not allowed", ~F.col(column).isin(*values))]


def check_constraints(df: DataFrame, rules, key, unique=()) -> DataFrame:
    """One row per violated rule and row: rule, key; and one per duplicated value.

    Row rules are evaluated in a single pass over the table.
    """
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
                               for name, cond in rules]), lambda x: x.isNotNull())
    parts = [df.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))]
    for column in unique:
        repeated = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
            F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(repeated.select(F.lit(f"{column} is not unique").alias("rule"),
                                     F.col(column).cast("string").alias("key")))
    return reduce(DataFrame.unionByName, parts)

"""Time, JSON and scope helpers as Spark columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col

SECOND_US = 1_000_000


def micros_of(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without time zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(F.col(column))
    return F.col(column).cast("long")


def json_or_null(c) -> Column:
    """JSON text of a nested column as the event tables store it: a missing value is the JSON null,
    an empty list is []."""
    return F.coalesce(F.to_json(_col(c)), F.lit("null"))


def split_scopes(c) -> Column:
    """Scopes of a comma-joined string: trimmed, without empty parts."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def has_scope(scopes, scope) -> Column:
    """Exact match or the wildcard."""
    return F.array_contains(_col(scopes), "*") | F.array_contains(_col(scopes), _col(scope))


def key_hash(c) -> Column:
    return F.sha2(_col(c), 256)

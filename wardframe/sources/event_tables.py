"""Append-only event tables: one layout and one log for batch and stream writers.

Every append is a folder of its own, `data/batch=<name>/event_date=<date>` (and below that a hash
bucket for tables that are looked up by a key). It becomes visible by its commit record, whose
number is the place of the append in the order of arrival, whoever wrote it. Ids are made of that
number, the event's time and the row, so they sort by recency; no task needs to know of another.
The record keeps the last batch of every source, so that a batch that is delivered again is known,
and counts the rows of each date, so that the newest rows are found without listing the others.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import common
from .commit_log import CommitLog

# Columns of the event tables.
TABLES = {
    "audit_events": ("request_id", "timestamp", "provider", "model", "decision", "risk_score",
                     "severity", "latency_ms", "secret_findings", "pii_findings",
                     "injection_findings", "output_findings"),
    "auth_events": ("timestamp", "event_type", "key_id", "key_name", "actor", "details"),
    "tool_events": ("timestamp", "approval_id", "event_type", "tool", "risk", "status",
                    "details"),
    "rag_events": ("request_id", "timestamp", "user_id", "role", "team", "trace"),
    "abuse_events": ("timestamp", "event_type", "key_id", "key_name", "user_id", "role", "team",
                     "path", "details"),
}
#: Tables that are looked up by a key, and the hash buckets of a date's rows.
LOOKUP = {"rag_events": "request_id"}
BUCKETS = 16


def _part(c, width=20):
    return F.lpad(c.cast("string"), width, "0")


def _bucket(c):
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(BUCKETS)).cast("int")


def _log(spark, table, folder):
    return CommitLog(spark, f"{folder}/{table}/log")


def append_events(events: DataFrame, table: str, folder: str, batch: int = None,
                  source: str = "append") -> int:
    """Append to a table; returns the number of the commit.

    `batch` numbers the appends of a source in rising order: one that is not above the source's last
    one has been appended before and changes nothing. The rows of a date, and of a bucket of tables
    with a lookup key, are gathered first: files grow with the dates and the rows, not with the
    dates times the tasks.
    """
    spark = events.sparkSession
    log = _log(spark, table, folder)

    def before(record):
        """The commit that has the source's batch already, or None."""
        last = record.get("sources", {}).get(source)
        return last[1] if batch is not None and last and last[0] >= batch else None

    done = before(log.newest()[1])
    if done:
        return done
    path = f"{folder}/{table}/data/batch=b{uuid.uuid4().hex}"
    own = F.col("id").cast("string") if "id" in events.columns else F.lit(None).cast("string")
    us = F.coalesce(common.micros_of(events, "timestamp"), F.lit(0).cast("long"))
    rows = events.select(own.alias("own_id"), F.concat_ws(
        "-", _part(us), _part(F.monotonically_increasing_id())).alias("place"), *TABLES[table],
        F.to_date("timestamp").alias("event_date"))
    places = ["event_date"]
    if table in LOOKUP:
        rows = rows.withColumn("bucket", _bucket(F.col(LOOKUP[table])))
        places.append("bucket")
    rows = rows.hint("rebalance", *places)  # splits a place that is too large for a task
    rows.write.partitionBy(*places).parquet(path)
    # answered from the files' footers
    counts = spark.read.schema(rows.schema).parquet(path).groupBy("event_date").count().collect()
    dates = {str(r.event_date): r["count"] for r in counts}
    while True:
        number, newest = log.newest()
        done = before(newest)
        if done:
            return done
        sources = dict(newest.get("sources", {}))
        if batch is not None:
            sources[source] = batch, number + 1
        if log.commit({"path": path, "dates": dates, "sources": sources}, number + 1):
            return number + 1


def append_batch(table: str, folder: str, source: str = "stream"):
    """A `foreachBatch` writer. A batch that is delivered twice is appended once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_events(batch, table, folder, batch_id, source)
    return write


def _schema(table):
    kinds = {"timestamp": "timestamp", "risk_score": "int", "latency_ms": "long",
             "approval_id": "long", "key_id": "long", "risk": "int"}
    return ", ".join(["own_id string", "place string"]
                     + [f"{c} {kinds.get(c, 'string')}" for c in TABLES[table]]
                     + ["event_date date"] + ["bucket int"] * (table in LOOKUP))


def _rows(spark, table, folder, commits, paths=None):
    """Rows of the commits [(number, record)], or of some of their paths [(number, path)]."""
    paths = [(n, r["path"]) for n, r in commits if r["dates"]] if paths is None else paths
    if not paths:
        return spark.createDataFrame([], _schema(table)).select(
            F.col("own_id").alias("id"), *TABLES[table], "event_date")
    read = spark.read.option("basePath", f"{folder}/{table}/data").parquet(
        *[p for _, p in paths])
    numbers = {p.split("/batch=")[1].split("/")[0]: n for n, p in paths}
    if len(numbers) == 1:
        number = F.lit(next(iter(numbers.values())))
    else:
        names = spark.createDataFrame(list(numbers.items()), "batch string, number long")
        read, number = read.join(names, "batch"), F.col("number")
    return read.select(F.coalesce("own_id", F.concat_ws("-", _part(number), "place")).alias("id"),
                       *TABLES[table], "event_date", *["bucket"] * (table in LOOKUP))


def read_events(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """A table; filters on event_date prune whole partitions."""
    log = _log(spark, table, folder)
    rows = _rows(spark, table, folder, [(n, log.record(n)) for n in log.numbers()])
    return rows.drop("bucket")


def newest_events(spark: SparkSession, table: str, folder: str, limit: int) -> DataFrame:
    """The `limit` newest rows by id, newest first.

    Commits are walked from the newest on, in each the dates from the latest on, until they hold
    `limit` rows by their records; only these partitions are listed and read. Rows that brought
    their own ids are of no order that the log knows: use `read_events` for such tables.
    """
    log, paths, held = _log(spark, table, folder), [], 0
    for number, record in log.newest_first():
        # a missing time counts as the oldest
        dates = sorted(record["dates"], key=lambda d: (d != "None", d), reverse=True)
        for date in dates:
            if held >= limit:
                break
            folder_of = "__HIVE_DEFAULT_PARTITION__" if date == "None" else date
            paths.append((number, f"{record['path']}/event_date={folder_of}"))
            held += record["dates"][date]
        if held >= limit:
            break
    rows = _rows(spark, table, folder, None, paths)
    return rows.drop("bucket").orderBy(F.col("id").desc()).limit(limit)


def lookup_events(spark: SparkSession, table: str, folder: str, key) -> DataFrame:
    """The rows of one key, oldest first; one hash bucket of every date is read."""
    log = _log(spark, table, folder)
    rows = _rows(spark, table, folder, [(n, log.record(n)) for n in log.numbers()])
    if "bucket" in rows.columns:
        rows = rows.filter(F.col("bucket") == _bucket(F.lit(key)))
    return rows.filter(F.col(LOOKUP[table]) == key).drop("bucket").orderBy("id")

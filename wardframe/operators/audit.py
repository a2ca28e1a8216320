"""Audit analytics over the event tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import _with

DEFAULT_LIMIT = 50
# Largest page of each event list.
AUDIT_PAGE, AUTH_PAGE, ABUSE_PAGE = 100, 100, 200


def page_limit(limit, largest) -> int:
    """A page size out of range falls back to the default."""
    return limit if limit is not None and 1 <= limit <= largest else DEFAULT_LIMIT


def _recent(events: DataFrame, limit, largest, order) -> DataFrame:
    """Top-k: every task keeps only its own newest rows."""
    newest = [F.col(c).desc() for c in order]
    return events.orderBy(*newest).limit(page_limit(limit, largest))


def recent_audit(events: DataFrame, limit=None, order=("id",)) -> DataFrame:
    return _recent(events, limit, AUDIT_PAGE, order)


def recent_auth(events: DataFrame, limit=None, order=("id",)) -> DataFrame:
    return _recent(events, limit, AUTH_PAGE, order)


def recent_abuse(events: DataFrame, limit=None, order=("id",)) -> DataFrame:
    return _recent(events, limit, ABUSE_PAGE, order)


def stat_columns() -> list:
    """The aggregates of the security statistics, for batch and streaming use."""
    decision, severity = F.col("decision"), F.col("severity")
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(decision == "ALLOW").alias("allowed_requests"),
        F.count_if(decision == "ALLOW_WITH_REDACTION").alias("redacted_requests"),
        F.count_if(decision == "BLOCK").alias("blocked_requests"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("average_latency_ms"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("average_risk_score"),
        F.count_if(severity == "CRITICAL").alias("critical_events"),
        F.count_if(severity == "HIGH").alias("high_severity_events"),
        F.count_if(severity == "MEDIUM").alias("medium_severity_events"),
    ]


def security_stats(events: DataFrame) -> DataFrame:
    """One row of totals and averages; zeros for an empty table."""
    return events.agg(*stat_columns())


def posture(keys: DataFrame, state: DataFrame, now_us: int) -> DataFrame:
    """Every key with its stored score and status, newest first.

    Uses the stored, undecayed score and ignores expiry.
    """
    s = state.select("key_id", F.col("stored_score").alias("_score"), "cooldown_until_us")
    df = keys.select(F.col("id").alias("key_id"), "name", "user_id", "role", "team", "scopes",
                     "revoked_at").join(s, "key_id", "left")
    df = _with(df, abuse_score=F.coalesce("_score", F.lit(0)))
    status = (F.when(F.col("revoked_at").isNotNull(), "REVOKED")
              .when(F.col("cooldown_until_us") > now_us, "COOLDOWN")
              .when(F.col("abuse_score") > 0, "ELEVATED").otherwise("HEALTHY"))
    return _with(df, status=status).select(
        "key_id", "name", "user_id", "role", "team", "scopes", "abuse_score", "status",
        "cooldown_until_us", "revoked_at").orderBy(F.col("key_id").desc())


def posture_summary(posture_rows: DataFrame) -> DataFrame:
    """One row of key counts per status."""
    status = F.col("status")
    return posture_rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "HEALTHY").alias("healthy"),
        F.count_if(status == "ELEVATED").alias("elevated"),
        F.count_if(status == "COOLDOWN").alias("cooldown"),
        F.count_if(status == "REVOKED").alias("revoked"))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row from several one-row frames with distinct columns, as a union and one aggregate."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])


def overview(stats: DataFrame, report: DataFrame, summary: DataFrame) -> DataFrame:
    """Request statistics, latest evaluation and key posture in one row."""
    return side_by_side(stats, report, summary)


def search(events: DataFrame, text: str) -> DataFrame:
    """Rows whose serialized form contains the text, whatever its case."""
    whole = F.lower(F.to_json(F.struct("*")))
    return events.filter(whole.contains(text.lower()))

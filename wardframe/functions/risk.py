"""Additive risk score and its bands as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Points and bands (lowest score, severity, action), highest band first.
PII_POINTS = 30
SECRET_POINTS = 95
MAX_SCORE = 100
BANDS = (
    (80, "CRITICAL", "BLOCK"),
    (60, "HIGH", "REVIEW"),
    (30, "MEDIUM", "ALLOW_WITH_REDACTION"),
    (0, "LOW", "ALLOW"),
)


def score(secret_count, pii_count, injection_count, max_injection) -> Column:
    points = (F.when(_col(pii_count) > 0, PII_POINTS).otherwise(0)
              + F.when(_col(secret_count) > 0, SECRET_POINTS).otherwise(0)
              + F.when(_col(injection_count) > 0, _col(max_injection)).otherwise(0))
    return F.least(points, F.lit(MAX_SCORE)).cast("int")


def _band(score_col, pick: int) -> Column:
    out = F.when(_col(score_col) >= BANDS[0][0], BANDS[0][pick])
    for band in BANDS[1:-1]:
        out = out.when(_col(score_col) >= band[0], band[pick])
    return out.otherwise(BANDS[-1][pick])


def severity(score_col) -> Column:
    return _band(score_col, 1)


def action(score_col) -> Column:
    return _band(score_col, 2)

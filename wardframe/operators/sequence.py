"""Chunks of time for running aggregates that never gather a key into one task.

Windows run per (key, chunk); one summary row per (key, chunk) is scanned over the chunks of a
key, whose number is bounded by the covered time and not by the traffic.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import _with

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def with_chunk(df: DataFrame, us="us", chunk_us=DAY_US) -> DataFrame:
    return _with(df, _chunk=F.floor(F.col(us) / F.lit(chunk_us)).cast("long"))

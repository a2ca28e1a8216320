"""Chat-request source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PROVIDER = "mock"
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("_corrupt", T.StringType()),
])
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def prepare(raw: DataFrame) -> DataFrame:
    """Default provider, and the reason a request is refused (NULL when it is fine)."""
    return raw.select(
        "request_id", F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce(F.nullif("provider", F.lit("")), F.lit(DEFAULT_PROVIDER)).alias("provider"),
        "messages",
        F.when(F.col("_corrupt").isNotNull(), "invalid request body")
        .when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "messages cannot be empty")
        .alias("refused"))


def read_requests(spark: SparkSession, path: str):
    """(accepted requests, refused requests) from JSON lines."""
    df = prepare(spark.read.schema(REQUEST_SCHEMA).options(**_OPTIONS).json(path))
    return df.filter(F.col("refused").isNull()).drop("refused"), df.filter("refused IS NOT NULL")


def stream_requests(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream, with the `refused` column left in for routing."""
    reader = spark.readStream.schema(REQUEST_SCHEMA).options(**_OPTIONS).options(**options)
    return prepare(reader.json(path))

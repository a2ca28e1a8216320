"""Evaluation-report history."""

from pyspark.sql import DataFrame, SparkSession

_METRIC = ("struct<total:bigint,passed:bigint,failed:bigint,accuracy:double,precision:double,"
           "recall:double,false_positives:bigint,false_negatives:bigint,"
           "average_latency_ns:bigint>")
SCHEMA = f"timestamp string, prompt_injection {_METRIC}, pii {_METRIC}, rag {_METRIC}"


def write_report(report: DataFrame, folder: str) -> None:
    """Append one report record."""
    report.coalesce(1).write.mode("append").json(folder)


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """All reports, from files of one record each, pretty-printed or not."""
    return spark.read.option("multiLine", True).schema(SCHEMA).json(folder)

"""Labelled evaluation cases from JSON-array files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INJECTION = "name string, input string, expected string"
PII = "name string, input string, expected_redactions int"
RETRIEVAL = ("name string, role string, team string, expected_included int, "
             "documents array<struct<id:string,source:string,owner_team:string,"
             "classification:string,trust_level:string,content:string,"
             "allowed_roles:array<string>>>")


def read_cases(spark: SparkSession, folder: str, multi_line=True):
    """(injection, pii, retrieval) cases of a folder: JSON arrays, or one case a line."""
    def load(name, schema):
        return spark.read.option("multiLine", multi_line).schema(schema).json(f"{folder}/{name}.json")

    return load("injection", INJECTION), load("pii", PII), load("rag", RETRIEVAL)


def retrieval_documents(cases: DataFrame) -> DataFrame:
    """Retrieval cases as document rows, keyed by case name and position."""
    return cases.select(
        F.col("name").alias("request_id"), "role", "team",
        F.posexplode("documents").alias("pos", "d")).select(
        "request_id", "pos", "role", "team", "d.*")

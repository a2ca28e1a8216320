"""Run a stream to the end of its input and read back what it wrote."""

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import new_folder


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream into a table of the shared folder, all available input."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{out}/table").option("checkpointLocation", f"{out}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Complete-mode stream: every batch replaces the table."""
    spark = stream.sparkSession
    out = new_folder(spark, name)

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(f"{out}/table")

    query = (stream.writeStream.outputMode("complete").foreachBatch(replace)
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def stream_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A Parquet table as a file stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]")

"""Stored state: a table of one row for each key, changed by upserts and deletes.

Rows lie in hash buckets of their key. A change rewrites the buckets that its keys fall into, into
a folder of its own, and becomes the table by a commit record that names the folder of every bucket
(see `commit_log`). Readers see the state of one commit as a whole. A change that another writer has
overtaken is made again on top of that one's; a batch that is delivered again is known by the
number its source has got to, and changes nothing.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from .commit_log import CommitLog, subfolders

BUCKETS = 64


class StateTable:
    """A stored state table of a schema such as "key_id long, score int, last_updated_us long"."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key="key_id",
                 buckets=BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, f"{self.folder}/log")

    def _read(self, paths):
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(set(paths)))

    def read(self) -> DataFrame:
        """The table as of now; later commits do not change the frame."""
        return self._read(self.log.newest()[1].get("paths", {}).values())

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _change(self, keys, change, source, batch):
        """Rewrite the buckets of keys(key) by change(rows of these buckets)."""
        # at most `buckets` rows
        touched = sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())
        while True:
            number, record = self.log.newest()
            sources = dict(record.get("sources", {}))
            if source is not None and sources.get(source, -1) >= batch:
                return False
            paths = dict(record.get("paths", {}))
            current = self._read([paths.pop(str(b)) for b in touched if str(b) in paths])
            new = f"{self.folder}/data/change={uuid.uuid4().hex}"
            change(current).select(self.schema.names).withColumn("bucket", self._bucket()) \
                .repartition("bucket").write.partitionBy("bucket").parquet(new)
            for name in subfolders(self.spark, new):
                paths[name.removeprefix("bucket=")] = f"{new}/{name}"
            if source is not None:
                sources[source] = batch
            if self.log.commit({"paths": paths, "sources": sources}, number + 1):
                return True

    def upsert(self, updates: DataFrame, order=("last_updated_us", "seq"), source=None,
               batch=None) -> bool:
        """Replace the rows of the updates' keys by their last update.

        Returns False where the source's batch has been applied before."""
        return self._change(updates, lambda rows: state.upsert_state(
            rows, updates, self.key, order), source, batch)

    def delete(self, keys: DataFrame, source=None, batch=None) -> DataFrame:
        """Delete the rows of keys(key); returns the keys that had none."""
        missing = keys.select(self.key).distinct().join(
            self.read().select(self.key), self.key, "left_anti")
        self._change(keys, lambda rows: state.delete_state(rows, keys, self.key)[0], source, batch)
        return missing

    def writer(self, order=("last_updated_us", "seq"), source="stream"):
        """A `foreachBatch` writer of upserts, safe on replay."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, order, source, batch_id)
        return write

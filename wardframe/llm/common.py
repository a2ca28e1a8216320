"""Helpers of the folder: inputs, written tables, byte views of Arrow text columns."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..plans.session import new_folder

#: Stands for a null id inside joins; the text's own hash goes along with it.
NO_ID = -(1 << 63)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark):
    """Whole texts come in Arrow batches of 2000 rows, unless the session asks for a number."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default
        spark.conf.set(BATCH_ROWS, "2000")


def texts(docs):
    """doc_id and text alone, null texts as empty ones: other columns cannot clash."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def packed(docs):
    """The whole row as one struct `row` beside doc_id and text as `texts` gives them."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.struct("*").alias("row"))


def unpacked(rows, **changed):
    """Whole rows again, in their own order of columns, with some columns changed."""
    names = rows.schema["row"].dataType.names
    return rows.select(*[changed[n].alias(n) if n in changed else F.col("row")[n].alias(n)
                         for n in names])


def keyed(docs):
    """Rows with (k_id, k_hash), equal for rows alike in id and text only."""
    return docs.withColumns({"k_id": F.coalesce("doc_id", F.lit(NO_ID)),
                             "k_hash": F.xxhash64("text")})


def written(df, name, **options):
    """The rows as a table in the shared folder: read again, never computed again."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{name}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw(column):
    """(bytes as uint8 array, offsets) of an Arrow string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32,
                         len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def small_batches(batches, size=8 << 20):
    """Batches cut so that the text column of each holds about `size` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = raw(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def vocabulary(name):
    """The place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)

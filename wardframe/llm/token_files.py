"""Token ids as binary files with a minimal perfect hash index.

Documents lie in ascending order of their keys (doc_id, number among rows of one id). A folder has

* `data/kind=ids/shard=N/`: one file of raw little-endian ids, documents back to back, 16 bits each
  if the vocabulary allows, else 32, and a newline at its end. Shards follow each other by number.
* `data/kind=docs/shard=N/`: the documents of a shard in order, likewise (`DOC`).
* `keys/`: keys and places of all documents as Parquet.
* `index/bucket=N/`: for the keys of a hash bucket a minimal perfect hash function, then for every
  key, by its number, a fingerprint and the place of the document: its shard, the ids before it in
  the shard and in all, and its length. A newline ends the file.

Whoever has a key hashes it to its bucket, asks the function for its number and finds the place
there: no search, whatever the number of documents. The fingerprint tells unknown keys. All files
are written and read by Spark's own writers and readers, so any store will do. Texts cross one
shuffle on their way to the files, and the files' content one on its way to those who ask, both
compressed.
"""

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import new_folder
from .common import raw, small_batches, texts
from .packing import END_ID, encoder
from .perfect import PerfectHash, fingerprints

#: Ids of a shard, beyond which it ends after the current document.
SHARD = 1 << 22
#: Bytes of texts that one task puts in order, on average.
PART_BYTES = 128 << 20
#: Documents of one index file, on average.
BUCKET = 1 << 16

#: A document of a shard: its key (`null` for a null doc_id), the ids before it there, its ids.
DOC = np.dtype([("null", "?"), ("doc_id", "<i8"), ("k", "<i8"), ("offset", "<i8"), ("n", "<i8")])
_SLOT = np.dtype([("mark", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("start", "<i8"),
                  ("n", "<i8")])
_U = np.uint64


def id_type(path, end_id=END_ID):
    """The type of the ids of a vocabulary file."""
    return "<u2" if max(encoder(path).whole.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def _pressed(column, level):
    """Rows with the bytes of a column without nulls compressed, and a number of their own."""
    def run(batches):
        press, row = zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId() << 40
        for batch in batches:
            names = batch.schema.names
            data, ends = raw(batch.column(column))
            data = memoryview(data)
            z = [press.compress(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            out = [pa.array(z, pa.binary()) if c == column else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                out + [pa.array(row + np.arange(len(z)))], [*names, "row"])
            row += len(z)
    return run


def _shards(path, end_id, kind, size):
    """(kind, shard, line): the two files of each shard of a part whose rows come in order."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, press = encoder(path), zstandard.ZstdDecompressor()
        number, last, k = TaskContext.get().partitionId() << 24, None, 0
        ids, docs, total = [], [], 0

        def done():
            data = np.frombuffer(b"".join(ids), "<u4").astype(kind)
            return pa.RecordBatch.from_pydict(
                {"kind": ["docs", "ids"], "shard": [number] * 2,
                 "line": [np.array(docs, DOC).tobytes(), data.tobytes()]},
                pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("line", pa.binary())]))

        for batch in small_batches(batches, 1 << 20):  # compressed
            texts_ = [press.decompress(z).decode() for z in batch.column("text").to_pylist()]
            for i, x in zip(batch.column("doc_id").to_pylist(), encode(texts_)):
                if total >= size:
                    yield done()
                    number += 1
                    ids, docs, total = [], [], 0
                # a shard counts the rows of an id anew: `places` adds those before it
                k = k + 1 if docs and last == (i,) else 0
                last = (i,)
                n = len(x) // 4 + 1
                docs.append((i is None, i or 0, k, total, n))
                ids += x, end
                total += n
        if docs:
            yield done()
    return run


_DOCS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()),
                   ("offset", pa.int64()), ("n", pa.int64())])
_RUNS = pa.schema([("shard", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()),
                   ("rows", pa.int64()), ("ids", pa.int64())])


def _doc_rows(batches):
    """The documents of shards from their files."""
    for batch in batches:
        for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
            docs = np.frombuffer(content.as_buffer().to_pybytes(), DOC)
            for at in range(0, len(docs), 1 << 16):
                part = docs[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), shard)),
                     pa.array(part["doc_id"].copy(), mask=part["null"].copy())]
                    + [pa.array(part[c].copy()) for c in ("k", "offset", "n")], schema=_DOCS)


def _run_rows(batches):
    """Of each shard its first doc_id and, if it is another one, its last, with their rows; the
    first with the ids of the shard."""
    for batch in batches:
        out = []
        for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
            docs = np.frombuffer(content.as_buffer().to_pybytes(), DOC)
            keys = docs[["null", "doc_id"]]
            total = int(docs["offset"][-1] + docs["n"][-1])
            for at, key in enumerate(keys[[0, -1]]):
                if at and key == keys[0]:
                    continue
                out.append({"shard": shard, "at": at, "rows": int((keys == key).sum()),
                            "doc_id": None if key["null"] else int(key["doc_id"]),
                            "ids": 0 if at else total})
        yield pa.RecordBatch.from_pylist(out, _RUNS)


def _index(batches):
    """(bucket, index file) of keys that come sorted by bucket."""
    now, held = None, []

    def done():
        cols = [np.concatenate(x) for x in zip(*held)]
        a, b = cols[0].view(_U), cols[1].view(_U)
        known = PerfectHash.of(a, b)
        slots = np.zeros(known.size, _SLOT)
        number = known(a, b)
        slots["mark"][number] = fingerprints(a, b)
        for name, values in zip(("shard", "offset", "start", "n"), cols[2:]):
            slots[name][number] = values
        return pa.RecordBatch.from_pydict(
            {"bucket": [now], "file": [known.dump() + slots.tobytes()]},
            pa.schema([("bucket", pa.int64()), ("file", pa.binary())]))

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("bucket", "a", "b", "shard", "offset",
                                                     "start", "n")]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [batch.num_rows]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if x == y:
                continue
            if held and cols[0][x] != now:
                yield done()
                held = []
            now = int(cols[0][x])
            held.append([c[x:y] for c in cols[1:]])
    if held:
        yield done()


def hashed(keys, buckets):
    """keys(doc_id, k, ...) with their two hashes and their bucket."""
    a = F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "k")
    b = F.xxhash64(F.lit(2), F.col("doc_id").isNull(), "doc_id", "k")
    return keys.withColumns({"a": a, "b": b, "bucket": F.pmod(a, F.lit(buckets).cast("long"))})


def _raw_files(df, columns, content, folder):
    """One file of raw bytes for each row; the writer ends it with a newline."""
    df.select(*columns, F.col(content).cast("string").alias("line")).write.partitionBy(
        *columns).option("compression", "none").text(folder)


def _contents(spark, folder, column):
    """(number, content) of all files of a folder, without the newline."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        folder).select(F.regexp_extract("path", f"{column}=([0-9]+)", 1).cast("long").alias(column),
                       F.expr("substring(content, 1, length - 1)").alias("content"))


@dataclass
class TokenFiles:
    """A written folder; the numbers are what a reader has to know."""

    spark: SparkSession
    folder: str
    kind: str
    buckets: int

    def keys(self) -> DataFrame:
        """(doc_id, k) of all documents."""
        if not self.buckets:
            return self.spark.createDataFrame([], "doc_id long, k long")
        return self.spark.read.schema("doc_id long, k long").parquet(f"{self.folder}/keys")

    def find(self, keys) -> DataFrame:
        """doc_id, k, shard, offset, start, n of each row of keys(doc_id, k); null places where
        the index has no such key (with a chance of 2 ** -32, a wrong place)."""
        if not self.buckets:
            return keys.select("doc_id", "k", *(F.lit(None).cast("long").alias(c) for c in
                                                ("shard", "offset", "start", "n")))
        asked = hashed(keys.select("doc_id", "k"), self.buckets).withColumn(
            "content", F.lit(None).cast("binary"))
        files = _contents(self.spark, f"{self.folder}/index", "bucket")
        both = asked.select("bucket", F.lit(1).alias("ask"), "doc_id", "k", "a", "b", "content") \
            .unionByName(files.select("bucket", F.lit(0).alias("ask"), "content"),
                         allowMissingColumns=True)
        return both.repartition("bucket").sortWithinPartitions("bucket", "ask").mapInArrow(
            _find, "doc_id long, k long, shard long, offset long, start long, n long")

    def read(self, places, digest=False) -> DataFrame:
        """doc_id, k, start, n and ids of found places: little-endian 32-bit ids, or with
        `digest` their unsigned crc32 as ids_crc32. Rows without a place are left out."""
        if not self.buckets:
            return places.select("doc_id", "k", "start", "n", F.lit(None).cast(
                "long" if digest else "binary").alias("ids_crc32" if digest else "ids"))
        files = _contents(self.spark, f"{self.folder}/data/kind=ids", "shard").mapInArrow(
            _pressed("content", 3), "shard long, content binary, row long").drop("row")
        both = places.filter("shard IS NOT NULL").select(
            "shard", F.lit(1).alias("ask"), "doc_id", "k", "offset", "start", "n",
            F.lit(None).cast("binary").alias("content")).unionByName(
            files.select("shard", F.lit(0).alias("ask"), "content"), allowMissingColumns=True)
        out = "ids_crc32 long" if digest else "ids binary"
        return both.repartition("shard").sortWithinPartitions("shard", "ask", "offset").mapInArrow(
            _read(self.kind, digest), f"doc_id long, k long, start long, n long, {out}")


def _cuts(batch, column):
    """Stretches of a batch's rows that are one file, or rows that ask alike."""
    at = batch.column(column).to_numpy()
    ask = batch.column("ask").to_numpy()
    new = np.flatnonzero((np.diff(at) != 0) | (ask[1:] == 0)) + 1
    first = np.flatnonzero(np.diff(ask) != 0) + 1
    cuts = np.unique(np.concatenate([[0], new, first, [batch.num_rows]]))
    return [(x, y, int(at[x]), ask[x]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _find(batches):
    known = slots = None
    for batch in batches:
        if not batch.num_rows:
            continue
        for x, y, _, ask in _cuts(batch, "bucket"):
            if not ask:
                known, rest = PerfectHash.load(batch.column("content")[x].as_buffer().to_pybytes())
                slots = np.frombuffer(rest, _SLOT)
                continue
            part = batch.slice(x, y - x)
            a, b = (part.column(c).to_numpy().view(_U) for c in "ab")
            if known is None:
                number = np.full(len(a), -1)
            else:
                number = known(a, b)
            ok = number >= 0
            if ok.any():
                ok[ok] = slots["mark"][number[ok]] == fingerprints(a[ok], b[ok])
            got = slots[number[ok]] if ok.any() else np.zeros(0, _SLOT)
            out = []
            for name in ("shard", "offset", "start", "n"):
                values = np.zeros(len(a), np.int64)
                values[ok] = got[name]
                out.append(pa.array(values, mask=~ok))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("k"), *out],
                ["doc_id", "k", "shard", "offset", "start", "n"])


def _read(kind, digest):
    def run(batches):
        ids = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for x, y, _, ask in _cuts(batch, "shard"):
                if not ask:
                    ids = np.frombuffer(zstandard.decompress(
                        batch.column("content")[x].as_buffer().to_pybytes()), kind)
                    continue
                part = batch.slice(x, y - x)
                got = [ids[a:a + n].astype("<u4").tobytes() for a, n in
                       zip(part.column("offset").to_pylist(), part.column("n").to_pylist())]
                last = pa.array([zlib.crc32(v) for v in got], pa.int64()) if digest \
                    else pa.array(got, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "k", "start", "n")] + [last],
                    ["doc_id", "k", "start", "n", "ids_crc32" if digest else "ids"])
    return run


def write_files(docs, path, folder=None, end_id=END_ID, shard=SHARD, bucket=BUCKET):
    """TokenFiles of all documents, each encoded by the vocabulary file `path` and ended by
    `end_id`, in ascending order of doc_id.

    Equal ids follow by the hash of the text, null ids come last; rows of one id are numbered k =
    0, 1, ... in this order. A null text is empty and has the end id alone. Empty tables give files
    without a document; other columns are not read. Ranges are cut by (id, hash, row), so that rows
    of one id, or alike in all, are dealt over tasks like any others. A document lies in one shard
    and is limited by what one row can hold (2 GB of ids).
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "llm-token-files")
    kind = id_type(path, end_id)
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    files = TokenFiles(spark, folder, kind, math.ceil(count / bucket))
    if not count:
        return files
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                math.ceil(total / PART_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row")]
    pressed = rows.mapInArrow(_pressed("text", 1),
                              "doc_id long, text binary, hash long, row long")
    _raw_files(pressed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _shards(path, end_id, kind, shard), "kind string, shard long, line binary"),
        ["kind", "shard"], "line", f"{folder}/data")
    _places(spark, folder).write.parquet(f"{folder}/keys")
    index = hashed(spark.read.parquet(f"{folder}/keys"), files.buckets).repartition(
        "bucket").sortWithinPartitions("bucket").mapInArrow(_index, "bucket long, file binary")
    _raw_files(index, ["bucket"], "file", f"{folder}/index")
    return files


def _places(spark, folder):
    """doc_id, k, shard, offset, start, n of every document of the shards."""
    docs = _contents(spark, f"{folder}/data/kind=docs", "shard")
    runs = docs.mapInArrow(_run_rows, "shard long, at int, doc_id long, rows long, ids long")
    # ids before each shard, and rows before it that have its first doc_id
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.withColumn("carry", F.coalesce(
        F.sum("rows").over(before.partitionBy("doc_id").orderBy("shard")), zero)).filter("at = 0")
    heads = runs.select("shard", F.col("doc_id").alias("head"), "carry", F.coalesce(
        F.sum("ids").over(before.orderBy("shard")), zero).alias("base"))
    return docs.mapInArrow(_doc_rows, "shard long, doc_id long, k long, offset long, n long").join(
        heads, "shard").select(
        "doc_id", (F.col("k") + F.when(F.col("doc_id").eqNullSafe(F.col("head")),
                                       F.col("carry")).otherwise(zero)).alias("k"),
        "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n")


def documents(files, digest=True):
    """doc_id, start, n_tokens and ids_crc32 (or ids) of every document, by its key: found
    through the index and read from the files."""
    got = files.read(files.find(files.keys()), digest)
    return got.select("doc_id", "start", F.col("n").alias("n_tokens"), got.columns[-1])

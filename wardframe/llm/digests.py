"""Quartile bucket digests of documents and their bounded difference.

Every window of five bytes gives three byte triplets; each is hashed to one of 256 buckets. The
quartiles of the bucket counts turn every bucket into two bits. The digest has a byte for the
length on a logarithmic scale, a byte for the ratios of the quartiles and 64 bytes of buckets,
all as hex digits. The difference adds up bucket steps, with a whole-scale step doubled, and the
distances of the two header bytes; likeness is one less its share of the largest difference.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import raw, small_batches, texts, written

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
STEP = np.array([0, 1, 2, 6])
HEADER = 16
LARGEST = BUCKETS * 6 + HEADER + 15

_RNG = np.random.default_rng(20)
_MIX = _RNG.integers(0, 1 << 32, (3, 256), dtype=np.uint32)


def bucket_counts(data, counts=None):
    """Counts of hashed byte triplets of `data`, a uint8 array."""
    counts = np.zeros(BUCKETS, np.int64) if counts is None else counts
    for n, (a, b, c) in enumerate(TRIPLETS):
        size = len(data) - c
        if size > 0:
            h = _MIX[0][data[a:a + size]] + _MIX[1][data[b:b + size]] * np.uint32(2 * n + 3)
            h ^= _MIX[2][data[c:c + size]]
            h *= np.uint32(0x85EBCA6B)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def _digest(counts, size):
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, int(np.log2(size + 1) * 8))
    ratio = (int(15 * q1 / q3) << 4 | int(15 * q2 / q3)) if q3 else 0
    return bytes([length, ratio]) + packed.astype(np.uint8).tobytes()


def digest(data):
    """The digest of a text, given as UTF-8 bytes."""
    return _digest(bucket_counts(np.frombuffer(data, np.uint8)), len(data))


def likeness(a, b):
    """1 for equal digests down to 0 for the largest difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    shift = np.array([6, 4, 2, 0], np.uint8)
    p = ((x[2:, None] >> shift) & 3).astype(np.int8)
    q = ((y[2:, None] >> shift) & 3).astype(np.int8)
    diff = int(STEP[np.abs(p - q)].sum())
    diff += min(HEADER, abs(int(x[0]) - int(y[0])))
    diff += min(HEADER, (abs((int(x[1]) >> 4) - (int(y[1]) >> 4))
                         + abs((int(x[1]) & 15) - (int(y[1]) & 15))) // 2)
    return 1 - diff / LARGEST


def edit(text, other):
    """The text with its last half replaced by as many code points of the other one."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compared(text, mine, other, theirs):
    """The six fields of a text with its digest, its next text and that one's digest."""
    edited = edit(text, other).encode()
    own = digest(edited)
    return (len(text), hashlib.sha256(edited).hexdigest(), mine.hex(), own.hex(),
            likeness(mine, own), likeness(mine, theirs))


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _chain(batches):
    """Each row beside the next one of its part; the part's first and last wait for others."""
    part, last, first = TaskContext.get().partitionId(), None, True

    def done(ids, rows, kind, text):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()),
             pa.array(kind, pa.int32()), pa.array(text, pa.string())]
            + [pa.array([r and r[i] for r in rows], k) for i, k in enumerate(_KINDS)],
            ["doc_id", "part", "kind", "text", *_NAMES])

    for batch in small_batches(batches):
        data, ends = raw(batch.column("text"))
        data, ids, rows, kind, text = data.tobytes(), [], [], [], []
        for i, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(),
                           ends[1:].tolist()):
            blob = data[a:b]
            now = (i, blob.decode(), digest(blob))
            if first:
                ids.append(i)
                rows.append(None)
                kind.append(1)
                text.append(now[1])
                first = False
            else:
                ids.append(last[0])
                rows.append(compared(last[1], last[2], now[1], now[2]))
                kind.append(0)
                text.append(None)
            last = now
        yield done(ids, rows, kind, text)
    if last:
        yield done([last[0]], [None], [2], [last[1]])


def _seams(batches):
    for batch in small_batches(batches):
        rows = []
        for text, other in zip(batch.column("text").to_pylist(),
                               batch.column("other").to_pylist()):
            rows.append(compared(text, digest(text.encode()), other, digest(other.encode())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(x, k) for x, k in zip(zip(*rows), _KINDS)],
            ["doc_id", *_NAMES])


def fingerprints(docs):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id, after the smallest the largest;
    equal ids follow by the text's hash, a null id comes last. A single document follows itself. Null texts
    are empty; equal texts have equal digests; empty tables give no rows; other columns are not
    read. Texts are shuffled once, by ranges of doc_id. Only the first and last row of a range
    meet another range's, through a table of two rows a range.
    """
    # the sampler of ranges keeps the order's columns in the driver: 16 bytes, not the text
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").desc()]
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    marked = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _chain, f"doc_id long, part int, kind int, text string, {FIELDS}")
    marked = written(marked, "chain")
    # a range's last row is followed by the first row of the next range that has one
    heads = marked.filter("kind = 1").select("part", F.col("text").alias("other"))
    parts = heads.select("part")
    line = Window.orderBy("part")
    follow = parts.select("part", F.coalesce(
        F.lead("part").over(line),
        F.first("part").over(line.rowsBetween(Window.unboundedPreceding,
                                              Window.unboundedFollowing))).alias("next_part"))
    tails = marked.filter("kind = 2").select("doc_id", "part", "text")
    seams = tails.join(follow, "part").join(
        heads.withColumnRenamed("part", "next_part"), "next_part").select(
        "doc_id", "text", "other").mapInArrow(_seams, f"doc_id long, {FIELDS}")
    return marked.filter("kind = 0").select("doc_id", *_NAMES).unionAll(seams)

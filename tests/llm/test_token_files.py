"""Token files: order, raw bytes, keyed access, perfect hashing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.llm import token_files
from wardframe.llm.common import vocabulary
from wardframe.llm.perfect import PerfectHash, fingerprints

from . import cases
from .test_packing import wanted

PATH = vocabulary("word_bpe_49k.json")


def slow(texts):
    """(doc_id, start, n, crc) of each text, ids from the tokenizers library."""
    line = sorted(zip(texts, wanted([t for _, t in texts])),
                  key=lambda x: (x[0][0] is None, x[0][0] or 0))
    out, start = [], 0
    for (i, _), ids in line:
        ids = np.array([*ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("shard,bucket", [(1 << 22, 1 << 18), (50, 7), (1, 1)])
def test_documents(spark, shard, bucket):
    texts = [(10 * i - 300, cases.prose(i, i % 23)) for i in range(150)] + [
        (5000, ""), (5001, None), (-9, cases.prose(1, 5000)), (1 << 62, "é 日"), (-(1 << 63), "x")]
    files = token_files.write_files(cases.documents(spark, texts), PATH, shard=shard, bucket=bucket)
    got = [tuple(r) for r in token_files.documents(files).collect()]
    want = slow(texts)
    assert sorted(got) == sorted(want)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        f"{files.folder}/data/kind=ids").orderBy(
        F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long")).collect()
    assert all(bytes(r.content[-1:]) == b"\n" for r in raw)
    ids = np.frombuffer(b"".join(bytes(r.content[:-1]) for r in raw), files.kind)
    assert files.kind == "<u2" and len(ids) == sum(r[2] for r in want)
    for _, start, n, crc in want:
        assert zlib.crc32(ids[start:start + n].astype("<u4").tobytes()) == crc
    if shard == 50:
        assert len(raw) > 20
        asked = spark.createDataFrame([(-9, 0), (-9, 1), (7, 0), (None, 0), (5000, 0), (5000, 0)],
                                      "doc_id long, k long")
        found = files.find(asked)
        assert sorted(r.doc_id for r in found.filter("shard IS NOT NULL").collect()) == \
            [-9, 5000, 5000]
        assert found.count() == 6
        row = files.read(found.filter("doc_id = -9")).collect()
        assert len(row) == 1 and len(row[0].ids) == 4 * row[0].n


@pytest.mark.parametrize("shard", [1 << 22, 30])
def test_repeated_and_null_ids(spark, shard):
    texts = cases.TEXTS + [(3, cases.prose(i % 4, 9)) for i in range(60)] + \
        [(None, cases.prose(i, 5)) for i in range(20)]
    files = token_files.write_files(cases.documents(spark, texts), PATH, shard=shard, bucket=10)
    got = token_files.documents(files).collect()
    assert cases.ids(got) == sorted(-1 if i is None else i for i, _ in texts)
    want = slow(texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == \
        sorted((i is None, i or 0, n, crc) for i, _, n, crc in want)
    line = sorted(got, key=lambda r: r.start)
    assert [r.start for r in line] == np.cumsum([0] + [r.n_tokens for r in line])[:-1].tolist()
    assert [r.doc_id for r in line] == [i for i, *_ in want]
    keys = files.keys().collect()
    assert len(set(keys)) == len(texts)
    assert sorted(r.k for r in keys if r.doc_id == 3) == list(range(61))


def test_empty(spark):
    files = token_files.write_files(cases.empty(spark), PATH)
    assert token_files.documents(files).count() == 0
    assert files.find(spark.createDataFrame([(1, 0)], "doc_id long, k long")).first().shard is None


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(size):
    rnd = np.random.default_rng(size)
    a, b = rnd.integers(0, 1 << 64, (2, size), np.uint64)
    known = PerfectHash.of(a, b)
    assert sorted(known(a, b).tolist()) == list(range(size))
    again, rest = PerfectHash.load(known.dump() + b"tail")
    assert rest == b"tail" and (again(a, b) == known(a, b)).all()
    assert len(known.bits) < 4 * size + 90
    if size > 100:
        marks = np.zeros(size, np.uint32)
        marks[known(a, b)] = fingerprints(a, b)
        c, d = rnd.integers(0, 1 << 64, (2, size), np.uint64)
        number = known(c, d)
        hit = number >= 0
        assert hit.any() and (marks[number[hit]] == fingerprints(c[hit], d[hit])).sum() <= 1


def test_equal_keys_are_refused():
    one = np.ones(2, np.uint64)
    with pytest.raises(ValueError):
        PerfectHash.of(one, one)

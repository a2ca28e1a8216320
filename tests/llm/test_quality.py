"""Quality counts against plain definitions; bands; the filter."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardframe.llm import quality

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update((i, i + 1, i + 2))
    lines, again = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.append(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again,
            len(hit))


def test_counts():
    rnd = random.Random(7)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "#", "|", "\x0b", "\x85", "日"])
                       for _ in range(rnd.randint(0, 120)))
        assert quality.counts(text.encode()) == plain_counts(text)


def test_table_and_filter(spark):
    docs = cases.documents(spark)
    rows = quality.quality_rules(docs).collect()
    assert cases.ids(rows) == cases.ALL_IDS
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (2, None)}
    assert by_id[1].kept and by_id[8].kept and not by_id[4].kept and not by_id[5].kept
    assert by_id[9].base_failed and by_id[12].base_failed
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert cases.ids(kept.collect()) == sorted(
        -1 if r.doc_id is None else r.doc_id for r in rows if r.kept)
    assert quality.passing(cases.empty(spark)).count() == 0
    assert quality.quality_rules(cases.empty(spark)).count() == 0


def test_bands(spark):
    rnd = random.Random(1)
    noise = " ".join("".join(chr(rnd.randint(33, 126)) for _ in range(9)) for _ in range(900))
    line = "the same line of words comes here with number "
    lines = "\n".join(f"{line}{i}" for i in range(400))
    good = cases.prose(5, 4000)
    texts = [(1, noise), (2, lines), (3, good), (4, good + "\n" + cases.prose(6, 400))]
    got = {r.doc_id: r for r in quality.quality_rules(cases.documents(spark, texts),
                                                      max_repeat=100).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert got[1].ratio < 1.45 and got[2].ratio > 6
    assert not any(r.base_failed for r in got.values())


def test_bands_judge_texts_they_have_not_seen(spark):
    """Limits of one half of the labelled documents, held against the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    bands = quality.fit_bands(docs, labels.filter(half))
    rows = quality.quality_rules(docs, bands=bands).join(labels.filter(~half), "doc_id").filter(
        "NOT base_failed").join(docs.select("doc_id", F.octet_length("text").alias("size")),
                                "doc_id").select("size", "quality", "kept").collect()
    lost = [not r.kept for r in rows if r.quality == 1]
    assert len(lost) > 1000 and sum(lost) <= 0.03 * len(lost)
    for low, high, least in ((2048, 1 << 62, 0.9), (768, 2048, 0.6)):
        caught = [not r.kept for r in rows if r.quality == 0 and low < r.size <= high]
        assert len(caught) > 30 and sum(caught) >= least * len(caught)


def test_limits_of_few_texts(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    bands = quality.fit_bands(docs, none)
    assert [b[0] for b in bands] == [0, *quality.CLASSES]
    assert bands[0][1:] == quality.BANDS[0][1:] and bands[-1][1:] == quality.BANDS[-1][1:]
    assert bands[4][1:] == quality.BANDS[2][1:]  # up to 768 bytes
    few = spark.createDataFrame([(i, 1) for i in (1, 2, 4, 5, 8, None, 1)],
                                "doc_id long, quality int")
    assert quality.fit_bands(docs, few) == bands
    sizes, ratios = np.full(200, 700), np.linspace(1.5, 1.9, 200)
    got = {b[0]: b[1:] for b in quality.limits(sizes, ratios)}
    assert got[768] == pytest.approx((1.35, 1.896), abs=0.01)


def test_last_chunk_and_bad_stretch():
    text = cases.prose(3, 2500).encode()
    bands = ((0, 1.2, 2.6), (1 << 62, 1.2, 9.0))
    junk = random.Random(1).randbytes(9000).hex().encode()[:9000]

    def bad(data):
        rows = pa.RecordBatch.from_pydict({"text": [data.decode()]})
        out = next(quality._judge(50, 50, bands, 4096, 0.25)(iter([rows]))).to_pylist()[0]
        return out["bad_chunks"], out["kept"]

    parts = -(-len(text) // 4096)
    assert bad(text) == (0, True)
    assert bad(text + b"ab " * 3000)[0] >= 2
    assert parts > 3 and bad(text[:4096] + b"ab " * 5000)[1] is False
    assert bad(junk)[0] == 0  # hex digits pack to half


def test_all_labels_count(spark):
    """Limits are the exact order statistics of every labelled text, however many there are."""
    docs = spark.range(24_000).selectExpr("id AS doc_id", """array_join(transform(
        sequence(1, 60 + id % 90), i -> substr(md5(cast(i * id % (40 + id % 30) AS string)), 1, 4)),
        ' ') AS text""").cache()
    labels = docs.selectExpr("doc_id", "1 AS quality")
    press = quality.packer()
    data = [r.text.encode() for r in docs.collect()]
    sizes = np.array([len(d) for d in data])
    ratios = np.array([len(d) / len(press.compress(d)) for d in data])
    assert quality.fit_bands(docs, labels) == quality.limits(sizes, ratios)


def test_words_as_spark_counts_them(spark):
    texts = ["", " ", "a", " a\n", "\n", "a b\t c", "\x0ba  b ", "a b c", "\n a \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", F.size(F.split(F.trim("text"), r"\s+")).alias("n")).collect()
    for r in rows:
        found = [quality._words_at_least(r.text.encode(), n) for n in (r.n, r.n + 1)]
        assert found == [True, False] or not r.text.strip(" ")

"""Language-model scores: exact base scores, filter counts, better fit on repeated prose."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from wardframe.llm import langmodel as lm

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) + ["\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("exact", [1 << 20, 0])
def test_base(spark, exact):
    got = lm.lm_scores(cases.documents(spark), exact_words=exact).collect()
    assert cases.ids(got) == cases.ALL_IDS
    count = Counter(w for i, t in cases.TEXTS if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)),
                   sum(count[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
                  for i, t in cases.TEXTS)
    assert want == sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known,
                           r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score <= 0 for r in got)
    assert lm.lm_scores(cases.empty(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    i = next(i for i in range(100) if held(i))
    (row,) = lm.lm_scores(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3)


def test_filter_counts():
    rnd = np.random.default_rng(5)
    h = rnd.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = np.maximum(1, (rnd.pareto(1, len(h)) * 2).astype(np.int64))
    words = lm.fill(h, lm.levels(counts))
    read = lm.Filter(np.array([len(words)]), words, 0)
    got = lm.middles(read.levels(h))
    assert (got >= counts / 2 ** (1 / lm.SCALE) - 1).all()  # never far below
    assert np.mean(np.abs(np.log2(got / counts)) < 1) > 0.95
    small = counts <= 3
    assert np.mean(got[small] == counts[small]) > 0.95  # exact but for false hits
    absent = read.levels(rnd.integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert (absent > 0).mean() < 0.05


def prose(seed=4):
    rnd = random.Random(seed)
    lines = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(30)) for _ in range(40)]
    return [(i, "\n".join(rnd.choice(lines) for _ in range(12))) for i in range(300)]


def test_scores_against_plain_counts(spark):
    """Exact counts, pairs seen once included: the filter's scores are near theirs."""
    rnd = random.Random(8)
    known = [(i, " ".join(f"w{min(int(rnd.paretovariate(0.6)), 4000)}" for _ in range(150)))
             for i in range(400)]
    train = [tokens(t) for i, t in known if not held(i)]
    single = Counter(w for t in train for w in t)
    pair = Counter(p for t in train for p in zip([None, *t], t))
    assert sum(c == 1 for c in pair.values()) > len(pair) / 2
    n, v = sum(single.values()), len(single)
    off = []
    for r in lm.lm_scores(cases.documents(spark, known)).collect():
        t = tokens(dict(known)[r.doc_id])
        want = 0
        for a, b in zip([None, *t], t):
            c = len(train) if a is None else single[a]
            want += math.log10(lm.PAIR_WEIGHT * (min(pair[a, b] / c, 1) if c else 0)
                               + (1 - lm.PAIR_WEIGHT) * (single[b] + 1) / (n + v + 1))
        off.append((r.score - want) / len(t))
    assert max(map(abs, off)) < 0.1 and abs(np.mean(off)) < 0.03


def test_segments_give_the_same_scores(spark):
    docs = cases.documents(spark, prose() + cases.TEXTS)
    rows = [sorted(map(repr, lm.lm_scores(docs, **bound).collect()))
            for bound in ({}, {"max_bits": 0}, {"exact_words": 0})]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 300 + len(cases.TEXTS)


def test_many_segments(spark, monkeypatch):
    docs = cases.documents(spark, prose())
    want = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 256)
    monkeypatch.setattr(lm, "ASKED", 500)
    rows = lm.lm_scores(docs, max_bits=0).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert math.isclose(r.base_score, want[r.doc_id].base_score)
        assert r.n_known == want[r.doc_id].n_known
        assert abs(r.score - want[r.doc_id].score) < 0.1 * r.n_tokens


def test_pairs_help(spark):
    rows = [r for r in lm.lm_scores(cases.documents(spark, prose())).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_packed_hashes_and_counts():
    rnd = np.random.default_rng(3)
    for h in (np.sort(rnd.integers(0, 1 << 64, 500, np.uint64)), np.array([5], np.uint64),
              np.array([0, 1, (1 << 64) - 1], np.uint64), np.arange(9, dtype=np.uint64)):
        assert (lm._unrun(*lm._run(h)) == h).all()
    for x in ([], [0], [1, 255], [256, 3], [1 << 16, 0, 7], [1 << 40, 2]):
        x = np.array(x, np.int64)
        assert lm._unslim(lm._slim(x), len(x)).tolist() == x.tolist()


def test_work_beyond_the_broadcast(spark):
    """N-grams travel packed, some rows for each chunk, and what is stored stays below the texts;
    before, each was a row of its own and each token was stored as a hash."""
    rows, folder = prose(), Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    lm.lm_scores(cases.documents(spark, rows), max_bits=0).collect()
    new = [f for d in set(folder.iterdir()) - before for f in d.rglob("*.parquet")]
    assert new and sum(f.stat().st_size for f in new) < sum(len(t) for _, t in rows) / 2
    docs = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "held_out": held(i)}
                                       for i, t in rows])
    words, data = Counter(), pa.BufferOutputStream()
    with pa.ipc.new_stream(data, docs.schema) as out:
        out.write_batch(docs)
    (got,) = lm._ask(2)([pa.RecordBatch.from_pylist([{"chunk": 7,
                                                      "data": data.getvalue().to_pybytes()}])])
    assert got.num_rows == 4
    for r in got.to_pylist():
        h = lm._unrun(r["first"], r["width"], r["data"])
        words.update(dict(zip(h.tolist(), lm._unslim(r["times"], len(h)).tolist())))
    train = [t for t in (tokens(t) for i, t in rows if not held(i))]
    single, pair = Counter(w for t in train for w in t), Counter(
        p for t in train for p in zip([None, *t], t))
    assert sorted(c for c in words.values() if c) == sorted([*single.values(), *pair.values()])

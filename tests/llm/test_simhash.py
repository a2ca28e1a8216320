"""Fingerprints, links and components against brute force."""

import random

import pytest
import xxhash

from wardframe.llm import simhash
from wardframe.llm.components import components

from . import cases


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or \
        ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(rows, same):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if same(rows[i], rows[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_edges(spark):
    got = simhash.near_duplicates(cases.documents(spark)).collect()
    assert cases.ids(got) == cases.ALL_IDS
    fps = [slow_fingerprint(t) for _, t in cases.TEXTS]
    assert sorted(r.fingerprint for r in got) == sorted(f"{f:016x}" for f in fps)
    group = slow_components(fps, near)
    low = {}
    for (i, _), g in zip(cases.TEXTS, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    want = {f"{f:016x}": low.get(g) for f, g in zip(fps, group)}
    assert {r.fingerprint: r.component_id for r in got} == want
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("gather", [1 << 14, 2])
def test_links_lose_nothing(spark, gather, monkeypatch):
    monkeypatch.setattr(simhash, "GATHER", gather)
    rnd = random.Random(gather)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(centres) | {0, 7, (1 << 64) - 1}
    for _ in range(150):
        f = rnd.choice(centres)
        for _ in range(rnd.randint(0, 6)):
            f ^= 1 << rnd.choice(range(64))
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
    assert all(near(a, b) for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    want, got = slow_components(fps, near), slow_components(
        fps, lambda a, b: frozenset((a, b)) in linked)
    assert len(set(want)) == len(set(got)) and len(set(zip(want, got))) == len(set(want))


def test_one_bucket_is_not_all_pairs():
    import numpy as np
    fps = np.arange(8, dtype=np.uint64)
    assert len(simhash.forest(fps, fps[:0])) == 7


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (70, 100), (9, 9)]
    got = {r.node: r.root for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 70: 50}


def test_one_of_each(spark):
    docs = cases.documents(spark)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    texts = [t or "" for _, t in cases.TEXTS]
    kinds = {tuple(t.split()) for t in texts}
    assert len(rows) == len(kinds)
    assert sum(r.doc_id == 1 for r in rows) == 1 and all(r.doc_id != 3 for r in rows)
    assert simhash.one_of_each(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("gather", [1 << 14, 2])
def test_near_copies_meet(spark, gather, monkeypatch):
    """One document of each group stays, by the fingerprints' distances alone."""
    monkeypatch.setattr(simhash, "GATHER", gather)
    rnd, texts = random.Random(8), []
    for g in range(30):
        base = cases.prose(g, rnd.randint(300, 900)).split()
        for _ in range(4):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"new{rnd.randint(0, 999)}"
            texts.append((len(texts), " ".join(words)))
    rnd.shuffle(texts)
    kept = {r.doc_id for r in simhash.one_of_each(cases.documents(spark, texts)).collect()}
    group, low = slow_components([slow_fingerprint(t) for _, t in texts], near), {}
    for (i, _), g in zip(texts, group):
        low[g] = min(low.get(g, i), i)
    assert kept == set(low.values()) and 30 <= len(kept) < 110

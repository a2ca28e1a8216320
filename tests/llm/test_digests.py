"""Quartile bucket digests: neighbours, edits, bounds."""

import hashlib
import math
import random

import pytest

from wardframe.llm import digests

from . import cases


def slow_digest(data):
    """The digest as its definition reads, a byte at a time."""
    mix = digests._MIX.tolist()
    counts = [0] * 256
    for at in range(len(data)):
        for n, (a, b, c) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 4))):
            if at + c < len(data):
                h = mix[0][data[at + a]] + mix[1][data[at + b]] * (2 * n + 3) & 0xFFFFFFFF
                counts[((h ^ mix[2][data[at + c]]) * 0x85EBCA6B & 0xFFFFFFFF) >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    out = [min(255, math.floor(math.log2(len(data) + 1) * 8)),
           15 * q[0] // q[2] * 16 + 15 * q[1] // q[2] if q[2] else 0]
    for at in range(0, 256, 4):
        out.append(int("".join(str(sum(c > x for x in q)) for c in counts[at:at + 4]), 4))
    return bytes(out)


def slow_likeness(x, y):
    def steps(v):
        return [v[2 + k // 4] // 4 ** (3 - k % 4) % 4 for k in range(256)]

    diff = sum((0, 1, 2, 6)[abs(a - b)] for a, b in zip(steps(x), steps(y)))
    diff += min(16, abs(x[0] - y[0]))
    diff += min(16, (abs(x[1] // 16 - y[1] // 16) + abs(x[1] % 16 - y[1] % 16)) // 2)
    return 1 - diff / (256 * 6 + 31)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_neighbours(spark, parts):
    texts = [(i * 3, cases.prose(i, i * 5)) for i in range(30)] + [(1, None), (2, ""), (4, "é" * 7)]
    docs = cases.documents(spark, texts).repartition(parts)
    rows = {r.doc_id: r for r in digests.fingerprints(docs).collect()}
    order = sorted((i, t or "") for i, t in texts)[::-1]
    assert len(rows) == len(texts)
    for n, (i, t) in enumerate(order):
        other = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + other[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine, theirs = slow_digest(t.encode()), slow_digest(other.encode())
        assert rows[i].n_chars == len(t) and rows[i].fingerprint == mine.hex()
        own = slow_digest(edited.encode())
        assert rows[i].edited_fingerprint == own.hex()
        assert rows[i].near_edited == slow_likeness(mine, own)
        assert rows[i].near_next == slow_likeness(mine, theirs)


def test_edges(spark):
    rows = digests.fingerprints(cases.documents(spark)).collect()
    assert cases.ids(rows) == cases.ALL_IDS
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = digests.fingerprints(cases.documents(spark, [(1, "alone here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert digests.fingerprints(cases.empty(spark)).count() == 0


def test_equal_ids_follow_by_hash(spark):
    texts = [(5, cases.prose(i, 40)) for i in range(12)] + [(6, "first"), (4, "last")]
    docs = cases.documents(spark, texts)
    mark = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    line = sorted(texts, key=lambda r: (-r[0], -mark[r[1]]))
    want = {slow_digest(a.encode()).hex(): slow_likeness(slow_digest(a.encode()),
                                                         slow_digest(b.encode()))
            for (_, a), (_, b) in zip(line, line[1:] + line[:1])}
    got = digests.fingerprints(docs).collect()
    assert {r.fingerprint: r.near_next for r in got} == want


def test_likeness():
    rnd = random.Random(3)
    a, b = cases.prose(1, 500), cases.prose(2, 500)
    few = " ".join(w if rnd.random() > .05 else "zqx" for w in a.split())
    da, db, df = (digests.digest(x.encode()) for x in (a, b, few))
    assert digests.likeness(da, da) == 1
    assert digests.likeness(da, df) > digests.likeness(da, db)
    assert digests.likeness(da, db) == digests.likeness(db, da)
    assert len({len(digests.digest(x)) for x in (b"", b"a", b"abcde" * 9)}) == 1
    low, high = bytes(66), bytes([255, 255]) + b"\xff" * 64
    assert digests.likeness(low, high) == 0

"""Repeat removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from wardframe.llm import repeats, suffix

WIDTH = 40


def brute(rows, width, keep):
    """The definition, byte by byte; rows alike in id and text are one place under "first"."""
    order = sorted(set((-1 if i is None else i, t or "") for i, t in rows))
    seen, times = {}, {}
    for i, t in order:
        b = t.encode()
        for p in range(len(b) - width + 1):
            seen.setdefault(b[p:p + width], (i, t, p))
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            times[b[p:p + width]] = times.get(b[p:p + width], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            first = seen[w] == (-1 if i is None else i, t or "", p)
            if times[w] > 1 if keep == "none" else not first:
                gone[p:p + width] = [True] * width
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (q == 0 or not gone[q - 1]) for q, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), spans,
                    hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(spark, rows, keep):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows],
                               "doc_id long, text string, m int, spans string")
    got = repeats.remove_repeats(df, WIDTH, keep).collect()
    whole = {hashlib.sha256(r.text.encode()).hexdigest(): r.kept_sha256 for r in got}
    assert sum(a == b for a, b in whole.items()) > 0.5 * len(whole)  # no cut inside characters
    got = [r[:5] for r in got]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)

    def word():
        return "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))

    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    out = [(i, " ".join(rnd.choice(passages)[rnd.randint(0, 30):] if rnd.random() < .3 else word()
                        for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    return out + [(7, out[7][1]), (8, out[7][1]), (None, out[9][1]), (100, None), (101, ""),
                  (102, "a" * 500), (103, out[3][1]), (104, "ab" * 100)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("gather", [8192, 3])
def test_brute_force(spark, rows, keep, gather, monkeypatch):
    monkeypatch.setattr(repeats, "GATHER", gather)
    assert found(spark, rows, keep) == brute(rows, WIDTH, keep)


def test_empty_and_stretches(spark, rows, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0
    monkeypatch.setattr(repeats, "STRETCH", 50)
    roller = repeats.Roller(16)
    for _, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        starts, n, _, _ = repeats.split_pieces(data, WIDTH, roller)
        assert n.sum() == max(0, len(data) - WIDTH + 1)
        assert (starts == np.cumsum(n) - n).all()


def test_previous_factor():
    rnd = random.Random(3)
    for _ in range(40):
        d = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(5, 120)))
        starts = sorted(rnd.sample(range(len(d)), rnd.randint(1, len(d))))

        def match(i, j):
            k = 0
            while k < 40 and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                k += 1
            return k

        earlier, later = suffix.previous_factor(np.frombuffer(d, np.uint8), starts, 40)
        assert earlier.tolist() == [max([match(i, j) for j in starts if j < i], default=0)
                                    for i in starts]
        assert later.tolist() == [max([match(i, j) for j in starts if j > i], default=0)
                                  for i in starts]

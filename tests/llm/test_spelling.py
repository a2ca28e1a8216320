"""Spelling variants: acceptors, pairs and whole results against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from wardframe.llm import spelling

from . import cases


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def strings(rnd, size, letters, times):
    return sorted({"".join(rnd.choice(letters) for _ in range(size)) for _ in range(times)})


def test_pairs_come_once():
    rnd = random.Random(1)
    for _ in range(300):
        size = rnd.randint(0, 6)
        short = strings(rnd, size, "abé", rnd.randint(1, 40))
        long = strings(rnd, size + 1, "abé", rnd.randint(0, 40))
        replaced, inserted = spelling.one_edit_pairs(short, long)
        got = [frozenset((short[i], short[j])) for i, j in replaced]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((a, b)) for a in short for b in short if one_edit(a, b)}
        got = [(short[i], long[j]) for i, j in inserted]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in short for b in long if one_edit(a, b)}
    assert spelling.one_edit_pairs([], ["a"]) == ([], [])


def test_acceptor_is_minimal():
    machine = spelling.Acceptor()
    words = sorted(a + b + c for a in "xyz" for b in "pqr" for c in "st")
    start = machine.add(words)
    assert len(machine.states) == 4 and machine.accepted[start] == len(words)
    for n, w in enumerate(words):
        state, place = start, 0
        for c in w:
            state, before = machine.states[state][c]
            place += before
        assert (state, place) == (0, n)
    longer = "a" * 20_000
    assert spelling.one_edit_pairs([longer], [longer + "a"]) == ([], [(0, 0)])


def slow(rows, slip=97):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in count if one_edit(v, w)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 2 * count[w]:
            form[w] = best
    out = []
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, count[w], len(near[w]), count.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def rows():
    rnd = random.Random(7)
    words = strings(rnd, 6, "abÉ", 150) + strings(rnd, 5, "aÿb", 60) + ["aaaaa", "aaaaaa", "a" * 7]
    out = []
    for i in range(300):
        picked = [words[int(rnd.random() ** 3 * len(words))] for _ in range(rnd.randint(0, 60))]
        out.append((i, rnd.choice((" ", "-", "9", "日")).join(
            w.upper() if rnd.random() < .1 else w for w in picked)))
    out += [(None, " ".join(words[:40]))] * 4 + [(7, out[7][1])] * 30 + [(500, None), (501, "")]
    return out + [(502, ("z" * 3000 + " ") * 3 + ("z" * 2999 + " ") * 8)]


@pytest.mark.parametrize("gather,listed", [(16384, 1 << 20), (3, 5)])
def test_brute_force(spark, gather, listed, monkeypatch):
    monkeypatch.setattr(spelling, "GATHER", gather)
    monkeypatch.setattr(spelling, "LISTED", listed)
    monkeypatch.setattr(spelling, "FLUSH", 50 if gather == 3 else 400_000)
    texts = rows()
    got = spelling.spelling_variants(cases.documents(spark, texts)).collect()
    want = slow(texts)
    assert sorted(tuple(r) for r in got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(r[4] > 5 for r in want)


def test_edges(spark):
    got = spelling.spelling_variants(cases.documents(spark)).collect()
    assert sorted(tuple(r) for r in got) == slow(cases.TEXTS)
    assert spelling.spelling_variants(cases.empty(spark)).count() == 0
    none = spelling.spelling_variants(cases.documents(spark, rows()), slip=None).collect()
    assert {r.word for r in none} >= {"a" * 7} and sum(r.n for r in none) > 1000

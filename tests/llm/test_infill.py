"""Fill-in-the-middle: ranks, round trips, forms."""

import hashlib
import random
import re

import pytest

from wardframe.llm import infill

from . import cases

UNITS = [None, r"\w+", r"[^\n]*\n", "[aeiou]+", "Z"]


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_ranks(unit, stretch, monkeypatch):
    monkeypatch.setattr(infill, "STRETCH", stretch)
    monkeypatch.setattr(infill, "FAN", 3)
    rnd = random.Random(4)
    for size in (0, 1, 2, 5, 40, 900):
        text = "".join(rnd.choice("ab eé\n𝄞日") for _ in range(size))
        starts = [m.start() for m in re.finditer(unit, text) if m.end() > m.start()] if unit \
            else list(range(size))
        if text and starts:
            starts[0] = 0
        elif text:
            starts = [0]
        listed = infill.SkipList(text, unit)
        assert listed.units == len(starts)
        assert [listed.place(k) for k in range(len(starts) + 1)] == starts + [len(text)]
        for bad in (-1, len(starts) + 1):
            with pytest.raises(IndexError):
                listed.place(bad)


def test_lanes_skip():
    listed = infill.SkipList("x" * 300_000)
    assert len(listed.lanes) >= 2
    for units, points, _ in listed.lanes:
        assert units == points and sum(units) <= 300_000
    assert sum(len(lane[0]) for lane in listed.lanes) < 300_000 / 32
    assert listed.place(299_999) == 299_999


def test_sentinels_in_pieces():
    rnd = random.Random(9)
    for i in range(3000):
        text = "".join(rnd.choice("<<PSM>>x") for _ in range(rnd.randint(0, 12)))
        n, form, a, b, output = infill.infill(i, text, plain=0, spm=50)
        assert infill.restore(output, form) == text and n == len(text)
        if any(s in text for s in ("<P>", "<S>", "<M>")) or not text:
            assert form == "plain" and output == text and a is None


def slow(doc_id, text):
    text = text or ""
    n, d = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if not text or any(f"<{x}>" in text for x in "PSM") or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_documents(spark):
    texts = cases.TEXTS + [(100 + i, cases.prose(i, i % 9)) for i in range(200)] + \
        [(20, "a<P>b"), (21, "<S>"), (22, "\0퟿<M"), (23, "<M><")]
    docs = cases.documents(spark, texts)
    whole = infill.fill_in_middle(docs)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted((tuple(r) for r in whole.collect()), key=key)
    want = sorted((slow(i, t) for i, t in texts), key=key)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    made = {(r[0], hashlib.sha256(r[5].encode()).hexdigest()) for r in want}
    rows = infill.digests(whole).collect()
    assert len(rows) == len(texts) and {(r.doc_id, r.output_sha256) for r in rows} == made
    assert sorted(r.restored_sha256 for r in rows) == sorted(
        hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)
    assert infill.digests(infill.fill_in_middle(cases.empty(spark))).count() == 0


def test_whole_rows_and_words(spark):
    docs = cases.documents(spark)
    got = infill.transformed(docs, unit=r"\S+\s*", plain=0)
    assert got.columns == docs.columns and got.count() == len(cases.TEXTS)
    rows = {r.doc_id: r.text for r in got.collect()}
    assert rows[5] is None and rows[4] == "" and rows[1].count("<M>") == 1
    for i in (1, 8):
        form = "spm" if rows[i].startswith("<S>") else "psm"
        assert infill.restore(rows[i], form) == dict(cases.TEXTS)[i]

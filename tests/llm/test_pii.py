"""Personal data: fixed patterns against plain regular expressions, the tagger on held-out texts."""

import hashlib
import random
import re

import numpy as np

from wardframe.llm import pii

from . import cases

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans():
    rnd = random.Random(2)
    parts = ["a@b.c", "@", "x.y@", "1.2.3.4", "300.1.1.1", "007", ".", "+1 (743) 555-3824", "+", "-",
             "4111 1111-1111 1111", "é", " ", "  ", "12", "%", "a@b", "5", "..", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000):
        pii.base_spans(text)


def test_viterbi():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        scores, moves = rnd.normal(size=(2, 4, 3)), rnd.normal(size=(3, 3))
        for chain, path in zip(scores, pii.viterbi(scores, moves)):
            best = max(np.ndindex(3, 3, 3, 3), key=lambda p: sum(
                chain[t, x] for t, x in enumerate(p)) + moves[0, p[0]] + moves[p[-1], 0]
                + sum(moves[a, b] for a, b in zip(p, p[1:])))
            assert tuple(path) == best


def test_held_out_texts():
    field = pii.trained(tuple(pii.EXAMPLES))
    rnd = random.Random(9)

    def digits(shape):
        return "".join(rnd.choice("123456789") if c == "9" else c for c in shape)

    right = total = wrong = 0
    for _ in range(300):
        kind, shape = rnd.choice([("phone", "(999) 999-9999"), ("phone", "999-999-9999"),
                                  ("ssn", "999-99-9999"), ("phone", "999.999.9999")])
        value = digits(shape)
        clean = f"in {digits('1999')} some {digits('99')} of {digits('999')} at {digits('9.9')}"
        text = f"{clean} write {value} and so on, {clean}"
        ((_, spans),) = pii.find([text.encode()], field)
        found = [(k, text[a:b]) for k, a, b in spans]
        right += (kind, value) in found
        wrong += len([f for f in found if f != (kind, value)])
        total += 1
    assert right >= 0.95 * total and wrong <= 0.02 * total


def test_long_stretches_are_not_cut(monkeypatch):
    """A span across the border of two blocks is found whole; blocks change nothing."""
    field = pii.trained(tuple(pii.EXAMPLES))
    rnd = random.Random(3)
    words = [rnd.choice(["12", "(743) 555-3824", "7", "310-555-4510", "4.5", "(661)", "078-05-1120",
                         "1999", "20", "5)"]) for _ in range(1500)]
    text = " ".join(words).encode()
    want = pii.find([text], field)
    assert want[0][1]
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(pii, "BLOCK", block)
        assert pii.find([text], field) == want


def test_spans_that_reach_beyond_a_pattern_stay():
    field = pii.trained(tuple(pii.EXAMPLES))
    ((base, spans),) = pii.find([b"listens on 10.20.30.40:8080 today"], field)
    assert base == [("ip", 11, 22)] and set(base) <= set(spans)
    assert ("ip", 11, 27) in spans
    assert pii.masked("listens on 10.20.30.40:8080 today", spans) == "listens on [IP] today"
    ((base, spans),) = pii.find([b"write to a.b@c.org now"], field)
    assert spans == base  # held whole by the pattern's


def test_table(spark):
    texts = cases.TEXTS + [(50, "é mail a.b@c.org, card 4111 1111 1111 1111 ip 10.0.0.1 "
                                "call +1 (743) 555-3824 or (310) 555-4510")]
    docs = cases.documents(spark, texts)
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, t in texts:
        if i is None or i == 2:
            continue
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert (rows[50].n_email, rows[50].n_ip, rows[50].n_card, rows[50].n_phone) == (1, 1, 1, 1)
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id != 2}
    assert got[50] == "é mail [EMAIL], card [CARD] ip [IP] call [PHONE] or [PHONE]"
    assert got[5] is None and got[1] == dict(texts)[1]
    assert pii.redacted(cases.empty(spark)).count() == 0
    assert pii.personal_data(cases.empty(spark)).count() == 0
    assert pii.personal_data(docs).count() == len(texts)

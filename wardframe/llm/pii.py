"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

A word's shape replaces its letters, digits and white space by their class. The field's labels
are outside, first word and further word of each kind; its features are shapes of a word and of
its neighbours. It is trained on the labelled table beside this module and decoded by Viterbi in
numpy batches. A span's words all hold a digit or an @; other words are outside by construction,
which cuts the chain there without changing its best path, so only the short stretches between
them are decoded. Spans that the field finds are added unless a pattern's span holds them whole;
redaction joins spans that overlap.
"""

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, raw, small_batches, texts, unpacked
from .pii_examples import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
ADDED = ("email", "ip", "phone", "ssn")
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text):
    """Leftmost matches: from every @ back to the end of its run of local characters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text):
    """(kind, start, end) of the fixed patterns, leftmost and without overlap within a kind."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- word shapes ----------------------------------------------------------------------------

_CLASS = bytearray(range(256))
for _c in range(256):
    if _c >= 0x80 or 97 <= _c <= 122:
        _CLASS[_c] = ord("a")
    elif 65 <= _c <= 90:
        _CLASS[_c] = ord("A")
    elif 48 <= _c <= 57:
        _CLASS[_c] = ord("9")
_CLASS = bytes(_CLASS)
_CONTINUED = bytes(range(0x80, 0xC0))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[57, 64]] = True
_RUN = re.compile(rb"(.)\1+", re.S)


def shape_features(shape):
    """Feature names of one shape; the empty shape stands for a missing word."""
    if not shape:
        return ("none",)
    core = shape.strip(b".,;:!?\"'<>[]{}")
    digits = core.count(b"9")
    short = _RUN.sub(rb"\1", core)
    full = core if len(core) <= 24 else short
    return ("bias", b"full " + full, b"short " + short, b"digits %d" % min(digits, 12),
            b"head " + core[:2], b"tail " + core[-2:],
            b"kinds " + bytes(sorted(set(core)))[:8],
            b"letters" if b"a" in core or b"A" in core else b"plain")


def _mark(line):
    """(shapes, labels) of one labelled text."""
    plain, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
        plain += line[at:m.start()]
        spans.append((len(plain), len(plain) + len(m[2]), m[1]))
        plain, at = plain + m[2], m.end()
    plain += line[at:]
    shapes, labels = [], []
    for m in re.finditer(r"\S+", plain):
        label = "O"
        for a, b, kind in spans:
            if m.start() < b and a < m.end():
                label = ("B-" if m.start() <= a else "I-") + kind
        shapes.append(m[0].encode().translate(_CLASS, _CONTINUED))
        labels.append(LABELS.index(label))
    return shapes, labels


class Field:
    """Weights of the field; scores of a shape as a word, as the one before and the one after."""

    def __init__(self, index, weights, moves):
        self.index, self.weights, self.moves, self.seen = index, weights, moves, {}

    def scores(self, shape):
        got = self.seen.get(shape)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = np.zeros((3, len(LABELS)))
            for where in range(3):
                for f in shape_features(shape):
                    i = self.index.get((where, f))
                    if i is not None:
                        got[where] += self.weights[i]
            self.seen[shape] = got
        return got


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(examples=tuple(EXAMPLES), rounds=150, rate=0.3, shrink=0.002):
    """Fit the field by gradient steps on the log likelihood with adaptive rates."""
    index, sents = {}, []
    for line in examples:
        shapes, labels = _mark(line)
        rows = []
        for i in range(len(shapes)):
            near = (shapes[i], shapes[i - 1] if i else b"",
                    shapes[i + 1] if i + 1 < len(shapes) else b"")
            rows.append([index.setdefault((w, f), len(index))
                         for w in range(3) for f in shape_features(near[w])])
        free = np.array([bool(_MARKS[np.frombuffer(s, np.uint8)].any()) for s in shapes])
        sents.append((rows, np.array(labels), free))
    k = len(LABELS)
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    pace_w, pace_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    for _ in range(rounds):
        grad, turn = -shrink * weights, -shrink * moves
        for rows, labels, free in sents:
            e = np.array([weights[r].sum(0) for r in rows])
            e[~free, 1:] = -1e9
            n = len(rows)
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = e[0] + moves[0]
            for t in range(1, n):
                fwd[t] = e[t] + _logsum(fwd[t - 1][:, None] + moves, 0)
            for t in range(n - 2, -1, -1):
                bwd[t] = _logsum(moves + (e[t + 1] + bwd[t + 1])[None, :], 1)
            total = _logsum(fwd[-1], 0)
            p = np.exp(fwd + bwd - total)
            diff = -p
            diff[np.arange(n), labels] += 1
            for t in range(n):
                np.add.at(grad, rows[t], diff[t])
            turn[0] += diff[0]
            for t in range(1, n):
                pair = np.exp(fwd[t - 1][:, None] + moves + (e[t] + bwd[t])[None, :] - total)
                turn -= pair
                turn[labels[t - 1], labels[t]] += 1
        pace_w += grad ** 2
        pace_m += turn ** 2
        weights += rate * grad / np.sqrt(pace_w)
        moves += rate * turn / np.sqrt(pace_m)
    return Field(index, weights, moves)


@functools.lru_cache(maxsize=4)
def trained(examples):
    return train(examples)


def viterbi(scores, moves):
    """Best labels of chains of one length: scores (chains, words, labels), from and to outside."""
    return decode([scores], moves)


def decode(blocks, moves):
    """As `viterbi`, with the chains' scores in blocks of words: of a word, only its best
    predecessors are kept, a byte each."""
    best, back = None, []
    for scores in blocks:
        came = np.zeros(scores.shape, np.uint8)
        for t in range(scores.shape[1]):
            if best is None:
                best = scores[:, 0] + moves[0]
                continue
            step = best[:, :, None] + moves[None]
            came[:, t] = step.argmax(1)
            best = step.max(1) + scores[:, t]
        back.append(came)
    back = np.concatenate(back, 1)
    n, length, _ = back.shape
    out = np.zeros((n, length), np.uint8)
    out[:, -1] = (best + moves[:, 0]).argmax(1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


#: Words of a stretch whose scores are held at once.
BLOCK = 4096


def _chains(shape, field):
    """Starts and ends of all words; of each stretch of words that hold a digit or an @, their
    numbers and a function that gives their label scores in blocks."""
    flat = np.frombuffer(shape, np.uint8)
    gap = np.concatenate([[True], _BLANK[flat], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    marked = np.unique(np.searchsorted(starts, np.flatnonzero(_MARKS[flat]), "right") - 1)
    stretches = np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1)
    word = lambda i: shape[starts[i]:ends[i]] if 0 <= i < len(starts) else b""

    def blocks(run):
        for at in range(0, len(run), BLOCK):
            yield np.array([field.scores(word(i))[0] + field.scores(word(i - 1))[1]
                            + field.scores(word(i + 1))[2] for i in run[at:at + BLOCK].tolist()])
    return starts, ends, [(run, blocks) for run in stretches if len(run)]


_TRIM_LEFT, _TRIM_RIGHT = b"\"'<[{,;:", b".,;:!?\"'>]}"


def added_spans(shapes, field):
    """For each shape text: (kind, start, end) of the field's spans."""
    found = [[] for _ in shapes]
    by_length, places, whole = {}, [], []
    for i, shape in enumerate(shapes):
        if b"9" in shape or b"@" in shape:
            starts, ends, chains = _chains(shape, field)
            places.append((i, shape, starts, ends))
            for run, blocks in chains:
                if len(run) > BLOCK:
                    path = decode((b[None] for b in blocks(run)), field.moves)
                    whole.append(([(len(places) - 1, run)], path))
                else:
                    by_length.setdefault(len(run), []).append(
                        (len(places) - 1, run, next(blocks(run))))
    for chains in by_length.values():
        whole.append(([c[:2] for c in chains],
                      viterbi(np.stack([c[2] for c in chains]), field.moves)))
    for chains, labels in whole:
        for (p, run), path in zip(chains, labels.tolist()):
            if not any(path):
                continue
            i, shape, starts, ends = places[p]
            spans = []
            for w, label in zip(run.tolist(), path):
                if not label:
                    continue
                name = LABELS[label]
                a, b = int(starts[w]), int(ends[w])
                if name[0] == "I" and spans and spans[-1][0] == name[2:] and spans[-1][3] == w - 1:
                    spans[-1][2:] = [b, w]
                else:
                    spans.append([name[2:], a, b, w])
            for kind, a, b, _ in spans:
                while a < b and shape[a] in _TRIM_LEFT:
                    a += 1
                while b > a and shape[b - 1] in _TRIM_RIGHT:
                    b -= 1
                if a < b:
                    found[i].append((kind, a, b))
    return [sorted(x, key=lambda s: s[1]) for x in found]


def _listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(blobs, field):
    """(base spans, all spans) of every text, given as UTF-8 bytes."""
    shapes = [b.translate(_CLASS, _CONTINUED) for b in blobs]
    out = []
    order = {k: i for i, k in enumerate((*KINDS, "ssn"))}
    for blob, shape, extra in zip(blobs, shapes, added_spans(shapes, field)):
        base = base_spans(blob.decode()) if b"9" in shape or b"@" in shape else []
        new = []
        if extra:
            taken = [(a, b) for _, a, b in base]
            for s in extra:
                if not any(a <= s[1] and s[2] <= b for a, b in taken):
                    new.append(s)
        out.append((base, sorted(base + new, key=lambda s: (order[s[0]], s[1]))))
    return out


def _scan(examples, redact):
    field = trained(examples)  # once, on the driver; a few thousand weights go to the tasks

    def run(batches):
        for batch in small_batches(batches):
            data, ends = raw(batch.column("text"))
            data = data.tobytes()
            blobs = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            found = find(blobs, field)
            keep = [i for i, k in enumerate(batch.schema.names) if k != "text"]
            columns = [batch.column(i) for i in keep]
            names = [batch.schema.names[i] for i in keep]
            if redact:
                columns.append(pa.array([masked(b.decode(), s) if s else b.decode()
                                         for b, (_, s) in zip(blobs, found)], pa.string()))
                names.append("text")
            else:
                for kind in KINDS:
                    columns.append(pa.array([sum(s[0] == kind for s in base)
                                             for base, _ in found], pa.int64()))
                    names.append(f"n_{kind}")
                columns.append(pa.array([hashlib.sha256(_listed(base).encode()).hexdigest()
                                         for base, _ in found], pa.string()))
                columns.append(pa.array([_listed(s) for _, s in found], pa.string()))
                names += ["base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def masked(text, spans):
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs, examples=tuple(EXAMPLES)):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    The counts and base_sha256 are of the fixed patterns alone; spans has them all and the
    field's as kind:start:end in code points, the field's unless one of the patterns' holds it
    whole. Null texts are empty; repeated rows come out
    repeated, empty tables give no rows, other columns are not read.
    """
    return texts(docs).mapInArrow(
        _scan(examples, False), "doc_id long, n_email long, n_ip long, n_card long, "
                                "n_phone long, base_sha256 string, spans string")


def redacted(docs, examples=tuple(EXAMPLES)):
    """All rows and columns of docs, with the spans of text replaced by their kinds; a null text
    stays null."""
    rows = packed(docs).drop("doc_id")
    got = rows.mapInArrow(_scan(examples, True),
                          StructType([rows.schema["row"], rows.schema["text"]]))
    return unpacked(got, text=F.when(F.col("row.text").isNotNull(), F.col("text")))

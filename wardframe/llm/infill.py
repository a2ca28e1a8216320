"""Fill-in-the-middle texts, cut by an indexable skip list.

A text's units (single code points, or the matches of a pattern with what follows them) are the
nodes of a skip list; the bottom lane is the text itself. Every node stands in lane k with a
chance of one in `FAN` ** k, drawn from a hash of its rank, so that a repeated task builds the same
list. A link of an express lane carries how many units and how many code points it skips. A
rank is found by descending: as long as the units skipped so far do not pass the rank, links are
followed and both widths added up; then the walk goes on one lane below, and at last from
unit to unit in the text.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, small_batches, texts, unpacked

#: Sentinels of prefix, suffix and middle; fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, so many stay as they are; of a hundred others, so many begin with the suffix.
PLAIN, SPM = 10, 20
SEED = "1"
FAN = 64
#: Units of a text whose links are made at once.
STRETCH = 1 << 20

_U = np.uint64


def _lanes_of(ranks):
    """In how many express lanes the nodes of these ranks stand."""
    h = (ranks.astype(_U) + _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    lanes, below = np.zeros(len(ranks), np.int8), np.ones(len(ranks), bool)
    for lane in range(1, 11):  # 64 ** 10 is more than any text has units
        below = below & ((h >> _U(6 * (lane - 1))) % _U(FAN) == 0)
        if not below.any():
            break
        lanes[below] = lane
    return lanes


class SkipList:
    """Places of a text's units by rank. `unit` is a pattern; None takes code points.

    Units are matched left to right; what no match covers belongs to the unit before it, at the
    text's start to the first unit; a text without a match has one unit, an empty one none.
    """

    def __init__(self, text, unit=None):
        self.text, self.unit = text, re.compile(unit) if unit else None
        lanes = []  # of each lane the ranks and the places of its nodes
        self.units = 0
        for ranks, places in self._stretches():
            level = _lanes_of(ranks)
            for lane in range(1, int(level.max(initial=0)) + 1):
                if lane > len(lanes):
                    lanes.append(([], []))
                at = level >= lane
                lanes[lane - 1][0].append(ranks[at])
                lanes[lane - 1][1].append(places[at])
            self.units = int(ranks[-1]) + 1
        self.lanes, under = [], None
        for ranks, places in lanes:
            # the head, of rank 0, stands in every lane
            ranks = np.concatenate([[0], *ranks]).astype(np.int64)
            places = np.concatenate([[0], *places]).astype(np.int64)
            keep = np.concatenate([[True], ranks[1:] > 0])
            ranks, places = ranks[keep], places[keep]
            down = None if under is None else np.searchsorted(under, ranks)
            self.lanes.append((np.diff(ranks).tolist(), np.diff(places).tolist(),
                               None if down is None else down.tolist()))
            under = ranks

    def _stretches(self):
        """(ranks, places in code points) of the units, `STRETCH` at a time."""
        if self.unit is None:
            for at in range(0, len(self.text), STRETCH):
                ranks = np.arange(at, min(at + STRETCH, len(self.text)))
                yield ranks, ranks
            return
        if not self.text:
            return
        places, before = [], 0
        for place in self._starts(0):
            places.append(place)
            if len(places) == STRETCH:
                yield np.arange(before, before + STRETCH), np.array(places)
                before, places = before + STRETCH, []
        if places:
            yield np.arange(before, before + len(places)), np.array(places)

    def _starts(self, place):
        """Where units start, from the unit that starts at `place` on."""
        first = True
        for m in self.unit.finditer(self.text, place):
            if m.end() == m.start():
                continue
            yield place if first else m.start()
            first = False
        if first and place < len(self.text):
            yield place

    def place(self, rank):
        """How many code points the first `rank` units have."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        if rank == self.units:
            return len(self.text)
        units = points = node = 0
        for n in range(len(self.lanes) - 1, -1, -1):
            skipped, width, down = self.lanes[n]
            while node < len(skipped) and units + skipped[node] <= rank:
                units += skipped[node]
                points += width[node]
                node += 1
            if down is not None:
                node = down[node]
        if self.unit is None:  # a unit is a code point: the rest of the walk is a step
            return points + rank - units
        for at in self._starts(points):
            if units == rank:
                return at
            units += 1
        raise AssertionError("a rank below the number of units has a place")


def draws(doc_id, seed=SEED):
    """Four numbers of 32 bits for a document; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def infill(doc_id, text, unit=None, plain=PLAIN, spm=SPM, seed=SEED):
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    listed = SkipList(text, unit)
    n = listed.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = listed.place(a), listed.place(b)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, output = "spm", SUFFIX + tail + PREFIX + head + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + head + SUFFIX + tail + MIDDLE + middle
    return n, form, a, b - a, output


def restore(output, form):
    """The text that an output of this form was made of: no sentinel is part of it."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _infills(unit, plain, spm, seed):
    def run(batches):
        for batch in small_batches(batches, 4 << 20):
            rows = [infill(i, t, unit, plain, spm, seed) for i, t in
                    zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            keep = [i for i, k in enumerate(batch.schema.names) if k != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array(x, k) for x, k in zip(zip(*rows), _KINDS)],
                [batch.schema.names[i] for i in keep] + [f.split()[0] for f in FIELDS.split(", ")])
    return run


def infills(rows, unit=None, plain=PLAIN, spm=SPM, seed=SEED):
    """The columns of rows(doc_id, text, ...) without the text, and the five of `infill`."""
    out = StructType([f for f in rows.schema if f.name != "text"])
    for field in FIELDS.split(", "):
        out = out.add(*field.split())
    return rows.mapInArrow(_infills(unit, plain, spm, seed), out)


def _restored(batches):
    for batch in small_batches(batches, 4 << 20):
        made = [restore(o, f) for o, f in zip(batch.column("text").to_pylist(),
                                              batch.column("form").to_pylist())]
        names = [k for k in batch.schema.names if k != "text"]
        digests = [[hashlib.sha256(t.encode()).hexdigest() for t in texts]
                   for texts in (batch.column("text").to_pylist(), made)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in names] + [pa.array(x, pa.string()) for x in digests],
            names + ["output_sha256", "restored_sha256"])


def fill_in_middle(docs, **settings):
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    Two ranks drawn from the doc_id cut the text's units into prefix, middle and suffix, in the
    order psm or spm between sentinels; an empty text, one with a sentinel inside and about a
    tenth of the others stay plain, with null counts. A null text is empty and a null doc_id draws
    as an empty one. Rows alike in id and text come out alike; empty tables give no rows; other
    columns are not read.
    """
    return infills(texts(docs), **settings)


def digests(outputs):
    """The rows with the digest of the output and of the text restored from it and the form."""
    kept = [c for c in outputs.columns if c != "output"]
    rows = outputs.withColumnRenamed("output", "text")
    out = StructType([outputs.schema[c] for c in kept]).add("output_sha256", "string").add(
        "restored_sha256", "string")
    return rows.mapInArrow(_restored, out)


def transformed(docs, **settings):
    """All rows and columns of docs with the outputs as texts; null texts stay null."""
    rows = infills(packed(docs).select("row", "doc_id", "text"), **settings)
    return unpacked(rows, text=F.when(F.col("row.text").isNotNull(), F.col("output")))


#: The query's rows in SQL.
SQL = """
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
    FROM documents),
drawn AS (
    SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
           ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM docs),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>')
                     OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
made AS (
    SELECT *, substr(text, 1, a) AS head, substr(text, a + 1, b - a) AS middle,
           substr(text, b + 1) AS tail FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END)
           AS output_sha256,
       sha256(text) AS restored_sha256
FROM made
"""

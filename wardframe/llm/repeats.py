"""Exact removal of repeated byte strings by longest-previous-factor arrays.

A window of `width` bytes is repeated if the same bytes start anywhere else, in any document.
Windows are routed by their minimizer (the smallest hash of a `gram` inside the window, leftmost
on ties): equal windows have equal minimizers, so neighbouring windows with one minimizer travel
as one piece, as hashes only. A piece whose minimizer occurs once holds no repeat. Pieces with
equal bytes are counted. Only where different pieces share a minimizer are their bytes fetched,
one copy of each, and put in suffix order; the longest previous factor tells which of their
windows occur in an earlier (or later) piece. Minimizers with more than `GATHER` different pieces
are never gathered: their pieces are split into short runs of windows that are counted by hash.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keyed, packed, raw, small_batches, texts, unpacked, written
from .suffix import previous_factor

WIDTH = 400
#: Different pieces of one minimizer that one task may compare at once, about 5 MB of text.
GATHER = 8192
#: Bytes of pieces in one suffix order.
BLOCK = 2 << 20
#: Windows of a document are hashed in stretches of this many.
STRETCH = 1 << 20
SUB = 16
#: Classes of windows that are ruled out before the suffix order is built.
ANCHORS = 8

_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)


class Roller:
    """Hashes of all substrings of one length: a polynomial modulo 2**64, then mixed."""

    def __init__(self, size):
        self.size = 0
        self.grow(size)

    def grow(self, size):
        if size <= self.size:
            return
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(_ODD, -1, 1 << 64))
            self.up = np.ones(size + 1, np.uint64)
            self.up[1:] = _ODD
            self.up = np.cumprod(self.up)
            self.down = np.ones(size + 1, np.uint64)
            self.down[1:] = inverse
            self.down = np.cumprod(self.down)
        self.size = size

    def __call__(self, data, length):
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        h = (sums[length:] - sums[:len(sums) - length]) * self.down[:len(sums) - length]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def gram_of(width):
    return max(8, width * 8 // 25)


def split_pieces(data, width, roller):
    """(starts, window counts, minimizer hashes, minimizer places) of a document's pieces."""
    gram, found = gram_of(width), []
    for at in range(0, len(data) - width + 1, STRETCH):
        part = data[at:at + STRETCH + width - 1]
        h = roller(part, gram)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, have = width - gram + 1, 1
        while 2 * have <= span:
            low = np.minimum(low[:len(low) - have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[:len(low) - (span - have)], low[span - have:])
        place = (low & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        count = np.diff(np.concatenate([first, [len(place)]]))
        found.append((first + at, count, h[place[first]], place[first] - first))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64),
                np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


PIECES = "k_id long, k_hash long, start long, n int, p int, m long, c long"


def _pieces(width):
    def run(batches):
        roller = Roller(1 << 16)
        for batch in small_batches(batches):
            data, ends = raw(batch.column("text"))
            got, which = [], []
            for i in range(batch.num_rows):
                doc = data[ends[i]:ends[i + 1]]
                if len(doc) < width:
                    continue
                start, n, m, p = split_pieces(doc, width, roller)
                whole = doc.tobytes()
                c = np.fromiter((xxhash.xxh3_64_intdigest(whole[s:e]) for s, e in
                                 zip(start.tolist(), (start + n + width - 1).tolist())),
                                np.uint64, len(start))
                got.append((start, n, p, m, c))
                which.append(np.full(len(start), i))
            if not got:
                continue
            start, n, p, m, c = (np.concatenate(x) for x in zip(*got))
            which = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k_id").take(which), batch.column("k_hash").take(which),
                 pa.array(start), pa.array(n.astype(np.int32)), pa.array(p.astype(np.int32)),
                 pa.array(m.view(np.int64)), pa.array(c.view(np.int64))],
                ["k_id", "k_hash", "start", "n", "p", "m", "c"])
    return run


def _fetch(width):
    """The bytes of the wanted pieces of each document."""
    def run(batches):
        for batch in small_batches(batches):
            data, ends = raw(batch.column("text"))
            out = {"m": [], "c": [], "n": [], "p": [], "o": [], "bytes": []}
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    at = ends[i] + w["start"]
                    for k in ("m", "c", "n", "p", "o"):
                        out[k].append(w[k])
                    out["bytes"].append(data[at:at + w["n"] + width - 1].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("m", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("p", pa.int32()),
                ("o", pa.struct([("k_id", pa.int64()), ("k_hash", pa.int64()),
                                 ("start", pa.int64())])), ("bytes", pa.binary())]))
    return run


def _runs(flags, edge):
    """Maximal runs of set flags that do not cross an edge: (first, after last)."""
    grown = np.concatenate([[False], flags, [False]])
    cut = np.concatenate([[True], edge[1:], [True]])
    begin = np.flatnonzero(grown[1:-1] & (~grown[:-2] | cut[:-1]))
    end = np.flatnonzero(grown[1:-1] & (~grown[2:] | cut[1:])) + 1
    return begin, end


FLAGS = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _compare(width, keep_rule):
    """Repeated windows of the pieces, which come in order of (m, first place)."""
    span = width - gram_of(width) + 1
    step = -(-span // ANCHORS)

    def live_windows(n, p, parts):
        """For each piece, which classes of its windows may occur in another piece.

        Windows are classed by how far their minimizer lies inside; those of one class share the
        bytes from the last one's start to the first one's end.
        """
        digests, where = [], []
        for i, (count, place, part) in enumerate(zip(n, p, parts)):
            low, high = max(0, place - count + 1) // step, place // step
            for j in range(low, high + 1):
                a = place - step * j
                digests.append(xxhash.xxh3_64_intdigest(part[max(a, 0):a - step + 1 + width]))
                where.append((i, j))
        _, same, times = np.unique(np.array(digests, np.uint64), return_inverse=True,
                                   return_counts=True)
        live = np.zeros((len(n), ANCHORS + 1), bool)
        where = np.array(where).reshape(-1, 2)
        live[where[:, 0], where[:, 1]] = times[same] > 1
        return live

    def block(m, c, n, p, parts):
        live = live_windows(n, p, parts)
        keep = np.flatnonzero(live.any(1))
        data = np.frombuffer(b"".join([parts[i] for i in keep.tolist()]), np.uint8)
        n, p = np.asarray(n, np.int64)[keep], np.asarray(p, np.int64)[keep]
        base = np.cumsum(n + width - 1) - (n + width - 1)
        piece = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ask = live[keep][piece, (p[piece] - within) // step]
        piece, within = piece[ask], within[ask]
        earlier, later = previous_factor(data, base[piece] + within, width)
        flags = earlier >= width
        if keep_rule == "none":
            flags |= later >= width
        edge = np.concatenate([[True], (np.diff(piece) != 0) | (np.diff(within) != 1)])
        begin, end = _runs(flags, edge)
        which = keep[piece[begin]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(m, np.int64)[which]), pa.array(np.asarray(c, np.int64)[which]),
             pa.array(within[begin].astype(np.int32)),
             pa.array((within[end - 1] + 1).astype(np.int32))], schema=FLAGS)

    def run(batches):
        group, size, last, place = ([], [], [], [], []), 0, None, None
        for batch in batches:
            for m, c, n, p, part in zip(*(batch.column(k).to_pylist() for k in
                                          ("m", "c", "n", "p", "bytes"))):
                if (m, c) == place:  # fetched from rows alike in id and text
                    continue
                place = (m, c)
                if size > BLOCK and m != last:
                    yield block(*group)
                    group, size = ([], [], [], [], []), 0
                for to, v in zip(group, (m, c, n, p, part)):
                    to.append(v)
                size, last = size + len(part), m
        if size:
            yield block(*group)
    return run


def _short_runs(width):
    """Hot pieces as runs of `SUB` windows, aligned to the minimizer, with their hashes."""
    def run(batches):
        roller = Roller(1 << 12)
        for batch in batches:
            out = {"m": [], "c": [], "o": [], "at": [], "core": [], "windows": []}
            for m, c, p, o, part in zip(*(batch.column(k).to_pylist()
                                          for k in ("m", "c", "p", "o", "bytes"))):
                data = np.frombuffer(part, np.uint8)
                windows = roller(data, width).view(np.int64)
                for full in range(p % SUB - SUB, len(windows), SUB):
                    a, b = max(full, 0), min(full + SUB, len(windows))
                    if a >= b:
                        continue
                    out["m"].append(m)
                    out["c"].append(c)
                    out["o"].append(o)
                    out["at"].append(a)
                    out["core"].append(xxhash.xxh3_64_intdigest(part[full + SUB - 1:full + width])
                                       - (1 << 63))
                    out["windows"].append(windows[a:b].tolist())
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("m", pa.int64()), ("c", pa.int64()),
                ("o", pa.struct([("k_id", pa.int64()), ("k_hash", pa.int64()),
                                 ("start", pa.int64())])), ("at", pa.int32()),
                ("core", pa.int64()),
                ("windows", pa.list_(pa.int64()))]))
    return run


def _hot_flags(hot, width, keep):
    """Repeated windows of pieces whose minimizer has too many different ones to gather."""
    runs = written(hot.mapInArrow(
        _short_runs(width), "m long, c long, o struct<k_id: long, k_hash: long, start: long>, "
                            "at int, core long, windows array<long>"), "runs")
    # a core that occurs in one piece belongs to windows that occur once
    cores = runs.groupBy("m", "core").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    windows = runs.join(cores.filter("low <> high").select("m", "core"), ["m", "core"]).select(
        "m", "c", "o", F.posexplode("windows").alias("i", "w"), "at").select(
        "m", "c", (F.col("at") + F.col("i")).alias("a"), "w",
        F.struct("o.k_id", "o.k_hash",
                 (F.col("o.start") + F.col("at") + F.col("i")).alias("start")).alias("p"))
    seen = windows.groupBy("m", "w").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    kept = F.lit(True) if keep == "none" else F.col("p") != F.col("first")
    return windows.join(seen.filter("first <> last"), ["m", "w"]).filter(kept).select(
        "m", "c", "a", (F.col("a") + 1).alias("b"))


def _cut(as_text=False):
    """What the spans leave of each text; as text, a character that was cut into is gone."""
    def run(batches):
        for batch in small_batches(batches):
            data, ends = raw(batch.column("text"))
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                doc = data[ends[i]:ends[i + 1]]
                if spans:
                    step = np.zeros(len(doc) + 1, np.int64)
                    np.add.at(step, [s["a"] for s in spans], 1)
                    np.add.at(step, [s["b"] for s in spans], -1)
                    gone = np.cumsum(step)[:-1] > 0
                    doc = doc[~gone]
                    out["n_spans"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                else:
                    out["n_spans"].append(0)
                kept = doc.tobytes()
                out["n_bytes"].append(int(ends[i + 1] - ends[i]))
                out["n_removed"].append(int(ends[i + 1] - ends[i]) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "ignore"))
            names = [k for k in batch.schema.names if k not in ("text", "spans")]
            own = [batch.column(k) for k in names]
            if as_text:
                yield pa.RecordBatch.from_arrays(
                    own + [pa.array(out["kept"], pa.string())], names + ["text"])
                continue
            yield pa.RecordBatch.from_arrays(
                own + [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")]
                + [pa.array(out[k], pa.string()) for k in ("kept_sha256", "kept")],
                names + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
    return run


def repeated_spans(rows, width=WIDTH, keep="none"):
    """(k_id, k_hash, spans) of keyed rows with a repeat; spans may overlap, ends excluded."""
    pieces = rows.select("k_id", "k_hash", "text").mapInArrow(_pieces(width), PIECES)
    # written, as a join of two exchanged tables is one whose hot keys are split
    recurring = written(pieces.groupBy("m").agg(
        F.count("*").alias("times"), (F.min("c") != F.max("c")).alias("mixed")
    ).filter("times > 1").drop("times"), "recurring")
    shared = written(pieces.join(recurring, "m"), "pieces")
    place = F.struct("k_id", "k_hash", "start")
    variants = shared.groupBy("m", "c").agg(
        F.count("*").alias("times"), F.min(place).alias("o"), F.first("n").alias("n"),
        F.first("p").alias("p"), F.first("mixed").alias("mixed"))
    # one row of each different piece, with its bytes
    wanted = variants.filter("mixed").select(
        "o.k_id", "o.k_hash", F.struct("o.start", "m", "c", "n", "p", "o").alias("w")
    ).groupBy("k_id", "k_hash").agg(F.collect_list("w").alias("wanted"))
    parts = written(
        rows.select("k_id", "k_hash", "text").join(wanted, ["k_id", "k_hash"])
        .select("text", "wanted").mapInArrow(
            _fetch(width), "m long, c long, n int, p int, "
                           "o struct<k_id: long, k_hash: long, start: long>, bytes binary"),
        "variants")
    hot = parts.groupBy("m").agg(F.count("*").alias("d")).filter(F.col("d") > GATHER)
    flags = parts.join(hot, "m", "left_anti").repartition("m").sortWithinPartitions(
        "m", "o", "c").drop("o").mapInArrow(
        _compare(width, keep), "m long, c long, a int, b int").unionByName(
        _hot_flags(parts.join(hot, "m", "left_semi"), width, keep))
    flags = flags.groupBy("m", "c").agg(F.collect_list(F.struct("a", "b")).alias("flags"))
    verdicts = written(variants.join(flags, ["m", "c"], "left").filter(
        "times > 1 OR flags IS NOT NULL").select("m", "c", "times", "o", "flags"), "verdicts")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    if keep == "none":
        own = F.when(F.col("times") > 1, whole).otherwise(F.col("flags"))
    else:
        own = F.when(place != F.col("o"), whole).otherwise(F.col("flags"))
    return shared.drop("mixed").join(verdicts, ["m", "c"]).select(
        "k_id", "k_hash", "start", F.explode(own).alias("f")).select(
        "k_id", "k_hash", F.struct((F.col("start") + F.col("f.a")).alias("a"),
                                   (F.col("start") + F.col("f.b") + width - 1).alias("b"))
        .alias("span")).groupBy("k_id", "k_hash").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs, width=WIDTH, keep="none"):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of every document. The digest is of
    the bytes that stay; the text drops a character's rest where a cut runs through it.

    keep="none" removes every byte that a repeated window covers, in all its places;
    keep="first" leaves the first place of each window, in order of (doc_id, text hash,
    position), a null id first. Null texts are empty; a text shorter than `width` keeps all.
    Rows alike in id and text repeat each other under "none" and are one place under "first",
    so they stay alike. Empty tables give no rows. Other columns are not read.
    """
    rows = keyed(texts(docs))
    spans = repeated_spans(rows, width, keep)
    return rows.join(spans, ["k_id", "k_hash"], "left").select("doc_id", "text", "spans") \
        .mapInArrow(_cut(), "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                 "kept_sha256 string, text string")


def without_repeats(docs, width=WIDTH):
    """All rows and columns of docs, text without later places of repeated windows.

    A cut inside a character drops the character's rest. Null texts stay null.
    """
    rows = keyed(packed(docs))
    spans = repeated_spans(rows, width, "first")
    got = rows.select("row", "k_id", "k_hash", "text").join(spans, ["k_id", "k_hash"], "left") \
        .select("row", "text", "spans").mapInArrow(
            _cut(True), StructType([rows.schema["row"], rows.schema["text"]]))
    return unpacked(got, text=F.when(F.col("row.text").isNotNull(), F.col("text")))

"""SimHash fingerprints and their links by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the segments, so one of them lies in the Hamming
ball of radius one around the other's segment. Of two segments that differ in one bit, one has
this bit set and the other not: it is enough to enumerate the half of the ball with a set bit
cleared. Every probe meets the segment table in an equi join's partition and full distances are
verified there. Equal fingerprints are one row from the start. A bucket yields a forest of its
links, never all of its pairs. Buckets with more than `GATHER` fingerprints are not gathered:
there, each fingerprint is keyed by the other segment with three bits (two for a probe) masked
out, and equal keys link through their smallest member, which loses no link.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.session import ensure_checkpoint_dir
from .common import keyed, packed, raw, small_batches, texts, unpacked, written
from .components import components

DISTANCE = 3
GATHER = 16384
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(words, size=3, seed=42):
    """SimHash of the XXH64 of all word shingles; zero without words."""
    return int(_majority(_hashes(words, size, seed))) if words else 0


def _hashes(words, size, seed):
    """XXH64 of the shingles of a text with words."""
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in
                     zip(starts[:1 - size].tolist(), ends[size - 1:].tolist())], np.uint64)


def _majority(h):
    """The bits that are set in over half of the hashes, as a long."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * count > len(h)).astype(np.uint64)
    return (bits << _SHIFTS).sum(dtype=np.uint64)


def _fingerprints(size, seed):
    def run(batches):
        for batch in small_batches(batches):
            data, ends = raw(batch.column("text"))
            data = data.tobytes()
            got = [fingerprint(data[a:b].lower().split(), size, seed)
                   for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            keep = [i for i, k in enumerate(batch.schema.names) if k != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array(np.array(got, np.uint64).view(np.int64))],
                [batch.schema.names[i] for i in keep] + ["fp"])
    return run


def fingerprints(rows, size=3, seed=42):
    """The columns of rows(text, ...) without the text, and fp."""
    out = StructType([f for f in rows.schema if f.name != "text"]).add("fp", "long")
    return rows.mapInArrow(_fingerprints(size, seed), out)


def _segments(batches):
    """(seg, key, fp, probe): the exact row of each segment and half of its ball."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for seg, shift in ((0, np.uint64(0)), (1, np.uint64(32))):
            part = (fp >> shift) & np.uint64(0xFFFFFFFF)
            which, keys, probe = [np.arange(len(fp))], [part], [np.zeros(len(fp), bool)]
            for bit in range(32):
                has = np.flatnonzero((part >> np.uint64(bit)) & np.uint64(1))
                which.append(has)
                keys.append(part[has] ^ np.uint64(1 << bit))
                probe.append(np.ones(len(has), bool))
            which = np.concatenate(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64) | (seg << 32)),
                 pa.array(fp[which].view(np.int64)), pa.array(np.concatenate(probe))],
                ["key", "fp", "probe"])


def forest(exact, probes):
    """Edges that connect what links of at most three bits connect: exact-exact, exact-probe.

    Grows one tree at a time: the distances of a whole front to the rest are one numpy block.
    """
    values = np.concatenate([exact, probes])
    is_exact = np.arange(len(values)) < len(exact)
    rest = np.arange(len(values))
    edges = []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for i in front:
                d = np.bitwise_count(values[rest] ^ values[i]) <= DISTANCE
                if not is_exact[i]:
                    d &= is_exact[rest]
                if d.any():
                    got = rest[d]
                    edges.extend((values[i], values[j]) for j in got)
                    reached.append(got)
                    rest = rest[~d]
                    if not len(rest):
                        break
            front = np.concatenate(reached) if reached else rest[:0]
    return edges


def _links(batches):
    """Edges of every bucket; rows come sorted by (key, probe)."""
    def bucket(fps, probe):
        fps, probe = np.concatenate(fps), np.concatenate(probe)
        cut = int((~probe).sum())
        if not cut:
            return []
        return forest(fps[:cut], fps[cut:])

    def rows(edges):
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()),
                                           pa.array(pairs[:, 1].copy())], ["a", "b"])

    last, fps, probe = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        pr = batch.column("probe").to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        # buckets of one row, and of probes alone, hold no link
        head = key[cuts[:-1]]
        edges = []
        lone = (np.diff(cuts) == 1) | pr[cuts[:-1]]
        for i in range(len(cuts) - 1):
            a, b = cuts[i], cuts[i + 1]
            inner = 0 < i < len(cuts) - 2
            if inner and lone[i]:
                continue
            if head[i] != last:
                if len(fps) and sum(map(len, fps)) > 1:
                    edges += bucket(fps, probe)
                last, fps, probe = head[i], [], []
            fps.append(fp[a:b])
            probe.append(pr[a:b])
        if edges:
            yield rows(edges)
    if len(fps) and sum(map(len, fps)) > 1:
        edges = bucket(fps, probe)
        if edges:
            yield rows(edges)


def _masked(batches):
    """Keys of a hot bucket's rows: the other segment with two and three bits masked out."""
    masks = {n: np.array([sum(1 << i for i in c) for c in combinations(range(32), n)], np.uint64)
             for n in (DISTANCE - 1, DISTANCE)}
    tags = {n: np.arange(len(m), dtype=np.int64) + (0 if n == DISTANCE else 1 << 20)
            for n, m in masks.items()}
    for batch in batches:
        for key, fp, probe in zip(*(batch.column(k).to_pylist()
                                    for k in ("key", "fp", "probe"))):
            shift = 32 if (key >> 32) == 0 else 0
            other = np.uint64((fp >> shift) & 0xFFFFFFFF)
            for n in ((DISTANCE - 1,) if probe else (DISTANCE - 1, DISTANCE)):
                size = len(masks[n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, key)), pa.array(tags[n]),
                     pa.array((other & ~masks[n]).astype(np.int64)),
                     pa.array(np.full(size, fp)), pa.array(np.full(size, probe))],
                    ["key", "mask", "rest", "fp", "probe"])


def links(fps):
    """Edges (a, b) over distinct fingerprints fps(fp) with the components of all true links."""
    rows = fps.mapInArrow(_segments, "key long, fp long, probe boolean")
    hot = written(rows.filter("NOT probe").groupBy("key").agg(F.count("*").alias("d"))
                  .filter(F.col("d") > GATHER).select("key"), "hot")
    cold = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions(
        "key", "probe").mapInArrow(_links, "a long, b long")
    masked = rows.join(hot, "key", "left_semi").mapInArrow(
        _masked, "key long, mask long, rest long, fp long, probe boolean")
    centre = masked.filter("NOT probe").groupBy("key", "mask", "rest").agg(
        F.min("fp").alias("centre"))
    stars = masked.join(centre, ["key", "mask", "rest"]).filter("fp <> centre").select(
        F.col("fp").alias("a"), F.col("centre").alias("b"))
    return cold.unionAll(stars)


def grouped(rows, size=3, seed=42):
    """(marked, groups) of keyed rows: marked has each row's fp, groups each fp's root and the
    smallest doc_id and first row of the root's component."""
    ensure_checkpoint_dir(rows.sparkSession)
    marked = written(fingerprints(rows.select("doc_id", "k_id", "k_hash", "text"), size, seed),
                     "fingerprints")
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "k_id", "k_hash")).alias("first"))
    roots = components(links(own.select("fp")))
    rooted = written(own.join(roots, own.fp == roots.node, "left").select(
        "fp", "low", "first", F.coalesce("root", "fp").alias("root")), "roots")
    best = rooted.groupBy("root").agg(F.min("low").alias("component_id"),
                                      F.min("first").alias("first"))
    return marked, rooted.select("fp", "root").join(best, "root")


def near_duplicates(docs, size=3, seed=42):
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Documents link if their fingerprints differ in three bits or fewer; component_id is the
    smallest doc_id reachable over links. Null texts are empty, empty texts have fingerprint zero
    and link like any other; a null doc_id is no candidate for the smallest one unless its
    component has no other. Repeated rows come out repeated, empty tables give no rows. Other
    columns are not read.
    """
    marked, groups = grouped(keyed(texts(docs)), size, seed)
    return marked.join(groups.select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs, size=3, seed=42):
    """All columns of one document of each group that links of three bits or fewer connect: the
    smallest doc_id's, a null one last; of rows alike in id the first by text hash, of rows alike
    in id and text any one. Texts without words are copies of each other."""
    rows = keyed(packed(docs))
    _, groups = grouped(rows, size, seed)
    first = groups.select("first.k_id", "first.k_hash").distinct()
    return unpacked(rows.select("row", "k_id", "k_hash").join(
        first, ["k_id", "k_hash"]).dropDuplicates(["k_id", "k_hash"]))

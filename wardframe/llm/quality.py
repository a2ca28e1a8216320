"""Quality rules: word counts and compression bands.

The ratio of a text is its UTF-8 length over its length under zstandard. Repetitive text
compresses too well, random text too little; short texts compress less, so the limits come by
length. Fixed chunks are held against limits of their own, the last one against those of texts as
long as it is, which finds a bad stretch inside a good text; a text goes if more than a quarter of
its bytes lie in chunks that are outside.

`fit_bands` takes the limits from all labelled documents: of each class of lengths the median ratio
of good texts and how far the others stray from it, which are exact order statistics. Without labels
the wide limits `BANDS` hold.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, raw, small_batches, texts, unpacked, written

CHUNK = 4096
#: (bytes up to, smallest ratio, largest ratio); the entry of zero bytes holds for whole chunks.
BANDS = ((0, 1.45, 2.65), (512, 1.1, 2.1), (2048, 1.25, 2.4), (8192, 1.45, 2.65),
         (1 << 62, 1.6, 3.0))
#: The classes of lengths that limits come by.
CLASSES = (256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 16384, 32768, 1 << 62)
#: Good texts that a class needs for a median of its own, and for a margin of its own.
FEW, ENOUGH = 10, 100
#: Ratios are counted in steps of this part of themselves first, to find where a rank lies.
STEP = 1 / 4096
#: Share of good texts that may lie beyond the upper limit; room below the lowest of them.
LOST, ROOM = 0.01, 0.9
BAD_CHUNKS = 0.25
SYMBOLS = b"#*$%&|<>"
LEVEL = 3

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1


def repeat_words(words):
    """Words inside a window of three words that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(flat[:-1] * len(ids) + flat[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(ids) + flat[2:], return_inverse=True,
                                 return_counts=True)
    twice = np.concatenate([[False, False], times[window] > 1, [False, False]])
    return int((twice[2:] | twice[1:-1] | twice[:-2]).sum())


def counts(data):
    """The five counts of one text, given as UTF-8 bytes."""
    words = data.split()
    letters = np.frombuffer(b"".join(words), np.uint8)
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    return (len(words), int((letters & 0xC0 != 0x80).sum()),
            int(_IS_SYMBOL[np.frombuffer(data, np.uint8)].sum()), again, repeat_words(words))


def outside(size, packed, bands=BANDS):
    """Whether a stretch of `size` bytes that packs to `packed` is outside its band."""
    for top, low, high in bands:
        if size <= top:
            return not low <= size / packed <= high
    raise ValueError("the last band must be open")


def packer():
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


def _judge(min_words, max_repeat, bands, chunk, bad_chunks):
    low, high = bands[0][1:]

    def run(batches):
        press = packer()
        for batch in small_batches(batches):
            data, ends = raw(batch.column("text"))
            data, rows = data.tobytes(), []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                text = data[a:b]
                found = counts(text)
                failed = found[0] < min_words or 100 * found[4] > max_repeat * found[0]
                ratio, bad, bad_bytes = 0.0, 0, 0
                if text:
                    packed = len(press.compress(text))
                    ratio = len(text) / packed
                    whole = outside(len(text), packed, bands)
                    for at in range(0, len(text) if len(text) > chunk else 0, chunk):
                        part = text[at:at + chunk]
                        size = len(press.compress(part))
                        out = not low <= len(part) / size <= high if len(part) == chunk \
                            else outside(len(part), size, bands)
                        bad += out
                        bad_bytes += out * len(part)
                else:
                    whole = True
                kept = not failed and not whole and bad_bytes <= bad_chunks * len(text)
                rows.append((*found, failed, kept, ratio, bad))
            keep = [i for i, k in enumerate(batch.schema.names) if k != "text"]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                list(chain((batch.schema.names[i] for i in keep), COLUMNS,
                           ("base_failed", "kept", "ratio", "bad_chunks"))))
    return run


def _words_at_least(data, least):
    """Whether splitting the text at white space, blanks trimmed first, gives so many parts."""
    trimmed = data.strip(b" ")
    ends = trimmed[:1], trimmed[-1:]
    return len(data.split()) + sum(e != b"" and e in b"\t\n\x0b\f\r" for e in ends) >= least


def _ratios(chunk, min_words):
    """(doc_id, size, ratio) of each text, and with size zero of its whole chunks."""
    def run(batches):
        press = packer()
        for batch in small_batches(batches):
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(),
                               batch.column("text").to_pylist()):
                data = text.encode()
                if not _words_at_least(data, min_words):
                    continue
                if data:
                    out.append((i, len(data), len(data) / len(press.compress(data))))
                if len(data) > chunk:  # one chunk of a text: chunks of one text are alike
                    at = len(data) // chunk // 2 * chunk
                    out.append((i, 0, chunk / len(press.compress(data[at:at + chunk]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 3, (
                    pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "size", "ratio"])
    return run


def _pools(counts):
    """Of each class with enough texts for a median: its neighbours whose margins it takes, itself
    first, until they are enough."""
    middle = [k for k, n in counts.items() if n >= FEW]
    pools = {}
    for k in middle:
        pools[k] = []
        for j in sorted((j for j in middle if (j > 0) == (k > 0)), key=lambda j: abs(j - k)):
            pools[k].append(j)
            if sum(counts[i] for i in pools[k]) >= ENOUGH:
                break
    return pools


def _wanted(counts):
    """Ranks by class that the limits are made of: the lowest, the middle ones, and of the upper
    limit as many as the pool's other classes may shift it by; small classes whole."""
    ranks = {k: set() for k in counts}
    for k, pool in _pools(counts).items():
        ranks[k] |= {(counts[k] - 1) // 2, counts[k] // 2}
        total = sum(counts[j] for j in pool)
        at = int((total - 1) * (1 - LOST))
        for j in pool:
            first = max(at - 1 - (total - counts[j]), 0)
            upper = range(first, min(at + 3, counts[j]))
            ranks[j] |= {0, *upper} if counts[j] >= ENOUGH else set(range(counts[j]))
    return ranks


def _bands(counts, ranked, classes):
    """Bands from the number of texts by class and their ratios {rank: ratio} by class."""
    tops, pools, bands = [0, *classes], _pools(counts), []
    middle = {k: float(np.mean([ranked[k][(counts[k] - 1) // 2], ranked[k][counts[k] // 2]]))
              for k in pools}
    for k, top in enumerate(tops):
        if k not in pools:
            bands.append((top, *next(b for b in BANDS if b[0] >= top)[1:]))
            continue
        total = sum(counts[j] for j in pools[k])
        place = (total - 1) * (1 - LOST)
        at, below, above = int(place), 0, []
        for j in pools[k]:
            first = max(at - 1 - (total - counts[j]), 0)
            below += first  # so many of this class lie below the wanted ranks in any case
            above += [r / middle[j] for n, r in ranked[j].items() if n >= first]
        above.sort()
        low, high = above[at - below], above[min(at + 1, total - 1) - below]
        stray = high - (high - low) * (1 - (place - at)) if place - at >= 0.5 \
            else low + (high - low) * (place - at)
        least = min(ranked[j][0] / middle[j] for j in pools[k])
        bands.append((top, float(middle[k] * least * ROOM), float(middle[k] * stray)))
    return tuple(bands)


def limits(sizes, ratios, classes=CLASSES):
    """Bands of good texts' sizes and ratios. A class with few texts takes its margins from its
    neighbours as well; one with hardly any keeps the wide limits."""
    group = np.searchsorted(np.array([0, *classes]), sizes)
    lines = {int(k): np.sort(ratios[group == k]) for k in np.unique(group)}
    counts = {k: len(v) for k, v in lines.items()}
    return _bands(counts, {k: {r: float(lines[k][r]) for r in ranks}
                           for k, ranks in _wanted(counts).items()}, classes)


def fit_bands(docs, labels, chunk=CHUNK, min_words=50, classes=CLASSES):
    """The bands of all documents that labels(doc_id, quality) call good. Texts with fewer than
    `min_words` words are left out, as they fail anyway.

    Labels meet numbers, not texts. Ratios are counted by class and step, then those of the steps
    with the wanted ranks are put in order, so neither the driver nor a task gets a class whole.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id")).distinct()
    group = F.lit(len(classes) + 1)
    for k, top in reversed(list(enumerate([0, *classes]))):
        group = F.when(F.col("size") <= top, k).otherwise(group)
    rows = texts(docs).filter("doc_id IS NOT NULL").mapInArrow(
        _ratios(chunk, min_words), "doc_id long, size long, ratio double").join(
        good, "doc_id", "left_semi").groupBy("doc_id", F.expr("size > 0")).agg(
        F.max("size").alias("size"), F.max("ratio").alias("ratio"))
    rows = written(rows.select(group.alias("k"), "ratio", F.floor(
        F.log("ratio") / F.lit(STEP)).alias("step")), "ratios")
    steps = sorted(rows.groupBy("k", "step").count().collect())
    counts, places, asked = {}, {}, {}
    for k, _, n in steps:
        counts[k] = counts.get(k, 0) + n
    wanted, before = {k: sorted(r) for k, r in _wanted(counts).items()}, dict.fromkeys(counts, 0)
    for k, step, n in steps:
        held = [r for r in wanted[k] if before[k] <= r < before[k] + n]
        if held:
            places[k, step], asked[k, step] = before[k], held
        before[k] += n
    ranked = {k: {} for k in counts}
    if asked:
        spark = docs.sparkSession
        ask = spark.createDataFrame([(*at, places[at], r) for at, held in asked.items()
                                     for r in held], "k int, step long, before long, rank long")
        inside = Window.partitionBy("k", "step").orderBy("ratio")
        lines = rows.join(F.broadcast(ask.select("k", "step", "before").distinct()), [
            "k", "step"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("before"))
        for k, rank, ratio in lines.join(F.broadcast(ask), ["k", "step", "before", "rank"]).select(
                "k", "rank", "ratio").collect():
            ranked[k][rank] = ratio
    return _bands(counts, ranked, classes)


def judge(rows, min_words=50, max_repeat=50, bands=BANDS, chunk=CHUNK, bad_chunks=BAD_CHUNKS):
    """The columns of rows(text, ...) without the text, the counts, base_failed, kept, ratio."""
    out = StructType([f for f in rows.schema if f.name != "text"])
    for name in COLUMNS:
        out = out.add(name, "long")
    out = out.add("base_failed", "boolean").add("kept", "boolean").add("ratio", "double") \
        .add("bad_chunks", "long")
    return rows.mapInArrow(_judge(min_words, max_repeat, bands, chunk, bad_chunks), out)


def quality_rules(docs, **settings):
    """doc_id, counts, base_failed, kept, ratio and bad_chunks of every document.

    Null and empty texts have no word and fail. Repeated rows come out repeated, a null doc_id
    stays null, empty tables give no rows. Other columns are not read.
    """
    return judge(texts(docs), **settings)


def passing(docs, **settings):
    """The documents that pass, with all their columns as they are."""
    return unpacked(judge(packed(docs).drop("doc_id"), **settings).filter("kept"))

"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words and word pairs are 64-bit hashes. Documents are stored once in chunks. Each chunk sends its
distinct n-grams, sorted, with their counts in training documents, in one exchange to buckets of
segments; a segment is given by the upper bits of the hash. There the counts are summed in hash
order. A count is quantised on a logarithmic scale to a level, and the n-gram is inserted once for
each level up to its own; repeated membership probes of rising level read it back until one misses.
Every n-gram is inserted. A segment is as large as its own n-grams ask, and their number grows with
the texts. Where the size of the texts keeps all segments below `MAX_BITS` and the exact word
counts, which the base score needs, below `EXACT_WORDS`, both are broadcast; beyond that, a bucket
probes its segments once for each n-gram and returns to each chunk the levels and word counts alone,
in the order in which the chunk sent the n-grams. Both ways read the same segments and give the same
scores.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import raw, small_batches, texts, written

FOLDS, HELD = 7, 2
#: Largest filter that is broadcast: 128 MB.
MAX_BITS = 1 << 30
BITS_EACH = 10
#: Bits that an insertion sets, all in one 64-bit word.
PROBES = 4
#: Segments at least, as a power of two, and bytes of training text for each beyond that.
LEAST_SEGMENTS, SEGMENT_BYTES = 6, 1 << 20
#: Levels per doubling of a count.
SCALE = 2
#: Weight of pairs against single words in the smoothed probability.
PAIR_WEIGHT = 0.5
#: Words whose exact counts may be broadcast, 12 bytes each.
EXACT_WORDS = 1 << 23
BATCH = 1 << 20
#: N-grams that the documents of a chunk have at most, or a single document; prose has a third.
ASKED = 1 << 23
#: Segments of a bucket, as a power of two.
BUCKET = 4
#: Chunks of a file: what one task may have to read.
FILE_CHUNKS = 16

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
START, END = _U(0x1234567), _U(0x89ABCDE)


def mixed(h):
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


class Words:
    """Hashes of all words of a batch of texts at once, by prefix sums of a polynomial."""

    def __init__(self):
        self.size = 0

    def grow(self, size):
        if size > self.size:
            steps = np.full(size + 1, _ODD, _U)
            back = np.full(size + 1, pow(_ODD, -1, 1 << 64), _U)
            steps[0] = back[0] = 1
            self.up, self.down, self.size = np.cumprod(steps), np.cumprod(back), size

    def __call__(self, data, ends):
        """(tokens, first token of each text): word hashes, after each text's words END."""
        self.grow(len(data))
        data = _LOWER[data]
        inside = np.concatenate([[False], ~_BLANK[data], [False]])
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True  # a word ends where its text ends
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        stops = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * self.up[:len(data)], out=sums[1:])
        h = mixed((sums[stops] - sums[starts]) * self.down[starts]
                  + (stops - starts).astype(_U) * _U(0xD1B54A32D192ED03))
        text = np.searchsorted(ends, starts, "right") - 1
        first = np.searchsorted(starts, ends[:-1], "left") + np.arange(len(ends) - 1)
        tokens = np.full(len(h) + len(ends) - 1, END, _U)
        tokens[np.arange(len(h)) + text] = h
        return tokens, first


def unigrams(tokens):
    """Even keys of single words."""
    return mixed(tokens) & ~_U(1)


def bigrams(tokens, first):
    """Odd keys of pairs; START stands before a text's first token."""
    before = np.concatenate([[START], tokens[:-1]])
    before[first] = START
    return mixed(before * _U(0xA0761D6478BD642F) + tokens) | _U(1)


def _most(batch):
    """N-grams that the documents of a batch have at most: two a token, END included."""
    return int(raw(batch.column("text"))[1][-1]) + 3 * batch.num_rows


CHUNK = "chunk long, size long, most long, asked long, data binary"


def _chunks(batches):
    """Documents in chunks: bytes and possible n-grams of those that train, possible n-grams of
    all, and these documents as Arrow stream."""
    chunk, held, size = TaskContext.get().partitionId() << 33, [], 0

    def closed():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema,
                               options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        train = [batch.filter(pc.invert(batch.column("held_out"))) for batch in held]
        most = sum(_most(batch) for batch in train)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.array([most - 3 * sum(batch.num_rows for batch in train)]),
             pa.array([most]), pa.array([size]),
             pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            [c.split()[0] for c in CHUNK.split(", ")])

    for batch in small_batches(batches, ASKED):
        most = _most(batch)
        if held and size + most > ASKED:
            yield closed()
            chunk, held, size = chunk + 1, [], 0
        held.append(batch)
        size += most
    if held:
        yield closed()


def _stored(data):
    """The batches of a chunk."""
    with pa.ipc.open_stream(data) as stream:
        yield from stream


def _edges(h):
    """Places in a sorted array where another value begins."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[:len(h)])


def _counted(h):
    """The distinct values, sorted, and how often each occurs."""
    h = np.sort(h)
    edge = _edges(h)
    return h[edge], np.diff(np.append(edge, len(h)))


def _run(h):
    """(first, width, later ones as distances of so many bytes) of rising hashes."""
    far = np.diff(h, prepend=h[:1])
    width = max(1, (int(far.max()).bit_length() + 7) // 8)
    return int(h[:1].view(np.int64)[0]), width, \
        far.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unrun(first, width, data):
    far = np.zeros((len(data) // width, 8), np.uint8)
    far[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.cumsum(far.view("<u8").ravel(), dtype=_U) + _U(first & 0xFFFFFFFFFFFFFFFF)


def _slim(x):
    """Whole numbers in as few bytes each as the largest takes, all first bytes before the second
    ones, which are mostly zero and compress well."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unslim(data, n):
    width = len(data) // n if n else 1
    x = np.frombuffer(data, np.uint8).reshape(width, n).T
    return np.ascontiguousarray(x).view(f"u{width}").ravel().astype(np.int64)


QUESTION = "bucket int, chunk long, first long, width int, data binary, times binary"


def _ask(b, held_out=True):
    """For each chunk its distinct n-grams by bucket, with their counts in training documents;
    those of training documents alone unless `held_out`."""
    def run(batches):
        words = Words()
        for rows in batches:
            for chunk, data in zip(rows.column("chunk").to_pylist(), rows.column("data")):
                keys = [], []
                for batch in _stored(data.as_buffer()):
                    for held in (False, True)[:1 + held_out]:
                        own = batch.filter(pc.equal(batch.column("held_out"), held))
                        for part in small_batches([own], BATCH):
                            tokens, first = words(*raw(part.column("text")))
                            keys[held].extend((unigrams(tokens), bigrams(tokens, first)))
                none = [np.zeros(0, _U)]
                known, times = _counted(np.concatenate(keys[False] or none))
                h = _counted(np.concatenate([known, *keys[True]]))[0]
                c = np.zeros(len(h), np.int64)
                c[np.searchsorted(h, known)] = times
                cuts = np.append(_edges(_segment_of(h, b)), len(h)).tolist()
                out = [(*_run(h[x:y]), _slim(c[x:y])) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_segment_of(h[cuts[:-1]], b), pa.int32()),
                     pa.array(np.full(len(out), chunk))]
                    + [pa.array([o[i] for o in out], t) for i, t in enumerate(
                        (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    [c.split()[0] for c in QUESTION.split(", ")])
    return run


def levels(c):
    """Level of each count: 1 for one, 2 for two, SCALE more for each doubling."""
    return np.maximum(1, np.floor(np.log2(c) * SCALE + 1e-9).astype(np.int64))


def middles(level):
    """Middle of the range of counts that share a level; zero for level zero."""
    low = np.ceil(2.0 ** (level / SCALE) - 1e-9)
    high = np.maximum(np.ceil(2.0 ** ((level + 1) / SCALE) - 1e-9) - 1, low)
    return np.where(level > 1, (low + high) / 2, np.minimum(level, 1).astype(float))


#: Of every level that fits a byte.
MIDDLES = middles(np.arange(256))


def _segment_of(h, k):
    return (h >> _U(64 - k)).astype(np.int64) if k else np.zeros(len(h), np.int64)


def _mask(h, level):
    """(hash, PROBES bits of one 64-bit word) of (n-gram, level)."""
    a = mixed(h + _U(0x632BE59BD9B4E019) * level.astype(_U))
    mask = np.zeros(len(a), _U)
    for i in range(PROBES):
        mask |= _U(1) << ((a >> _U(6 * i)) & _U(63))
    return a >> _U(32), mask


def fill(h, level):
    """The 64-bit words of a filter that holds every n-gram at all levels up to its own."""
    words = np.zeros(max(1, math.ceil(int(level.sum()) * BITS_EACH / 64)), _U)
    for n in range(1, int(level.max(initial=0)) + 1):
        a, mask = _mask(h[level >= n], np.array(n))
        np.bitwise_or.at(words, ((a * _U(len(words))) >> _U(32)).astype(np.int64), mask)
    return words


class Filter:
    """Levels of n-grams by membership probes in 2^k segments, whose words follow each other.

    The n-grams share their `skip` upper bits, which the segments leave out."""

    def __init__(self, size, words, k, skip=0):
        self.words, self.k, self.skip = words, k, _U(skip)
        self.size, self.start = size.astype(_U), np.cumsum(size) - size

    def levels(self, h):
        """The highest level that is reached without a miss."""
        segment = _segment_of(h << self.skip, self.k)
        size, start = self.size[segment], self.start[segment]
        level, live, n = np.zeros(len(h), np.int64), np.flatnonzero(size), 0
        while len(live):
            n += 1
            a, mask = _mask(h[live], np.array(n))
            at = start[live] + ((a * size[live]) >> _U(32)).astype(np.int64)
            live = live[self.words[at] & mask == mask]
            level[live] = n
        return level


def _found(known, count, h):
    """The counts beside the sorted keys `known`, zero for other hashes."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, count[at], 0).astype(np.int64)


class Model:
    """Corpus totals and the formulas of both scores."""

    def __init__(self, tokens, vocabulary, documents):
        self.tokens, self.vocabulary, self.documents = tokens, vocabulary, documents

    def scores(self, exact, single, together, first):
        """(known tokens, base score, score) of each text, from each token's word count and level
        and the level of its pair."""
        if not self.tokens:  # one token is possible: END
            return np.zeros(len(first), np.int64), np.zeros(len(first)), np.zeros(len(first))
        single, together = MIDDLES[single], MIDDLES[together]
        known = np.add.reduceat((exact > 0).astype(np.int64), first)
        base = np.add.reduceat(
            np.log10((exact + 1) / (self.tokens + self.vocabulary + 1)), first)
        context = np.concatenate([[0.0], single[:-1]])
        context[first] = self.documents
        alone = (single + 1) / (self.tokens + self.vocabulary + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            after = np.where((together > 0) & (context > 0),
                             np.minimum(together / context, 1.0), 0.0)
        return known, base, np.add.reduceat(
            np.log10(PAIR_WEIGHT * after + (1 - PAIR_WEIGHT) * alone), first)


TOTALS = "tokens long, vocabulary long, documents long"
SEGMENT = f"segment long, data binary, known binary, times binary, {TOTALS}"
ANSWER = f"chunk long, bucket int, level binary, times binary, {TOTALS}"


def _types(schema):
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])


def _summed(k, b, answer):
    """Buckets of questions: their segments' filters, word hashes, counts and totals; or, to
    `answer`, the totals alone and for each question the levels and exact word counts."""
    end = unigrams(np.array([END], _U))[0]
    segment_schema, answer_schema = _types(SEGMENT), _types(ANSWER)

    def finished(bucket, asked):
        h = np.concatenate([x for _, x, _ in asked])
        order = np.argsort(h)
        group, c = h[order], np.concatenate([x for _, _, x in asked])
        edge = _edges(group)
        own, times = group[edge], np.add.reduceat(c[order], edge)
        seen = times > 0
        known, count = own[seen], times[seen]
        level, segment = levels(count), _segment_of(known, k)
        cuts = _edges(segment).tolist()
        size, parts = np.zeros(1 << (k - b), np.int64), []
        for x, y in zip(cuts, [*cuts[1:], len(known)]):
            at, word = int(segment[x]), known[x:y] & _U(1) == 0
            parts.append(fill(known[x:y], level[x:y]))
            size[at & ((1 << (k - b)) - 1)] = len(parts[-1])
            vocabulary, often = known[x:y][word], count[x:y][word]
            total = {"tokens": int(often.sum()), "vocabulary": len(vocabulary),
                     "documents": int(often[vocabulary == end].sum())}
            yield pa.RecordBatch.from_pylist([total if answer else total | {
                "segment": at, "data": parts[-1].tobytes(), "known": vocabulary.tobytes(),
                "times": often.tobytes()}], answer_schema if answer else segment_schema)
        if not answer:
            return
        read = Filter(size, np.concatenate(parts), k - b, b).levels(own) if parts \
            else np.zeros(len(own), np.int64)
        level, group = np.empty(len(h), np.uint8), np.diff(np.append(edge, len(h)))
        level[order] = np.repeat(read, group)
        c[order] = np.repeat(times, group)
        at, word = 0, h & _U(1) == 0
        for i in range(0, len(asked), 256):
            out = []
            for chunk, x, _ in asked[i:i + 256]:
                to = at + len(x)
                out.append({"chunk": chunk, "bucket": bucket, "level": level[at:to].tobytes(),
                            "times": _slim(c[at:to][word[at:to]])})
                at = to
            yield pa.RecordBatch.from_pylist(out, answer_schema)

    def run(batches):
        bucket, asked = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if asked and r["bucket"] != bucket:
                    yield from finished(bucket, asked)
                    asked = []
                bucket = r["bucket"]
                h = _unrun(r["first"], r["width"], r["data"])
                asked.append((r["chunk"], h, _unslim(r["times"], len(h))))
        if asked:
            yield from finished(bucket, asked)
    return run


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
          "score double")
NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _rows(batch, tokens, first, got):
    """Scored rows of a batch of documents."""
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("held_out"),
         pa.array(np.diff(np.append(first, len(tokens))))] + [pa.array(x) for x in got], NAMES)


def _score(parts, k, totals):
    """Scores of all texts by the broadcast segments and word counts."""
    def run(batches):
        words, model = Words(), Model(*totals)
        size, data, known, count = parts.value
        read = Filter(size, data, k)
        for rows in batches:
            for chunk in rows.column("data"):
                for batch in small_batches(_stored(chunk.as_buffer()), BATCH):
                    tokens, first = words(*raw(batch.column("text")))
                    key, place = np.unique(unigrams(tokens), return_inverse=True)
                    pair, after = np.unique(bigrams(tokens, first), return_inverse=True)
                    yield _rows(batch, tokens, first, model.scores(
                        _found(known, count, key)[place], read.levels(key)[place],
                        read.levels(pair)[after], first))
    return run


def _join(totals):
    """For each chunk its answers by bucket, followed by its documents: the documents' scores."""
    def scored(words, model, data, answers):
        parts = [(batch, *words(*raw(batch.column("text"))))
                 for batch in small_batches(_stored(data), BATCH)]
        h = np.concatenate([unigrams(tokens) for _, tokens, _ in parts]
                           + [bigrams(tokens, first) for _, tokens, first in parts])
        order = np.argsort(h)
        h = h[order]
        edge = _edges(h)
        level = np.frombuffer(b"".join(x for x, _ in answers), np.uint8)
        word, own = h[edge] & _U(1) == 0, np.zeros(len(edge), np.int64)
        at, count = 0, []
        for x, times in answers:
            count.append(_unslim(times, int(word[at:at + len(x)].sum())))
            at += len(x)
        if at != len(edge):
            raise ValueError("answers of another chunk")
        own[word] = np.concatenate(count)
        often = np.diff(np.append(edge, len(h)))
        read, exact = np.empty(len(h), np.uint8), np.empty(len(h), np.int64)
        read[order], exact[order] = np.repeat(level, often), np.repeat(own, often)
        n, x = len(h) // 2, 0
        for batch, tokens, first in parts:
            y = x + len(tokens)
            yield _rows(batch, tokens, first, model.scores(
                exact[x:y], read[x:y], read[n + x:n + y], first))
            x = y

    def run(batches):
        words, model, at, answers = Words(), Model(*totals), None, []
        for batch in batches:
            for chunk, level, times, data in zip(batch.column("chunk").to_pylist(), *[
                    batch.column(n) for n in ("level", "times", "data")]):
                if chunk != at:
                    at, answers = chunk, []
                if level.is_valid:
                    answers.append((level.as_py(), times.as_py()))
                else:
                    yield from scored(words, model, data.as_buffer(), answers)
    return run


def _by_answers(docs, answers, totals):
    """The scores without a broadcast: tasks hold one chunk and its answers at a time."""
    none = F.lit(None)
    answers = answers.filter("chunk IS NOT NULL").select(
        "chunk", "bucket", "level", "times", none.cast("binary").alias("data"))
    docs = docs.select("chunk", none.cast("int").alias("bucket"),
                       none.cast("binary").alias("level"), none.cast("binary").alias("times"),
                       "data")
    return answers.unionByName(docs).repartition("chunk").sortWithinPartitions(
        "chunk", F.col("bucket").asc_nulls_last()).mapInArrow(_join(totals), SCORED)


def _broadcast(segments, k):
    """Sizes and words of all segments, word hashes in order and their counts."""
    size, parts, known, count = np.zeros(1 << k, np.int64), {}, [], []
    for r in segments.select("segment", "data", "known", "times").toLocalIterator():
        parts[r.segment] = np.frombuffer(r.data, _U)
        size[r.segment] = len(parts[r.segment])
        known.append((r.segment, np.frombuffer(r.known, _U)))
        times = np.frombuffer(r.times, np.int64)
        count.append((r.segment, times if times.max(initial=0) >> 32 else times.astype(np.uint32)))
    none = np.zeros(0, _U)
    joined = [np.concatenate([x for _, x in sorted(c, key=lambda x: x[0])] or [none])
              for c in (list(parts.items()), known, count)]
    return segments.sparkSession.sparkContext.broadcast((size, *joined))


def lm_scores(docs, max_bits=MAX_BITS, exact_words=EXACT_WORDS):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out, the others train; one with a
    null doc_id trains. Null texts are empty and have the end token alone. Repeated rows count and
    come out as often as they come. Without training documents no token is known. Empty tables
    give no rows; other columns are not read. The filter and the word counts are broadcast where
    the texts are too short for a filter above `max_bits` or more than `exact_words` words; the
    scores are the same.
    """
    rows = texts(docs).withColumn("held_out", F.coalesce(
        F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False)))
    docs = written(rows.mapInArrow(_chunks, CHUNK), "chunks", maxRecordsPerFile=FILE_CHUNKS)
    size, most, ngrams = docs.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        "size", "most", "asked")]).first()
    k = max(LEAST_SEGMENTS, math.ceil(math.log2(max(1, size / SEGMENT_BYTES))))
    # more buckets, of a segment at least, where most documents are held out
    b = min(k, max(0, k - BUCKET, math.ceil(math.log2(max(1, ngrams / SEGMENT_BYTES))) - BUCKET))
    small = most * BITS_EACH + (64 << k) <= max_bits and most // 2 <= exact_words
    asked = docs.select("chunk", "data").mapInArrow(_ask(b, not small), QUESTION)
    told = written(asked.repartitionById(1 << b, F.col("bucket")).sortWithinPartitions("bucket")
                   .mapInArrow(_summed(k, b, not small), SEGMENT if small else ANSWER),
                   "segments" if small else "answers")
    totals = tuple(told.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        "tokens", "vocabulary", "documents")]).first())
    scored = docs.select("data").mapInArrow(_score(_broadcast(told, k), k, totals), SCORED) \
        if small else _by_answers(docs, told, totals)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score",
                         "score")

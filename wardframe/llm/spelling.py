"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary's acceptor, a transducer that makes exactly one edit and the acceptor again are
composed; the accepted pairs are the near words. The composition is dealt by its initial state:
one edit leaves either the first or the last half of a word alone, so a pair agrees in a half that
the acceptor (or the acceptor of the reversed words) reads before the edit. Words that lead to the
same state form a group, and only what that state still accepts, the window between the parts
read, is composed. A group with more than `GATHER` words goes on to deeper states: its windows
are halved again, until they are one code point, where the alphabet bounds the group.

A group's acceptor is minimised and counts what each state accepts, so that a path adds up to
the place of its word in the group's sorted list; no string is built. The composition keeps
to a single path for each pair: an inserted code point is the last one of its run, and a pair
belongs to the group of its first differing place.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from .common import small_batches, texts, written

#: Letters of a run; fixed values of the definition.
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a code point, by hash.
SLIP = 97
#: Words of a group that one task may compose.
GATHER = 16384
#: Different words that a task counts before it passes them on.
FLUSH = 400_000
#: Code points of a text up to which its runs are listed at once.
LISTED = 1 << 20


def slipped(doc_id, run, slip=SLIP):
    """The run, without one code point if the hash of its document and it says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counts(slip, min_length):
    def run(batches):
        total = Counter()

        def flush():
            yield pa.RecordBatch.from_pydict(
                {"word": list(total), "n": list(total.values())},
                pa.schema([("word", pa.string()), ("n", pa.int64())]))
            total.clear()

        for batch in small_batches(batches, 4 << 20):
            for i, text in zip(batch.column("doc_id").to_pylist(),
                               batch.column("text").to_pylist()):
                text = text.encode().lower().decode()  # bytes lower A-Z alone
                runs = RUN.findall(text) if len(text) <= LISTED else \
                    (m.group() for m in RUN.finditer(text))
                for w, n in Counter(runs).items():
                    if slip:
                        w = slipped(i, w, slip)
                    if len(w) >= min_length:
                        total[w] += n
            if len(total) > FLUSH:
                yield from flush()
        yield from flush()
    return run


def word_counts(docs, min_length=MIN_LENGTH, min_count=MIN_COUNT, slip=SLIP):
    """(word, n) of the runs of all documents that are long and frequent enough, written."""
    return written(texts(docs).mapInArrow(_counts(slip, min_length), "word string, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count),
                   "words")


class Acceptor:
    """Minimised acceptors of sorted lists of strings of one length, with shared states.

    A state is {code point: (next state, strings accepted over smaller ones)}; state 0 accepts the
    empty string.
    """

    def __init__(self):
        self.states, self.accepted, self.known = [{}], [1], {}

    def _state(self, arcs):
        key = tuple(arcs)
        state = self.known.get(key)
        if state is None:
            state, before, moves = len(self.states), 0, {}
            for c, to in arcs:
                moves[c] = (to, before)
                before += self.accepted[to]
            self.states.append(moves)
            self.accepted.append(before)
            self.known[key] = state
        return state

    def add(self, strings):
        """The initial state for the strings: sorted, distinct, of one length."""
        last, size = strings[0], len(strings[0])
        arcs = [[] for _ in range(size)]
        for now in [*strings[1:], None]:
            same = 0
            if now is not None:
                while last[same] == now[same]:
                    same += 1
            to = 0
            for depth in range(size - 1, same - 1, -1):
                arcs[depth].append((last[depth], to))
                if depth > same or now is None:
                    to = self._state(arcs[depth])
                    arcs[depth] = []
            last = now
        return to


def one_edit_pairs(short, long, at_end=True):
    """((i, j) places in `short` of strings that differ in one code point,
    (i, j) places in `short` and `long` where the second has one code point more).

    Both lists are sorted and distinct; strings of `long` have one code point more than those of
    `short`. Without `at_end`, no code point is inserted after the last one.
    """
    if not short:
        return [], []
    machine = Acceptor()
    start, after = machine.add(short), machine.add(long) if long else None
    states, found = machine.states, {}

    def common(p, q):
        """(place below p, place below q) of the strings that both accept: the edit is made."""
        pairs = found.get((p, q))
        if pairs is None:
            pairs, walk = [], [(p, q, 0, 0)]
            while walk:
                x, y, i, j = walk.pop()
                if not x and not y:
                    pairs.append((i, j))
                    continue
                others = states[y]
                for c, (to, a) in states[x].items():
                    if c in others:
                        other, b = others[c]
                        walk.append((to, other, i + a, j + b))
            found[p, q] = pairs
        return pairs

    replaced, inserted, walk = [], [], [(start, after, 0, 0)]
    while walk:  # before the edit, both sides have read the same
        p, q, i, j = walk.pop()
        here = list(states[p].values())
        for n, (x, a) in enumerate(here):
            for y, b in here[:n]:
                replaced += [(i + a + u, i + b + v) for u, v in common(x, y)]
        longer = states[q] if q is not None else {}
        for c, (y, b) in longer.items():
            if not p and at_end:
                inserted.append((i, j + b))
            for d, (x, a) in states[p].items():
                if d != c and d in states[y]:  # an insertion is the last of its run
                    z, e = states[y][d]
                    inserted += [(i + a + u, j + b + e + v) for u, v in common(x, z)]
        for c, (x, a) in states[p].items():
            y, b = longer.get(c, (None, 0))
            walk.append((x, y, i + a, j + b))
    return replaced, inserted


def _near(batches):
    """For each word of a group its near words there: how many, and the most frequent one."""
    key, held, out = None, [], []

    def group():
        length, low, high = held[0][1:4]
        lists = [[r for r in held if len(r[4]) == length],
                 [r for r in held if len(r[4]) > length]]
        if not lists[0]:
            return
        windows = [[r[4][low:len(r[4]) - high] for r in rows] for rows in lists]
        best = [[[0, 0, ""] for _ in rows] for rows in lists]

        def meet(mine, n, word):
            mine[0] += 1
            if n > mine[1] or n == mine[1] and word < mine[2]:
                mine[1:] = n, word

        replaced, inserted = one_edit_pairs(*windows, at_end=high == 0)
        for pairs, other in ((replaced, 0), (inserted, 1)):
            for i, j in pairs:
                a, b = lists[0][i], lists[other][j]
                meet(best[0][i], b[5], b[4])
                meet(best[other][j], a[5], a[4])
        for rows, found in zip(lists, best):
            out.extend((r[4], *f) for r, f in zip(rows, found) if f[0])

    def passed():
        words, n, most, near = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(most, pa.int64()),
             pa.array(near, pa.string())], ["word", "n_near", "near_n", "near"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist()
                         for k in ("key", "length", "low", "high", "word", "n"))):
            if row[0] != key:
                if len(held) > 1:
                    group()
                key, held = row[0], []
            held.append(row)
        if len(out) > 50_000:
            yield passed()
    if len(held) > 1:
        group()
    if out:
        yield passed()


def _halved(rows):
    """Each row twice: the first half of its window read from the left, the last from the right."""
    size = F.col("length") - F.col("low") - F.col("high")
    half = F.expr("(length - low - high) div 2").cast("int")
    return rows.withColumn("w", F.explode(F.array(
        F.struct((F.col("low") + half).alias("low"), F.col("high").alias("high")),
        F.struct(F.col("low").alias("low"), (F.col("high") + size - half).alias("high"))))) \
        .select("word", "n", "length", "w.low", "w.high") \
        .withColumn("key", F.concat_ws(
            " ", "length", "low", "high", F.expr("substring(word, 1, low)"),
            F.expr("right(word, high)")))


def near_words(words, min_length=MIN_LENGTH):
    """(word, n_near, near_n, near): how many words(word, n) are one edit away, and the one of
    largest n, the smallest of equals. Words without one are left out."""
    size = F.length("word")
    # a group has words of one length and those one longer: these stand in two classes
    rows = _halved(words.select("word", "n", F.explode(F.when(
        size > min_length, F.array(size, size - 1)).otherwise(F.array(size))).alias("length"),
        F.lit(0).alias("low"), F.lit(0).alias("high")))
    done = []
    while True:
        hot = written(rows.filter("length - low - high > 1").groupBy("key").agg(
            F.count("*").alias("d")).filter(F.col("d") > GATHER).select("key"), "hot-states")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = _halved(written(rows.join(hot, "key", "left_semi").drop("key"), "deeper"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    found = whole.repartition("key").sortWithinPartitions("key", "word").mapInArrow(
        _near, "word string, n_near long, near_n long, near string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")).select(
        "word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.near").alias("near"))


def followed(forms):
    """(word, root) of forms(word, form): where the steps from a word end. Every round doubles the
    steps made; as n at least doubles with each step, a handful of rounds is enough."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs, min_length=MIN_LENGTH, min_count=MIN_COUNT, ratio=RATIO, slip=SLIP):
    """word, form, root, n, n_near, form_n of every frequent word of all documents.

    A word's form is its most frequent near word (ties: the smallest), if it is `ratio` times as
    frequent as the word; `root` is where its forms lead to, the word itself without one. Runs are
    lower-cased in A-Z; one in `slip` loses a code point (None: no run does). Null texts have no
    word, a null doc_id hashes as an empty one, repeated rows count as often as they come. Tables
    without frequent words give no rows; other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    words = word_counts(docs, min_length, min_count, slip)
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = written(words.join(near_words(words, min_length), "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    roots = followed(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

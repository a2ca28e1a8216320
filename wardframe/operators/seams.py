"""Injection scan of a text that lies in parts, such as the documents of a request, without ever
putting it together.

A rule's match is at most SPAN characters of normalized text, so what the parts alone do not tell
is decided by their ends. A part's digest is its normalized text with the middle replaced by BLOCK,
which no match touches. Digests in order are a text with the same matches across seams, and that
text has a digest again: neighbours are joined chunk by chunk, then chunk after chunk. Encoded
payloads never hold the line break between parts, so each part decides on its own.

The exemption (an attack in quotes, none outside) depends on quotes of any length. It is only looked
at for texts with a suspicion and a framing phrase. Whether a quote is open at the start of a part
is the state of a small machine, replayed over the parts; then what lies inside quotes and what lies
outside are two texts in parts, judged by their digests like the whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text
from . import scan
from .replay import MAX_GROUP_ROWS, Fold, replay
from .scan import _with

#: Characters of the longest match of any rule.
SPAN = max(sum(max(len(w.replace("?", "")) for w in g) for g in r.groups) + sum(r.gaps)
           for r in P.RULES)
#: Longer than any gap between words, made of word characters: no word ends or starts beside it.
BLOCK = "x" * (max(max(r.gaps) for r in P.RULES if r.gaps) + 1)
#: Parts whose positions share a chunk are joined in one row first.
CHUNK = 4096
_KEEP = SPAN + 1


def digest(norm) -> Column:
    """Both ends of a normalized text, long enough for any match that leaves it."""
    t = F.col(norm) if isinstance(norm, str) else norm
    cut = F.concat(F.substring(t, 1, _KEEP), F.lit(BLOCK), F.substring(t, -_KEEP, _KEEP))
    return F.when(F.length(t) <= 2 * _KEEP + len(BLOCK), t).otherwise(cut)


def with_hit(df: DataFrame, norm, out: str) -> DataFrame:
    """Append whether a rule matches the normalized text."""
    df = _with(df, _low=text.lowered(norm))
    return scan._once(df, **{out: F.coalesce(text.any_rule(norm, "_low"), F.lit(False))}).drop(
        "_low")


def _joined(df: DataFrame, keys) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("_at", "_digest")))
    df = df.groupBy(*keys).agg(
        parts.alias("_parts"), F.min("_at").alias("_at"), F.max("_hit").alias("_hit"),
        F.max("_framed").alias("_framed"), F.sum("_count").alias("_count"))
    texts = F.filter(F.col("_parts")["_digest"], lambda t: t != "")
    df = with_hit(_with(df, _join=F.array_join(texts, " ")), "_join", "_across")
    return _with(df, _digest=digest("_join"), _hit=F.col("_hit") | F.col("_across")).drop(
        "_parts", "_join", "_across")


def judge_parts(parts: DataFrame, keys, chunked=True) -> DataFrame:
    """One row per text: whether a rule matches it in `_hit`, the largest `_framed` of its parts and
    the sum of their `_count`.

    parts(*keys, _at, _chunk, _digest, _hit, _framed, _count). `_at` orders the parts of a text and
    `_chunk` grows with it; `chunked` tells that there is more than one chunk.
    """
    if chunked:
        parts = _joined(parts, [*keys, "_chunk"])
    return _joined(parts, keys).select(*keys, "_hit", "_framed", "_count")


# --- the exemption ---------------------------------------------------------------------------

_QUOTES = ("", '"', "'")


def _quote_fold() -> Fold:
    """State: which of `_QUOTES` is open. Its inputs are the end states by start state."""
    def step(state, *ends):
        before = state[0] if state else 0
        return (ends[before],), (before,)

    return Fold(("_end0", "_end1", "_end2"), T.StructType([
        T.StructField("_open", T.IntegerType())]), step, "open int",
        tuple((n,) for n in range(len(_QUOTES))))


def _by_rest(build) -> Column:
    """`build(pattern)` with the quotations' pattern of a part: a quote that the part does not
    close runs to its end if a later part closes it, and is a plain character otherwise."""
    out = None
    for double in (False, True):
        for single in (False, True):
            tails = "".join(rf"|{'' if later else '(?!)'}({q})[^{q}]*\z"
                            for q, later in (('"', double), ("'", single)))
            when = (F.col("_later1") == double) & (F.col("_later2") == single)
            value = build(P.QUOTED + tails)
            out = F.when(when, value) if out is None else out.when(when, value)
    return out


def _outside(opened: Column) -> Column:
    """What is left outside quotes; a quote that stays open leaves its sign and a blank."""
    return _by_rest(lambda p: F.regexp_replace(opened, p, " $1$2 "))


def _end(outside: Column) -> Column:
    return (F.when(F.col("_later1") & outside.endswith('" '), 1)
            .when(F.col("_later2") & outside.endswith("' "), 2).otherwise(0))


def exempt(parts: DataFrame, key: str, chunked=True, max_group_rows=MAX_GROUP_ROWS,
           slices=None) -> DataFrame:
    """The keys whose text has a rule's match inside quotes and none outside.

    parts(key, _at, _chunk, _n, _text): `_n` tells the rows of a key apart.
    """
    held = [F.max(F.when(F.col("_text").contains(q), F.col("_at"))).alias(f"_last{n}")
            for n, q in enumerate(_QUOTES) if q]
    df = parts.join(parts.groupBy(F.col(key).alias("_k")).agg(*held),
                    F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    df = _with(df, **{f"_later{n}": F.coalesce(F.col(f"_last{n}") > F.col("_at"), F.lit(False))
                      for n in (1, 2)}).drop("_last1", "_last2")
    ends = df
    for n, q in enumerate(_QUOTES):
        ends = _with(ends, _left=_outside(F.concat(F.lit(q), "_text")))
        ends = _with(ends, **{f"_end{n}": _end(F.col("_left"))})
    ends = ends.select(key, "_at", "_n", "_end0", "_end1", "_end2")
    opened = replay(ends, _quote_fold(), key, ["_at"], max_group_rows, slices, parts).select(
        F.col(key).alias("_k"), F.col("_n").alias("_m"), "_open")
    df = df.join(opened, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_n") == F.col("_m")))

    sign = F.element_at(F.array(*[F.lit(q) for q in _QUOTES]), F.col("_open") + 1)
    df = _with(df, _opened=F.concat(sign, "_text"))
    df = _with(df, _left=_outside(F.col("_opened")),
               _found=_by_rest(lambda p: F.regexp_extract_all("_opened", F.lit(p), 0)))
    df = _with(df, _end=_end(F.col("_left")))
    df = _with(df, _left=F.when(F.col("_end") > 0, F.expr("left(_left, length(_left) - 2)"))
               .otherwise(F.col("_left")))
    # the sign of a quote that an earlier part opened is none of this part's characters
    inner = F.transform("_found", lambda q, i: F.when(
        (i == 0) & (F.col("_open") > 0), q.substr(F.lit(2), F.length(q))).otherwise(q))
    block = F.lit(f" {BLOCK} ")
    df = _with(df, _inner=F.concat(F.when(F.col("_open") == 0, block).otherwise(""),
                                   F.array_join(inner, f" {BLOCK} "),
                                   F.when(F.col("_end") == 0, block).otherwise("")))
    views = F.array(*[F.struct(F.lit(v).alias("_side"), F.col(c).alias("_piece"))
                      for v, c in (("out", "_left"), ("in", "_inner"))])
    df = df.select(key, "_at", "_chunk", F.inline(views), F.lit(False).alias("_framed"),
                   F.lit(1).alias("_count"))
    df = with_hit(scan.normalize(df, "_piece", "_norm"), "_norm", "_hit")
    df = _with(df, _digest=digest("_norm")).drop("_piece", "_norm")
    sides = judge_parts(df, [key, "_side"], chunked)
    return sides.groupBy(key).agg(
        F.max(F.col("_hit") & (F.col("_side") == "in")).alias("_in"),
        F.max(F.col("_hit") & (F.col("_side") == "out")).alias("_out")).filter(
        F.col("_in") & ~F.col("_out")).select(key)

"""Text normalization and prompt-injection detection as Spark SQL expressions.

The scans are large expressions, so they are composed as SQL text and parsed once per use. The
`*_sql` functions take and return SQL text and also back the SQL functions of `functions.sql`; the
others return columns.
"""

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

FINDING_TYPE = ("array<struct<rule_id:int,type:string,severity:string,confidence:int,"
                "action:string,matched:string>>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(value: str) -> str:
    """A SQL string literal without escapes; quotes and control characters become regex escapes."""
    return 'r"' + value.replace('"', r"\x22") + '"'


def plain(value: str) -> str:
    """A SQL string literal of plain text."""
    return "'" + "".join(
        c if c.isalnum() or c in " .,:;<>_-" else f"\\u{ord(c):04x}" for c in value) + "'"


def name(column: str) -> str:
    return f"`{column}`"


# --- normalization ---------------------------------------------------------------------------

def clean_sql(x: str) -> str:
    return f"coalesce({x}, '')"


def visible_sql(x: str) -> str:
    raw = clean_sql(x)
    ascii_text = raw
    for ch in P.ASCII_SPACES:
        ascii_text = f"replace({ascii_text}, {plain(ch)}, ' ')"
    # letter by letter on the bytes: `translate` makes an object of every character
    other = f"regexp_replace({raw}, {literal(P.FORMAT_CHARS)}, '')"
    for ch, letter in zip(P.HOMOGLYPHS, P.HOMOGLYPH_LETTERS):
        other = f"replace({other}, {plain(ch)}, {plain(letter)})"
    other = f"regexp_replace({other}, {literal(P.OTHER_SPACE)}, ' ')"
    return f"IF(octet_length({raw}) = char_length({raw}), {ascii_text}, {other})"


def normalize_sql(x: str) -> str:
    return f"trim(regexp_replace({visible_sql(x)}, ' {{2,}}', ' '))"


def lowered_sql(n: str) -> str:
    return f"lower(replace({n}, 'ſ', 's'))"


def clean(c) -> Column:
    """The text, with a missing value read as empty."""
    return F.coalesce(_col(c), F.lit(""))


def visible(column: str) -> Column:
    """Drop format characters, replace look-alikes, turn every white space into a plain space.

    Plain ASCII text holds neither format characters nor look-alikes, so it takes a path of plain
    byte replacements.
    """
    return F.expr(visible_sql(name(column)))


def collapse(vis: str) -> Column:
    """Second half of the normalization: one space between words, none at the ends."""
    v = name(vis)
    return F.expr(f"trim(IF(contains({v}, '  '), regexp_replace({v}, ' {{2,}}', ' '), {v}))")


def normalize(column: str) -> Column:
    """Both halves in one expression."""
    return F.expr(normalize_sql(name(column)))


def lowered(norm: str) -> Column:
    """Lower-case view of normalized text, used only to rule rules out cheaply."""
    return F.expr(lowered_sql(name(norm)))


def strip(c) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(clean(c), F.lit(P.SPACES))


# --- rules -----------------------------------------------------------------------------------

def _any(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def _rule_hit_sql(n: str, low: str, rule: P.Rule) -> str:
    """A rule: some stem of every word group occurs (rarer groups first), then the pattern."""
    stems = [_any(f"contains({low}, {plain(s)})" for s in P.word_stems(words))
             for words in reversed(rule.groups)]
    return "(" + " AND ".join([*stems, f"{n} rlike {literal(P.RULE_PATTERNS[rule.rule_id])}"]) + ")"


@lru_cache(maxsize=None)
def any_rule_sql(n: str, low: str) -> str:
    return _any(_rule_hit_sql(n, low, r) for r in P.RULES)


def any_rule_in_sql(x: str) -> str:
    """Rules over text that is not normalized yet, for the rare texts that get this far.

    Without the stem test the expression stays small, which matters as it occurs several times.
    """
    hits = _any(f"nrm rlike {literal(p)}" for p in P.RULE_PATTERNS.values())
    return f"exists(array({normalize_sql(x)}), nrm -> {hits})"


def screened_rule_in_sql(x: str) -> str:
    """The same with the stem test, for many texts; both derived texts are bound once."""
    return (f"exists(transform(array({normalize_sql(x)}), nrm -> named_struct('n', nrm, 'l', "
            f"{lowered_sql('nrm')})), bnd -> {any_rule_sql('bnd.n', 'bnd.l')})")


def _finding_sql(rule: P.Rule, matched: str) -> str:
    return (f"named_struct('rule_id', {rule.rule_id}, 'type', '{rule.type}', 'severity', "
            f"'{rule.severity}', 'confidence', {rule.confidence}, 'action', 'BLOCK', "
            f"'matched', {matched})")


def no_findings() -> Column:
    return F.array().cast(FINDING_TYPE)


def rule_findings(norm: str, low: str) -> Column:
    """One finding per matching rule, in rule order, with the first matched text."""
    n, low = name(norm), name(low)
    arms = ", ".join(
        f"IF({_rule_hit_sql(n, low, r)}, "
        + _finding_sql(r, f"regexp_extract({n}, {literal(P.RULE_PATTERNS[r.rule_id])}, 0)")
        + ", NULL)" for r in P.RULES)
    return F.expr(f"array_compact(array({arms}))")


# --- encoded payloads ------------------------------------------------------------------------

def payload_sql(x: str) -> str:
    raw = clean_sql(x)
    decoded = "make_valid_utf8(CAST(try_to_binary(cand, 'base64') AS STRING))"
    attack = f"length(cand) % 4 = 0 AND coalesce({any_rule_in_sql(decoded)}, FALSE)"
    found = (f"try_element_at(filter(regexp_extract_all({raw}, {literal(P.BASE64_RUN)}, 0), "
             f"cand -> {attack}), 1)")
    return f"IF({raw} rlike {literal(P.BASE64_HINT)}, {found}, NULL)"


def encoded_payload(column: str) -> Column:
    """First base64 candidate of the raw text whose decoded text trips a rule, else NULL.

    Only candidates of a padded length are decoded; decoding never recurses.
    """
    return F.expr(payload_sql(name(column)))


def encoded_findings(payload: str) -> Column:
    """Zero or one finding for a payload found by `encoded_payload`."""
    p = name(payload)
    return F.expr(f"IF({p} IS NULL, CAST(array() AS {FINDING_TYPE}), "
                  f"array({_finding_sql(P.ENCODED_RULE, p)}))")


# --- exemption and the full scan -------------------------------------------------------------

def framed_sql(x: str) -> str:
    # a marker that contains a shorter one adds nothing to the test
    markers = [m for m in P.DISCUSSION_MARKERS
               if not any(o != m and o in m for o in P.DISCUSSION_MARKERS)]
    hits = _any(f"contains(lwr, {plain(m)})" for m in markers)
    return f"exists(array(lower({clean_sql(x)})), lwr -> {hits})"  # lowered once for all


def is_framed(column: str) -> Column:
    """A phrase occurs that frames quoted text as discussion."""
    return F.expr(framed_sql(name(column)))


def any_rule(norm: str, low: str) -> Column:
    """Whether a rule matches normalized text, given its lower-cased view too."""
    return F.expr(any_rule_sql(name(norm), name(low)))


def benign_sql(x: str) -> str:
    raw = clean_sql(x)
    framed = framed_sql(x)
    quotes = f"regexp_extract_all({raw}, {literal(P.QUOTED)}, 0)"
    outside = f"regexp_replace({raw}, {literal(P.QUOTED)}, ' ')"
    return (f"({framed} AND exists({quotes}, quo -> {any_rule_in_sql('quo')}) "
            f"AND NOT {any_rule_in_sql(outside)})")


def is_benign_discussion(column: str) -> Column:
    """Framed discussion: a marker, an attack inside quotes, and none outside them."""
    return F.expr(benign_sql(name(column)))


def hit_sql(x: str) -> str:
    """Whether the full scan reports anything; the exemption is only tried on suspicion."""
    return (f"IF({screened_rule_in_sql(clean_sql(x))} OR {payload_sql(x)} IS NOT NULL, "
            f"NOT {benign_sql(x)}, FALSE)")


def max_confidence(findings) -> Column:
    """Highest confidence of a finding list, 0 when it is empty."""
    return F.coalesce(F.array_max(F.transform(_col(findings), lambda f: f["confidence"])), F.lit(0))


def safe_lines_sql(x: str) -> str:
    kept = f"filter(split({clean_sql(x)}, '\\n', -1), ln -> NOT {hit_sql('ln')})"
    return f"btrim(array_join({kept}, '\\n'), {plain(P.SPACES)})"


def keep_safe_lines(column: str) -> Column:
    """Drop the lines that carry a finding, rejoin the rest and trim."""
    return F.expr(safe_lines_sql(name(column)))

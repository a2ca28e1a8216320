"""Licence scans by canonical digests: whole texts against a table of known licence digests.

The canonical form lowers case, drops lines that name a copyright's holder or reserve all rights
(a sentence that merely wraps before the word stays), writes equivalent spellings alike and leaves words of letters and digits with single spaces. Equal canonical forms
have equal SHA-256 digests, so the lookup is an equi join on the digest. One-line notices inside
a text are looked up line by line in a map of known notices.
"""

from pyspark.sql import functions as F

from .common import texts
from .licence_texts import LICENCES, NOTICES

#: Lines that name the holder of a copyright, or reserve all rights and nothing else.
MARKED_LINE = (r"(?m)^[^\p{L}\p{N}\n]*("
               r"copyright[ \t:]*(\(c\)|©|[0-9]{4}|[<\[{]|by[ \t])[^\n]*|"
               r"\(c\)[ \t]*(copyright|[0-9]{4}|[<\[{])[^\n]*|©[^\n]*|"
               r"all rights reserved[^\p{L}\p{N}\n]*)$")
NO_WORD = r"[^\p{L}\p{N}]+"
#: Spellings that count as equal.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("authoris", "authoriz"), ("organis", "organiz"),
    ("favour", "favor"), ("whilst", "while"), ("copyright owner", "copyright holder"),
    ("https:", "http:"),
)


def canonical(c):
    """The canonical form of a text column."""
    out = F.regexp_replace(F.lower(c), MARKED_LINE, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, NO_WORD, " "))


def digest(c):
    return F.sha2(canonical(c), 256)


def known_licences(spark, licences=LICENCES):
    """(digest, license) of a table of licence texts, one row for each digest."""
    return spark.createDataFrame(list(licences), "license string, text string").groupBy(
        digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def licence_files(spark, folder):
    """As `known_licences`, of a folder with one text file for each licence, named after it: full
    texts of long licences need not be part of this package."""
    rows = spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("license"),
        digest(F.col("value")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licences(docs, known=None, notices=NOTICES):
    """doc_id, canonical_sha256, license, notices of every document.

    `license` is the known licence whose canonical text is the whole text's, or null; `notices`
    are the identifiers of known one-line notices among the text's lines, distinct and sorted,
    comma-joined. Null and empty texts have the digest of the empty form. Repeated rows come out
    repeated, empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    known = known_licences(spark) if known is None else known
    rows = spark.createDataFrame(list(notices), "license string, text string").select(
        canonical(F.col("text")).alias("form"), "license").collect()  # the notices given
    table = F.create_map(*[F.lit(x) for r in rows for x in (r.form, r.license)])
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike("licen[cs]"))
    found = F.transform(lines, lambda x: F.try_element_at(table, canonical(x)))
    marked = texts(docs).select(
        "doc_id", digest(F.col("text")).alias("canonical_sha256"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(
            found, lambda x: x.isNotNull()))), ",").alias("notices"))
    return marked.join(known, F.col("canonical_sha256") == F.col("digest"), "left").drop("digest")


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_form(c):
    out = f"regexp_replace(lower({c}), {_quoted(MARKED_LINE)}, '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(regexp_replace({out}, {_quoted(NO_WORD)}, ' ', 'g'))"


def _values(pairs):
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in pairs)


SQL = f"""
WITH licences AS (SELECT sha256({_sql_form('t')}) AS digest, min(l) AS license
                  FROM (VALUES {_values(LICENCES)}) v(l, t) GROUP BY 1),
known_notices AS (SELECT DISTINCT {_sql_form('t')} AS form, l
                  FROM (VALUES {_values(NOTICES)}) v(l, t)),
whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM whole),
found AS (SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS notices
          FROM lines JOIN known_notices ON form = {_sql_form('line')}
          WHERE regexp_matches(lower(line), 'licen[cs]') GROUP BY doc_id)
SELECT doc_id, sha256({_sql_form('text')}) AS canonical_sha256, coalesce(notices, '') AS notices,
       license
FROM whole LEFT JOIN found USING (doc_id)
     LEFT JOIN licences ON digest = sha256({_sql_form('text')})
"""

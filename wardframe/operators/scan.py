"""Corpus scans: any table with a text column in, the same rows with scan columns out.

All of these are narrow (no shuffle). Intermediate values that several expressions read, such as
the normalized text, sit in a projection of their own, so each is computed once per row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sensitive, text


def _with(df: DataFrame, **cols) -> DataFrame:
    """Append columns in one projection (replacing columns of the same name in place)."""
    return df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()})


def _once(df: DataFrame, **cols) -> DataFrame:
    """Append columns that are computed exactly once per row, whatever reads them later.

    A filter on a computed column is otherwise pushed below the projection by copying its
    expression, and copies of copies through several scan stages make both planning and the run
    explode. Predicates do not move through a generator, so the values stay as they are.
    """
    once = F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.drop(*cols).select("*", once)


def normalize(df: DataFrame, column="text", out="text_norm") -> DataFrame:
    """Append the normalized text."""
    df = _with(df, _vis=text.visible(column))
    return _with(df, **{out: text.collapse("_vis")}).drop("_vis")


def scan_rules(df: DataFrame, column="text", out="findings") -> DataFrame:
    """Append the rule findings (no decoding, no exemption)."""
    df = normalize(df, column, "_norm")
    df = _with(df, _low=text.lowered("_norm"))
    df = _once(df, **{out: text.rule_findings("_norm", "_low")})
    return df.drop("_norm", "_low")


def scan_encoded(df: DataFrame, column="text", out="payload") -> DataFrame:
    """Append the first base64 candidate that decodes to an attack, or NULL."""
    return _once(df, **{out: text.encoded_payload(column)})


def is_benign_discussion(df: DataFrame, column="text", out="benign") -> DataFrame:
    """Append whether the text only discusses a quoted attack."""
    return _once(df, **{out: text.is_benign_discussion(column)})


def scan_injection(df: DataFrame, column="text", findings="findings",
                   count="injection_count", confidence="max_confidence",
                   exempt=None, of_norm=None) -> DataFrame:
    """Append the full scan. The exemption is only evaluated for rows that have findings.

    `exempt` names a further column that tells whether findings were dropped by the exemption;
    `of_norm` names further columns with functions of the normalized text's column.
    """
    df = normalize(df, column, "_norm")
    df = _with(df, _payload=text.encoded_payload(column))
    df = _with(df, _low=text.lowered("_norm"))
    df = _with(df, _rules=text.rule_findings("_norm", "_low"))
    df = _with(df, _all=F.when(F.col("_payload").isNull(), F.col("_rules")).otherwise(
        F.concat("_rules", text.encoded_findings("_payload"))))
    df = _with(df, _exempt=(F.size("_all") > 0) & text.is_benign_discussion(column))
    df = _with(df, _kept=F.when(F.col("_exempt"), text.no_findings()).otherwise(F.col("_all")))
    out = {findings: F.col("_kept"), count: F.size("_kept"),
           confidence: text.max_confidence("_kept")}
    if exempt:
        out[exempt] = F.col("_exempt")
    out |= {n: f("_norm") for n, f in (of_norm or {}).items()}
    df = _once(df, **out)
    return df.drop("_norm", "_low", "_payload", "_rules", "_all", "_exempt", "_kept")


def redact_pii(df: DataFrame, column="text", out="redacted",
               findings="pii_findings", count="pii_count") -> DataFrame:
    """Append the redacted text and one finding per kind of personal data."""
    df = _with(df, _p0=text.clean(column))
    df = _with(df, _p1=sensitive.redact_stage("_p0", 0))
    df = _with(df, _p2=sensitive.redact_stage("_p1", 1))
    df = _with(df, _p3=sensitive.redact_stage("_p2", 2))
    df = _with(df, _found=sensitive.pii_findings("_p0", "_p1", "_p2", "_p3"))
    df = _once(df, **{out: F.col("_p3"), findings: F.col("_found"), count: F.size("_found")})
    return df.drop("_p0", "_p1", "_p2", "_p3", "_found")


def scan_secrets(df: DataFrame, column="text", out="secret_findings", count="secret_count",
                 rules=sensitive.SECRET_RULES) -> DataFrame:
    """Append the secret findings. `rules` may extend the built-in list."""
    df = _with(df, **{out: sensitive.secret_findings(column, rules)})
    return _with(df, **{count: F.size(out)})


def scan_output(df: DataFrame, column="text", prefix="output_") -> DataFrame:
    """Append the model-output scan: safe, redacted text, both finding lists."""
    df = redact_pii(df, column, prefix + "redacted", prefix + "pii_findings",
                    prefix + "pii_count")
    df = scan_secrets(df, column, prefix + "secret_findings", prefix + "secret_count")
    return _with(df, **{prefix + "safe": F.col(prefix + "secret_count") == 0})


def drop_suspicious_lines(df: DataFrame, column="text", out="safe_text") -> DataFrame:
    """Append the text without the lines that carry a finding.

    A text without any finding in it can still hold a suspicious line (a quotation may span
    lines), so every line of every text is looked at.
    """
    return _once(df, **{out: text.keep_safe_lines(column)})

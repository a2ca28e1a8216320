"""Personal-data redaction and secret detection as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import _col, clean

PII_TYPE = "array<struct<type:string,severity:string,action:string,redacted_as:string>>"
SECRET_TYPE = "array<struct<type:string,severity:string,action:string>>"

# Redaction stages in order (type, severity, replacement).
PII_STAGES = (
    ("EMAIL_ADDRESS", "MEDIUM", "<EMAIL_REDACTED>"),
    ("PHONE_NUMBER", "MEDIUM", "<PHONE_REDACTED>"),
    ("SSN", "HIGH", "<SSN_REDACTED>"),
)

# (type, Java pattern, substring every match holds). Callers may pass further rules of this form.
SECRET_RULES = (("ACCESS_KEY", P.ACCESS_KEY, "AKIA"),)


def _stage_hit(c: Column, stage: int) -> Column:
    if stage == 0:
        return c.contains("@") & c.rlike(P.EMAIL)
    if stage == 1:
        return c.rlike(P.PHONE_HINT) & c.rlike(P.PHONE)
    return c.contains("-") & c.rlike(P.SSN)


def redact_stage(c, stage: int) -> Column:
    """Replace all matches of one stage; text without a match passes unchanged."""
    c = _col(c)
    pattern = (P.EMAIL, P.PHONE, P.SSN)[stage]
    return F.when(_stage_hit(c, stage),
                  F.regexp_replace(c, pattern, PII_STAGES[stage][2])).otherwise(c)


def redact(c) -> Column:
    """All three stages chained, for array elements and single expressions."""
    out = clean(c)
    for stage in range(3):
        out = redact_stage(out, stage)
    return out


def pii_findings(before_email, before_phone, before_ssn, redacted) -> Column:
    """One finding per stage that changed the text."""
    texts = [_col(before_email), _col(before_phone), _col(before_ssn), _col(redacted)]
    return F.array_compact(F.array(*[
        F.when(texts[i] != texts[i + 1], F.struct(
            F.lit(t).alias("type"), F.lit(s).alias("severity"),
            F.lit("REDACT").alias("action"), F.lit(r).alias("redacted_as")))
        for i, (t, s, r) in enumerate(PII_STAGES)
    ]))


def secret_findings(c, rules=SECRET_RULES) -> Column:
    """One finding per secret rule that matches."""
    raw = clean(c)
    return F.array_compact(F.array(*[
        F.when((raw.contains(hint) if hint else F.lit(True)) & raw.rlike(pattern), F.struct(
            F.lit(t).alias("type"), F.lit("CRITICAL").alias("severity"),
            F.lit("BLOCK").alias("action")))
        for t, pattern, hint in rules
    ]))

"""The scans as SQL functions. Catalyst inlines their bodies; no Python runs."""

from pyspark.sql import SparkSession

from . import patterns as P
from . import risk, sensitive, text


def _redact_sql(x: str, stage: int) -> str:
    pattern = (P.EMAIL, P.PHONE, P.SSN)[stage]
    return f"regexp_replace({x}, {text.literal(pattern)}, '{sensitive.PII_STAGES[stage][2]}')"


def _hit_sql(x: str, stage: int) -> str:
    return f"({x} rlike {text.literal((P.EMAIL, P.PHONE, P.SSN)[stage])})"


def _pii_sql(x: str):
    """(redacted text, number of kinds found), both over the stages in order."""
    stage, count = text.clean_sql(x), []
    for i in range(3):
        count.append(f"IF({_hit_sql(stage, i)}, 1, 0)")
        stage = _redact_sql(stage, i)
    return stage, " + ".join(count)


def _band_sql(x: str, pick: int) -> str:
    arms = " ".join(f"WHEN {x} >= {b[0]} THEN '{b[pick]}'" for b in risk.BANDS[:-1])
    return f"CASE {arms} ELSE '{risk.BANDS[-1][pick]}' END"


def definitions() -> dict:
    """{signature: (type, body)} of all functions."""
    redacted, kinds = _pii_sql("t")
    secrets = " + ".join(f"IF({text.clean_sql('t')} rlike {text.literal(p)}, 1, 0)"
                         for _, p, _ in sensitive.SECRET_RULES)
    points = (f"least({risk.MAX_SCORE}, IF(pii > 0, {risk.PII_POINTS}, 0) + "
              f"IF(secrets > 0, {risk.SECRET_POINTS}, 0) + IF(injections > 0, confidence, 0))")
    confidence = ", ".join(
        f"IF(n rlike {text.literal(P.RULE_PATTERNS[r.rule_id])}, {r.confidence}, 0)"
        for r in P.RULES)
    conf = (f"IF({text.hit_sql('t')}, greatest(IF({text.payload_sql('t')} IS NULL, 0, "
            f"{P.ENCODED_RULE.confidence}), try_element_at(transform("
            f"array({text.normalize_sql('t')}), n -> greatest({confidence})), 1)), 0)")
    return {
        "normalize_text(t STRING)": ("STRING", text.normalize_sql("t")),
        "has_injection(t STRING)": ("BOOLEAN", text.hit_sql("t")),
        "injection_confidence(t STRING)": ("INT", conf),
        "encoded_payload(t STRING)": ("STRING", text.payload_sql("t")),
        "is_benign_discussion(t STRING)": ("BOOLEAN", text.benign_sql("t")),
        "safe_lines(t STRING)": ("STRING", text.safe_lines_sql("t")),
        "redact_pii(t STRING)": ("STRING", redacted),
        "pii_count(t STRING)": ("INT", kinds),
        "secret_count(t STRING)": ("INT", secrets),
        "risk_score(secrets INT, pii INT, injections INT, confidence INT)": ("INT", points),
        "risk_severity(score INT)": ("STRING", _band_sql("score", 1)),
        "risk_action(score INT)": ("STRING", _band_sql("score", 2)),
    }


def register(spark: SparkSession) -> list:
    """Create all functions in the session and return their names."""
    names = []
    for signature, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
        names.append(signature.split("(")[0])
    return names

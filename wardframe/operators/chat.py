"""Chat verdicts: assembly, scan, risk, output verdict and audit projection."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import common, risk, sensitive, text
from . import scan
from .scan import _with

ASSISTANT = "assistant"
# Fixed value: message of a model call that failed.
M_FAILED = "model provider request failed"


def assemble_prompt(messages: DataFrame, key="request_id", order="turn", content="text",
                    carry=()) -> DataFrame:
    """One row per request: contents in turn order, one per line, trimmed.

    The prompt is the row itself and as long as its messages. `carry` names columns that are
    constant per request.
    """
    turns = F.sort_array(F.collect_list(F.struct(F.col(order), text.clean(content).alias("c"))))
    out = messages.groupBy(key, *carry).agg(turns.alias("_turns"))
    return out.select(key, *carry, text.strip(
        F.array_join(F.transform("_turns", lambda t: t["c"]), "\n")).alias("raw_prompt"))


def assemble_exchange(messages: DataFrame, key="request_id", order="turn", content="text",
                      role="role") -> DataFrame:
    """One row per conversation: all messages but a final assistant message as raw_prompt, and
    that one as model_response, NULL where the model has not answered."""
    turns = F.sort_array(F.collect_list(F.struct(
        F.col(order), text.clean(content).alias("c"), F.col(role).alias("r"))))
    out = messages.groupBy(key).agg(turns.alias("_turns"))
    out = _with(out, _last=F.element_at("_turns", -1))
    answered = F.coalesce(F.col("_last.r") == ASSISTANT, F.lit(False))
    asked = F.when(answered, F.slice("_turns", F.lit(1), F.size("_turns") - 1)).otherwise(
        F.col("_turns"))
    return out.select(
        key, text.strip(F.array_join(F.transform(asked, lambda t: t["c"]), "\n"))
        .alias("raw_prompt"), F.when(answered, F.col("_last.c")).alias("model_response"))


def assemble_messages(requests: DataFrame, messages="messages") -> DataFrame:
    """The same for requests that carry their messages as an array; needs no shuffle."""
    joined = F.array_join(F.transform(messages, lambda m: text.clean(m["content"])), "\n")
    return _with(requests, raw_prompt=text.strip(joined))


def score_risk(df: DataFrame) -> DataFrame:
    """Append risk_score, severity and decision from the three counts and the confidence."""
    df = _with(df, risk_score=risk.score(
        "secret_count", "pii_count", "injection_count", "max_confidence"))
    return _with(df, severity=risk.severity("risk_score"), decision=risk.action("risk_score"))


def _service(name) -> str:
    return f"{name} " if name else ""


def judge_chat(requests: DataFrame, prompt="raw_prompt", service=None) -> DataFrame:
    """Scan an assembled prompt for secrets, attacks and personal data, and decide."""
    df = scan.scan_secrets(requests, prompt)
    df = scan.scan_injection(df, prompt, findings="injection_findings",
                             exempt="injection_exempt")
    df = scan.redact_pii(df, prompt, out="sanitized_prompt")
    df = score_risk(df)
    name = _service(service)
    # Messages of the verdicts, here and in `judge_output`.
    return _with(
        df,
        status=F.when(F.col("decision") == "BLOCK", 403).otherwise(200),
        message=F.when(F.col("decision") == "BLOCK", f"request blocked by {name}security policy")
        .when(F.col("decision") == "ALLOW_WITH_REDACTION",
              "request allowed after sensitive data redaction")
        .otherwise(f"request passed {name}security checks"))


def redact_messages(messages: DataFrame, content="text", out="redacted") -> DataFrame:
    """Redact every message on its own (the form that is passed on to a model)."""
    return scan.redact_pii(messages, content, out)


def redact_message_array(requests: DataFrame, messages="messages") -> DataFrame:
    """The same for requests that carry their messages as an array."""
    return _with(requests, **{messages: F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"), sensitive.redact(m["content"]).alias("content")))})


def judge_output(judged: DataFrame, output="model_response", service=None) -> DataFrame:
    """Merge the scan of the model output into a chat verdict.

    Blocked inputs have no output. An unsafe output overrides decision, score and severity. An
    admitted request without an output is a failed model call: `provider_failed`, status 502.
    """
    df = scan.scan_output(judged, output)
    blocked_in = F.col("decision") == "BLOCK"
    failed = ~blocked_in & F.col(output).isNull()
    unsafe = ~blocked_in & ~F.col("output_safe")
    name = _service(service)
    return _with(
        df,
        output_blocked=unsafe,
        input_blocked=blocked_in,
        provider_failed=failed,
        final_decision=F.when(unsafe, "BLOCK").otherwise(F.col("decision")),
        final_risk_score=F.when(unsafe, risk.MAX_SCORE).otherwise(F.col("risk_score")),
        final_severity=F.when(unsafe, "CRITICAL").otherwise(F.col("severity")),
        final_status=F.when(unsafe | blocked_in, 403).when(failed, 502).otherwise(200),
        final_output=F.when(~unsafe & ~blocked_in & ~failed, F.col("output_redacted")),
        final_message=F.when(blocked_in, F.col("message"))
        .when(failed, M_FAILED)
        .when(unsafe, f"model output blocked by {name}security policy")
        .when(F.col("output_pii_count") > 0, "request allowed after output redaction")
        .otherwise(F.col("message")))


def to_audit_events(judged: DataFrame) -> DataFrame:
    """Audit rows: blocked inputs and completed requests. Unsafe outputs and failed model calls
    leave no row.

    An exempt discussion is stored with the findings null, a text without findings with [].

    Needs request_id, timestamp, provider, model and latency_ms next to the verdict columns.
    """
    output = F.struct(
        F.col("output_safe").alias("safe"), F.col("output_redacted").alias("redacted"),
        F.col("output_pii_findings").alias("pii_findings"),
        F.col("output_secret_findings").alias("secret_findings"))
    return judged.filter(~F.col("output_blocked") & ~F.col("provider_failed")).select(
        "request_id", "timestamp", "provider", "model", "decision", "risk_score", "severity",
        F.col("latency_ms").cast("long").alias("latency_ms"),
        common.json_or_null("secret_findings").alias("secret_findings"),
        common.json_or_null("pii_findings").alias("pii_findings"),
        F.when(F.col("injection_exempt"), F.lit("null")).otherwise(
            common.json_or_null("injection_findings")).alias("injection_findings"),
        F.when(F.col("input_blocked"), F.lit("null")).otherwise(
            common.json_or_null(output)).alias("output_findings"))

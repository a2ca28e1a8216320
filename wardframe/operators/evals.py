"""Evaluation of labelled cases: outcomes, metrics, previous report, regression gate."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk
from . import retrieval, scan
from .audit import side_by_side
from .scan import _with

SUITES = ("prompt_injection", "pii", "rag")


def eval_injection(cases: DataFrame, column="input", expected="expected") -> DataFrame:
    """Append actual, passed and outcome (tp, tn, fp, fn). A review counts as a block."""
    df = scan.scan_injection(cases, column)
    action = risk.action(risk.score(F.lit(0), F.lit(0), "injection_count", "max_confidence"))
    df = _with(df, actual=F.when(action == "REVIEW", "BLOCK").otherwise(action))
    want, got = F.col(expected) == "BLOCK", F.col("actual") == "BLOCK"
    return _with(
        df, passed=F.col("actual") == F.col(expected),
        outcome=F.when(want & got, "tp").when(~want & ~got, "tn").when(got, "fp").otherwise("fn"))


def eval_pii(cases: DataFrame, column="input", expected="expected_redactions") -> DataFrame:
    df = scan.redact_pii(cases, column)
    return _with(df, passed=F.col("pii_count") == F.col(expected))


def eval_texts(cases: DataFrame, column="input", expected="expected",
               expected_redactions="expected_redactions") -> DataFrame:
    """Rows (suite, passed, outcome) of both text suites from one pass over the cases."""
    df = eval_injection(cases, column, expected)
    df = _with(df, _attack=F.struct(F.lit(SUITES[0]).alias("suite"), "passed", "outcome"))
    df = eval_pii(df.drop("passed", "outcome"), column, expected_redactions)
    both = F.array("_attack", F.struct(F.lit(SUITES[1]).alias("suite"), F.col("passed"),
                                       F.lit(None).cast("string").alias("outcome")))
    return df.select(F.inline(both))


def eval_retrieval(cases: DataFrame, judged: DataFrame) -> DataFrame:
    """cases(request_id, expected_included); cases without documents admit none."""
    admitted = retrieval.build_trace(judged).select("request_id", "context_count")
    df = cases.join(admitted, "request_id", "left")
    df = _with(df, actual_included=F.coalesce("context_count", F.lit(0))).drop("context_count")
    return _with(df, passed=F.col("actual_included") == F.col("expected_included"))


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metrics(evaluated: DataFrame) -> DataFrame:
    """One row per suite from rows(suite, passed, outcome or NULL)."""
    def outcomes(*names):
        return F.count_if(F.coalesce(F.col("outcome").isin(*names), F.lit(False)))

    df = evaluated.groupBy("suite").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        outcomes("tp").alias("tp"), outcomes("tn").alias("tn"),
        outcomes("fp").alias("fp"), outcomes("fn").alias("fn"))
    return df.select(
        "suite", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"),
        _ratio(F.col("passed"), F.col("total")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"))


METRIC = ("total", "passed", "failed", "accuracy", "precision", "recall", "false_positives",
          "false_negatives")


def report(metric_rows: DataFrame, timestamp: str) -> DataFrame:
    """One report row: a metric struct per suite. Suites without rows are NULL.

    Latencies of single calls are not measured, so that field is NULL.
    """
    row = F.struct(*METRIC, F.lit(None).cast("long").alias("average_latency_ns"))
    return metric_rows.agg(*[
        F.max(F.when(F.col("suite") == s, row)).alias(s) for s in SUITES
    ]).select(F.lit(timestamp).alias("timestamp"), *SUITES)


def text_report(metric_rows: DataFrame) -> DataFrame:
    """One printable line per suite."""
    return metric_rows.select("suite", F.format_string(
        "%s: %d of %d passed, accuracy %.2f%%, precision %.3f, recall %.3f",
        "suite", "passed", "total", F.col("accuracy") * 100, "precision", "recall").alias("line"))


def previous_report(history: DataFrame, baseline: DataFrame = None) -> DataFrame:
    """Second newest report when there are two (the newest is the current run), else the baseline.

    A top-2 of the history, so no window gathers the whole of it.
    """
    two = history.orderBy(F.col("timestamp").desc()).limit(2)
    w = Window.orderBy(F.col("timestamp").desc())
    second = two.select("*", F.row_number().over(w).alias("_n")).filter("_n = 2").drop("_n")
    if baseline is None:
        return second
    tagged = second.select(F.lit(0).alias("_p"), *history.columns).unionByName(
        baseline.select(F.lit(1).alias("_p"), *history.columns))
    return tagged.orderBy("_p").limit(1).drop("_p")


def latest_report(history: DataFrame, fallback: DataFrame = None) -> DataFrame:
    """Newest report, or the packaged one when there is none."""
    newest = history.orderBy(F.col("timestamp").desc()).limit(1)
    if fallback is None:
        return newest
    tagged = newest.select(F.lit(0).alias("_p"), *history.columns).unionByName(
        fallback.select(F.lit(1).alias("_p"), *history.columns))
    return tagged.orderBy("_p").limit(1).drop("_p")


def _zero(c):
    """A metric that is absent from a report is zero."""
    return F.coalesce(F.col(c), F.lit(0))


def regression(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row of flags; without a previous report nothing regressed."""
    c = current.select(*[F.col(s).alias(f"c_{s}") for s in SUITES])
    p = previous.select(*[F.col(s).alias(f"p_{s}") for s in SUITES], F.lit(True).alias("_has"))
    df = side_by_side(c, p)

    def flag(cond):
        return F.coalesce(F.col("_has") & cond, F.lit(False))

    df = df.select(
        flag(_zero("c_prompt_injection.recall") < _zero("p_prompt_injection.recall"))
        .alias("recall_down"),
        flag(_zero("c_prompt_injection.false_negatives")
             > _zero("p_prompt_injection.false_negatives")).alias("false_negatives_up"),
        flag(_zero("c_rag.accuracy") < _zero("p_rag.accuracy")).alias("retrieval_accuracy_down"),
        (_zero("c_prompt_injection.failed") + _zero("c_pii.failed") + _zero("c_rag.failed"))
        .cast("long").alias("failed_cases"))
    df = _with(df, regressed=F.col("recall_down") | F.col("false_negatives_up")
               | F.col("retrieval_accuracy_down"))
    return _with(df, failed=F.col("regressed") | (F.col("failed_cases") > 0))


def regression_checks(flags: DataFrame) -> DataFrame:
    """The flags as rows, for reading."""
    names = ["recall_down", "false_negatives_up", "retrieval_accuracy_down"]
    return flags.unpivot([], names, "check", "regressed")

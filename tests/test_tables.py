"""Sources, sinks, state tables, audit and evaluation."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardframe.operators import audit, evals, state
from wardframe.sources import event_tables, reports, requests, state_tables
from wardframe.streaming import run, scans

STATE = "key_id long, score int, last_updated_us long"


def test_requests_from_json_lines(spark, tmp_path):
    lines = [
        {"request_id": "a", "model": "m", "messages": [{"role": "user", "content": "hi"}]},
        {"request_id": "b", "model": "m", "provider": "", "messages": []},
        {"request_id": "c", "provider": "x", "messages": [{"role": "user", "content": "ho"}]},
    ]
    path = tmp_path / "in"
    path.mkdir()
    (path / "r.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    good, bad = requests.read_requests(spark, str(path))
    assert {r.request_id: r.provider for r in good.collect()} == {"a": "mock", "c": "x"}
    assert sorted(r.refused for r in bad.collect()) == [
        "invalid request body", "messages cannot be empty"]
    stream = requests.stream_requests(spark, str(path)).filter("refused IS NULL")
    judged = scans.judge_requests(stream).select("request_id", "decision")
    assert run.drain(judged, "judged").count() == 2


def audit_rows(spark, n, day=1):
    t = dt.datetime(2024, 1, day)
    rows = [(i, f"r{i}", t, "mock", "m", ["ALLOW", "BLOCK", "REVIEW"][i % 3], i % 100,
             ["LOW", "CRITICAL", "HIGH"][i % 3], i, "[]", "[]", "[]", "null") for i in range(n)]
    return spark.createDataFrame(
        rows, "id long, request_id string, timestamp timestamp, provider string, model string, "
        "decision string, risk_score int, severity string, latency_ms long, "
        "secret_findings string, pii_findings string, injection_findings string, "
        "output_findings string")


def test_event_tables_append_and_prune(spark, tmp_path):
    folder = str(tmp_path)
    event_tables.append_events(audit_rows(spark, 5, 1), "audit_events", folder)
    event_tables.append_events(audit_rows(spark, 7, 2), "audit_events", folder)
    df = event_tables.read_events(spark, "audit_events", folder)
    assert df.count() == 12
    one = df.filter(F.col("event_date") == "2024-01-02")
    assert one.count() == 7
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_batch_delivered_twice_counts_once(spark, tmp_path):
    write = event_tables.append_batch("audit_events", str(tmp_path))
    for batch in (0, 1, 1):
        write(audit_rows(spark, 5), batch)
    assert event_tables.read_events(spark, "audit_events", str(tmp_path)).count() == 10


def test_two_writers_of_one_table(spark, tmp_path):
    """Appends and stream batches mix; ids are in order of arrival, whoever wrote them."""
    folder, rows = str(tmp_path), audit_rows(spark, 4).drop("id")
    write = event_tables.append_batch("audit_events", folder)
    assert event_tables.read_events(spark, "audit_events", folder).count() == 0
    write(rows, 0)
    assert event_tables.append_events(rows, "audit_events", folder) == 2
    write(rows.limit(0), 1)
    write(rows, 2)
    write(rows, 1)  # delivered again
    assert event_tables.append_events(rows, "audit_events", folder, 5, "other") == 5
    assert event_tables.append_events(rows, "audit_events", folder, 5, "other") == 5
    got = event_tables.read_events(spark, "audit_events", folder)
    assert got.count() == 16 and got.select("id").distinct().count() == 16
    arrivals = sorted(int(r.id.split("-")[0]) for r in got.collect())
    assert arrivals == [1] * 4 + [2] * 4 + [4] * 4 + [5] * 4
    newest = event_tables.newest_events(spark, "audit_events", folder, 6).collect()
    assert [int(r.id.split("-")[0]) for r in newest] == [5] * 4 + [4] * 2


def test_only_committed_data_is_seen(spark, tmp_path):
    folder, rows = str(tmp_path), audit_rows(spark, 3).drop("id")
    event_tables.append_events(rows, "audit_events", folder)
    rows.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(
        f"{folder}/audit_events/data/batch=bfailed")
    assert event_tables.read_events(spark, "audit_events", folder).count() == 3
    log = event_tables._log(spark, "audit_events", folder)
    assert not log.commit({}, 1) and log.commit({"path": "", "dates": {}, "sources": {}}, 2)
    assert event_tables.append_events(rows, "audit_events", folder) == 3
    assert log.numbers() == [1, 2, 3]


def test_newest_rows_read_one_date_of_many(spark, tmp_path):
    folder = str(tmp_path)
    days = spark.range(365 * 60).selectExpr(
        "concat('r', id) AS request_id",
        "IF(id = 7, NULL, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, 0) "
        "+ make_dt_interval(CAST(id div 60 AS INT), 0, CAST(id % 60 AS INT), 0)) AS timestamp",
        "'m' AS provider", "'m' AS model", "'ALLOW' AS decision", "0 AS risk_score",
        "'LOW' AS severity", "id AS latency_ms", "'[]' AS secret_findings", "'[]' AS pii_findings",
        "'[]' AS injection_findings", "'null' AS output_findings").repartition(2, "timestamp")
    event_tables.append_events(days, "audit_events", folder)
    top = event_tables.newest_events(spark, "audit_events", folder, 50)
    assert [r.latency_ms for r in top.collect()] == list(range(365 * 60 - 1, 365 * 60 - 51, -1))
    assert {f.split("event_date=")[1].split("/")[0] for f in top.inputFiles()} == {"2024-12-30"}
    two = event_tables.newest_events(spark, "audit_events", folder, 100)
    assert two.count() == 100 and len({f.split("event_date=")[1][:10]
                                       for f in two.inputFiles()}) == 2
    assert event_tables.newest_events(spark, "audit_events", folder, 10 ** 6).collect()[-1] \
        .latency_ms == 7  # no time: the oldest


def test_lookup_reads_one_bucket(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(400).selectExpr(
        "concat('r', id % 80) AS request_id", "timestamp'2024-01-01' + make_dt_interval("
        "CAST(id div 80 AS INT)) AS timestamp", "'u' AS user_id", "'r' AS role", "'t' AS team",
        "CAST(id AS STRING) AS trace")
    event_tables.append_events(rows, "rag_events", folder)
    event_tables.append_events(rows.limit(0), "rag_events", folder)
    found = event_tables.lookup_events(spark, "rag_events", folder, "r7")
    assert [r.trace for r in found.collect()] == ["7", "87", "167", "247", "327"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    every = event_tables.read_events(spark, "rag_events", folder)
    assert len(every.inputFiles()) > 5 * 8
    # the files that were opened hold the rows of one bucket
    opened = {r.f for r in every.filter(F.col("request_id") == "r7").select(
        F.input_file_name().alias("f")).collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in opened}) == 1


def test_stored_state(spark, tmp_path):
    table = state_tables.StateTable(spark, str(tmp_path), STATE, buckets=8)
    assert table.read().count() == 0

    def rows():
        return {r.key_id: r.score for r in table.read().collect()}

    first = spark.createDataFrame([(i, i, 10, 0) for i in range(40)], STATE + ", seq int")
    write = table.writer()
    write(first, 0)
    files = set(table.read().inputFiles())
    second = spark.createDataFrame([(3, 90, 20, 1), (3, 91, 20, 2), (77, 5, 1, 0)],
                                   STATE + ", seq int")
    for _ in range(2):
        write(second, 1)
    write(first, 0)
    assert rows() == {**{i: i for i in range(40)}, 3: 91, 77: 5}
    assert table.log.numbers() == [1, 2]
    # only the buckets of the two keys were written anew
    assert len(files & set(table.read().inputFiles())) >= 6
    old = table.read()
    missing = table.delete(spark.createDataFrame([(3,), (5,), (500,)], "key_id long"))
    assert [r.key_id for r in missing.collect()] == [500]
    assert 3 not in rows() and 5 not in rows() and len(rows()) == 39
    assert old.count() == 41  # a frame stays the state it was made of
    table.delete(table.read().select("key_id"))
    assert rows() == {}


def test_state_change_that_was_overtaken(spark, tmp_path, monkeypatch):
    """Two writers from the same state: the later one starts again, nothing is lost."""
    one, two = (state_tables.StateTable(spark, str(tmp_path), STATE, buckets=2) for _ in "ab")
    row = spark.createDataFrame([(1, 1, 1, 1)], STATE + ", seq int")
    other = spark.createDataFrame([(2, 2, 1, 1)], STATE + ", seq int")
    plain, calls = one.log.commit, []

    def commit(record, number):
        if not calls:
            calls.append(two.upsert(other))
        return plain(record, number)

    monkeypatch.setattr(one.log, "commit", commit)
    assert one.upsert(row) and calls == [True]
    assert sorted(r.key_id for r in one.read().collect()) == [1, 2]
    assert one.log.numbers() == [1, 2]


def test_upsert_and_delete(spark):
    now = spark.createDataFrame([(1, 1, 10), (2, 2, 10)], STATE)
    new = spark.createDataFrame([(2, 5, 20, 1), (2, 6, 20, 2), (3, 7, 5, 0)], STATE + ", seq int")
    got = {r.key_id: r.score for r in state.upsert_state(now, new).collect()}
    assert got == {1: 1, 2: 6, 3: 7}
    left, missing = state.delete_state(now, spark.createDataFrame([(1,), (9,)], "key_id long"))
    assert [r.key_id for r in left.collect()] == [2]
    assert [r.key_id for r in missing.collect()] == [9]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", "PENDING", 0), (2, "a", "LOST", -1), (3, None, None, 1)],
                               "id int, hash string, status string, score int")
    rules = (state.not_null("hash", "status") + state.non_negative("score")
             + state.in_domain("status", state.APPROVAL_STATUSES))
    found = state.check_constraints(df, rules, "id", unique=("hash",)).collect()
    assert sorted((r.rule, r.key) for r in found) == [
        ("hash is not unique", "a"), ("hash is null", "3"), ("score is negative", "2"),
        ("status is not allowed", "2"), ("status is null", "3")]


@pytest.mark.parametrize("asked,largest,want", [
    (None, 100, 50), (0, 100, 50), (-1, 100, 50), (100, 100, 100), (101, 100, 50),
    (200, 200, 200)])
def test_page_sizes(asked, largest, want):
    assert audit.page_limit(asked, largest) == want


def test_audit_lists_and_stats(spark):
    df = audit_rows(spark, 70)
    top = audit.recent_audit(df)
    assert [r.id for r in top.collect()] == list(range(69, 19, -1))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    stats = audit.security_stats(df).first()
    assert (stats.total_requests, stats.allowed_requests, stats.blocked_requests) == (70, 24, 23)
    empty = audit.security_stats(df.limit(0)).first()
    assert set(empty) == {0}
    assert [r.id for r in audit.search(df, "R69").collect()] == [69]


def test_posture_order_of_statuses(spark):
    keys = spark.createDataFrame(
        [(i, f"k{i}", "u", "admin", "t", "*", dt.datetime(2024, 1, 1) if i == 1 else None)
         for i in range(1, 5)],
        "id long, name string, user_id string, role string, team string, scopes string, "
        "revoked_at timestamp")
    st = spark.createDataFrame([(1, 9, 500), (2, 1, 500), (3, 1, 100)],
                               "key_id long, stored_score int, cooldown_until_us long")
    rows = audit.posture(keys, st, 100)
    assert {r.key_id: r.status for r in rows.collect()} == {
        1: "REVOKED", 2: "COOLDOWN", 3: "ELEVATED", 4: "HEALTHY"}
    s = audit.posture_summary(rows).first()
    assert (s.total, s.healthy, s.elevated, s.cooldown, s.revoked) == (4, 1, 1, 1, 1)


def graded(spark, hits, misses, rag=(3, 0)):
    rows = ([("prompt_injection", True, "tp")] * hits + [("prompt_injection", False, "fn")] * misses
            + [("pii", True, None)] + [("rag", True, None)] * rag[0]
            + [("rag", False, None)] * rag[1])
    return evals.metrics(spark.createDataFrame(rows, "suite string, passed boolean, "
                                                     "outcome string"))


def test_reports_history_and_regression(spark, tmp_path):
    folder = str(tmp_path / "history")
    old = evals.report(graded(spark, 4, 0), "2024-01-01T00:00:00Z")
    new = evals.report(graded(spark, 3, 1, (2, 1)), "2024-01-02T00:00:00Z")
    reports.write_report(old, folder)
    history = reports.read_history(spark, folder)
    assert evals.previous_report(history).count() == 0
    assert evals.previous_report(history, history).first().timestamp == "2024-01-01T00:00:00Z"
    first = evals.regression(history, evals.previous_report(history)).first()
    assert not first.regressed and not first.failed
    reports.write_report(new, folder)
    history = reports.read_history(spark, folder)
    latest = evals.latest_report(history)
    assert latest.first().timestamp == "2024-01-02T00:00:00Z"
    flags = evals.regression(latest, evals.previous_report(history))
    row = flags.first()
    assert (row.recall_down, row.false_negatives_up, row.retrieval_accuracy_down, row.failed) == (
        True, True, True, True)
    assert row.failed_cases == 2
    assert evals.regression_checks(flags).count() == 3
    packaged = evals.latest_report(history.limit(0), old).first()
    assert packaged.timestamp == "2024-01-01T00:00:00Z"


def test_metrics_without_denominators(spark):
    m = {r.suite: r for r in graded(spark, 0, 0).collect()}
    assert m["pii"].precision == 0.0 and m["pii"].recall == 0.0 and m["pii"].accuracy == 1.0
    assert "100.00%" in evals.text_report(graded(spark, 1, 0)).filter("suite = 'pii'").first().line


def test_absent_metrics_count_as_zero(spark, tmp_path):
    doc = {"timestamp": "2024-01-01T00:00:00Z",
           "prompt_injection": {"total": 1, "passed": 1, "failed": 0, "accuracy": 1},
           "pii": {"total": 1, "passed": 1, "failed": 0, "accuracy": 1},
           "rag": {"total": 1, "passed": 1, "failed": 0, "accuracy": 1}}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    history = reports.read_history(spark, str(tmp_path))
    now = evals.report(graded(spark, 1, 1), "2024-01-02T00:00:00Z")
    row = evals.regression(now, history).first()
    assert (row.recall_down, row.false_negatives_up) == (False, True)


def test_event_ids_define_recency(spark, tmp_path):
    folder = str(tmp_path)
    rows = audit_rows(spark, 6).drop("id")
    for batch in (1, 2):
        event_tables.append_events(rows, "audit_events", folder, batch)
    df = event_tables.read_events(spark, "audit_events", folder)
    assert df.select("id").distinct().count() == 12
    newest = audit.recent_audit(df, 6).collect()
    assert all(r.id.lstrip("0").startswith("2-") for r in newest)
    later = rows.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
    event_tables.append_events(rows.unionByName(later), "audit_events", folder, 3)
    top = audit.recent_audit(event_tables.read_events(spark, "audit_events", folder), 6).collect()
    assert {r.timestamp.hour for r in top} == {1}

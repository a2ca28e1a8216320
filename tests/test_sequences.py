"""Ordered replays: plain-Python folds as reference, skewed inputs, streams."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardframe.operators import approvals, traffic
from wardframe.plans import fixtures as X
from wardframe.streaming import folds, run

REQUEST = "key_id long, us long, seq long, path string, handler_status int"
SECOND = 1_000_000
PATHS = ("/v1/chat/completions", "/v1/rag/chat", "/v1/tools/evaluate")


def requests(n, keys, gap, seed, hot=0.0):
    rng = random.Random(seed)
    us, rows = 0, []
    for i in range(n):
        us += rng.randrange(gap)
        key = 0 if rng.random() < hot else rng.randrange(keys)
        rows.append((key, us, i, rng.choice(PATHS), rng.choice((200, 200, 403))))
    return rows


def allow(rows, capacity, rate):
    df_state, out = {}, {}
    for key, us, seq, *_ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        tokens, last = df_state.get(key, (float(capacity), us))
        tokens = min(float(capacity), tokens + (us - last) / 1e6 * rate)
        ok = tokens >= 1
        df_state[key] = (tokens - 1 if ok else tokens, us)
        out[seq] = ok
    return out


def test_bucket_burst_and_refill(spark):
    rows = [(1, 0, i, "", 200) for i in range(4)] + [(1, SECOND, 9, "", 200)]
    df = spark.createDataFrame(rows, REQUEST)
    got = {r.seq: (r.allowed, r.retry_after_seconds)
           for r in traffic.rate_limit(df, 3, 1.0).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, 1),
                   9: (True, None)}
    never = traffic.rate_limit(df, 3, 0.0).filter("allowed").count()
    assert never == 3


def test_bucket_matches_a_plain_fold(spark):
    rows = requests(2000, 7, SECOND, 1)
    df = spark.createDataFrame(rows, REQUEST)
    got = traffic.rate_limit(df, 3, 2.0)
    assert {r.seq: r.allowed for r in got.collect()} == allow(rows, 3, 2.0)
    low, high = got.agg(F.min("tokens"), F.max("tokens")).first()
    assert 0 <= low and high <= 3


def test_retry_seconds_round_half_up(spark):
    assert [traffic._whole_seconds(n) for n in
            (1, 499_999_999, 1_499_999_999, 1_500_000_000, 2_500_000_000)] == [1, 1, 1, 2, 3]


def test_score_window_equals_fold(spark):
    decay = 5 * SECOND
    rows = [(k, us, s, 1 + s % 3) for k, us, s, *_ in requests(3000, 5, 3 * SECOND, 2, 0.5)]
    df = spark.createDataFrame(rows, "key_id long, us long, seq long, points int")
    want, state = {}, {}
    for key, us, seq, pts in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        score, last = state.get(key, (0, us))
        score = max(0, score - (us - last) // decay) + pts
        state[key], want[seq] = (score, us), score
    for chunk in (SECOND, 60 * SECOND, traffic.DAY_US):
        got = traffic.abuse_score(df, decay, chunk)
        assert {r.seq: r.score for r in got.collect()} == want
    free = traffic.abuse_score(df, 0, 60 * SECOND).agg(F.max("score")).first()[0]
    totals = defaultdict(int)
    for key, _, _, pts in rows:
        totals[key] += pts
    assert free == max(totals.values())


def test_decay_and_cooldown_boundaries(spark):
    fold = traffic.gate_fold(threshold=5, cooldown_us=30 * SECOND, decay_us=60 * SECOND)
    state, seen = None, []
    for us, pts in [(0, 3), (1, 2), (2, 3), (30 * SECOND, 0), (31 * SECOND, 0),
                    (60 * SECOND + 1, 0)]:
        state, out = fold.step(state, us, pts)
        seen.append((out[0], out[2]))
    # the request at the very end of the cooldown is blocked, one second later it passes
    assert seen == [(False, 3), (False, 5), (True, 5), (True, 5), (False, 5), (False, 4)]


SETTINGS = dict(capacity=3, threshold=5, cooldown_us=20 * SECOND, decay_us=10 * SECOND)


@pytest.mark.parametrize("gap,slices", [(SECOND // 2, 7), (4 * SECOND, 5), (60 * SECOND, 9)])
def test_hot_key_over_slices_equals_one_pass(spark, gap, slices):
    df = spark.createDataFrame(requests(3000, 6, gap, 3, hot=0.6), REQUEST)
    one = traffic.traffic_guard(df, refill_per_second=0.5, **SETTINGS)
    many = traffic.traffic_guard(df, refill_per_second=0.5, max_group_rows=100, slices=slices,
                                 **SETTINGS)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_guard_outcomes_and_events(spark):
    df = spark.createDataFrame(requests(3000, 6, 3 * SECOND, 4), REQUEST)
    done = traffic.traffic_guard(df, refill_per_second=0.1, **SETTINGS)
    rows = done.collect()
    kinds = {r.outcome for r in rows}
    assert kinds == {"ADMITTED", "RATE_LIMITED", "COOLDOWN_BLOCKED"}
    assert all(r.points == 0 for r in rows if r.outcome == "COOLDOWN_BLOCKED")
    assert all((r.points > 0) == (r.status == 429 or (r.status == 403 and "tools" not in r.path))
               for r in rows if r.outcome != "COOLDOWN_BLOCKED")
    events = {r.event_type: r.n for r in traffic.abuse_events(done).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert events["ABUSE_COOLDOWN_STARTED"] == sum(r.entered for r in rows)
    assert events["RATE_LIMIT_EXCEEDED"] == sum(r.outcome == "RATE_LIMITED" for r in rows)


def test_state_decays_to_the_moment(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, PATHS[0], 403), (1, SECOND, 1, PATHS[0], 403), (2, 0, 2, PATHS[2], 200)],
        REQUEST)
    done = traffic.traffic_guard(df, refill_per_second=5.0, **SETTINGS)
    row = traffic.abuse_state(done, 35 * SECOND, 10 * SECOND).collect()
    assert [(r.key_id, r.score, r.stored_score, r.last_updated_us) for r in row] == [
        (1, 3, 6, 31 * SECOND)]


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rows = requests(600, 4, 3 * SECOND, 5)
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(rows[i * 200:(i + 1) * 200], REQUEST).coalesce(1) \
            .write.mode("append").parquet(source)
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
    out = run.drain(folds.traffic_guard(stream, rate=0.1, **SETTINGS), "guard")
    batch = traffic.traffic_guard(spark.createDataFrame(rows, REQUEST), refill_per_second=0.1,
                                  **SETTINGS)
    cols = batch.columns
    got = sorted(map(str, out.filter("NOT late").select(*cols).collect()))
    assert got == sorted(map(str, batch.collect()))


def test_late_rows_never_rewind(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([(1, 100, 0, "", 200)], [(1, 50, 1, "", 200), (1, 200, 2, "", 200)]):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
    out = run.drain(folds.token_bucket(stream, 5, 0.0), "bucket").collect()
    assert {r.seq: (r.late, r.tokens) for r in out} == {
        0: (False, 4.0), 1: (True, None), 2: (False, 3.0)}


ORDER = ("ts", "n")


def attempts(spark, rows):
    return spark.createDataFrame(
        [(a, i, i, action, role, "*") for i, (a, action, role) in enumerate(rows)],
        "approval_id long, ts long, n int, action string, actor_role string, actor_scopes string")


def pending(spark, *ids):
    return spark.createDataFrame([(i, "send_email", 60, "PENDING") for i in ids],
                                 "approval_id long, tool string, risk int, status string")


def test_approval_life_cycle(spark):
    steps = ["claim", "approve", "approve", "claim", "claim", "fail", "reject", "claim", "finish",
             "claim", "finish"]
    tried = attempts(spark, [(1, s, "admin") for s in steps])
    done = approvals.classify_attempts(pending(spark, 1), tried, ORDER)
    got = [(r.prior_status, r.conflict) for r in sorted(done.collect(), key=lambda r: r.n)]
    assert got == [
        ("PENDING", "approval must be APPROVED before execution"),
        ("PENDING", None),
        ("APPROVED", "approval not found or already resolved"),
        ("APPROVED", None),
        ("EXECUTING", "approval execution already in progress"),
        ("EXECUTING", None),
        ("APPROVED", "approval not found or already resolved"),
        ("APPROVED", None),
        ("EXECUTING", None),
        ("EXECUTED", "approval already executed"),
        ("EXECUTED", "no execution in progress")]
    final = approvals.replay(pending(spark, 1, 2), done, ORDER)
    assert {r.approval_id: (r.status, r.executed_at) for r in final.collect()} == {
        1: ("EXECUTED", 8), 2: ("PENDING", None)}
    events = approvals.transition_events(pending(spark, 1), done)
    assert [r.event_type for r in approvals.timeline(events, 1, ("timestamp",)).collect()] == [
        "TOOL_APPROVED", "TOOL_EXECUTION_STARTED", "TOOL_EXECUTION_STARTED",
        "TOOL_EXECUTION_SUCCEEDED"]


def test_actors_and_unknown_approvals(spark):
    tried = attempts(spark, [(1, "approve", "sales"), (9, "approve", "admin"),
                             (9, "claim", "admin")])
    done = approvals.classify_attempts(pending(spark, 1), tried, ORDER)
    assert [r.conflict for r in sorted(done.collect(), key=lambda r: r.n)] == [
        "admin role required", "approval not found or already resolved", "approval not found"]


def test_one_approval_with_most_attempts(spark):
    rng = random.Random(6)
    kinds = ["approve", "reject", "claim", "finish", "fail"]
    rows = [(1 if rng.random() < .7 else rng.randrange(2, 9), rng.choice(kinds),
             rng.choice(["admin", "sales"])) for _ in range(2000)]
    tried, known = attempts(spark, rows), pending(spark, *range(1, 7))
    one = approvals.classify_attempts(known, tried, ORDER)
    many = approvals.classify_attempts(known, tried, ORDER, max_group_rows=50, slices=6)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_guard_needs_one_exchange_and_no_group_in_memory(spark, small):
    df = X.requests(spark, small).select("key_id", "us", "seq", "path", "handler_status")
    plan = traffic.traffic_guard(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan
    assert "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("slices", [3, 12])
def test_hot_approval_takes_one_round(spark, slices, monkeypatch):
    from wardframe.operators import replay as engine
    rounds = []
    plain = engine._end_rows
    monkeypatch.setattr(engine, "_end_rows", lambda *a: rounds.append(1) or plain(*a))
    rnd = random.Random(slices)
    created = spark.createDataFrame([(1, "t", 1, "PENDING"), (2, "t", 1, "PENDING")],
                                    "approval_id long, tool string, risk int, status string")
    rows = [(1 if rnd.random() < .9 else 2, i, rnd.choice(["approve", "claim", "fail", "claim"]),
             "admin", "*") for i in range(600)] + [(None, i, "approve", "admin", "*")
                                                  for i in range(90)]
    tried = spark.createDataFrame(rows, "approval_id long, us long, action string, "
                                        "actor_role string, actor_scopes string")
    hot = approvals.classify_attempts(created, tried, ("us",), 50, slices)
    got = sorted(map(str, hot.collect()))
    assert len(rounds) == 1
    want = approvals.classify_attempts(created, tried, ("us",), 10_000)
    assert got == sorted(map(str, want.collect())) and len(got) == len(rows)


def test_hot_null_key_is_split(spark):
    rows = [(None if i % 3 else 5, i * SECOND, i) for i in range(300)]
    df = spark.createDataFrame(rows, "key_id long, us long, seq long")
    hot = traffic.rate_limit(df, 2, 0.5, max_group_rows=20, slices=6)
    want = traffic.rate_limit(df, 2, 0.5)
    assert sorted(map(str, hot.collect())) == sorted(map(str, want.collect()))


def test_units_of_a_bucket():
    for rate in (5.0, 0.3, 1 / 43200, 2, 0.0):
        bucket = traffic._Bucket(20, rate)
        assert bucket.step / bucket.one * 1e6 == pytest.approx(rate) and bucket.full < 1 << 62
    assert traffic._Bucket(20, 0.3).take(0, 0, 10 * SECOND)[:2] == (True, 20_000_000)


def fold_over(fold, state, rows):
    for row in rows:
        state = fold.step(state, *row)[0]
    return state


@pytest.mark.parametrize("capacity,rate", [(3, 0.5), (20, 5.0), (1, 0.3), (0, 1.0), (4, 0.0)])
def test_bucket_of_a_slice_is_a_function_of_its_start(capacity, rate):
    rng = random.Random(int(capacity * 10 + rate))
    fold = traffic.bucket_fold(capacity, rate)
    bucket = traffic._Bucket(capacity, rate)
    for _ in range(60):
        gap = rng.choice([0, SECOND // 10, SECOND // 2, 3 * SECOND, 60 * SECOND])
        us, rows = 10 * SECOND, []
        for _ in range(rng.randint(1, 80)):
            us += rng.randint(0, max(gap, 1))
            rows.append((us,))
        summary = fold.summary()
        for row in rows:
            summary.row(*row)
        function = summary.function()
        assert len(function[2]) <= 2 * len(rows) + 1
        starts = [None] + [(rng.randint(0, bucket.full), rng.randint(9 * SECOND, rows[0][0]))
                           for _ in range(40)]
        for start in starts + [(0, rows[0][0]), (bucket.full, rows[0][0])]:
            assert fold.applied(function, start) == fold_over(fold, start, rows)


@pytest.mark.parametrize("cooldown", [1, 7, 40, 1000])
def test_cooldown_of_a_slice_is_a_function_of_its_start(cooldown):
    rng = random.Random(cooldown)
    fold = traffic.cooldown_fold(5, cooldown)
    for _ in range(200):
        us, rows = 100, []
        for _ in range(rng.randint(1, 60)):
            us += rng.choice([0, 1, 3, 9])
            rows.append((us, rng.randint(2, 8)))
        summary = fold.summary()
        for row in rows:
            summary.row(*row)
        function = summary.function()
        # a start lies at most a cooldown after the row before the slice
        until = range(0, rows[0][0] + cooldown + 1, 1 + cooldown // 50)
        for start in [None, (None,)] + [(u,) for u in until]:
            assert fold.applied(function, start) == fold_over(fold, start, rows)


@pytest.mark.parametrize("most", [4096, 1])
def test_saturated_key_takes_few_rounds(spark, most, monkeypatch):
    """Buckets that never fill and cooldowns out of step, over twelve slices of one key."""
    from wardframe.operators import replay as engine
    rounds = []
    plain = engine._end_rows
    monkeypatch.setattr(engine, "_end_rows", lambda *a: rounds.append(1) or plain(*a))
    for summary in (traffic._BucketSummary, traffic._CooldownSummary):
        monkeypatch.setattr(summary, "MOST", most)
    rng = random.Random(12)
    rows = [(1 if i % 10 else i, 37 * i * 10_000 + rng.randint(0, 300_000), i)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "key_id long, us long, seq long")
    got = traffic.rate_limit(df, 5, 0.7, max_group_rows=100, slices=12)
    assert len(rounds) == 1 if most > 1 else len(rounds) > 6
    assert sorted(got.collect()) == sorted(traffic.rate_limit(df, 5, 0.7).collect())
    assert got.filter("NOT allowed").count() > 1000
    scored = df.selectExpr("*", "cast(4 + seq % 3 as int) AS score")
    rounds.clear()
    got = traffic.cooldowns(scored, 5, 30 * SECOND, max_group_rows=100, slices=12)
    assert len(rounds) == 1 if most > 1 else len(rounds) > 3
    want = traffic.cooldowns(scored, 5, 30 * SECOND)
    assert sorted(got.collect()) == sorted(want.collect())
    assert 10 < got.filter("entered AND key_id = 1").count() < 100


def test_score_of_a_crowded_hour_over_equal_slices(spark):
    """One key with all its rows in one hour: as many slices as asked for, of like size."""
    rng = random.Random(21)
    rows = [(1 if i % 8 else None if i % 16 else 3, i * SECOND // 3 + rng.randint(0, 900_000), i,
             rng.randint(0, 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "key_id long, us long, seq long, points int")
    want = traffic.abuse_score(df, SECOND // 2)
    got = traffic.abuse_score(df, SECOND // 2, max_group_rows=100, slices=8)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    scores, last, at = {}, {}, {}
    for key, us, seq, points in sorted(rows, key=lambda r: r[1:3]):
        if key in last:
            last[key] = max(0, last[key] - (us - at[key]) // (SECOND // 2))
        last[key], at[key] = last.get(key, 0) + points, us
        scores[seq] = last[key]
    assert {r.seq: r.score for r in got.collect()} == scores
    sizes = [r["count"] for r in traffic._equal_slices(df, 8).groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000

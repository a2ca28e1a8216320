"""Streams in event time: order, watermark, timers, late rows, memory."""

import random

import pytest
from pyspark.sql import functions as F

from wardframe.operators import traffic
from wardframe.streaming import event_time, run, scans

SECOND = 1_000_000
REQUEST = "key_id long, us long, seq long, path string, handler_status int"
SETTINGS = dict(capacity=3, threshold=5, cooldown_us=20 * SECOND, decay_us=10 * SECOND)
PATHS = ["/v1/chat/completions", "/v1/rag/chat", "/v1/tools"]


def source(spark, path, batches, schema=REQUEST):
    """A stream with one file for each micro-batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def requests(n, seed):
    rng = random.Random(seed)
    us, rows = 1000 * SECOND, []
    for seq in range(n):
        us += rng.randint(0, 2 * SECOND)
        rows.append((rng.randrange(4), us, seq, rng.choice(PATHS), rng.choice([200, 403, 429])))
    return rows


def test_mixed_files_give_the_batch_result(spark, tmp_path):
    """Rows that lag behind by less than the delay are put in order; later ones go aside."""
    rows, rng = requests(600, 3), random.Random(4)
    lagged = sorted(rows, key=lambda r: r[1] + rng.randint(0, 50 * SECOND))
    batches = [lagged[i:i + 100] for i in range(0, 600, 100)]
    behind = [(1, 1001 * SECOND, 9000, PATHS[0], 200), (2, None, 9001, PATHS[0], 200)]
    batches[4] = batches[4] + behind
    batches.append([(9, rows[-1][1] + 1000 * SECOND, 9002, PATHS[2], 200)])
    got, late = event_time.drain_split(event_time.traffic_guard(
        source(spark, tmp_path / "in", batches), "60 seconds", slot_ms=10_000, rate=0.1,
        **SETTINGS), "guard")
    want = traffic.traffic_guard(spark.createDataFrame(rows, REQUEST), refill_per_second=0.1,
                                 **SETTINGS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert sorted(r.seq for r in late.collect()) == [9000, 9001]
    assert all(r.outcome is None for r in late.collect())


def test_rows_wait_for_the_watermark(spark, tmp_path):
    batches = [[(1, 100 * SECOND, 0, "", 200)], [(1, 95 * SECOND, 1, "", 200)],
               [(1, 161 * SECOND, 2, "", 200)]]
    got, late = event_time.drain_split(event_time.token_bucket(
        source(spark, tmp_path / "in", batches), "30 seconds", 5, 0.0, slot_ms=1000), "bucket")
    # the watermark ends at 131 s: the last row still waits
    assert [(r.seq, r.tokens) for r in got.orderBy("us").collect()] == [(1, 4.0), (0, 3.0)]
    assert late.count() == 0


def test_idle_keys_lose_their_state(spark, tmp_path):
    def tokens(idle_ms, folder):
        batches = [[(1, 10 * SECOND, 0, "", 200)], [(2, 400 * SECOND, 1, "", 200)],
                   [(1, 500 * SECOND, 2, "", 200)], [(2, 900 * SECOND, 3, "", 200)]]
        got, _ = event_time.drain_split(event_time.token_bucket(
            source(spark, tmp_path / folder, batches), "10 seconds", 5, 0.0, slot_ms=1000,
            idle_ms=idle_ms), "bucket")
        return {r.seq: r.tokens for r in got.collect()}

    assert tokens(None, "a") == {0: 4.0, 1: 4.0, 2: 3.0}
    assert tokens(60_000, "b") == {0: 4.0, 1: 4.0, 2: 4.0}


class Store:
    """The state API of a processor in memory, with the size of what is held at once."""

    def __init__(self):
        self.maps, self.timers = {}, set()

    def getValueState(self, name, schema, ttl=None):
        return self.getMapState(name, schema, schema)

    def getMapState(self, name, key, value, ttl=None):
        return self.maps.setdefault(name, Cells())

    def registerTimer(self, ms):
        self.timers.add(ms)


class Cells(dict):
    getValue, containsKey = dict.__getitem__, dict.__contains__
    updateValue, removeKey = dict.__setitem__, dict.__delitem__

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_two_million_rows_of_a_key_in_bounded_memory():
    """A micro-batch of two million rows of one key: frames go to the store as they come, slots
    come back one by one."""
    import tracemalloc

    import pandas as pd
    fold, store, frames = traffic.bucket_fold(5, 0.5), Store(), 200
    processor = event_time.EventTimeProcessor(fold, ["us", "seq"], ("us", "seq"), 1000)
    processor.init(store)

    def rows():
        for n in range(frames):
            seq = range(n * 10_000, (n + 1) * 10_000)
            yield pd.DataFrame({"us": [s * 1000 for s in reversed(seq)],
                                "seq": list(reversed(seq))})

    assert list(processor.handleInputRows((1,), rows(), At(0))) == []
    assert sum(n for n, in store.maps["parts"].values()) >= 2000
    tracemalloc.start()
    total, last, before = 0, -1, tracemalloc.get_traced_memory()[0]
    for ms in sorted(store.timers):
        for frame in processor.handleExpiredTimer((1,), At(ms), At(ms)):
            assert len(frame) <= event_time.CHUNK and frame["us"].iloc[0] > last
            last = frame["us"].iloc[-1]
            total += len(frame)
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert total == frames * 10_000 and not store.maps["rows"] and not store.maps["parts"]
    assert most < 20 << 20


@pytest.mark.parametrize("lateness,windows", [("10 minutes", {0: 3, 5: 1}),
                                              ("0 seconds", {0: 2, 5: 1, 10: 1})])
def test_windows_in_append_mode(spark, tmp_path, lateness, windows):
    """Closed windows are emitted once; rows behind the watermark are not counted."""
    schema = "minute int, decision string, severity string, latency_ms long, risk_score int"

    def at(*minutes):
        return [(m, "ALLOW", "LOW", 1, 1) for m in minutes]

    stream = source(spark, tmp_path / "in", [at(1, 2), at(6), at(12), at(3), at(21)], schema)
    timed = stream.withColumn("timestamp", F.timestamp_seconds(F.col("minute") * 60))
    rows = run.drain(scans.windowed_stats(timed, lateness=lateness), "windows").collect()
    got = {r.window.start.minute: r.total_requests for r in rows}
    assert got == windows

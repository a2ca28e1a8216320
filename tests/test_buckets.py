"""Keys of a stream travel in buckets: state and results stay those of each key."""

import pandas as pd

from tests.test_event_time import At, Store
from wardframe.operators import approvals, traffic
from wardframe.streaming import event_time, folds


def frame(rows, columns):
    return pd.DataFrame(rows, columns=columns)


def test_a_slot_of_many_keys_is_one_frame():
    columns, store = ["key_id", "us", "seq"], Store()
    processor = event_time.EventTimeProcessor(
        traffic.bucket_fold(2, 0.0), columns, ("us", "seq"), 1000, key="key_id")
    processor.init(store)
    rows = [(k, 5000 - n, n) for n in range(3) for k in range(1000)]
    assert list(processor.handleInputRows((0,), iter([frame(rows, columns)]), At(0))) == []
    assert len(store.maps["rows"]) == 1 and store.timers == {1000}
    out = list(processor.handleExpiredTimer((0,), At(1000), At(1000)))
    assert len(out) == 1 and len(out[0]) == 3000
    # of each key the latest of three rows in event time, seq 0, finds the bucket empty
    refused = out[0][~out[0].allowed.astype(bool)]
    assert sorted(refused.key_id) == list(range(1000)) and set(refused.seq) == {0}
    assert len(store.maps["folds"]) == 1000 and not store.maps["rows"]


def test_slots_that_have_passed_come_back_in_order():
    columns, store = ["key_id", "us", "seq"], Store()
    processor = event_time.EventTimeProcessor(
        traffic.bucket_fold(9, 0.0), columns, ("us", "seq"), 1000, key="key_id")
    processor.init(store)
    rows = [(n % 2, 1_000_000 * s + 5, 10 * s + n) for s in (2, 0, 1) for n in range(4)]
    list(processor.handleInputRows((0,), iter([frame(rows, columns)]), At(0)))
    out = [f for ms in (1000, 2000) for f in processor.handleExpiredTimer(
        (0,), At(2500), At(ms))]
    assert [s for f in out for s in f.seq if s % 2] == [1, 3, 11, 13]
    assert list(store.maps["parts"]) == [(2,)]


def test_idle_keys_of_a_bucket_go_alone():
    columns, store = ["key_id", "us", "seq"], Store()
    processor = event_time.EventTimeProcessor(
        traffic.bucket_fold(5, 0.0), columns, ("us", "seq"), 1000, 9200, key="key_id")
    processor.init(store)
    rows = [(1, 500_000, 0), (2, 500_000, 1), (2, 4_500_000, 2), (1, 9_500_000, 3),
            (2, 9_500_000, 4)]
    list(processor.handleInputRows((0,), iter([frame(rows, columns)]), At(0)))
    out = [f for ms in (1000, 5000, 10_000) for f in processor.handleExpiredTimer(
        (0,), At(10_000), At(ms))]
    assert {s: t for f in out for s, t in zip(f.seq, f.tokens)} == {
        0: 4.0, 1: 4.0, 2: 3.0, 3: 4.0, 4: 2.0}
    gone = max(ms for ms in store.timers if ms % 1000)
    list(processor.handleExpiredTimer((0,), At(gone), At(gone)))
    assert not store.maps["folds"]


def test_a_batch_of_many_keys_is_one_frame():
    """Late rows and states are those of a key; whole numbers beyond 2^53 stay beside nulls."""
    columns, store = ["id", "us", "action", "valid", "n"], Store()
    processor = folds.FoldProcessor(approvals.life_cycle_fold(), columns, ["us"], key="id",
                                    flags="nulls", whole=["id", "us", "n"])
    processor.init(store)
    rows = [(k, 10 - n, a, True, 2 ** 60 + k, None) for k in range(500)
            for n, a in enumerate(("claim", "approve"))] + [(0, 10, "reject", True, 0, "101")]
    out = list(processor.handleInputRows((3,), iter([frame(rows, columns + ["nulls"])]), At(0)))
    assert len(out) == 1 and len(out[0]) == 1001 and not out[0].late.any()
    by_id = {(r.id, r.action): (r.new_status, r.n) for r in out[0].itertuples()}
    assert by_id[499, "claim"] == ("EXECUTING", 2 ** 60 + 499)
    assert by_id[None, "reject"] == ("REJECTED", None)
    again = frame([(7, 9, "reject", True, 1, None), (7, 11, "finish", True, 1, None)],
                  columns + ["nulls"])
    out = next(processor.handleInputRows((3,), iter([again]), At(0)))
    assert list(out.late) == [True, False] and list(out.new_status) == [None, "EXECUTED"]


def test_flags_of_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2, None), (3, 4, "b")],
                               "k long, n int, s string")
    dealt, own, flags, whole = folds.bucketed(df, "k", 4)
    assert whole == ["k", "n"] and dealt.schema["n"].dataType == df.schema["n"].dataType
    got = {tuple(r[:3]): (r[own], r[flags]) for r in dealt.collect()}
    assert {k: v[1] for k, v in got.items()} == {(1, 0, "a"): "01", (0, 2, None): "10",
                                                 (3, 4, "b"): None}
    assert all(0 <= v[0] < 4 for v in got.values())

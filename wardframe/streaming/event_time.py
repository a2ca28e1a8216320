"""Keyed folds in event time: rows wait in the state store until the watermark has passed them.

Rows of a key may come in any order within the watermark's delay. Keys are dealt into buckets by
hash. Each input frame is cut by slots of event time and put into the store at once; a timer at the
end of the slot brings back the slots that the watermark has passed, one by one, puts the rows of
each key in order and replays them on top of the key's state. What is in memory is one input frame
or one slot of one bucket, however many rows a key has in a micro-batch, and the states of the keys
in the slots that have passed. Rows behind the watermark have no place left: they come out marked
`late` and go to a sink of their own. A key that has been idle for long enough loses its state by a
timer too.
"""

import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import traffic
from ..operators.replay import Fold
from ..plans.session import ensure_state_store, new_folder
from .folds import CHUNK, bucketed, frame_values

SLOT_MS = 60_000
#: Groups that the keys of a stream are dealt over by hash; every slot of each comes back alone.
BUCKETS = 256


class EventTimeProcessor(StatefulProcessor):
    """Replays a fold over the rows of a bucket's keys in order of event time (`order[0]`,
    microseconds)."""

    def __init__(self, fold: Fold, columns, order, slot_ms=SLOT_MS, idle_ms=None, key=None,
                 key_type=None, flags=None, whole=()):
        self.fold, self.columns, self.order = fold, columns, list(order)
        self.slot_ms, self.idle_ms = slot_ms, idle_ms
        self.key, self.key_type = key, key_type or T.LongType()
        self.flags, self.whole = flags, list(whole)
        self.names = [f.name for f in fold.outputs.fields]

    def init(self, handle):
        self.handle = handle
        self.states = handle.getMapState(
            "folds", T.StructType([T.StructField("key", self.key_type)]),
            self.fold.state + ", last_us bigint")
        self.parts = handle.getMapState("parts", "slot bigint", "n int")
        self.rows = handle.getMapState("rows", "slot bigint, part int", "data binary")

    def _frame(self, data, outputs, late):
        out = {c: data[c] for c in self.columns}
        out.update(zip(self.names, zip(*outputs)))
        out["late"] = [late] * len(outputs)
        return pd.DataFrame(out, dtype=object)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blank = (None,) * len(self.names)
        counts = {}
        for frame in rows:
            data = frame_values(frame, self.columns, self.flags, self.whole)
            slots, late = {}, []
            for i, us in enumerate(data[self.order[0]]):
                if us is None or us < passed:
                    late.append(i)
                else:
                    slots.setdefault(int(us) // (1000 * self.slot_ms), []).append(i)
            for slot, places in slots.items():
                if slot not in counts:
                    held = self.parts.containsKey((slot,))
                    counts[slot] = self.parts.getValue((slot,))[0] if held else 0
                    if not held:
                        self.handle.registerTimer((slot + 1) * self.slot_ms)
                part = {c: [v[i] for i in places] for c, v in data.items()}
                self.rows.updateValue((slot, counts[slot]), (pickle.dumps(part),))
                counts[slot] += 1
            if late:
                yield self._frame({c: [v[i] for i in late] for c, v in data.items()},
                                  [blank] * len(late), True)
        for slot, n in counts.items():
            self.parts.updateValue((slot,), (n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        mine = now // self.slot_ms - 1
        if now % self.slot_ms:
            self._forget(now)
        elif self.parts.containsKey((mine,)):
            # all that the watermark has passed: the other slots' timers then find nothing to do
            passed = timerValues.getCurrentWatermarkInMs()
            yield from self._replayed(sorted(
                s for s, in list(self.parts.keys())
                if s == mine or (s + 1) * self.slot_ms < passed))

    def _gone(self, last):
        """When a key's state goes, never at the end of a slot, where the slot's own timer is."""
        gone = int(last) // 1000 + self.idle_ms + 1
        return gone + (gone % self.slot_ms == 0)

    def _forget(self, now):
        idle = [k for k, in list(self.states.keys())
                if self._gone(self.states.getValue((k,))[-1]) <= now]
        for k in idle:
            self.states.removeKey((k,))

    def _slot(self, slot):
        data = {c: [] for c in self.columns}
        for n in range(self.parts.getValue((slot,))[0]):
            for c, v in pickle.loads(bytes(self.rows.getValue((slot, n))[0])).items():
                data[c].extend(v)
            self.rows.removeKey((slot, n))
        self.parts.removeKey((slot,))
        return data

    def _replayed(self, slots):
        states = {}
        for slot in slots:
            data = self._slot(slot)
            ranks = list(zip(*[data[c] for c in self.order]))
            places = {}
            for i, k in enumerate(data[self.key] if self.key else [None] * len(ranks)):
                places.setdefault(k, []).append(i)
            line = []
            for k, rows in places.items():
                line.extend((k, i) for i in sorted(rows, key=ranks.__getitem__))
                if k not in states:
                    held = self.states.containsKey((k,))
                    states[k] = tuple(self.states.getValue((k,))) if held else None
                if self.idle_ms and states[k] and \
                        self._gone(states[k][-1]) < (slot + 1) * self.slot_ms:
                    states[k] = None
            for at in range(0, len(line), CHUNK):
                some = line[at:at + CHUNK]
                part = {c: [v[i] for _, i in some] for c, v in data.items()}
                out = []
                for (k, i), row in zip(some, zip(*[part[c] for c in self.fold.inputs])):
                    state, result = self.fold.step(states[k] and states[k][:-1], *row)
                    states[k] = (*state, ranks[i][0])
                    out.append(result)
                yield self._frame(part, out, False)
        for k, state in states.items():
            self.states.updateValue((k,), (*state[:-1], int(state[-1])))
        if self.idle_ms:
            self.handle.registerTimer(max(self._gone(s[-1]) for s in states.values()))

    def close(self):
        pass


def fold_in_time(stream: DataFrame, fold: Fold, key: str, order, delay: str, slot_ms=SLOT_MS,
                 idle_ms=None, buckets=BUCKETS) -> DataFrame:
    """Append the fold's outputs and `late` to every row of a stream.

    `order[0]` is the event time in microseconds, `delay` how far rows may lag behind the latest.
    A row comes out once the watermark has passed its slot; those of the last slots stay in the
    store until later rows come. A row without a time is late. Every key has a state of its own;
    the rows of `buckets` groups of keys travel together. Needs the RocksDB store.
    """
    ensure_state_store(stream.sparkSession)
    fields = stream.schema.fields + fold.outputs.fields + [T.StructField("late", T.BooleanType())]
    # without the time column behind the watermark, Spark does not drop late rows unseen
    timed = stream.withColumn("event_time", F.timestamp_micros(order[0])).withWatermark(
        "event_time", delay).drop("event_time")
    dealt, own, flags, whole = bucketed(timed, key, buckets)
    processor = EventTimeProcessor(fold, stream.columns, order, slot_ms, idle_ms, key,
                                   stream.schema[key].dataType, flags, whole)
    return dealt.groupBy(own).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="EventTime")


def traffic_guard(stream: DataFrame, delay: str, slot_ms=SLOT_MS, idle_ms=None,
                  **settings) -> DataFrame:
    """The traffic guard in event time over requests(key_id, us, seq, path, handler_status)."""
    return fold_in_time(stream, traffic.guard_fold(**settings), "key_id", traffic.ORDER, delay,
                        slot_ms, idle_ms)


def token_bucket(stream: DataFrame, delay: str, capacity=traffic.CAPACITY, rate=traffic.RATE,
                 slot_ms=SLOT_MS, idle_ms=None) -> DataFrame:
    return fold_in_time(stream, traffic.bucket_fold(capacity, rate), "key_id", traffic.ORDER, delay,
                        slot_ms, idle_ms)


def split_writer(folder: str):
    """A `foreachBatch` writer with two sinks: `rows` and, behind the watermark, `late`. A batch
    that is delivered twice replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        for name, rows in (("rows", ~F.col("late")), ("late", F.col("late"))):
            batch.filter(rows).drop("late").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
                f"{folder}/{name}")
        batch.unpersist()
    return write


def drain_split(stream: DataFrame, name: str):
    """(rows, late rows) of a folded stream, run to the end of its input."""
    spark: SparkSession = stream.sparkSession
    out = new_folder(spark, name)
    query = (stream.writeStream.foreachBatch(split_writer(out))
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([f for f in stream.schema.fields if f.name != "late"])
    return tuple(spark.read.schema(schema).parquet(f"{out}/{n}").select(schema.names)
                 for n in ("rows", "late"))

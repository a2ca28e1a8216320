"""Keyed folds as streams: the batch state machines over a state store."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import approvals, traffic
from ..operators.replay import Fold
from ..operators.scan import _with
from ..plans.session import ensure_state_store


#: Groups that the keys of a stream are dealt over by hash: a group's rows come to Python and go
#: back in common frames, whatever the number of keys.
BUCKETS = 1024
#: Rows that come out at once.
CHUNK = 10_000


def bucketed(stream: DataFrame, key: str, buckets: int):
    """(stream dealt into buckets, names of the bucket's and the flags' column, whole numbers).

    pandas makes a column of whole numbers with a missing one floats, which are not exact from 2^53
    on. So they come with zeros for nulls, and rows with a null with a flag for each such column.
    """
    own, flags = "fold_bucket", "fold_nulls"
    while {own, flags} & set(stream.columns):
        own, flags = own + "_", flags + "_"
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.IntegralType)]
    some = F.lit(False)
    for c in whole:
        some = some | F.col(c).isNull()
    signs = [F.when(F.col(c).isNull(), "1").otherwise("0") for c in whole]
    dealt = stream.select(
        *[F.coalesce(c, F.lit(0).cast(stream.schema[c].dataType)).alias(c) if c in whole
          else F.col(c) for c in stream.columns],
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias(own),
        F.when(some, F.concat(F.lit(""), *signs)).alias(flags))
    return dealt, own, flags, whole


def frame_values(frame, columns, flags=None, whole=()):
    """Python values of a frame's columns, with missing ones as None."""
    data = {c: _values(frame[c]) for c in columns}
    if flags is not None:
        for i, nulls in enumerate(frame[flags].tolist()):
            if isinstance(nulls, str):
                for c, sign in zip(whole, nulls):
                    if sign == "1":
                        data[c][i] = None
    return data


class FoldProcessor(StatefulProcessor):
    """Replays the rows of a bucket's keys in (order) sequence on top of their stored states.

    Rows of one micro-batch are put in order first; what a batch may hold of one bucket is bounded
    by the rate limit of the source. A row older than the last one replayed for its key is late: it
    is passed on, marked, and never rewinds the state.
    """

    def __init__(self, fold: Fold, columns, order, ttl_ms=None, key=None, key_type=None,
                 flags=None, whole=()):
        self.fold, self.columns, self.order, self.ttl_ms = fold, columns, order, ttl_ms
        self.key, self.key_type = key, key_type or T.LongType()
        self.flags, self.whole = flags, list(whole)

    def init(self, handle):
        schema = self.fold.state + ", last_us bigint"
        self.states = handle.getMapState(
            "folds", T.StructType([T.StructField("key", self.key_type)]), schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        data = {c: [] for c in self.columns}
        for frame in rows:
            for c, v in frame_values(frame, self.columns, self.flags, self.whole).items():
                data[c].extend(v)
        ranks = list(zip(*[data[c] for c in self.order]))
        places = {}
        for i, k in enumerate(data[self.key] if self.key else [None] * len(ranks)):
            places.setdefault(k, []).append(i)
        inputs = list(zip(data[self.order[0]], *[data[c] for c in self.fold.inputs]))
        blank = (None,) * len(self.fold.outputs.fields)
        late, out = [False] * len(ranks), [blank] * len(ranks)
        for k, line in places.items():
            line.sort(key=ranks.__getitem__)
            state, last = None, None
            if self.states.containsKey((k,)):
                *state, last = self.states.getValue((k,))
                state = tuple(state)
            for i in line:
                us, *row = inputs[i]
                if last is not None and us < last:
                    late[i] = True
                    continue
                state, out[i] = self.fold.step(state, *row)
                last = us
            if state is not None:
                self.states.updateValue((k,), (*state, last))
        for field, values in zip(self.fold.outputs.fields, zip(*out)):
            data[field.name] = values
        data["late"] = late
        for at in range(0, len(ranks), CHUNK):
            yield pd.DataFrame({c: v[at:at + CHUNK] for c, v in data.items()}, dtype=object)

    def close(self):
        pass


def _values(series):
    """Python values of a column, with missing ones as None."""
    values = series.tolist()
    return [None if v is None or v != v else v for v in values] if series.hasnans else values


def fold_stream(stream: DataFrame, fold: Fold, key: str, order, ttl_ms=None,
                buckets=BUCKETS) -> DataFrame:
    """Append the fold's outputs and `late` to every row of a stream. Needs the RocksDB store.

    Every key has a state of its own; the rows of `buckets` groups of keys travel together. Column
    names must not start with an underscore: the state API hands those over renamed.
    """
    ensure_state_store(stream.sparkSession)
    fields = stream.schema.fields + fold.outputs.fields + [T.StructField("late", T.BooleanType())]
    dealt, own, flags, whole = bucketed(stream, key, buckets)
    processor = FoldProcessor(fold, stream.columns, list(order), ttl_ms, key,
                              stream.schema[key].dataType, flags, whole)
    return dealt.groupBy(own).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None")


def traffic_guard(stream: DataFrame, ttl_ms=None, **settings) -> DataFrame:
    """The traffic guard as a stream over requests(key_id, us, seq, path, handler_status)."""
    return fold_stream(stream, traffic.guard_fold(**settings), "key_id", traffic.ORDER, ttl_ms)


def token_bucket(stream: DataFrame, capacity=traffic.CAPACITY, rate=traffic.RATE,
                 ttl_ms=None) -> DataFrame:
    return fold_stream(stream, traffic.bucket_fold(capacity, rate), "key_id", traffic.ORDER,
                       ttl_ms)


def approval_states(stream: DataFrame, order=("us",), ttl_ms=None) -> DataFrame:
    """Approval attempts as a stream; `known` is appended by joining the created approvals.

    Needs approval_id, action, actor_role, actor_scopes, known and the order columns.
    """
    df = approvals.with_validity(stream)
    fold = approvals.life_cycle_fold()
    # attempts on unknown approvals need no state
    replayed = fold_stream(df.filter("known"), fold, "approval_id", order, ttl_ms)
    unknown = df.filter("NOT known").select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fold.outputs.fields],
        F.lit(False).alias("late"))
    df = replayed.unionByName(unknown)
    df = _with(df, conflict=F.when(~F.col("late"), approvals.conflict_reason()))
    df = _with(df, accepted=F.col("conflict").isNull() & ~F.col("late"))
    return df.drop("scope_ok", "role_ok", "valid")

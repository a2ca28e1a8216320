"""Replay of per-key sequences through a state machine, over hot keys too.

A fold is a function of (state, row). Rows of a key are replayed in order, one Arrow batch at a
time, so no group is ever held in memory. A count per key, with map-side combine, tells the keys
with more than `max_group_rows` rows; there are at most total / max_group_rows of them.

* Other keys: hash partitioned by key, sorted, replayed. One exchange.
* Hot keys: range partitioned by (key, order), so that one key is spread over many equally large
  slices, and checkpointed. A slice in the middle of a key starts from the state its predecessor
  ended with. A machine with few states (`Fold.states`) has its slices run once from all of them at
  the same time; one with a summary (`Fold.summary`) has every slice summed up once as a function
  from start to end state. Either way the slices are then linked up, which takes one round for any
  number of them. For other machines all slices run at once from an assumed state, then every slice
  whose assumption proved wrong runs again, until all hand-overs agree; in the worst case, a key
  whose states never meet, that is one round for each of its slices. The first slice of a key
  always starts from the true state, so agreement of all hand-overs means every result is exact.
  Only the end states or functions of the slices reach the driver.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ensure_checkpoint_dir

MAX_GROUP_ROWS = 1_000_000
SLICE_ROWS = 1_000_000
SLICE = "slice_no"


@dataclass(frozen=True)
class Fold:
    """A state machine: `step(state, *values) -> (state, outputs)`, started with state None.

    `inputs` are the columns passed to `step`; `outputs` is the schema of what it returns. States
    are tuples of plain values, so they can be compared and shipped; `state` is their schema, for
    use in a stream. `states` lists all states of a machine that has only a few. `summary()` makes
    an object whose `row(*values)` takes the rows of a slice and whose `function()` is then a small
    value, for which `applied(function, state)` is the state that a start `state` ends as. A
    function of None stands for a slice that cannot be summed up: it is run once its start is known.
    """

    inputs: tuple
    outputs: T.StructType
    step: Callable
    state: str = ""
    states: tuple = ()
    summary: Callable | None = None
    applied: Callable | None = None


def _arrow_type(t: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
            T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[t]


class _Run:
    """Runs a fold over sorted batches that may hold many keys."""

    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key
        self.fields = [(f.name, _arrow_type(f.dataType)) for f in fold.outputs.fields]

    def __call__(self, batches: Iterator, start=None):
        """Yield the batches with output columns; leaves the last key and state in `self.end`.

        `start` is the (key, state) that the rows before have ended with."""
        step = self.fold.step
        key, state = start or (None, None)
        first = None
        seen = False
        for batch in batches:
            keys = batch.column(self.key).to_pylist()
            values = [batch.column(c).to_pylist() for c in self.fold.inputs]
            out = []
            for k, *row in zip(keys, *values):
                if not seen:
                    first, seen = k, True
                    if start is None or k != key:
                        state = None
                    key = k
                elif k != key:
                    key, state = k, None
                state, result = step(state, *row)
                out.append(result)
            columns = list(zip(*out)) if out else [[] for _ in self.fields]
            arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, self.fields)]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + arrays,
                names=list(batch.schema.names) + [n for n, _ in self.fields])
        self.end = (seen, first, key, state)


def replay(df: DataFrame, fold: Fold, key: str, order, max_group_rows=MAX_GROUP_ROWS,
           slices=None, counted: DataFrame = None) -> DataFrame:
    """Append the fold's outputs to every row. `order` must be unique within a key.

    `counted` may name a cheaper frame with the same number of rows per key.
    """
    order = list(order)
    schema = T.StructType(df.schema.fields + fold.outputs.fields)
    hot = ((df if counted is None else counted).groupBy(key)
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_group_rows))
    hot_rows = hot.agg(F.sum("n")).first()[0]
    if hot_rows is None:
        return _replay_hashed(df, fold, key, order, schema)
    hot = hot.select(F.col(key).alias("_hot"))
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))  # the null key may be a hot one
    n = slices or max(-(-hot_rows // SLICE_ROWS),
                      int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cold = _replay_hashed(df.join(hot, is_hot, "left_anti").select(df.columns), fold, key, order,
                          schema)
    sliced = _replay_slices(df.join(hot, is_hot, "left_semi").select(df.columns), fold, key, order,
                            schema, n)
    return cold.unionByName(sliced)


def _replay_hashed(df, fold, key, order, schema):
    run = _Run(fold, key)
    ordered = df.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(lambda batches: run(batches), schema)


def _replay_slices(df, fold, key, order, schema, slices):
    ensure_checkpoint_dir(df.sparkSession)
    # the slice number is stored with the rows: a task's own number changes with the plan
    ordered = (df.repartitionByRange(slices, F.col(key), *[F.col(c) for c in order])
               .sortWithinPartitions(key, *order)
               .withColumn(SLICE, F.spark_partition_id()).checkpoint(eager=True))
    if fold.states:
        starts = _linked(_slice_maps(ordered, fold, key), fold)
    elif fold.summary:
        starts = _applied(ordered, fold, key)
    else:
        ends, starts, pending = {}, {}, None
        while pending is None or pending:
            ends.update(_slice_ends(ordered, fold, key, starts, pending))
            starts, pending = _hand_over(ends, starts)
    run = _Run(fold, key)

    def emit(batches):
        for i, rest in _numbered(batches):
            yield from run(rest, starts.get(i))

    return ordered.mapInArrow(emit, schema)


def _numbered(batches):
    """(slice number, its batches without that column), once, or nothing for an empty slice."""
    batches = (b for b in batches if b.num_rows)
    head = next(batches, None)
    if head is not None:
        number = head.column(SLICE)[0].as_py()
        yield number, (b.drop_columns([SLICE]) for b in chain([head], batches))


def _slice_ends(ordered, fold, key, starts, only):
    """{slice: (first key, last key, last state)} of the slices in `only` (all when None)."""
    run = _Run(fold, key)

    def ends(batches):
        for i, rest in _numbered(batches):
            if only is not None and i not in only:
                return
            for _ in run(rest, starts.get(i)):
                pass
            _, first, last, state = run.end
            yield _end_row(i, (first, last, state))

    return _end_rows(ordered, ends)


def _end_row(i, end):
    return pa.RecordBatch.from_pydict(
        {"slice": [i], "end": [pickle.dumps(end)]},
        schema=pa.schema([("slice", pa.int32()), ("end", pa.binary())]))


def _end_rows(ordered, ends):
    """{slice: end}: one small row per slice; keys and states keep their types."""
    rows = ordered.mapInArrow(ends, "slice int, end binary").collect()
    return {r["slice"]: pickle.loads(r["end"]) for r in rows}


def _slice_maps(ordered, fold, key):
    """{slice: (first key, last key, end states)}: one end state for each start state, or one
    alone where the slice ends in a later key than it starts with."""
    def ends(batches):
        for i, rest in _numbered(batches):
            first, last, now, seen = None, None, [None, *fold.states], False
            for batch in rest:
                for k, *row in zip(batch.column(key).to_pylist(),
                                   *[batch.column(c).to_pylist() for c in fold.inputs]):
                    if not seen:
                        first, last, seen = k, k, True
                    elif k != last:
                        last, now = k, [None]
                    now = [fold.step(s, *row)[0] for s in now]
            yield _end_row(i, (first, last, now))

    return _end_rows(ordered, ends)


def _linked(maps, fold):
    """{slice: (key, state) before its first row}."""
    starts, before = {}, None
    places = {s: n for n, s in enumerate((None, *fold.states))}
    for i in sorted(maps):
        first, last, ends = maps[i]
        state = None
        if before is not None and before[0] == first:
            starts[i] = before
            state = before[1]
        before = (last, ends[places[state]] if len(ends) > 1 else ends[0])
    return starts


def _slice_functions(ordered, fold, key):
    """{slice: (first key, last key, function or None, end state)}: the end state where the slice
    ends in a later key than it starts with."""
    def ends(batches):
        for i, rest in _numbered(batches):
            first, last, state, summary = None, None, None, None
            for batch in rest:
                for k, *row in zip(batch.column(key).to_pylist(),
                                   *[batch.column(c).to_pylist() for c in fold.inputs]):
                    if summary is None:
                        first, last, summary = k, k, fold.summary()
                    elif k != last:
                        last, state = k, None
                    if first == last:
                        summary.row(*row)
                    else:
                        state = fold.step(state, *row)[0]
            yield _end_row(i, (first, last, summary.function() if first == last else None, state))

    return _end_rows(ordered, ends)


def _applied(ordered, fold, key):
    """{slice: (key, state) before its first row}, one function after the other."""
    functions = _slice_functions(ordered, fold, key)
    starts, before = {}, None
    for i in sorted(functions):
        first, last, function, state = functions[i]
        same = before is not None and before[0] == first
        if same:
            starts[i] = before
        if first == last:
            start = before[1] if same else None
            if function is None:
                state = _slice_ends(ordered, fold, key, starts, {i})[i][2]
            else:
                state = fold.applied(function, start)
        before = (last, state)
    return starts


def _hand_over(ends, starts):
    """New start state per slice, and the slices whose outcome depends on a changed start."""
    fresh, pending = {}, set()
    previous = None
    for i in sorted(ends):
        first, last, _ = ends[i]
        if previous is not None and previous[0] == first:
            fresh[i] = (first, previous[1])
            # a slice that ends in a later key ends the same whatever it started from
            if starts.get(i) != fresh[i] and first == last:
                pending.add(i)
        previous = (last, ends[i][2])
    return fresh, pending

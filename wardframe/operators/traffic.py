"""Per-key traffic control: token bucket, violation points, abuse score, cooldown, guard.

Inputs carry key_id, us (microseconds), seq; (us, seq) orders the rows of a key.
"""

from bisect import bisect_left
from fractions import Fraction
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ensure_checkpoint_dir
from .replay import MAX_GROUP_ROWS, SLICE_ROWS, Fold, replay
from .scan import _with
from .sequence import DAY_US, HOUR_US, with_chunk  # noqa: F401

ORDER = ("us", "seq")
CHAT_PATH = "/v1/chat/completions"
RAG_CHAT_PATH = "/v1/rag/chat"

# Service settings.
CAPACITY = 20
RATE = 5.0
THRESHOLD = 5
COOLDOWN_US = 30_000_000
DECAY_US = 30_000_000
# Points of a violation.
LIMIT_POINTS = 1
BLOCK_POINTS = 3

_NS = 1_000_000_000


def _fields(*pairs) -> T.StructType:
    kinds = {"bool": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(),
             "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in pairs])


class _Bucket:
    """Token counts as whole numbers of a unit, so that a microsecond adds a whole number too.

    The rate counts as the nearest fraction with a denominator of at most a million: 5.0, 0.3 and
    1 / 43200 are what they say, and a count fits into 64 bits for any capacity below nine million.
    """

    def __init__(self, capacity, rate):
        rate = Fraction(rate).limit_denominator(1_000_000)
        self.step, self.one = rate.numerator, 1_000_000 * rate.denominator
        self.full = int(Fraction(capacity) * self.one)

    def filled(self, tokens, refilled, us):
        """Units at a moment."""
        if tokens is None:
            return self.full
        return min(tokens + max(us - refilled, 0) * self.step, self.full)

    def take(self, tokens, refilled, us):
        """One decision: (allowed, units, refilled, retry in ns)."""
        tokens = self.filled(tokens, refilled, us)
        refilled = us if refilled is None else max(us, refilled)
        if tokens >= self.one:
            return True, tokens - self.one, refilled, 0
        if self.step <= 0:
            return False, tokens, refilled, _NS
        return False, tokens, refilled, max((self.one - tokens) * 1000 // self.step, 1_000_000)

    def tokens(self, units):
        return None if units is None else units / self.one


class _BucketSummary:
    """The bucket over a slice as a function of the units at its first row, x.

    The function is piecewise: on each interval of x the bucket ends with x plus a number, or, where
    it was full on the way, with a constant. An interval is cut where a refill reaches the brim and
    where a decision turns; neighbours that move alike again are one. A slice whose function has
    more than `MOST` pieces is not summed up.
    """

    MOST = 256

    def __init__(self, bucket, most=MOST):
        self.bucket, self.most, self.first, self.at = bucket, most, None, None
        self.pieces = [(0, bucket.full, True, 0)]  # first and last x, moves with x, by how much

    def row(self, us):
        full, one = self.bucket.full, self.bucket.one
        if self.first is None:
            self.first = self.at = us
        add, self.at = max(us - self.at, 0) * self.bucket.step, max(us, self.at)
        if self.pieces is None:
            return
        out = []

        def put(low, high, moves, value):
            if low > high:
                return
            if out and out[-1][2:] == (moves, value):
                out[-1] = (out[-1][0], high, moves, value)
            else:
                out.append((low, high, moves, value))

        for low, high, moves, value in self.pieces:
            if not moves:
                value = min(value + add, full)
                put(low, high, False, value - one if value >= one else value)
                continue
            value += add
            brim, turn = min(high, full - value - 1), one - value
            put(low, min(brim, turn - 1), True, value)
            put(max(low, turn), brim, True, value - one)
            put(max(low, brim + 1), high, False, full - one if full >= one else full)
        self.pieces = out if len(out) <= self.most else None

    def function(self):
        return self.pieces and (self.first, self.at, self.pieces)

    @staticmethod
    def applied(bucket, function, state):
        first, at, pieces = function
        x = bucket.filled(*(state or (None, None)), first)
        _, _, moves, value = pieces[bisect_left([p[1] for p in pieces], x)]
        return (x + value if moves else value), at


def _whole_seconds(ns):
    return max((ns + _NS // 2) // _NS, 1)


def bucket_fold(capacity=CAPACITY, rate=RATE) -> Fold:
    bucket = _Bucket(capacity, rate)

    def step(state, us):
        allowed, tokens, refilled, retry = bucket.take(*(state or (None, None)), us)
        seconds = None if allowed else _whole_seconds(retry)
        return (tokens, refilled), (allowed, bucket.tokens(tokens), seconds)

    return Fold(("us",), _fields(("allowed", "bool"), ("tokens", "double"),
                                 ("retry_after_seconds", "long")), step,
                "tokens bigint, refilled bigint", (),
                partial(_BucketSummary, bucket, _BucketSummary.MOST),
                partial(_BucketSummary.applied, bucket))


def rate_limit(requests: DataFrame, capacity=CAPACITY, refill_per_second=RATE,
               max_group_rows=MAX_GROUP_ROWS, slices=None) -> DataFrame:
    """Append allowed, tokens (after the decision) and retry_after_seconds."""
    return replay(requests, bucket_fold(capacity, refill_per_second), "key_id", ORDER,
                  max_group_rows, slices)


def points(path="path", status="status") -> Column:
    """Violation points of a response."""
    path, status = F.col(path), F.col(status)
    return (F.when(status == 429, LIMIT_POINTS)
            .when((status == 403) & path.isin(CHAT_PATH, RAG_CHAT_PATH), BLOCK_POINTS)
            .otherwise(0))


def points_reason(path="path", status="status") -> Column:
    path, status = F.col(path), F.col(status)
    return (F.when(status == 429, "rate_limit_violation")
            .when((status == 403) & (path == CHAT_PATH), "chat_security_block")
            .when((status == 403) & (path == RAG_CHAT_PATH), "rag_security_block")
            .otherwise(""))


def violation_points(responses: DataFrame, path="path", status="status") -> DataFrame:
    return _with(responses, points=points(path, status), reason=points_reason(path, status))


def abuse_score(violations: DataFrame, decay_us=DECAY_US, chunk_us=HOUR_US,
                max_group_rows=MAX_GROUP_ROWS, slices=None) -> DataFrame:
    """Append the decayed score after each recorded violation(key_id, us, seq, points).

    The recurrence s = max(0, s - floor(gap / decay)) + p is a running sum with a floor at zero:
    with U the sum of earlier points less the decays up to now, s = U - min(0, lowest U) + p. Both
    running values are taken per (key, chunk); one summary row per chunk, its sum and its lowest
    point, links the chunks, so a key is never gathered into one task. A chunk is a stretch of
    time; keys with a chunk of more than `max_group_rows` rows have slices of equally many rows
    instead, however close together these lie.
    """
    df = with_chunk(violations, "us", chunk_us)
    crowded = df.groupBy("key_id", "_chunk").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > max_group_rows)
    if crowded.isEmpty():
        return _scores(df, violations.columns, decay_us)
    hot = crowded.select(F.col("key_id").alias("_hot")).distinct()
    is_hot = F.col("key_id").eqNullSafe(F.col("_hot"))  # the null key may be a hot one
    cold = df.join(hot, is_hot, "left_anti").select(df.columns)
    sliced = _equal_slices(violations.join(hot, is_hot, "left_semi").select(violations.columns),
                           slices)
    return _scores(cold, violations.columns, decay_us).unionByName(
        _scores(sliced, violations.columns, decay_us))


def _equal_slices(df: DataFrame, slices=None) -> DataFrame:
    """The rows with a `_chunk`: ranges of (key, time) of about equally many rows, kept with the
    rows, as a task's own number changes with the plan."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = slices or max(-(-df.count() // SLICE_ROWS),
                      int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _with(df.repartitionByRange(n, "key_id", *ORDER), _chunk=F.spark_partition_id().cast(
        "long")).checkpoint(eager=True)


def _scores(df: DataFrame, columns, decay_us) -> DataFrame:
    """`abuse_score` of rows with chunks."""
    place = F.struct(*ORDER)
    chunk = Window.partitionBy("key_id", "_chunk").orderBy(*ORDER)
    upto = chunk.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("us") - F.lag("us").over(chunk)
    df = _with(df, _move=F.coalesce(
        F.lag("points").over(chunk) - _steps(gap, decay_us), F.lit(0)).cast("long"))
    df = _with(df, _sum=F.sum("_move").over(upto))
    df = _with(df, _low=F.min("_sum").over(upto))

    heads = df.groupBy("key_id", "_chunk").agg(
        F.min("us").alias("_from"), F.max("us").alias("_to"),
        F.max_by("points", place).alias("_pts"), F.max_by("_sum", place).alias("_total"),
        F.min("_sum").alias("_dip"))
    line = Window.partitionBy("key_id").orderBy("_chunk")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.col("_from") - F.lag("_to").over(line)
    heads = _with(heads, _edge=F.coalesce(
        F.lag("_pts").over(line) - _steps(edge, decay_us), F.lit(0)).cast("long"))
    heads = _with(heads, _base=F.sum("_edge").over(
        line.rowsBetween(Window.unboundedPreceding, 0))
        + F.coalesce(F.sum("_total").over(before), F.lit(0)))
    heads = heads.select("key_id", "_chunk", "_base", F.coalesce(
        F.min(F.col("_base") + F.col("_dip")).over(before), F.lit(0)).alias("_past"))

    same = df["key_id"].eqNullSafe(heads["key_id"]) & (df["_chunk"] == heads["_chunk"])
    df = df.join(heads, same, "left").drop(heads["key_id"], heads["_chunk"])
    u = F.col("_base") + F.col("_sum")
    floor = F.least(F.lit(0), F.col("_past"), F.col("_base") + F.col("_low"))
    return df.select(*[F.col(c) for c in columns],
                     (u - floor + F.col("points")).cast("int").alias("score"))


def _steps(gap: Column, decay_us: int) -> Column:
    """Whole decay periods in a gap of microseconds; none when there is no decay."""
    if decay_us <= 0:
        return F.lit(0).cast("long")
    return ((gap - F.pmod(gap, F.lit(decay_us))) / decay_us).cast("long")


class _CooldownSummary:
    """Cooldowns over a slice as a step function of the `until` that it starts with.

    A row that may start a cooldown does so for every start whose cooldown is over by then. Starts
    that ever share a cooldown stay together, so they form classes, joined as rows go by. Starts
    that no such row has reached are still what they were; none lies further ahead of the first
    row than a cooldown lasts.
    """

    MOST = 4096  # steps of a function that is small enough to hand over

    def __init__(self, threshold, cooldown_us, most=MOST):
        self.threshold, self.cooldown, self.most = threshold, cooldown_us, most
        self.first, self.bounds, self.joined, self.open = None, [], [], []

    def row(self, us, score):
        if self.first is None:
            self.first = us
        if score < self.threshold:
            return
        over = [k for k in self.open if k[0] <= us]
        new = not self.bounds or (self.bounds[-1] < us
                                  and self.bounds[-1] < self.first + self.cooldown)
        if not over and not new:
            return
        root = over[0][1] if over else len(self.bounds)
        for _, other in over[1:]:
            self.joined[other] = root
        if new:  # starts up to this row, from the last such row on
            self.bounds.append(us)
            self.joined.append(root)
        # a cooldown that starts later ends later: the open ones stay in order
        self.open = self.open[len(over):] + [(us + self.cooldown, root)]

    def _root(self, k):
        while self.joined[k] != k:
            self.joined[k] = k = self.joined[self.joined[k]]
        return k

    def function(self):
        ends = {root: until for until, root in self.open}
        steps = []
        for k, bound in enumerate(self.bounds):
            end = ends[self._root(k)]
            if steps and steps[-1][1] == end:
                steps[-1] = (bound, end)
            else:
                steps.append((bound, end))
        return steps if len(steps) <= self.most else None

    @staticmethod
    def applied(steps, state):
        (until,) = state or (None,)
        at = 0 if until is None else bisect_left([s[0] for s in steps], until)
        return (steps[at][1] if at < len(steps) else until,)


def cooldown_fold(threshold=THRESHOLD, cooldown_us=COOLDOWN_US) -> Fold:
    def step(state, us, score):
        (until,) = state or (None,)
        blocked = until is not None and us < until
        entered = score >= threshold and not blocked
        if entered:
            until = us + cooldown_us
        return (until,), (entered, until)

    return Fold(("us", "score"), _fields(("entered", "bool"), ("cooldown_until_us", "long")),
                step, "until bigint", (),
                partial(_CooldownSummary, threshold, cooldown_us, _CooldownSummary.MOST),
                _CooldownSummary.applied)


def cooldowns(scored: DataFrame, threshold=THRESHOLD, cooldown_us=COOLDOWN_US,
              max_group_rows=MAX_GROUP_ROWS, slices=None, counted=None) -> DataFrame:
    """Append entered and cooldown_until_us to scored violations.

    `counted`, the violations before scoring, spares scoring them once more for their number."""
    return replay(scored, cooldown_fold(threshold, cooldown_us), "key_id", ORDER,
                  max_group_rows, slices, counted)


class _Tracker:
    """Abuse state of one key as (score, updated, until); None stands for no state yet."""

    def __init__(self, threshold, cooldown_us, decay_us):
        self.threshold, self.cooldown, self.decay = threshold, cooldown_us, decay_us

    def decayed(self, score, updated, us):
        if self.decay > 0 and us - updated >= self.decay:
            steps = (us - updated) // self.decay
            return max(score - steps, 0), updated + steps * self.decay
        return score, updated

    def check(self, score, updated, until, us):
        """(blocked, score, updated, until) at a request."""
        if updated is None:
            return False, 0, None, None
        score, updated = self.decayed(score, updated, us)
        if until is not None and us < until:
            return True, score, updated, until
        return False, score, updated, None

    def add(self, score, updated, until, us, pts):
        """(entered, score, updated, until) after a violation."""
        if updated is None:
            score, updated = 0, us
        score, _ = self.decayed(score, updated, us)
        score += pts
        if score >= self.threshold and (until is None or us >= until):
            return True, score, us, us + self.cooldown
        return False, score, us, until


def gate_fold(threshold=THRESHOLD, cooldown_us=COOLDOWN_US, decay_us=DECAY_US) -> Fold:
    tracker = _Tracker(threshold, cooldown_us, decay_us)

    def step(state, us, pts):
        score, updated, until = state or (0, None, None)
        blocked, score, updated, until = tracker.check(score, updated, until, us)
        if blocked:
            return (score, updated, until), (
                True, _whole_seconds((until - us) * 1000), score, until)
        if pts:
            _, score, updated, until = tracker.add(score, updated, until, us, pts)
        return (score, updated, until), (False, None, score, until)

    return Fold(("us", "points"), _fields(
        ("blocked", "bool"), ("retry_after_seconds", "long"), ("score", "int"),
        ("cooldown_until_us", "long")), step, "score int, updated bigint, until bigint")


def gate(requests: DataFrame, threshold=THRESHOLD, cooldown_us=COOLDOWN_US, decay_us=DECAY_US,
         max_group_rows=MAX_GROUP_ROWS, slices=None) -> DataFrame:
    """Cooldown gate over requests whose points are known should they be admitted.

    Appends blocked, retry_after_seconds, score and cooldown_until_us after the request.
    """
    return replay(requests, gate_fold(threshold, cooldown_us, decay_us), "key_id", ORDER,
                  max_group_rows, slices)


def guard_fold(capacity=CAPACITY, rate=RATE, threshold=THRESHOLD, cooldown_us=COOLDOWN_US,
               decay_us=DECAY_US) -> Fold:
    """Gate, then bucket, then the handler's status, then points, score and cooldown."""
    tracker, bucket = _Tracker(threshold, cooldown_us, decay_us), _Bucket(capacity, rate)
    # Reasons and outcomes.
    violations = {CHAT_PATH: "chat_security_block", RAG_CHAT_PATH: "rag_security_block"}

    def step(state, us, path, handler_status):
        tokens, refilled, score, updated, until = state or (None, None, 0, None, None)
        blocked, score, updated, until = tracker.check(score, updated, until, us)
        if blocked:
            wait = _whole_seconds((until - us) * 1000)
            return (tokens, refilled, score, updated, until), (
                "COOLDOWN_BLOCKED", 429, wait, bucket.tokens(tokens), 0, "", score, False, until, updated)
        allowed, tokens, refilled, retry = bucket.take(tokens, refilled, us)
        if allowed:
            outcome, status, wait = "ADMITTED", handler_status, None
            reason = violations.get(path, "") if status == 403 else ""
            pts = BLOCK_POINTS if reason else 0
            if status == 429:
                pts, reason = LIMIT_POINTS, "rate_limit_violation"
        else:
            outcome, status, wait = "RATE_LIMITED", 429, _whole_seconds(retry)
            pts, reason = LIMIT_POINTS, "rate_limit_violation"
        entered = False
        if pts:
            entered, score, updated, until = tracker.add(score, updated, until, us, pts)
        return (tokens, refilled, score, updated, until), (
            outcome, status, wait, bucket.tokens(tokens), pts, reason, score, entered, until, updated)

    return Fold(("us", "path", "handler_status"), _fields(
        ("outcome", "string"), ("status", "int"), ("retry_after_seconds", "long"),
        ("tokens", "double"), ("points", "int"), ("reason", "string"), ("score", "int"),
        ("entered", "bool"), ("cooldown_until_us", "long"), ("updated_us", "long")), step,
        "tokens bigint, refilled bigint, score int, updated bigint, until bigint")


def traffic_guard(requests: DataFrame, capacity=CAPACITY, refill_per_second=RATE,
                  threshold=THRESHOLD, cooldown_us=COOLDOWN_US, decay_us=DECAY_US,
                  max_group_rows=MAX_GROUP_ROWS, slices=None) -> DataFrame:
    """The whole guard over requests(key_id, us, seq, path, handler_status)."""
    fold = guard_fold(capacity, refill_per_second, threshold, cooldown_us, decay_us)
    return replay(requests, fold, "key_id", ORDER, max_group_rows, slices)


def abuse_events(guarded: DataFrame) -> DataFrame:
    """One row per event a guarded request causes, in the order they are written."""
    us = F.col("cooldown_until_us")
    until = F.concat(
        F.date_format(F.timestamp_micros(us).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"),
        F.regexp_replace(F.concat(F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0")),
                         r"\.?0+$", ""), F.lit("Z"))
    limited = F.col("outcome") == "RATE_LIMITED"

    def event(n, cond, name, details):
        return F.when(cond, F.struct(
            F.lit(n).alias("n"), F.lit(name).alias("event_type"), F.to_json(details).alias("d")))

    wait = F.col("retry_after_seconds")
    events = F.array_compact(F.array(
        event(0, F.col("outcome") == "COOLDOWN_BLOCKED", "ABUSE_COOLDOWN_BLOCKED",
              F.struct("score", wait)),
        event(1, limited, "RATE_LIMIT_EXCEEDED", F.struct(wait)),
        event(2, F.col("points") > 0, "ABUSE_SCORE_UPDATED",
              F.struct("score", "points", "reason", "status")),
        event(3, F.col("entered"), "ABUSE_COOLDOWN_STARTED",
              F.struct("score", until.alias("cooldown_until"), F.col("reason").alias("trigger"))),
    ))
    keep = [c for c in ("key_id", "us", "seq", "path", "key_name", "user_id", "role", "team")
            if c in guarded.columns]
    df = guarded.select(*keep, F.explode(events).alias("e"))
    return df.select(F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"),
                     *keep, F.col("e.n").alias("event_no"), "e.event_type",
                     F.col("e.d").alias("details"))


def identify_events(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Append key_name, user_id, role and team of each event's key; unknown keys have none."""
    who = keys.select(F.col("id").alias("key_id"), F.col("name").alias("key_name"), "user_id",
                      "role", "team")
    return events.join(who, "key_id", "left")


def abuse_state(guarded: DataFrame, at_us: int, decay_us=DECAY_US) -> DataFrame:
    """Stored state per key at a moment: the last row's state, decayed to that moment.

    Keys without a violation so far have no state. One row per key leaves the aggregation, with
    map-side combine. `stored_score` is the undecayed value.
    """
    past = guarded.filter((F.col("us") <= at_us) & F.col("updated_us").isNotNull())
    last = past.groupBy("key_id").agg(F.max_by(
        F.struct("score", "updated_us", "cooldown_until_us"), F.struct(*ORDER)).alias("s"))
    steps = _steps(F.lit(at_us) - F.col("s.updated_us"), decay_us)
    return last.select(
        "key_id", F.greatest(F.lit(0), F.col("s.score") - steps).cast("int").alias("score"),
        F.col("s.score").alias("stored_score"),
        (F.col("s.updated_us") + steps * decay_us).alias("last_updated_us"),
        F.col("s.cooldown_until_us").alias("cooldown_until_us"))


def list_abuse_state(state: DataFrame) -> DataFrame:
    """Highest score first, then by key."""
    return state.orderBy(F.col("score").desc(), F.col("key_id"))

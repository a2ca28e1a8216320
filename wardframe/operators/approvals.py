"""Approval life cycle: creation, replay of attempts, conflicts, events and lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import common
from .replay import Fold
from .replay import replay as replay_fold
from .scan import _once, _with

ADMIN = "admin"
#: Attempts of an approval up to which they are followed as one array.
MAX_GROUP_ROWS = 1024

# Scope that each kind of attempt needs. Results of an execution need none.
ATTEMPT_SCOPES = {"approve": "approvals:write", "reject": "approvals:write",
                  "claim": "tools:execute"}
# Status and event that an accepted attempt leads to.
NEXT_STATUS = {"approve": "APPROVED", "reject": "REJECTED", "claim": "EXECUTING",
               "finish": "EXECUTED", "fail": "APPROVED"}
STATUSES = ("PENDING", *dict.fromkeys(NEXT_STATUS.values()))
EVENTS = {"approve": "TOOL_APPROVED", "reject": "TOOL_REJECTED",
          "claim": "TOOL_EXECUTION_STARTED", "finish": "TOOL_EXECUTION_SUCCEEDED"}


def _lookup(key: Column, table: dict) -> Column:
    items = list(table.items())
    out = F.when(key == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(key == k, v)
    return out


def create_approvals(evaluated: DataFrame, id="call_id", ts="ts"):
    """(PENDING approvals, TOOL_APPROVAL_REQUESTED events) of the calls that need one."""
    need = evaluated.filter(F.col("decision") == "REQUIRE_APPROVAL")
    approvals = need.select(
        F.col(id).alias("approval_id"), F.col(ts).alias("created_at"), "tool", "arguments", "risk",
        "reason", F.lit("PENDING").alias("status"))
    events = need.select(
        F.col(ts).alias("timestamp"), F.col(id).alias("approval_id"),
        F.lit("TOOL_APPROVAL_REQUESTED").alias("event_type"), "tool", "risk",
        F.lit("PENDING").alias("status"), F.col("arguments").alias("details"))
    return approvals, events


def transition(status, action, valid):
    """Status after an attempt. Attempts that the current status does not admit change nothing."""
    if not valid:
        return status
    if status == "PENDING" and action in ("approve", "reject"):
        return NEXT_STATUS[action]
    if status == "APPROVED" and action == "claim":
        return "EXECUTING"
    if status == "EXECUTING" and action in ("finish", "fail"):
        return NEXT_STATUS[action]
    return status


def life_cycle_fold() -> Fold:
    def step(state, action, valid):
        prior = state[0] if state else "PENDING"
        after = transition(prior, action, valid)
        return (after,), (prior, after)

    return Fold(("action", "valid"), T.StructType([
        T.StructField("prior_status", T.StringType()),
        T.StructField("new_status", T.StringType())]), step, "status string",
        tuple((s,) for s in STATUSES))


def with_validity(attempts: DataFrame) -> DataFrame:
    """Append scope_ok, role_ok and valid: may this actor make this attempt at all."""
    need = _lookup(F.col("action"), ATTEMPT_SCOPES)
    scoped = need.isNull() | common.has_scope(common.split_scopes("actor_scopes"), need)
    admin = need.isNull() | (F.col("actor_role") == ADMIN)
    df = _once(attempts, scope_ok=F.coalesce(scoped, F.lit(False)),
               role_ok=F.coalesce(admin, F.lit(False)))
    return _with(df, valid=F.col("scope_ok") & F.col("role_ok"))


def conflict_reason() -> Column:
    """Why an attempt is refused, in the order of the checks; NULL when it is accepted."""
    action, status, known = F.col("action"), F.col("prior_status"), F.col("known")
    resolving, ending = action.isin("approve", "reject"), action.isin("finish", "fail")
    need = _lookup(action, ATTEMPT_SCOPES)
    # Texts of the refusals.
    return (
        F.when(~F.col("scope_ok"), F.concat(F.lit("required scope: "), need))
        .when(~F.col("role_ok"), "admin role required")
        .when(resolving & (~known | (status != "PENDING")),
              "approval not found or already resolved")
        .when(~known, "approval not found")
        .when((action == "claim") & (status == "EXECUTED"), "approval already executed")
        .when((action == "claim") & (status == "EXECUTING"),
              "approval execution already in progress")
        .when((action == "claim") & (status != "APPROVED"),
              "approval must be APPROVED before execution")
        .when(ending & (status != "EXECUTING"), "no execution in progress"))


def _next_status(status: Column, action: Column, valid: Column) -> Column:
    """`transition` as a column."""
    out = F.when(~valid, status)
    for before, actions in (("PENDING", ("approve", "reject")), ("APPROVED", ("claim",)),
                            ("EXECUTING", ("finish", "fail"))):
        for a in actions:
            out = out.when((status == before) & (action == a), NEXT_STATUS[a])
    return out.otherwise(status)


def _followed(df: DataFrame, order) -> DataFrame:
    """Append prior_status and new_status to the attempts of approvals with few of them: each
    approval's attempts in order are one array, which `aggregate` walks through."""
    rest = [c for c in df.columns if c not in order]
    grouped = df.groupBy("approval_id").agg(
        F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_rows"))

    def step(acc, row):
        after = _next_status(acc["s"], row["action"], row["valid"])
        return F.struct(after.alias("s"), F.concat(acc["seen"], F.array(
            F.struct(acc["s"].alias("prior"), after.alias("new")))).alias("seen"))

    start = F.struct(F.lit("PENDING").alias("s"),
                     F.array().cast("array<struct<prior: string, new: string>>").alias("seen"))
    walked = grouped.select("_rows", F.aggregate("_rows", start, step,
                                                 lambda acc: acc["seen"]).alias("_seen"))
    each = walked.select(F.explode(F.arrays_zip("_rows", "_seen")).alias("e"))
    return each.select(*[F.col(f"e._rows.{c}").alias(c) for c in df.columns],
                       F.col("e._seen.prior").alias("prior_status"),
                       F.col("e._seen.new").alias("new_status"))


def classify_attempts(approvals: DataFrame, attempts: DataFrame, order,
                      max_group_rows=MAX_GROUP_ROWS, slices=None) -> DataFrame:
    """Append known, prior_status, accepted, conflict and new_status to every attempt.

    attempts(approval_id, action, actor_role, actor_scopes as comma text, and the order columns).
    Attempts on unknown approvals have no state. The attempts of an approval meet in one array over
    one exchange; approvals with more than `max_group_rows` attempts are replayed as sorted rows
    instead, over slices if need be (see `operators.replay`).
    """
    fold = life_cycle_fold()
    known = approvals.select("approval_id")
    real = with_validity(_with(attempts.join(known, "approval_id", "left_semi").select(
        attempts.columns), known=F.lit(True)))
    hot = attempts.groupBy("approval_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > max_group_rows).select("approval_id")
    if hot.isEmpty():
        df = _followed(real, order)
    else:
        df = _followed(real.join(hot, "approval_id", "left_anti").select(real.columns), order)
        df = df.unionByName(replay_fold(
            real.join(hot, "approval_id", "left_semi").select(real.columns), fold, "approval_id",
            order, max_group_rows, slices))
    df = _with(df, conflict=conflict_reason())
    df = _with(df, accepted=F.col("conflict").isNull())
    # what has no approval is never accepted: readers of accepted attempts do not touch it
    unknown = with_validity(_with(attempts.join(known, "approval_id", "left_anti").select(
        attempts.columns), known=F.lit(False)))
    unknown = unknown.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fold.outputs.fields])
    unknown = _with(unknown, conflict=conflict_reason(), accepted=F.lit(False))
    out = [*attempts.columns, "known", "prior_status", "accepted", "conflict", "new_status"]
    return df.select(out).unionByName(unknown.select(out))


def replay(approvals: DataFrame, classified: DataFrame, order, ts="ts") -> DataFrame:
    """Approvals with their final status and execution time."""
    done = classified.filter("accepted").groupBy("approval_id").agg(
        F.max_by("new_status", F.struct(*order)).alias("_status"),
        F.max(F.when(F.col("action") == "finish", F.col(ts))).alias("executed_at"))
    return approvals.join(done, "approval_id", "left").select(
        *[F.coalesce("_status", "status").alias(c) if c == "status" else F.col(c)
          for c in approvals.columns], "executed_at")


def transition_events(approvals: DataFrame, classified: DataFrame, ts="ts",
                      actor=("actor_role",)) -> DataFrame:
    """Events of the accepted attempts. A failed execution leaves none.

    Details hold the actor, whose columns are named without their `actor_`, the arguments of a
    resolved call, and the result (as JSON) of a successful execution where the attempts have one.
    """
    hit = classified.filter(F.col("accepted") & (F.col("action") != "fail"))
    carried = [c for c in ("arguments",) if c in approvals.columns]
    hit = hit.join(approvals.select("approval_id", "tool", "risk", *carried), "approval_id")
    action, parts = F.col("action"), []

    def named(name, text, cond):  # the text is JSON already
        parts.append(F.coalesce(F.when(cond, F.concat(F.lit(f'"{name}":'), text, F.lit(","))),
                                F.lit("")))

    if carried:
        named("arguments", F.col("arguments"), action.isin("approve", "reject"))
    if "result" in classified.columns:
        named("result", F.col("result"), action == "finish")
    who = F.to_json(F.struct(*[F.col(c).alias(c.removeprefix("actor_")) for c in actor]))
    return hit.select(
        F.col(ts).alias("timestamp"), "approval_id",
        _lookup(F.col("action"), EVENTS).alias("event_type"), "tool", "risk",
        F.col("new_status").alias("status"), 
        F.concat(F.lit("{"), *parts, F.lit('"actor":'), who, F.lit("}")).alias("details"))


def pending(approvals: DataFrame) -> DataFrame:
    return approvals.filter(F.col("status") == "PENDING").orderBy(F.col("approval_id").desc())


def active(approvals: DataFrame) -> DataFrame:
    return approvals.filter(
        F.col("status").isin("PENDING", "APPROVED", "EXECUTING") & F.col("executed_at").isNull()
    ).orderBy(F.col("approval_id").desc())


def by_id(approvals: DataFrame, approval_id) -> DataFrame:
    return approvals.filter(F.col("approval_id") == approval_id)


def timeline(events: DataFrame, approval_id=None, order=("id",)) -> DataFrame:
    """Events of one approval, or of all, oldest first."""
    if approval_id is not None:
        events = events.filter(F.col("approval_id") == approval_id)
    return events.orderBy("approval_id", *order)

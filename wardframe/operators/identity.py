"""Credentials: resolution, scopes, provisioning, revocation and lookup."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import common
from .scan import _with

# Guarded routes (method, path, required scope; NULL = any identity).
ROUTES = (
    ("POST", "/v1/chat/completions", None),
    ("GET", "/v1/audit/events", "audit:read"),
    ("GET", "/v1/audit/stats", "audit:read"),
    ("GET", "/v1/audit/auth-events", "audit:read"),
    ("GET", "/v1/audit/abuse-events", "audit:read"),
    ("POST", "/v1/tools/evaluate", "tools:evaluate"),
    ("GET", "/v1/approvals", "audit:read"),
    ("POST", "/v1/approvals/{id}/approve", "approvals:write"),
    ("POST", "/v1/approvals/{id}/reject", "approvals:write"),
    ("POST", "/v1/approvals/{id}/execute", "tools:execute"),
    ("GET", "/v1/approvals/{id}/events", "audit:read"),
    ("GET", "/v1/keys", "keys:manage"),
    ("POST", "/v1/keys", "keys:manage"),
    ("POST", "/v1/keys/{id}/revoke", "keys:manage"),
    ("GET", "/v1/security/posture", "audit:read"),
    ("GET", "/v1/evals/latest", "evals:read"),
    ("POST", "/v1/rag/inspect", "rag:inspect"),
    ("POST", "/v1/rag/context", "rag:context"),
    ("POST", "/v1/rag/chat", "rag:chat"),
    ("GET", "/v1/rag/requests/{request_id}/provenance", "audit:read"),
)


def routes(spark: SparkSession) -> DataFrame:
    """The route table: twenty fixed rows, safe to broadcast."""
    return spark.createDataFrame(list(ROUTES), "method string, path string, scope string")


def resolve(requests: DataFrame, keys: DataFrame, raw_key="raw_key", ts="ts") -> DataFrame:
    """Append the identity behind a raw key, or the reason there is none.

    A plain equi join on the hash: the adaptive planner broadcasts a small key table and splits a
    hot key otherwise. `revoked_at` and `expires_at` are judged at request time, so a key that is
    revoked later still resolves for earlier requests.
    """
    k = keys.select(
        F.col("key_hash").alias("_hash"), F.col("id").alias("key_id"),
        F.col("name").alias("key_name"), "user_id", "role", "team",
        F.col("scopes").alias("_scopes"), F.col("expires_at").alias("_exp"),
        F.col("revoked_at").alias("_rev"))
    df = _with(requests, _hash=common.key_hash(raw_key)).join(k, "_hash", "left")
    df = _with(df, reason=F.when(F.col("key_id").isNull(), "invalid API key")
               .when(F.col("_rev") <= F.col(ts), "API key revoked")
               .when(F.col(ts) > F.col("_exp"), "API key expired"))
    ok = F.col("reason").isNull()
    return df.select(
        *[F.col(c) for c in requests.columns],
        *[F.when(ok, F.col(c)).alias(c)
          for c in ("key_id", "key_name", "user_id", "role", "team")],
        F.when(ok, common.split_scopes("_scopes")).alias("scopes"),
        ok.alias("authenticated"), "reason")


def require_scope(requests: DataFrame, route_table: DataFrame) -> DataFrame:
    """Append whether an identity's scopes admit the request's route, and why not.

    Identity columns as `resolve` appends them; a NULL scope list means no identity.
    """
    r = route_table.select("method", "path", F.col("scope").alias("required_scope"))
    df = requests.join(r, ["method", "path"], "left")
    allowed = F.col("scopes").isNotNull() & (
        F.col("required_scope").isNull()
        | F.coalesce(common.has_scope("scopes", "required_scope"), F.lit(False)))
    df = _with(df, allowed=allowed)
    return _with(
        df,
        status=F.when(F.col("scopes").isNull(), 401).when(F.col("allowed"), 200).otherwise(403),
        scope_reason=F.when(F.col("scopes").isNull(), "authenticated identity unavailable")
        .when(~F.col("allowed"), F.concat(F.lit("required scope: "), F.col("required_scope"))))


def provision_keys(requests: DataFrame, ts="ts"):
    """(key rows, API_KEY_CREATED events) for creation requests that carry their raw key.

    Needs id, name, raw_key, user_id, role, team, scopes (array), expires_in_hours, actor.
    """
    df = _with(requests, expires_at=F.when(
        F.col("expires_in_hours") > 0,
        F.col(ts) + F.make_dt_interval(hours=F.col("expires_in_hours"))))
    keys = df.select(
        "id", "name", common.key_hash("raw_key").alias("key_hash"), "user_id", "role", "team",
        F.array_join("scopes", ",").alias("scopes"), "expires_at",
        F.lit(None).cast(requests.schema[ts].dataType).alias("revoked_at"),
        F.col(ts).alias("created_at"))
    events = df.select(
        F.col(ts).alias("timestamp"), F.lit("API_KEY_CREATED").alias("event_type"),
        F.col("id").alias("key_id"), F.col("name").alias("key_name"),
        common.json_or_null("actor").alias("actor"),
        F.to_json(F.struct("user_id", "role", "team", "scopes", "expires_at"),
                  {"ignoreNullFields": "false"}).alias("details"))
    return keys, events


def apply_revocations(keys: DataFrame, revocations: DataFrame, ts="ts"):
    """(keys, API_KEY_REVOKED events, requests without effect).

    Revocations name a key by `key_id`, or by `raw_key` when `key_id` is NULL. The first one
    wins; later ones, ones for revoked keys and ones for unknown keys have no effect. They are
    reduced to one row per key before any join, with map-side combine. A revocation's `actor`
    goes into its event.
    """
    who = F.to_json("actor") if "actor" in revocations.columns else F.lit(None).cast("string")
    tagged = _with(revocations, _hash=common.key_hash("raw_key"), _actor=who)
    first = F.min(F.struct(F.col(ts), F.col("seq"), F.col("_actor"))).alias("_first")
    by_id = tagged.filter(F.col("key_id").isNotNull()).groupBy("key_id").agg(first)
    by_hash = (tagged.filter(F.col("key_id").isNull() & F.col("raw_key").isNotNull())
               .groupBy("_hash").agg(first))
    hashed = by_hash.join(keys.select("id", F.col("key_hash").alias("_hash")), "_hash")
    wins = (by_id.select(F.col("key_id").alias("id"), "_first")
            .unionByName(hashed.select("id", "_first"))
            .groupBy("id").agg(F.min("_first").alias("_first")))
    joined = keys.join(wins, "id", "left")
    effective = F.col("revoked_at").isNull() & F.col("_first").isNotNull()
    out = joined.select(*[
        F.coalesce("revoked_at", f"_first.{ts}").alias(c) if c == "revoked_at" else F.col(c)
        for c in keys.columns])
    hit = joined.filter(effective)
    events = hit.select(
        F.col(f"_first.{ts}").alias("timestamp"), F.lit("API_KEY_REVOKED").alias("event_type"),
        F.col("id").alias("key_id"), F.col("name").alias("key_name"),
        F.coalesce("_first._actor", F.lit("null")).alias("actor"),
        F.to_json(F.struct("user_id", "role", "team", "scopes")).alias("details"))
    refused = revocations.join(hit.select("_first.seq"), "seq", "left_anti")
    return out, events, refused


def list_keys(keys: DataFrame) -> DataFrame:
    """All keys without their hash, newest first."""
    return keys.drop("key_hash").orderBy(F.col("id").desc())


def latest_key_by_name(keys: DataFrame, name=None) -> DataFrame:
    """Newest key of each name, or of one name."""
    if name is not None:
        keys = keys.filter(F.col("name") == name)
    cols = [c for c in keys.columns if c not in ("key_hash",)]
    newest = keys.groupBy("name").agg(F.max_by(F.struct(*cols), "id").alias("_k"))
    return newest.select("_k.*")


def key_by_id(keys: DataFrame, key_id: int) -> DataFrame:
    return keys.drop("key_hash").filter(F.col("id") == key_id)

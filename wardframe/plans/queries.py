"""Registered queries: one callable per operator, with its SQL counterpart."""

from pyspark.sql import functions as F

from ..functions import common, sql
from ..operators import (approvals, audit, chat, evals, identity, retrieval, scan, state, tools,
                         traffic)
from ..operators.scan import _with
from ..sources import cases, event_tables, reports, requests, state_tables
from ..streaming import event_time, folds, run, scans
from . import fixtures as X
from . import oracle as O
from .session import new_folder

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _types(c="findings"):
    return F.array_join(F.transform(c, lambda f: f["type"]), ",")


def _matched(c="findings"):
    return F.array_join(F.transform(c, lambda f: f["matched"]), "|")


# --- content scans ---------------------------------------------------------------------------

@register("normalize_text", f"WITH {X.ATTACKED_SQL} SELECT conv_id, turn, "
                            f"{O.norm('text')} AS text_norm FROM attacked")
def normalize_text(spark, sf):
    return scan.normalize(X.attacked(spark, sf)).select("conv_id", "turn", "text_norm")


@register("rule_findings", f"WITH {X.ATTACKED_SQL}, {O.scan_cte('attacked', 'text')} "
          f"SELECT conv_id, turn, {O.types('list_filter(raw_findings, lambda v: v.rule_id < 9)')} "
          f"AS types FROM scanned")
def rule_findings(spark, sf):
    df = scan.scan_rules(X.attacked(spark, sf))
    return df.select("conv_id", "turn", _types().alias("types"))


@register("injection_findings", f"WITH {X.ATTACKED_SQL}, {O.scan_cte('attacked', 'text')} "
          f"SELECT conv_id, turn, {O.types()} AS types, {O.matched()} AS matched, "
          "fcount AS injection_count, fconf AS max_confidence FROM scanned")
def injection_findings(spark, sf):
    df = scan.scan_injection(X.attacked(spark, sf))
    return df.select("conv_id", "turn", _types().alias("types"), _matched().alias("matched"),
                     "injection_count", "max_confidence")


@register("encoded_injection", f"WITH {X.ATTACKED_SQL} SELECT conv_id, turn, "
                               f"{O.payload('text')} AS payload FROM attacked")
def encoded_injection(spark, sf):
    return scan.scan_encoded(X.attacked(spark, sf)).select("conv_id", "turn", "payload")


@register("benign_discussion", f"WITH {X.ATTACKED_SQL} SELECT conv_id, turn, "
                               f"{O.benign('text')} AS benign FROM attacked")
def benign_discussion(spark, sf):
    return scan.is_benign_discussion(X.attacked(spark, sf)).select("conv_id", "turn", "benign")


@register("pii_redaction", f"WITH {X.ATTACKED_DOCUMENTS_SQL}, "
          f"{O.pii_cte('attacked_documents', 'text')} "
          "SELECT doc_id, red AS redacted, array_to_string(pii, ',') AS types, "
          "CAST(pcount AS INTEGER) AS pii_count FROM redacted")
def pii_redaction(spark, sf):
    df = scan.redact_pii(X.attacked_documents(spark, sf))
    return df.select("doc_id", "redacted", _types("pii_findings").alias("types"), "pii_count")


@register("secret_scan", f"WITH {X.ATTACKED_SQL} SELECT conv_id, turn, {O.secret('text')} "
                         "AS secret_count FROM attacked")
def secret_scan(spark, sf):
    return scan.scan_secrets(X.attacked(spark, sf)).select("conv_id", "turn", "secret_count")


@register("output_scan", f"WITH {X.ATTACKED_SQL}, src AS (SELECT * FROM attacked "
          f"WHERE role = 'assistant'), {O.pii_cte('src', 'text')} "
          f"SELECT conv_id, turn, {O.secret('text')} = 0 AS safe, red AS redacted, "
          f"CAST(pcount AS INTEGER) AS pii_count, {O.secret('text')} AS secret_count "
          "FROM redacted")
def output_scan(spark, sf):
    df = scan.scan_output(X.attacked(spark, sf).filter("role = 'assistant'"))
    return df.select("conv_id", "turn", F.col("output_safe").alias("safe"),
                     F.col("output_redacted").alias("redacted"),
                     F.col("output_pii_count").alias("pii_count"),
                     F.col("output_secret_count").alias("secret_count"))


@register("line_filter", f"WITH {X.ATTACKED_DOCUMENTS_SQL} SELECT doc_id, "
                         f"{O.safe_lines('text')} AS safe_text FROM attacked_documents")
def line_filter(spark, sf):
    df = scan.drop_suspicious_lines(X.attacked_documents(spark, sf))
    return df.select("doc_id", "safe_text")


# --- chat ------------------------------------------------------------------------------------

def _chat_requests(spark, sf):
    """All messages of a conversation but its final answer, which is the model response."""
    return chat.assemble_exchange(X.attacked(spark, sf), "conv_id")


def _judged(spark, sf):
    return chat.judge_chat(_chat_requests(spark, sf))


@register("prompt_assembly", f"WITH {O.CHAT} SELECT conv_id, raw_prompt FROM chat")
def prompt_assembly(spark, sf):
    return _chat_requests(spark, sf).select("conv_id", "raw_prompt")


@register("risk_bands", f"WITH {O.CHAT} SELECT severity, decision, count(*) AS requests, "
          "sum(risk_score)::BIGINT AS score_sum FROM judged GROUP BY ALL")
def risk_bands(spark, sf):
    return _judged(spark, sf).groupBy("severity", "decision").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("risk_score").alias("score_sum"))


@register("chat_verdict", f"WITH {O.CHAT} SELECT conv_id, decision, risk_score, severity, "
          f"red AS sanitized_prompt, {O.types()} AS injection_types, sec AS secret_count, "
          f"CAST(pcount AS INTEGER) AS pii_count, {O.MESSAGE} AS message, "
          "CASE WHEN decision = 'BLOCK' THEN 403 ELSE 200 END AS status FROM judged")
def chat_verdict(spark, sf):
    return _judged(spark, sf).select(
        "conv_id", "decision", "risk_score", "severity", "sanitized_prompt",
        _types("injection_findings").alias("injection_types"), "secret_count", "pii_count",
        "message", "status")


@register("message_redaction", f"WITH {X.ATTACKED_SQL}, {O.pii_cte('attacked', 'text')} "
          "SELECT conv_id, turn, red AS redacted FROM redacted")
def message_redaction(spark, sf):
    return chat.redact_messages(X.attacked(spark, sf)).select("conv_id", "turn", "redacted")


@register("output_verdict", f"""WITH {O.CHAT} SELECT conv_id,
  CASE WHEN output_blocked THEN 'BLOCK' ELSE decision END AS final_decision,
  CASE WHEN output_blocked THEN 100 ELSE risk_score END AS final_risk_score,
  CASE WHEN output_blocked THEN 'CRITICAL' ELSE severity END AS final_severity,
  CASE WHEN output_blocked OR decision = 'BLOCK' THEN 403 WHEN failed THEN 502 ELSE 200 END
    AS final_status,
  CASE WHEN NOT output_blocked AND NOT failed AND decision <> 'BLOCK' THEN o_red END
    AS final_output,
  CASE WHEN decision = 'BLOCK' THEN {O.MESSAGE}
       WHEN failed THEN 'model provider request failed'
       WHEN output_blocked THEN 'model output blocked by security policy'
       WHEN o_pcount > 0 THEN 'request allowed after output redaction'
       ELSE {O.MESSAGE} END AS final_message FROM merged""")
def output_verdict(spark, sf):
    return chat.judge_output(_judged(spark, sf)).select(
        "conv_id", "final_decision", "final_risk_score", "final_severity", "final_status",
        "final_output", "final_message")


def _audit(spark, sf):
    """Audit rows with the conversation as id; latency stands for the prompt length."""
    df = _with(
        chat.judge_output(_judged(spark, sf)),
        request_id=F.concat(F.lit("req_"), F.col("conv_id").cast("string")),
        timestamp=F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")),
        provider=F.lit("mock"), model=F.lit("base"), latency_ms=F.length("raw_prompt"))
    rows = chat.to_audit_events(df)
    return _with(rows, id=F.substring_index("request_id", "_", -1).cast("long"))


@register("audit_projection", f"WITH {O.AUDIT} SELECT request_id, provider, model, decision, "
          "risk_score, severity, latency_ms, secret_findings, pii_findings, injection_findings, "
          "input_blocked AS no_output FROM audit")
def audit_projection(spark, sf):
    return _audit(spark, sf).select(
        "request_id", "provider", "model", "decision", "risk_score", "severity", "latency_ms",
        "secret_findings", "pii_findings", "injection_findings",
        (F.col("output_findings") == "null").alias("no_output"))


# --- sources and sinks -----------------------------------------------------------------------

@register("request_source", f"""WITH {X.ATTACKED_SQL}
SELECT 'req_' || CAST(conv_id AS VARCHAR) AS request_id, 'mock' AS provider,
       CAST(count(*) AS INTEGER) AS messages, sum(length(text))::BIGINT AS chars
FROM attacked GROUP BY conv_id""")
def request_source(spark, sf):
    """Conversations written as JSON lines and read back through the request source."""
    path = new_folder(spark, "requests")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    (X.attacked(spark, sf).groupBy("conv_id")
     .agg(F.sort_array(F.collect_list(message)).alias("messages"))
     .select(F.concat(F.lit("req_"), F.col("conv_id").cast("string")).alias("request_id"),
             F.lit("base").alias("model"), F.lit("").alias("provider"), "messages")
     .write.json(path))
    accepted, _ = requests.read_requests(spark, path)
    chars = F.aggregate("messages", F.lit(0).cast("long"),
                        lambda a, m: a + F.length(m["content"]))
    return accepted.select("request_id", "provider", F.size("messages").alias("messages"),
                           chars.alias("chars"))


@register("event_table", f"WITH {O.AUDIT} SELECT request_id, decision, risk_score, "
          "pii_findings FROM audit")
def event_table(spark, sf):
    """Audit rows appended to their date-partitioned table and read back."""
    folder = new_folder(spark, "events")
    event_tables.append_events(_audit(spark, sf), "audit_events", folder)
    return event_tables.read_events(spark, "audit_events", folder).select(
        "request_id", "decision", "risk_score", "pii_findings")


@register("event_mixed", f"WITH {O.AUDIT} SELECT request_id, decision, "
          "CASE WHEN length(request_id) % 2 = 0 THEN 1 ELSE 2 END AS arrival FROM audit")
def event_mixed(spark, sf):
    """One log, two writers: half of the rows as an append, the rest as a stream's batch that is
    delivered twice; `arrival` is the place of a row's append, which its id begins with."""
    folder, rows = new_folder(spark, "events"), _audit(spark, sf).drop("id")
    even = F.length("request_id") % 2 == 0
    write = event_tables.append_batch("audit_events", folder)
    event_tables.append_events(rows.filter(even), "audit_events", folder, 7)
    for _ in range(2):
        write(rows.filter(~even), 0)
    event_tables.append_events(rows.filter(even), "audit_events", folder, 7)
    return event_tables.read_events(spark, "audit_events", folder).select(
        "request_id", "decision", F.split("id", "-")[0].cast("int").alias("arrival"))


@register("event_newest", f"WITH {O.AUDIT} SELECT request_id, decision FROM audit "
                          "ORDER BY conv_id DESC LIMIT 100")
def event_newest(spark, sf):
    """The newest page of the event table, from as few dates as hold it: here twelve rows a day."""
    folder, rows = new_folder(spark, "events"), _audit(spark, sf)
    rows = _with(rows, timestamp=F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200))
    event_tables.append_events(rows.drop("id"), "audit_events", folder)
    return event_tables.newest_events(
        spark, "audit_events", folder, audit.page_limit(100, 100)).select("request_id", "decision")


def _stored(spark, events, table):
    """Events appended to their table, in a folder of its own, and read back."""
    folder = new_folder(spark, "events")
    event_tables.append_events(events, table, folder)
    return event_tables.read_events(spark, table, folder)


@register("case_source", f"""WITH {X.ATTACKED_SQL}
SELECT 'turn_' || conv_id || '_' || turn AS name, length(text) AS chars,
       CASE WHEN k IN {X.ATTACKS} THEN 'BLOCK' ELSE 'ALLOW' END AS expected,
       CASE WHEN k IN (11, 13) THEN 3 ELSE 0 END AS expected_redactions FROM attacked""")
def case_source(spark, sf):
    """Turns written as labelled cases and read back through the case source."""
    folder = new_folder(spark, "cases")
    turns = _with(X.attacked(spark, sf), name=F.concat_ws("_", F.lit("turn"), "conv_id", "turn"))
    turns.select("name", F.col("text").alias("input"), F.when(F.col("k").isin(*X.ATTACKS), "BLOCK")
                 .otherwise("ALLOW").alias("expected")).write.json(f"{folder}/injection.json")
    turns.select("name", F.col("text").alias("input"), F.when(F.col("k").isin(11, 13), 3)
                 .otherwise(0).alias("expected_redactions")).write.json(f"{folder}/pii.json")
    X.retrieval_requests(spark, sf).groupBy(
        F.format_string("request_%d", "request_id").alias("name"), "role", "team").agg(
        F.lit(0).alias("expected_included"), F.sort_array(F.collect_list(F.struct(
            "id", "source", "owner_team", "classification", "trust_level", "content",
            "allowed_roles"))).alias("documents")).write.json(f"{folder}/rag.json")
    injection, pii, _ = cases.read_cases(spark, folder, multi_line=False)
    return injection.join(pii.select("name", "expected_redactions"), "name").select(
        "name", F.length("input").alias("chars"), "expected", "expected_redactions")


# --- identity --------------------------------------------------------------------------------

def _resolved(spark, sf):
    return identity.resolve(X.requests(spark, sf).drop("key_id"), X.api_keys(spark, sf))


@register("key_resolution", f"WITH {O.RESOLVED} SELECT seq, "
          "CASE WHEN reason IS NULL THEN id END AS key_id, "
          "CASE WHEN reason IS NULL THEN user_id END AS user_id, "
          "CASE WHEN reason IS NULL THEN role END AS role, "
          "CASE WHEN reason IS NULL THEN team END AS team, "
          "CASE WHEN reason IS NULL THEN array_to_string("
          f"{O.SCOPE_LIST.format(s='scopes')}, '|') END AS scopes, "
          "reason IS NULL AS authenticated, reason FROM resolved")
def key_resolution(spark, sf):
    return _resolved(spark, sf).select(
        "seq", "key_id", "user_id", "role", "team", F.array_join("scopes", "|").alias("scopes"),
        "authenticated", "reason")


_SCOPE_OK = (f"(need IS NULL OR len(list_filter({O.SCOPE_LIST.format(s='scopes')}, "
             "lambda v: v = '*' OR v = need)) > 0)")


@register("scope_check", f"""WITH {O.RESOLVED}, wanted AS (
  SELECT *, CASE path WHEN '/v1/tools/evaluate' THEN 'tools:evaluate'
                      WHEN '/v1/rag/chat' THEN 'rag:chat' END AS need FROM resolved),
judged AS (SELECT *, reason IS NULL AND {_SCOPE_OK} AS allowed FROM wanted)
SELECT seq, path, need AS required_scope, allowed,
  CASE WHEN reason IS NOT NULL THEN 401 WHEN allowed THEN 200 ELSE 403 END AS status,
  CASE WHEN reason IS NOT NULL THEN 'authenticated identity unavailable'
       WHEN NOT allowed THEN 'required scope: ' || need END AS scope_reason FROM judged""")
def scope_check(spark, sf):
    df = identity.require_scope(_resolved(spark, sf), identity.routes(spark))
    return df.select("seq", "path", "required_scope", "allowed", "status", "scope_reason")


def _provisioned(spark, sf):
    """Keys as creation requests: every third one expires."""
    df = X.api_keys(spark, sf).select(
        "id", "name", F.concat(F.lit("sm_"), F.col("id").cast("string")).alias("raw_key"),
        "user_id", "role", "team", common.split_scopes("scopes").alias("scopes"),
        F.when(F.pmod("id", F.lit(3)) == 0, F.col("id").cast("int")).otherwise(0)
        .alias("expires_in_hours"), F.col("created_at").alias("ts"),
        F.struct(F.lit("u_admin_1").alias("user_id"), F.lit("admin").alias("role"),
                 F.lit("security").alias("team")).alias("actor"))
    return identity.provision_keys(df)


@register("key_provisioning", f"""WITH {X.API_KEYS_SQL}
SELECT id, key_hash, array_to_string({O.SCOPE_LIST.format(s='scopes')}, ',') AS scopes,
  CASE WHEN id % 3 = 0 AND id > 0 THEN epoch_us(created_at) + id * 3600000000 END AS expires_us,
  'API_KEY_CREATED' AS event_type,
  '{{"user_id":"u_admin_1","role":"admin","team":"security"}}' AS actor FROM api_keys""")
def key_provisioning(spark, sf):
    keys, events = _provisioned(spark, sf)
    keys = _with(keys, expires_us=common.micros_of(keys, "expires_at"))
    return keys.join(events.select(F.col("key_id").alias("id"), "event_type", "actor"), "id") \
        .select("id", "key_hash", "scopes", "expires_us", "event_type", "actor")


def _revocations(spark, sf):
    """Purchases as revocation requests, by id or, for odd events, by raw key."""
    return X.requests(spark, sf).filter("path = '/v1/tools/evaluate'").selectExpr(
        "seq", "ts", "CASE WHEN seq % 2 = 0 THEN key_id END AS key_id",
        "CASE WHEN seq % 2 = 1 THEN raw_key END AS raw_key",
        "named_struct('user_id', 'u_admin_1', 'role', 'admin', 'team', 'security') AS actor")


_REVOKE_SQL = f"""WITH {X.API_KEYS_SQL}, {X.REQUESTS_SQL},
asked AS (SELECT seq, us, CASE WHEN seq % 2 = 0 THEN key_id END AS key_id,
            CASE WHEN seq % 2 = 1 THEN raw_key END AS raw_key
          FROM requests WHERE path = '/v1/tools/evaluate'),
named AS (SELECT a.seq, a.us, k.id FROM asked a JOIN api_keys k
          ON k.id = a.key_id OR (a.key_id IS NULL AND k.key_hash = sha256(a.raw_key))),
wins AS (SELECT id, min(us) AS us, arg_min(seq, us) AS seq FROM named GROUP BY id)"""


@register("key_revocation", _REVOKE_SQL + """
SELECT k.id, coalesce(epoch_us(k.revoked_at), w.us) AS revoked_us,
       k.revoked_at IS NULL AND w.us IS NOT NULL AS newly FROM api_keys k LEFT JOIN wins w USING (id)""")
def key_revocation(spark, sf):
    keys, events, _ = identity.apply_revocations(X.api_keys(spark, sf), _revocations(spark, sf))
    keys = _with(keys, revoked_us=common.micros_of(keys, "revoked_at"))
    hit = events.select(F.col("key_id").alias("id"), F.lit(True).alias("newly"))
    return keys.join(hit, "id", "left").select(
        "id", "revoked_us", F.coalesce("newly", F.lit(False)).alias("newly"))


@register("event_auth", _REVOKE_SQL + """
SELECT 'API_KEY_CREATED' AS event_type, id AS key_id, name AS key_name,
  '{"user_id":"u_admin_1","role":"admin","team":"security"}' AS actor,
  epoch_us(created_at) AS us FROM api_keys
UNION ALL SELECT 'API_KEY_REVOKED', k.id, k.name,
  '{"user_id":"u_admin_1","role":"admin","team":"security"}', w.us
FROM api_keys k JOIN wins w USING (id) WHERE k.revoked_at IS NULL""")
def event_auth(spark, sf):
    """Creations and revocations of keys in their event table."""
    _, created = _provisioned(spark, sf)
    _, revoked, _ = identity.apply_revocations(X.api_keys(spark, sf), _revocations(spark, sf))
    rows = _stored(spark, created.unionByName(revoked), "auth_events")
    return rows.select("event_type", "key_id", "key_name", "actor",
                       common.micros_of(rows, "timestamp").alias("us"))


@register("revocation_refused", _REVOKE_SQL + """
SELECT seq FROM asked WHERE seq NOT IN (
  SELECT w.seq FROM wins w JOIN api_keys k USING (id) WHERE k.revoked_at IS NULL)""")
def revocation_refused(spark, sf):
    return identity.apply_revocations(X.api_keys(spark, sf), _revocations(spark, sf))[2] \
        .select("seq")


@register("key_latest", f"WITH {X.API_KEYS_SQL} SELECT team || ':' || role AS name, "
          "max(id) AS id, arg_max(user_id, id) AS user_id, arg_max(scopes, id) AS scopes "
          "FROM api_keys GROUP BY 1")
def key_latest(spark, sf):
    keys = _with(X.api_keys(spark, sf), name=F.concat_ws(":", "team", "role"))
    return identity.latest_key_by_name(keys).select("name", "id", "user_id", "scopes")


@register("key_list", f"WITH {X.API_KEYS_SQL} SELECT id, name, user_id, role, team, scopes "
                      "FROM api_keys ORDER BY id DESC")
def key_list(spark, sf):
    return identity.list_keys(X.api_keys(spark, sf)).select(
        "id", "name", "user_id", "role", "team", "scopes")


# --- documents -------------------------------------------------------------------------------

@register("document_authorization", f"WITH {O.RAG} SELECT request_id, pos, id, "
          "denied IS NULL AS allowed, coalesce(denied, 'document access permitted') "
          "AS access_reason FROM access")
def document_authorization(spark, sf):
    return retrieval.authorize(X.retrieval_requests(spark, sf)).select(
        "request_id", "pos", "id", "allowed", "access_reason")


@register("access_stage", f"WITH {O.RAG} SELECT request_id, pos, id, 'BLOCK' AS decision, "
          "FALSE AS included, denied AS reason FROM access WHERE denied IS NOT NULL")
def access_stage(spark, sf):
    return retrieval.denied_entries(X.retrieval_requests(spark, sf))


@register("rag_inspect", f"WITH {O.RAG} SELECT id, verdict AS decision, "
          f"safe AS sanitized, {O.types()} AS types, why AS reason FROM inspected")
def rag_inspect(spark, sf):
    return retrieval.inspect(X.retrieval_requests(spark, sf)).select(
        "id", "decision", "sanitized", _types().alias("types"), "reason")


def _rag(spark, sf, texts=True):
    return retrieval.judge_requests(X.retrieval_requests(spark, sf), texts)


@register("rag_cross_document", f"WITH {O.RAG_GROUPS} SELECT request_id, authorized, "
                                "combined_hit, sanitized_hit FROM verdicts")
def rag_cross_document(spark, sf):
    return retrieval.cross_document(X.retrieval_requests(spark, sf))


@register("rag_context", f"WITH {O.RAG_GROUPS} SELECT request_id, pos, document_id, source, "
          "trust_level, classification, owner_team, decision, included, reason, content "
          "FROM context")
def rag_context(spark, sf):
    return retrieval.document_context(X.retrieval_requests(spark, sf))


@register("rag_trace", f"WITH {O.RAG_GROUPS} SELECT request_id, "
          "CAST(count(*) FILTER (WHERE included) AS INTEGER) AS context_count, "
          "string_agg(document_id || ':' || decision || ':' || reason, '|' ORDER BY pos) AS trace "
          "FROM context GROUP BY request_id")
def rag_trace(spark, sf):
    return retrieval.build_trace(_rag(spark, sf, texts=False)).select(
        "request_id", "context_count", F.array_join(F.transform("entries", lambda e: F.concat_ws(
            ":", e["document_id"], e["decision"], e["reason"])), "|").alias("trace"))


@register("rag_prompt", f"WITH {O.RAG_GROUPS} SELECT request_id, 'CONTEXT:' || chr(10) || "
          "coalesce(string_agg('SOURCE: ' || document_id || chr(10) || content || chr(10) "
          "|| chr(10), '' ORDER BY pos) FILTER (WHERE included), '') || chr(10) || 'QUESTION:' "
          "|| chr(10) || 'What does ' || CAST(request_id AS VARCHAR) || ' say?' AS prompt, "
          "CAST(count(*) FILTER (WHERE included) AS INTEGER) AS context_count "
          "FROM context GROUP BY request_id")
def rag_prompt(spark, sf):
    judged = _rag(spark, sf)
    asked = X.table(spark, sf, "documents").select(
        F.expr("doc_id div 4").alias("request_id")).distinct().select(
        "request_id", F.format_string("What does %d say?", "request_id").alias("query"))
    return retrieval.context_prompt(judged, asked)


@register("rag_provenance", f"WITH {O.RAG_GROUPS} SELECT request_id, any_value(user_id) AS user_id,"
          " any_value(role) AS role, any_value(team) AS team, "
          "to_json(list({'document_id': document_id, 'source': source, 'trust_level': trust_level,"
          " 'classification': classification, 'owner_team': owner_team, 'decision': decision, "
          "'included': included, 'reason': reason} ORDER BY pos))::VARCHAR AS trace "
          "FROM context GROUP BY request_id")
def rag_provenance(spark, sf):
    docs = X.retrieval_requests(spark, sf)
    asked = docs.select("request_id", "user_id", "role", "team").distinct().select(
        "*", F.timestamp_seconds("request_id").alias("timestamp"))
    judged = retrieval.judge_requests(docs, texts=False)
    return retrieval.rag_events(judged, asked).drop("timestamp")


@register("rag_response", f"WITH {O.RAG_GROUPS}, said AS (SELECT doc_id // 4 AS request_id, text "
          f"FROM attacked_documents WHERE doc_id % 4 = 3), {O.pii_cte('said', 'text')}, "
          f"answered AS (SELECT *, {O.secret('text')} AS secrets FROM redacted), "
          "traced AS (SELECT request_id, CAST(count(*) FILTER (WHERE included) AS INTEGER) AS n, "
          "string_agg(document_id || ':' || decision || ':' || reason, '|' ORDER BY pos) AS trace "
          "FROM context GROUP BY request_id) SELECT request_id, "
          "CASE WHEN secrets > 0 THEN 403 ELSE 200 END AS status, "
          "CASE WHEN secrets > 0 THEN 'model output blocked' END AS error, "
          "CASE WHEN secrets = 0 THEN red END AS response, "
          "CASE WHEN secrets = 0 THEN coalesce(n, 0) END AS context_count, "
          "CASE WHEN secrets = 0 THEN trace END AS trace FROM answered "
          "LEFT JOIN traced USING (request_id)")
def rag_response(spark, sf):
    """The last document of each request stands for the model's answer."""
    said = X.attacked_documents(spark, sf).filter("doc_id % 4 = 3").select(
        F.expr("doc_id div 4").alias("request_id"), F.col("text").alias("model_response"))
    return retrieval.judge_response(_rag(spark, sf, texts=False), said).select(
        "request_id", "status", "error", "response", "context_count",
        F.array_join(F.transform("context_trace", lambda e: F.concat_ws(
            ":", e["document_id"], e["decision"], e["reason"])), "|").alias("trace"))


@register("provenance", f"WITH {O.RAG_GROUPS} SELECT request_id, any_value(user_id) AS user_id,"
          " any_value(role) AS role, any_value(team) AS team, "
          "CAST(count(*) AS INTEGER) AS entries FROM context WHERE request_id = 42 "
          "GROUP BY request_id")
def provenance(spark, sf):
    """Provenance of all requests in their event table, and one request looked up there."""
    docs = X.retrieval_requests(spark, sf)
    asked = docs.select("request_id", "user_id", "role", "team").distinct().select(
        "*", F.timestamp_seconds("request_id").alias("timestamp"))
    folder = new_folder(spark, "events")
    judged = retrieval.judge_requests(docs, texts=False)
    event_tables.append_events(retrieval.rag_events(judged, asked), "rag_events", folder)
    return event_tables.lookup_events(spark, "rag_events", folder, 42).select(
        "request_id", "user_id", "role", "team", F.json_array_length("trace").alias("entries"))


# --- tools and approvals ---------------------------------------------------------------------

def _evaluated(spark, sf):
    return tools.evaluate_tools(X.tool_calls(spark, sf), X.INTERNAL_DOMAIN)


@register("tool_policy", f"WITH {O.TOOLS} SELECT call_id, tool, role, decision, reason, risk "
                         "FROM evaluated")
def tool_policy(spark, sf):
    return _evaluated(spark, sf).select("call_id", "tool", "role", "decision", "reason", "risk")


@register("tool_status", f"WITH {O.TOOLS} SELECT tool, status, count(*) AS calls FROM evaluated "
                         "GROUP BY tool, status")
def tool_status(spark, sf):
    return _evaluated(spark, sf).groupBy("tool", "status").agg(F.count(F.lit(1)).alias("calls"))


ATTEMPT_ORDER = ("ts", "o1", "o2", "o3", "o4")


def _created(spark, sf):
    return approvals.create_approvals(_evaluated(spark, sf))


def _classified(spark, sf):
    created, _ = _created(spark, sf)
    tried = X.attempts(spark, sf).withColumnRenamed("call_id", "approval_id")
    return created, approvals.classify_attempts(created, tried, ATTEMPT_ORDER)


def _final(spark, sf):
    created, classified = _classified(spark, sf)
    return approvals.replay(created, classified, ATTEMPT_ORDER)


@register("approvals_created", f"WITH {O.APPROVALS} SELECT approval_id, epoch_us(created_at) AS "
          "created_us, tool, arguments, risk, reason, 'PENDING' AS status FROM approvals")
def approvals_created(spark, sf):
    created, _ = _created(spark, sf)
    return created.select("approval_id", common.micros_of(created, "created_at")
                          .alias("created_us"), "tool", "arguments", "risk", "reason", "status")


_EXECUTED = "epoch_us(executed_at) AS executed_us"


@register("approval_replay", f"WITH RECURSIVE {O.REPLAY} SELECT approval_id, tool, status, "
                             f"{_EXECUTED} FROM final")
def approval_replay(spark, sf):
    df = _final(spark, sf)
    return df.select("approval_id", "tool", "status",
                     common.micros_of(df, "executed_at").alias("executed_us"))


@register("approval_conflicts", f"WITH RECURSIVE {O.REPLAY} SELECT action, prior_status, "
          "conflict, new_status, count(*) AS attempts, min(approval_id) AS first_approval, "
          "sum(approval_id)::BIGINT AS approval_sum FROM classified GROUP BY ALL")
def approval_conflicts(spark, sf):
    _, classified = _classified(spark, sf)
    return classified.groupBy("action", "prior_status", "conflict", "new_status").agg(
        F.count(F.lit(1)).alias("attempts"), F.min("approval_id").alias("first_approval"),
        F.sum("approval_id").alias("approval_sum"))


@register("approval_active", f"WITH RECURSIVE {O.REPLAY} SELECT approval_id, tool, risk, status "
          "FROM final WHERE status IN ('PENDING', 'APPROVED', 'EXECUTING') "
          "AND executed_at IS NULL")
def approval_active(spark, sf):
    return approvals.active(_final(spark, sf)).select("approval_id", "tool", "risk", "status")


@register("approval_pending", f"WITH RECURSIVE {O.REPLAY} SELECT approval_id, tool, risk "
                              "FROM final WHERE status = 'PENDING'")
def approval_pending(spark, sf):
    return approvals.pending(_final(spark, sf)).select("approval_id", "tool", "risk")


@register("approval_timeline", f"""WITH RECURSIVE {O.REPLAY}
SELECT approval_id, epoch_us(created_at) AS us, 'TOOL_APPROVAL_REQUESTED' AS event_type, tool, risk,
       'PENDING' AS status FROM approvals
UNION ALL SELECT c.approval_id, epoch_us(c.ts), {O.EVENT_NAMES}, a.tool, a.risk, c.new_status
FROM classified c JOIN approvals a USING (approval_id)
WHERE c.conflict IS NULL AND c.action <> 'fail'""")
def approval_timeline(spark, sf):
    _, requested = _created(spark, sf)
    created, classified = _classified(spark, sf)
    events = requested.unionByName(approvals.transition_events(created, classified))
    df = _with(events, us=common.micros_of(events, "timestamp"))
    return approvals.timeline(df, order=("us", "event_type")).select(
        "approval_id", "us", "event_type", "tool", "risk", "status")


@register("event_tool", f"""WITH RECURSIVE {O.REPLAY}
SELECT approval_id, epoch_us(created_at) AS us, 'TOOL_APPROVAL_REQUESTED' AS event_type, tool,
       'PENDING' AS status, arguments AS details FROM approvals
UNION ALL SELECT c.approval_id, epoch_us(c.ts), {O.EVENT_NAMES}, a.tool, c.new_status,
  '{{' || CASE WHEN c.action IN ('approve', 'reject') THEN '"arguments":' || a.arguments || ','
          ELSE '' END || '"actor":{{"role":"' || n.actor_role || '"}}}}'
FROM classified c JOIN (SELECT approval_id, rn, actor_role FROM needed) n USING (approval_id, rn) JOIN approvals a USING (approval_id)
WHERE c.conflict IS NULL AND c.action <> 'fail'""")
def event_tool(spark, sf):
    """The whole life cycle of all approvals in its event table, in order of recency."""
    _, requested = _created(spark, sf)
    created, classified = _classified(spark, sf)
    rows = _stored(spark, requested.unionByName(
        approvals.transition_events(created, classified)), "tool_events")
    return approvals.timeline(rows).select(
        "approval_id", common.micros_of(rows, "timestamp").alias("us"), "event_type", "tool",
        "status", "details")


# --- traffic ---------------------------------------------------------------------------------

_BUCKET = {"capacity": X.BUCKET_CAPACITY, "refill_per_second": X.BUCKET_RATE}
_ABUSE = {"threshold": X.THRESHOLD, "cooldown_us": X.COOLDOWN_US, "decay_us": X.DECAY_US}


def _plain_requests(spark, sf):
    return X.requests(spark, sf).select("key_id", "us", "seq", "path", "handler_status")


def _guarded(spark, sf):
    return traffic.traffic_guard(_plain_requests(spark, sf), **_BUCKET, **_ABUSE)


@register("token_bucket", f"WITH RECURSIVE {O.BUCKET} SELECT key_id, seq, allowed, "
          "round(tokens, 6) AS tokens, CASE WHEN NOT allowed THEN "
          f"{O._SECS.format(ns=O._RETRY.format(t='tokens'))} END AS retry_after_seconds FROM fold")
def token_bucket(spark, sf):
    df = traffic.rate_limit(_plain_requests(spark, sf), **_BUCKET)
    return df.select("key_id", "seq", "allowed", F.round("tokens", 6).alias("tokens"),
                     "retry_after_seconds")


def _violations(spark, sf):
    df = traffic.violation_points(_plain_requests(spark, sf), "path", "handler_status")
    return df.filter("points > 0").select("key_id", "us", "seq", "points")


@register("violation_points", f"""WITH {X.REQUESTS_SQL} SELECT seq,
  CASE WHEN handler_status = 429 THEN 1 WHEN handler_status = 403 AND path IN
       ('/v1/chat/completions', '/v1/rag/chat') THEN 3 ELSE 0 END AS points,
  CASE WHEN handler_status = 429 THEN 'rate_limit_violation'
       WHEN handler_status = 403 AND path = '/v1/chat/completions' THEN 'chat_security_block'
       WHEN handler_status = 403 AND path = '/v1/rag/chat' THEN 'rag_security_block'
       ELSE '' END AS reason FROM requests""")
def violation_points(spark, sf):
    return traffic.violation_points(
        _plain_requests(spark, sf), "path", "handler_status").select("seq", "points", "reason")


@register("abuse_score", f"WITH RECURSIVE {O.SCORES} SELECT key_id, seq, "
                         "CAST(score AS INTEGER) AS score FROM scored")
def abuse_score(spark, sf):
    return traffic.abuse_score(_violations(spark, sf), X.DECAY_US).select(
        "key_id", "seq", "score")


@register("cooldowns", f"WITH RECURSIVE {O.COOL} SELECT key_id, seq, entered, "
                       "until_us AS cooldown_until_us FROM cool")
def cooldowns(spark, sf):
    found = _violations(spark, sf)
    scored = traffic.abuse_score(found, X.DECAY_US)
    return traffic.cooldowns(scored, X.THRESHOLD, X.COOLDOWN_US, counted=found).select(
        "key_id", "seq", "entered", "cooldown_until_us")


@register("cooldown_gate", f"WITH RECURSIVE {O.GATE} SELECT key_id, seq, blocked, "
          f"{O._SECS.format(ns='wait_ns')} AS retry_after_seconds, CAST(score AS INTEGER) AS score,"
          " until_us AS cooldown_until_us FROM gate")
def cooldown_gate(spark, sf):
    df = traffic.violation_points(_plain_requests(spark, sf), "path", "handler_status")
    return traffic.gate(df, **_ABUSE).select(
        "key_id", "seq", "blocked", "retry_after_seconds", "score", "cooldown_until_us")


_GUARD_OUT = ("key_id", "seq", "outcome", "status", "retry_after_seconds", "points", "reason",
              "score", "entered", "cooldown_until_us")


@register("traffic_guard", f"WITH RECURSIVE {O.GUARD_ROWS} SELECT {', '.join(_GUARD_OUT)}, "
                           "round(tokens, 6) AS tokens FROM guarded")
def traffic_guard(spark, sf):
    return _guarded(spark, sf).select(*_GUARD_OUT, F.round("tokens", 6).alias("tokens"))


_UNTIL_TEXT = ("strftime(make_timestamp(cooldown_until_us), '%Y-%m-%dT%H:%M:%S') || "
               "CASE WHEN cooldown_until_us % 1000000 = 0 THEN '' ELSE '.' || rtrim("
               "lpad(CAST(cooldown_until_us % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z'")


@register("abuse_events", f"""WITH RECURSIVE {O.GUARD_ROWS}
SELECT key_id, seq, path, 'ABUSE_COOLDOWN_BLOCKED' AS event_type, '{{"score":' || score ||
  ',"retry_after_seconds":' || retry_after_seconds || '}}' AS details
  FROM guarded WHERE outcome = 'COOLDOWN_BLOCKED'
UNION ALL SELECT key_id, seq, path, 'RATE_LIMIT_EXCEEDED', '{{"retry_after_seconds":' ||
  retry_after_seconds || '}}' FROM guarded WHERE outcome = 'RATE_LIMITED'
UNION ALL SELECT key_id, seq, path, 'ABUSE_SCORE_UPDATED', '{{"score":' || score || ',"points":' ||
  points || ',"reason":"' || reason || '","status":' || status || '}}'
  FROM guarded WHERE points > 0
UNION ALL SELECT key_id, seq, path, 'ABUSE_COOLDOWN_STARTED', '{{"score":' || score ||
  ',"cooldown_until":"' || {_UNTIL_TEXT} || '","trigger":"' || reason || '"}}'
  FROM guarded WHERE entered""")
def abuse_events(spark, sf):
    return traffic.abuse_events(_guarded(spark, sf)).select(
        "key_id", "seq", "path", "event_type", "details")


@register("event_abuse",
          f"WITH {X.API_KEYS_SQL}, found AS ({SQL['abuse_events']}) SELECT key_id, event_type, "
          "path, details, name AS key_name, user_id, role, team "
          "FROM found LEFT JOIN api_keys ON id = key_id")
def event_abuse(spark, sf):
    """Abuse events with the identity of their key in their event table."""
    events = traffic.identify_events(traffic.abuse_events(_guarded(spark, sf)),
                                     X.api_keys(spark, sf))
    return _stored(spark, events, "abuse_events").select(
        "key_id", "event_type", "path", "details", "key_name", "user_id", "role", "team")


@register("abuse_state", f"WITH RECURSIVE {O.STATE} SELECT key_id, score, stored_score, "
                         "last_updated_us, cooldown_until_us FROM state")
def abuse_state(spark, sf):
    return traffic.list_abuse_state(
        traffic.abuse_state(_guarded(spark, sf), O.AT_US, X.DECAY_US))


# --- state tables ----------------------------------------------------------------------------

def _updates(spark, sf):
    """Every request sets its key's score to its number; earlier half is the current table."""
    df = _plain_requests(spark, sf).select(
        "key_id", F.col("seq").cast("int").alias("score"), F.col("us").alias("last_updated_us"),
        "seq")
    cut = F.lit(1705276800000000)
    current = df.filter(F.col("last_updated_us") < cut).groupBy("key_id").agg(
        F.max_by("score", "last_updated_us").alias("score"),
        F.max("last_updated_us").alias("last_updated_us"))
    return current, df.filter(F.col("last_updated_us") >= cut)


@register("state_upsert", f"WITH {X.REQUESTS_SQL} SELECT key_id, "
          "CAST(arg_max(seq, us) AS INTEGER) AS score, max(us) AS last_updated_us "
          "FROM requests GROUP BY key_id")
def state_upsert(spark, sf):
    current, updates = _updates(spark, sf)
    return state.upsert_state(current, updates)


@register("state_table", f"WITH {X.REQUESTS_SQL} SELECT key_id, "
          "CAST(arg_max(seq, us) AS INTEGER) AS score, max(us) AS last_updated_us "
          "FROM requests WHERE key_id NOT IN (SELECT c_custkey FROM customer "
          "WHERE c_nationkey < 12) GROUP BY key_id")
def state_table(spark, sf):
    """The stored table: two batches of upserts, the second delivered twice, and a delete."""
    current, updates = _updates(spark, sf)
    stored = state_tables.StateTable(spark, new_folder(spark, "state"),
                                     "key_id long, score int, last_updated_us long")
    write = stored.writer()
    write(_with(current, seq=F.lit(0).cast("long")), 0)
    for _ in range(2):
        write(updates, 1)
    stored.delete(X.table(spark, sf, "customer").filter("c_nationkey < 12").select(
        F.col("c_custkey").alias("key_id")))
    return stored.read()


_DELETE = f"""WITH {X.REQUESTS_SQL},
states AS (SELECT DISTINCT key_id FROM requests),
gone AS (SELECT c_custkey AS key_id FROM customer WHERE c_nationkey < 12)"""


@register("state_delete", _DELETE + """
SELECT key_id, 'kept' AS result FROM states WHERE key_id NOT IN (SELECT key_id FROM gone)
UNION ALL SELECT key_id, 'not found' FROM gone WHERE key_id NOT IN (SELECT key_id FROM states)""")
def state_delete(spark, sf):
    rows = _plain_requests(spark, sf).select("key_id").distinct()
    gone = X.table(spark, sf, "customer").filter("c_nationkey < 12").select(
        F.col("c_custkey").alias("key_id"))
    kept, missing = state.delete_state(rows, gone)
    return kept.select("key_id", F.lit("kept").alias("result")).unionByName(
        missing.select("key_id", F.lit("not found").alias("result")))


@register("constraint_violations", f"""WITH {X.API_KEYS_SQL},
keys AS (SELECT *, CASE WHEN id % 17 = 0 THEN NULL ELSE team END AS t,
                CASE WHEN id % 10 = 3 THEN 'dup' || (id // 100) ELSE key_hash END AS h,
                CAST(id % 23 AS INTEGER) - 1 AS s,
                CASE WHEN id % 19 = 0 THEN 'LOST' ELSE 'PENDING' END AS st FROM api_keys)
SELECT 'team is null' AS rule, CAST(id AS VARCHAR) AS key FROM keys WHERE t IS NULL
UNION ALL SELECT 'score is negative', CAST(id AS VARCHAR) FROM keys WHERE s < 0
UNION ALL SELECT 'status is not allowed', CAST(id AS VARCHAR) FROM keys WHERE st = 'LOST'
UNION ALL SELECT 'key_hash is not unique', h FROM keys GROUP BY h HAVING count(*) > 1""")
def constraint_violations(spark, sf):
    keys = X.api_keys(spark, sf).select(
        "id", F.expr("CASE WHEN id % 17 = 0 THEN NULL ELSE team END AS team"),
        F.expr("CASE WHEN id % 10 = 3 THEN concat('dup', id div 100) ELSE key_hash END "
               "AS key_hash"),
        F.expr("CAST(id % 23 AS INT) - 1 AS score"),
        F.expr("CASE WHEN id % 19 = 0 THEN 'LOST' ELSE 'PENDING' END AS status"))
    rules = (state.not_null("team") + state.non_negative("score")
             + state.in_domain("status", state.APPROVAL_STATUSES))
    return state.check_constraints(keys, rules, "id", unique=("key_hash",))


# --- audit -----------------------------------------------------------------------------------

@register("audit_recent", f"WITH {O.AUDIT} SELECT id, request_id, decision, risk_score, severity "
                          "FROM audit ORDER BY id DESC LIMIT 100")
def audit_recent(spark, sf):
    return audit.recent_audit(_audit(spark, sf), 100).select(
        "id", "request_id", "decision", "risk_score", "severity")


@register("auth_recent", f"WITH {X.API_KEYS_SQL} SELECT id, 'API_KEY_CREATED' AS event_type, "
                         "name AS key_name FROM api_keys ORDER BY id DESC LIMIT 50")
def auth_recent(spark, sf):
    _, events = _provisioned(spark, sf)
    return audit.recent_auth(_with(events, id=F.col("key_id")), 0).select(
        "id", "event_type", "key_name")


@register("abuse_recent", f"""WITH RECURSIVE {O.GUARD_ROWS}
SELECT us, seq, key_id, event_type FROM (
  SELECT us, seq, key_id, 1 AS n, 'RATE_LIMIT_EXCEEDED' AS event_type FROM guarded
  WHERE outcome = 'RATE_LIMITED'
  UNION ALL SELECT us, seq, key_id, 0, 'ABUSE_COOLDOWN_BLOCKED' FROM guarded
  WHERE outcome = 'COOLDOWN_BLOCKED'
  UNION ALL SELECT us, seq, key_id, 2, 'ABUSE_SCORE_UPDATED' FROM guarded WHERE points > 0
  UNION ALL SELECT us, seq, key_id, 3, 'ABUSE_COOLDOWN_STARTED' FROM guarded WHERE entered)
ORDER BY us DESC, seq DESC, n DESC LIMIT 200""")
def abuse_recent(spark, sf):
    events = traffic.abuse_events(_guarded(spark, sf))
    return audit.recent_abuse(events, 200, ("us", "seq", "event_no")).select(
        "us", "seq", "key_id", "event_type")


@register("audit_stats", f"WITH {O.AUDIT} {O.STATS}")
def audit_stats(spark, sf):
    return audit.security_stats(_audit(spark, sf))


def _posture(spark, sf):
    snapshot = traffic.abuse_state(_guarded(spark, sf), O.AT_US, X.DECAY_US)
    return audit.posture(X.api_keys(spark, sf), snapshot, O.AT_US)


@register("posture", f"WITH RECURSIVE {O.POSTURE} SELECT key_id, name, user_id, role, team, "
                     "scopes, abuse_score, status, cooldown_until_us, revoked_us FROM posture")
def posture(spark, sf):
    df = _posture(spark, sf)
    return df.select("key_id", "name", "user_id", "role", "team", "scopes", "abuse_score",
                     "status", "cooldown_until_us",
                     common.micros_of(df, "revoked_at").alias("revoked_us"))


@register("posture_summary", f"WITH RECURSIVE {O.POSTURE} {O.SUMMARY}")
def posture_summary(spark, sf):
    return audit.posture_summary(_posture(spark, sf))


@register("audit_search", f"WITH {O.AUDIT} SELECT id, request_id, decision FROM audit "
          "WHERE contains(lower(decision || ' ' || severity || ' ' || secret_findings || ' ' || "
          "pii_findings || ' ' || injection_findings), 'data_exfiltration')")
def audit_search(spark, sf):
    rows = _audit(spark, sf).drop("output_findings")
    return audit.search(rows, "DATA_Exfiltration").select("id", "request_id", "decision")


# --- evaluations -----------------------------------------------------------------------------

def _eval_rows(spark, sf):
    turns = X.attacked(spark, sf)
    cases = _with(turns, expected=F.when(F.col("k").isin(*X.ATTACKS), "BLOCK").otherwise("ALLOW"),
                  expected_redactions=F.when(F.col("k").isin(11, 13), 3).otherwise(0))
    docs = X.attacked_documents(spark, sf)
    wanted = docs.groupBy(F.expr("doc_id div 4").alias("request_id")).agg(
        F.count_if(~F.col("k").isin(*X.ATTACKS)).alias("expected_included"))
    rag = evals.eval_retrieval(wanted, _rag(spark, sf, texts=False))
    none = F.lit(None).cast("string").alias("outcome")
    return evals.eval_texts(cases, "text").unionByName(
        rag.select(F.lit("rag").alias("suite"), "passed", none))


@register("eval_confusion", f"WITH {O.EVAL} SELECT expected, actual, count(*) AS cases "
                            "FROM inj_eval GROUP BY ALL")
def eval_confusion(spark, sf):
    cases = _with(X.attacked(spark, sf), expected=F.when(
        F.col("k").isin(*X.ATTACKS), "BLOCK").otherwise("ALLOW"))
    return evals.eval_injection(cases, "text").groupBy("expected", "actual").agg(
        F.count(F.lit(1)).alias("cases"))


_METRICS = "suite, total, passed, failed, accuracy, precision, recall, false_positives, " \
           "false_negatives"


@register("eval_metrics", f"WITH {O.EVAL} SELECT {_METRICS} FROM metric")
def eval_metrics(spark, sf):
    return evals.metrics(_eval_rows(spark, sf))


def _history(spark, sf):
    """History folder of two earlier runs, the newer one better, and the current one.

    The current report is evaluated once, when it is written.
    """
    metric = ("named_struct('total', {t}L, 'passed', {p}L, 'failed', {f}L, 'accuracy', {a}D, "
              "'precision', 1D, 'recall', {r}D, 'false_positives', 0L, 'false_negatives', {n}L, "
              "'average_latency_ns', CAST(NULL AS BIGINT))")

    def old(ts, **kw):
        row = ", ".join(f"{metric.format(**kw)} AS {s}" for s in evals.SUITES)
        return spark.sql(f"SELECT '{ts}' AS timestamp, {row}")

    folder = new_folder(spark, "history")
    for row in (old("2024-01-01T00:00:00Z", t=26, p=13, f=13, a=0.5, r=0.5, n=9),
                old("2024-01-02T00:00:00Z", t=26, p=26, f=0, a=1.0, r=1.0, n=0),
                evals.report(evals.metrics(_eval_rows(spark, sf)), "2024-01-03T00:00:00Z")):
        reports.write_report(row, folder)
    return reports.read_history(spark, folder)


@register("eval_history", f"WITH {O.EVAL} SELECT '2024-01-03T00:00:00Z' AS timestamp, "
          "max(passed) FILTER (WHERE suite = 'prompt_injection') AS injection_passed, "
          "max(passed) FILTER (WHERE suite = 'pii') AS pii_passed, "
          "max(accuracy) FILTER (WHERE suite = 'rag') AS rag_accuracy FROM metric")
def eval_history(spark, sf):
    """The current report written to the history and read back as the latest."""
    latest = evals.latest_report(_history(spark, sf))
    return latest.select(
        "timestamp", F.col("prompt_injection.passed").alias("injection_passed"),
        F.col("pii.passed").alias("pii_passed"), F.col("rag.accuracy").alias("rag_accuracy"))


@register("eval_regression", f"""WITH {O.EVAL},
now AS (SELECT max(recall) FILTER (WHERE suite = 'prompt_injection') AS recall,
               max(false_negatives) FILTER (WHERE suite = 'prompt_injection') AS fn,
               max(accuracy) FILTER (WHERE suite = 'rag') AS acc, sum(failed)::BIGINT AS failed
        FROM metric)
SELECT recall < 1 AS recall_down, fn > 0 AS false_negatives_up, acc < 1 AS retrieval_accuracy_down,
       failed AS failed_cases, recall < 1 OR fn > 0 OR acc < 1 AS regressed,
       recall < 1 OR fn > 0 OR acc < 1 OR failed > 0 AS failed FROM now""")
def eval_regression(spark, sf):
    history = _history(spark, sf)
    return evals.regression(evals.latest_report(history), evals.previous_report(history))


@register("overview", f"""WITH RECURSIVE {O.AUDIT}, {O.POSTURE.lstrip()}
SELECT st.*, ev.*, su.* FROM ({O.STATS}) st,
 (WITH {O.EVAL} SELECT sum(total)::BIGINT AS eval_total, sum(passed)::BIGINT AS eval_passed
  FROM metric) ev, ({O.SUMMARY}) su""")
def overview(spark, sf):
    """Statistics, the newest report's cases over all three suites, and the posture."""
    latest = evals.latest_report(_history(spark, sf))
    report = latest.select(*[
        sum((F.coalesce(F.col(f"{s}.{field}"), F.lit(0)) for s in evals.SUITES[1:]),
            F.coalesce(F.col(f"{evals.SUITES[0]}.{field}"), F.lit(0))).alias(f"eval_{field}")
        for field in ("total", "passed")])
    return audit.overview(audit.security_stats(_audit(spark, sf)), report,
                          audit.posture_summary(_posture(spark, sf)))


# --- streams and SQL functions ---------------------------------------------------------------

def _stream_requests(spark, sf):
    events = run.stream_table(spark, sf, "events")
    return X.requests_of(events).select("key_id", "us", "seq", "path", "handler_status")


@register("stream_traffic_guard", SQL["traffic_guard"])
def stream_traffic_guard(spark, sf):
    guard = folds.traffic_guard(_stream_requests(spark, sf), capacity=X.BUCKET_CAPACITY,
                                rate=X.BUCKET_RATE, **_ABUSE)
    return run.drain(guard, "guard").filter(~F.col("late")).select(
        *_GUARD_OUT, F.round("tokens", 6).alias("tokens"))


_DAY_US = 86_400_000_000


@register("stream_event_time", f"WITH RECURSIVE {O.BUCKET} SELECT key_id, seq, allowed, "
          f"round(tokens, 6) AS tokens FROM fold WHERE (us // {_DAY_US} + 1) * {_DAY_US} < "
          f"(SELECT max(us) FROM requests) - 3600000000")
def stream_event_time(spark, sf):
    """Buckets in event time: the days that the watermark, an hour behind, has passed."""
    rows, _ = event_time.drain_split(event_time.token_bucket(
        _stream_requests(spark, sf), "1 hour", X.BUCKET_CAPACITY, X.BUCKET_RATE,
        slot_ms=_DAY_US // 1000), "event-time")
    return rows.select("key_id", "seq", "allowed", F.round("tokens", 6).alias("tokens"))


@register("stream_chat_verdict", f"WITH {X.ATTACKED_SQL}, "
          f"s1 AS (SELECT *, {O.strip('text')} AS prompt FROM attacked), "
          f"{O.scan_cte('s1', 'prompt')}, {O.pii_cte('scanned', 'prompt')}, "
          f"r AS (SELECT *, {O.score(O.secret('prompt'), 'pcount', 'fcount', 'fconf')} AS "
          "risk_score FROM redacted) SELECT conv_id, turn, risk_score, "
          f"{O.severity('risk_score')} AS severity, {O.action('risk_score')} AS decision FROM r")
def stream_chat_verdict(spark, sf):
    turns = X.attacked_of(run.stream_table(spark, sf, "conversations"))
    requests = _with(turns, messages=F.array(F.struct("role", F.col("text").alias("content"))))
    judged = scans.judge_requests(requests)
    return run.drain(judged.select("conv_id", "turn", "risk_score", "severity", "decision"),
                     "verdicts")


@register("stream_inspect", SQL["rag_inspect"])
def stream_inspect(spark, sf):
    docs = X.retrieval_of(run.stream_table(spark, sf, "documents"))
    df = scans.inspect_documents(docs).select(
        "id", "decision", "sanitized", _types().alias("types"), "reason")
    return run.drain(df, "inspected")


@register("stream_identity", SQL["key_resolution"])
def stream_identity(spark, sf):
    asked = X.requests_of(run.stream_table(spark, sf, "events")).drop("key_id")
    df = scans.resolve_identities(asked, X.api_keys(spark, sf)).select(
        "seq", "key_id", "user_id", "role", "team", F.array_join("scopes", "|").alias("scopes"),
        "authenticated", "reason")
    return run.drain(df, "identities")


@register("stream_approvals", SQL["approval_conflicts"])
def stream_approvals(spark, sf):
    created, _ = _created(spark, sf)
    known = created.select("approval_id", F.lit(True).alias("known"))
    tried = X.attempts_of(run.stream_table(spark, sf, "lineitem")).withColumnRenamed(
        "call_id", "approval_id")
    tried = _with(tried, us=common.micros_of(tried, "ts")).drop("ts").join(
        known, "approval_id", "left")
    tried = _with(tried, known=F.coalesce("known", F.lit(False)))
    df = folds.approval_states(tried, ("us", "o1", "o2", "o3", "o4"))
    rows = run.drain(df, "approvals")
    rows = _with(rows, prior_status=F.when(F.col("known"), F.col("prior_status")),
                 new_status=F.when(F.col("known"), F.col("new_status")))
    return rows.groupBy("action", "prior_status", "conflict", "new_status").agg(
        F.count(F.lit(1)).alias("attempts"), F.min("approval_id").alias("first_approval"),
        F.sum("approval_id").alias("approval_sum"))


@register("stream_stats", f"WITH {X.ATTACKED_SQL}, "
          f"{O.scan_cte('attacked', 'text')}, {O.pii_cte('scanned', 'text')}, "
          f"r AS (SELECT *, {O.score(O.secret('text'), 'pcount', 'fcount', 'fconf')} AS "
          f"risk_score, length(text) AS latency_ms FROM redacted), audit AS (SELECT *, "
          f"{O.severity('risk_score')} AS severity, {O.action('risk_score')} AS decision FROM r) "
          f"{O.STATS}")
def stream_stats(spark, sf):
    turns = X.attacked_of(run.stream_table(spark, sf, "conversations"))
    requests = _with(turns, messages=F.array(F.struct("role", F.col("text").alias("content"))))
    judged = _with(scans.judge_requests(requests), latency_ms=F.length("text"))
    return run.drain_complete(scans.running_stats(judged), "stats")


@register("stream_windows", f"WITH {X.ATTACKED_SQL}, "
          f"{O.scan_cte('attacked', 'text')}, {O.pii_cte('scanned', 'text')}, "
          f"r AS (SELECT *, {O.score(O.secret('text'), 'pcount', 'fcount', 'fconf')} AS "
          f"risk_score FROM redacted), judged AS (SELECT *, {O.action('risk_score')} AS decision "
          "FROM r) SELECT 1704067200 + (conv_id // 5) * 300 AS window_start, "
          "count(*) AS total_requests, count(*) FILTER (WHERE decision = 'BLOCK') AS "
          "blocked_requests, avg(risk_score) AS average_risk_score FROM judged GROUP BY 1")
def stream_windows(spark, sf):
    """Statistics of five-minute windows; a conversation starts every minute."""
    turns = X.attacked_of(run.stream_table(spark, sf, "conversations"))
    requests = _with(turns, messages=F.array(F.struct("role", F.col("text").alias("content"))))
    judged = _with(scans.judge_requests(requests), latency_ms=F.length("text"),
                   timestamp=F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60))
    rows = run.drain_complete(scans.windowed_stats(judged), "windows")
    return rows.select(F.unix_seconds("window.start").alias("window_start"), "total_requests",
                       "blocked_requests", "average_risk_score")


@register("sql_functions", f"WITH {X.ATTACKED_SQL}, {O.scan_cte('attacked', 'text')}, "
          f"{O.pii_cte('scanned', 'text')}, "
          f"r AS (SELECT *, {O.score(O.secret('text'), 'pcount', 'fcount', 'fconf')} AS risk "
          f"FROM redacted) SELECT conv_id, turn, {O.norm('text')} AS text_norm, fcount > 0 AS "
          f"injected, fconf AS confidence, pl AS payload, red AS redacted, "
          f"CAST(pcount AS INTEGER) AS kinds, {O.secret('text')} AS secrets, "
          f"{O.severity('risk')} AS severity, {O.action('risk')} AS action FROM r")
def sql_functions(spark, sf):
    sql.register(spark)
    X.attacked(spark, sf).createOrReplaceTempView("wardframe_attacked")
    return spark.sql("""
        WITH scanned AS (
          SELECT conv_id, turn, text, has_injection(text) AS injected,
                 injection_confidence(text) AS confidence, pii_count(text) AS kinds,
                 secret_count(text) AS secrets FROM wardframe_attacked),
        scored AS (SELECT *, risk_score(secrets, kinds, IF(injected, 1, 0), confidence) AS risk
                   FROM scanned)
        SELECT conv_id, turn, normalize_text(text) AS text_norm, injected, confidence,
               encoded_payload(text) AS payload, redact_pii(text) AS redacted, kinds, secrets,
               risk_severity(risk) AS severity, risk_action(risk) AS action FROM scored""")

"""SQL counterparts of the registered queries, written independently for DuckDB.

Patterns are RE2 here and stand as they are; the Spark side builds its own Java forms.
"""

from . import fixtures as X

# RE2 patterns by rule (id, type, severity, confidence, pattern).
RULES = (
    (1, "IGNORE_PREVIOUS_INSTRUCTIONS", "HIGH", 95,
     r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(previous|prior|earlier|above)\b.{0,30}"
     r"\b(instructions?|rules?|prompt)\b"),
    (2, "SYSTEM_PROMPT_EXTRACTION", "HIGH", 90,
     r"(?i)\b(reveal|show|print|output|repeat|expose)\b.{0,40}"
     r"\b(system prompt|developer message|hidden instructions?)\b"),
    (3, "ROLE_OVERRIDE", "MEDIUM", 75,
     r"(?i)\b(you are now|act as|pretend to be)\b.{0,60}"
     r"\b(unrestricted|developer mode|jailbroken|no rules)\b"),
    (4, "DATA_EXFILTRATION", "CRITICAL", 95,
     r"(?i)\b(export|dump|retrieve|send|list)\b.{0,60}\b(all|every)\b.{0,30}"
     r"\b(customers?|users?|records?|credentials?|secrets?)\b"),
    (5, "MULTILINGUAL_INSTRUCTION_OVERRIDE", "HIGH", 90,
     r"(?i)\b(ignora|olvida)\b.{0,50}\b(instrucciones|reglas)\b.{0,30}\b(anteriores|previas)\b"),
    (6, "MULTILINGUAL_PROMPT_EXTRACTION", "HIGH", 90,
     r"(?i)\b(revela|muestra|imprime)\b.{0,50}\b(prompt del sistema|instrucciones ocultas)\b"),
    (7, "MULTILINGUAL_INSTRUCTION_OVERRIDE", "HIGH", 90,
     r"(?i)\b(ignore|oublie)\b.{0,50}\b(instructions|règles|regles)\b.{0,30}"
     r"\b(précédentes|precedentes|antérieures|anterieures)\b"),
    (8, "MULTILINGUAL_PROMPT_EXTRACTION", "HIGH", 90,
     r"(?i)\b(révèle|revele|montre|affiche)\b.{0,50}"
     r"\b(prompt système|prompt systeme|instructions cachées|instructions cachees)\b"),
)
# Payload, quotation, discussion, personal-data and secret patterns.
BASE64 = r"\b[A-Za-z0-9+/]{24,}={0,2}\b"
QUOTED = "\"[^\"]*\"|'[^']*'"
MARKERS = ("article says", "article states", "common attack phrase", "attack phrase",
           "example of", "example:", "quoted phrase", "security training",
           "prompt injection example", "phrase means")
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SECRET = r"\bAKIA[0-9A-Z]{16}\b"
_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"

q = X.quote


def norm(x):
    folded = (f"translate(regexp_replace({x}, {q(r'[\p{Cf}]')}, '', 'g'), "
              "'аеорсхАЕОРСХ', 'aeopcxAEOPCX')")
    return f"trim(regexp_replace({folded}, {q(_WS + '+')}, ' ', 'g'))"


def strip(x):
    return f"regexp_replace({x}, {q(chr(92) + 'A' + _WS + '+|' + _WS + '+' + chr(92) + 'z')}, '', 'g')"


def any_rule(n):
    return "(" + " OR ".join(f"regexp_matches({n}, {q(r[4])})" for r in RULES) + ")"


def any_rule_raw(x):
    """any_rule over text that is not normalized yet, with the normalized value bound once."""
    return f"list_any_value(list_transform([{norm(x)}], lambda nn: {any_rule('nn')}))"


def payload(x):
    decoded = "coalesce(try(decode(from_base64(c))), '')"
    return (f"list_filter(regexp_extract_all({x}, {q(BASE64)}), "
            f"lambda c: length(c) % 4 = 0 AND {any_rule_raw(decoded)})[1]")


def benign(x):
    marker = " OR ".join(f"contains(lower({x}), {q(m)})" for m in MARKERS)
    return (f"(({marker}) AND len(list_filter(regexp_extract_all({x}, {q(QUOTED)}), "
            f"lambda qq: {any_rule_raw('qq')})) > 0 "
            f"AND NOT {any_rule_raw(f'regexp_replace({x}, {q(QUOTED)}, {q(chr(32))}, {q(chr(103))})')})")


def _finding(rid, kind, sev, conf, matched):
    return (f"{{'rule_id': {rid}, 'type': '{kind}', 'severity': '{sev}', 'confidence': {conf}, "
            f"'action': 'BLOCK', 'matched': {matched}}}")


def scan_cte(src, col, name="scanned", prefix=""):
    """CTEs that add {prefix}findings, {prefix}fcount and {prefix}fconf to a relation."""
    p = prefix
    arms = ", ".join(
        f"CASE WHEN regexp_matches({p}nt, {q(r[4])}) THEN "
        + _finding(r[0], r[1], r[2], r[3], f"regexp_extract({p}nt, {q(r[4])}, 0)") + " END"
        for r in RULES)
    enc = _finding(9, "ENCODED_PROMPT_INJECTION", "HIGH", 90, f"{p}pl")
    return f"""
{name}_n AS (SELECT *, {norm(col)} AS {p}nt, {payload(col)} AS {p}pl FROM {src}),
{name}_f AS (SELECT *, list_filter([{arms}, CASE WHEN {p}pl IS NOT NULL THEN {enc} END],
                                   lambda v: v IS NOT NULL) AS {p}raw_findings FROM {name}_n),
{name} AS (
  SELECT *, CAST(len({p}findings) AS INTEGER) AS {p}fcount,
         CAST(coalesce(list_max(list_transform({p}findings, lambda v: v.confidence)), 0)
              AS INTEGER) AS {p}fconf
  FROM (SELECT *, CASE WHEN len({p}raw_findings) > 0 AND {benign(col)} THEN []
                       ELSE {p}raw_findings END AS {p}findings FROM {name}_f)
)"""


def hit(x):
    """Full scan of one text as a boolean expression."""
    return f"(({any_rule_raw(x)} OR {payload(x)} IS NOT NULL) AND NOT {benign(x)})"


def safe_lines(x):
    return strip(f"array_to_string(list_filter(string_split({x}, chr(10)), "
                 f"lambda ln: NOT {hit('ln')}), chr(10))")


def pii_cte(src, col, name="redacted", prefix=""):
    """CTEs that add {prefix}red (text), {prefix}pii (list of types) and {prefix}pcount."""
    p = prefix
    return f"""
{name}_1 AS (SELECT *, regexp_matches({col}, {q(EMAIL)}) AS {p}h1,
             regexp_replace({col}, {q(EMAIL)}, '<EMAIL_REDACTED>', 'g') AS {p}r1 FROM {src}),
{name}_2 AS (SELECT *, regexp_matches({p}r1, {q(PHONE)}) AS {p}h2,
             regexp_replace({p}r1, {q(PHONE)}, '<PHONE_REDACTED>', 'g') AS {p}r2 FROM {name}_1),
{name} AS (SELECT *, regexp_matches({p}r2, {q(SSN)}) AS {p}h3,
             regexp_replace({p}r2, {q(SSN)}, '<SSN_REDACTED>', 'g') AS {p}red,
             list_filter([CASE WHEN {p}h1 THEN 'EMAIL_ADDRESS' END,
                          CASE WHEN {p}h2 THEN 'PHONE_NUMBER' END,
                          CASE WHEN regexp_matches({p}r2, {q(SSN)}) THEN 'SSN' END],
                         lambda v: v IS NOT NULL) AS {p}pii,
             CAST({p}h1 AS INTEGER) + CAST({p}h2 AS INTEGER)
               + CAST(regexp_matches({p}r2, {q(SSN)}) AS INTEGER) AS {p}pcount FROM {name}_2)"""


def secret(x):
    return f"CAST(regexp_matches({x}, {q(SECRET)}) AS INTEGER)"


def score(sec, pii, inj, conf):
    return (f"CAST(least(100, CASE WHEN {pii} > 0 THEN 30 ELSE 0 END + CASE WHEN {sec} > 0 "
            f"THEN 95 ELSE 0 END + CASE WHEN {inj} > 0 THEN {conf} ELSE 0 END) AS INTEGER)")


def severity(s):
    return (f"CASE WHEN {s} >= 80 THEN 'CRITICAL' WHEN {s} >= 60 THEN 'HIGH' "
            f"WHEN {s} >= 30 THEN 'MEDIUM' ELSE 'LOW' END")


def action(s):
    return (f"CASE WHEN {s} >= 80 THEN 'BLOCK' WHEN {s} >= 60 THEN 'REVIEW' "
            f"WHEN {s} >= 30 THEN 'ALLOW_WITH_REDACTION' ELSE 'ALLOW' END")


def types(f="findings"):
    return f"array_to_string(list_transform({f}, lambda v: v.type), ',')"


def matched(f="findings"):
    return f"array_to_string(list_transform({f}, lambda v: v.matched), '|')"


# Judged chat requests: prompt of all user and system turns, last assistant text as response.
CHAT = X.ATTACKED_SQL + f""",
placed AS (
  SELECT *, role = 'assistant' AND turn = max(turn) OVER (PARTITION BY conv_id) AS final
  FROM attacked),
chat AS (
  SELECT conv_id,
    {strip("coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (NOT final), '')")}
      AS raw_prompt,
    max(text) FILTER (final) AS answer
  FROM placed GROUP BY conv_id),
""" + scan_cte("chat", "raw_prompt", "chat_s") + "," + pii_cte("chat_s", "raw_prompt", "chat_p") \
    + f""",
chat_r AS (SELECT *, {secret('raw_prompt')} AS sec,
           {score(secret('raw_prompt'), 'pcount', 'fcount', 'fconf')} AS risk_score FROM chat_p),
judged AS (SELECT *, {severity('risk_score')} AS severity, {action('risk_score')} AS decision
           FROM chat_r),
""" + pii_cte("judged", "answer", "out_p", "o_") + f""",
merged AS (
  SELECT *, {secret('answer')} AS osec, decision <> 'BLOCK' AND answer IS NULL AS failed,
         decision <> 'BLOCK' AND coalesce({secret('answer')} > 0, FALSE) AS output_blocked
  FROM out_p)"""

MESSAGE = """CASE WHEN decision = 'BLOCK' THEN 'request blocked by security policy'
  WHEN decision = 'ALLOW_WITH_REDACTION' THEN 'request allowed after sensitive data redaction'
  ELSE 'request passed security checks' END"""

PII_JSON = """CASE WHEN {p}pcount = 0 THEN '[]' ELSE '[' || array_to_string(list_filter([
  CASE WHEN {p}h1 THEN '{{"type":"EMAIL_ADDRESS","severity":"MEDIUM","action":"REDACT","redacted_as":"<EMAIL_REDACTED>"}}' END,
  CASE WHEN {p}h2 THEN '{{"type":"PHONE_NUMBER","severity":"MEDIUM","action":"REDACT","redacted_as":"<PHONE_REDACTED>"}}' END,
  CASE WHEN {p}h3 THEN '{{"type":"SSN","severity":"HIGH","action":"REDACT","redacted_as":"<SSN_REDACTED>"}}' END],
  lambda v: v IS NOT NULL), ',') || ']' END"""
SECRET_JSON = ("CASE WHEN {c} > 0 THEN '[{{\"type\":\"ACCESS_KEY\",\"severity\":\"CRITICAL\","
               "\"action\":\"BLOCK\"}}]' ELSE '[]' END")
AUDIT = CHAT + f""",
audit AS (
  SELECT conv_id AS id, 'req_' || CAST(conv_id AS VARCHAR) AS request_id, 'mock' AS provider,
         'base' AS model, decision, risk_score, severity,
         CAST(length(raw_prompt) AS BIGINT) AS latency_ms,
         {SECRET_JSON.format(c='sec')} AS secret_findings,
         {PII_JSON.format(p='')} AS pii_findings,
         CASE WHEN fcount = 0 AND len(raw_findings) > 0 THEN 'null' WHEN fcount = 0 THEN '[]'
              ELSE CAST(to_json(findings) AS VARCHAR) END
           AS injection_findings,
         decision = 'BLOCK' AS input_blocked, o_pcount, conv_id
  FROM merged WHERE NOT output_blocked AND NOT failed)"""

STATS = """
  SELECT count(*) AS total_requests,
         count(*) FILTER (WHERE decision = 'ALLOW') AS allowed_requests,
         count(*) FILTER (WHERE decision = 'ALLOW_WITH_REDACTION') AS redacted_requests,
         count(*) FILTER (WHERE decision = 'BLOCK') AS blocked_requests,
         coalesce(avg(latency_ms), 0) AS average_latency_ms,
         coalesce(avg(risk_score), 0) AS average_risk_score,
         count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_events,
         count(*) FILTER (WHERE severity = 'HIGH') AS high_severity_events,
         count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_severity_events
  FROM audit"""

# Identity resolution of guarded requests.
RESOLVED = X.API_KEYS_SQL + "," + X.REQUESTS_SQL + """,
resolved AS (
  SELECT r.seq, r.us, r.ts, r.method, r.path, k.id, k.name, k.user_id, k.role, k.team, k.scopes,
         CASE WHEN k.id IS NULL THEN 'invalid API key'
              WHEN k.revoked_at <= r.ts THEN 'API key revoked'
              WHEN r.ts > k.expires_at THEN 'API key expired' END AS reason
  FROM requests r LEFT JOIN api_keys k ON sha256(r.raw_key) = k.key_hash)"""

SCOPE_LIST = ("list_filter(list_transform(string_split(coalesce({s}, ''), ','), "
              "lambda v: trim(v)), lambda v: v <> '')")

# Retrieval pipeline.
RAG = X.RETRIEVAL_SQL + f""",
access AS (
  SELECT *, CASE
      WHEN upper(classification) = 'RESTRICTED' AND coalesce(role, '') <> 'admin'
        THEN 'restricted document requires admin role'
      WHEN listed AND (role IN ('analyst', 'admin')) IS NOT TRUE
        THEN 'caller role is not authorized for document'
      WHEN owner_team <> '' AND coalesce(team, '') <> owner_team AND coalesce(role, '') <> 'admin'
        THEN 'cross-team document access denied' END AS denied,
    {strip('content')} AS trimmed
  FROM retrieval),
""" + scan_cte("access", "trimmed", "one") + f""",
inspected AS (
  SELECT *, CASE WHEN fcount = 0 THEN 'ALLOW' WHEN trust_level = 'UNTRUSTED_EXTERNAL' THEN 'BLOCK'
                 ELSE 'FILTER' END AS verdict,
    CASE WHEN fcount = 0 THEN 'document passed retrieval security checks'
         WHEN trust_level = 'UNTRUSTED_EXTERNAL'
           THEN 'untrusted document contains prompt injection'
         ELSE 'trusted document contained suspicious instructions and was filtered' END AS why,
    CASE WHEN fcount = 0 THEN trimmed WHEN trust_level <> 'UNTRUSTED_EXTERNAL'
         THEN {safe_lines('trimmed')} END AS safe
  FROM one)"""
RAG_GROUPS = RAG + """,
raw_join AS (
  SELECT request_id, CAST(count(*) AS INTEGER) AS authorized,
         string_agg(content || chr(10), '' ORDER BY pos) AS raw_text
  FROM inspected WHERE denied IS NULL GROUP BY request_id),
safe_join AS (
  SELECT request_id, string_agg(safe || chr(10), '' ORDER BY pos) AS safe_text
  FROM inspected WHERE denied IS NULL AND verdict <> 'BLOCK' GROUP BY request_id),
grouped AS (
  SELECT a.request_id, coalesce(r.authorized, 0) AS authorized,
         coalesce(r.raw_text, '') AS raw_text, coalesce(s.safe_text, '') AS safe_text
  FROM (SELECT DISTINCT request_id FROM inspected) a
  LEFT JOIN raw_join r USING (request_id) LEFT JOIN safe_join s USING (request_id)),
""" + scan_cte("grouped", "raw_text", "g1", "a_") + "," \
    + scan_cte("g1", "safe_text", "g2", "b_") + """,
verdicts AS (SELECT request_id, authorized, a_fcount > 0 AND authorized > 1 AS combined_hit,
                    b_fcount > 0 AS sanitized_hit FROM g2),
context AS (
  SELECT i.request_id, i.pos, i.id AS document_id, i.source, i.trust_level, i.classification,
         i.owner_team, i.user_id, i.role, i.team,
    CASE WHEN denied IS NOT NULL THEN 'BLOCK' WHEN combined_hit THEN 'BLOCK'
         WHEN sanitized_hit AND verdict <> 'BLOCK' THEN 'BLOCK' ELSE verdict END AS decision,
    denied IS NULL AND NOT combined_hit AND NOT sanitized_hit AND verdict <> 'BLOCK' AS included,
    CASE WHEN denied IS NOT NULL THEN denied
         WHEN combined_hit THEN 'combined retrieval context contains prompt injection'
         WHEN sanitized_hit AND verdict <> 'BLOCK'
           THEN 'sanitized retrieval context contains prompt injection' ELSE why END AS reason,
    CASE WHEN denied IS NULL AND NOT combined_hit AND NOT sanitized_hit AND verdict <> 'BLOCK'
         THEN safe END AS content
  FROM inspected i JOIN verdicts v USING (request_id))"""

# Tool policy.
_FIELDS = ("CASE WHEN json_type(body, '$.fields') = 'ARRAY' THEN "
           "CAST(json_extract(body, '$.fields') AS VARCHAR[]) ELSE [] END")
_SENSITIVE = "('ssn','password','api_key','credit_card','health_data','bank_account')"
_PROTECTED = "('role','permissions','account_owner','billing_plan')"
TOOLS = X.TOOL_CALLS_SQL + f""",
bodies AS (
  SELECT *, NOT json_valid(arguments) AS bad,
         CASE WHEN json_valid(arguments)  -- the last of equal names counts
              THEN regexp_replace(arguments, '^{{.*("fields":.*)$', '{{\\1') ELSE '{{}}' END AS body
  FROM tool_calls),
parsed AS (
  SELECT *, {_FIELDS} AS fields,
         CASE WHEN json_type(body, '$.to') = 'VARCHAR'
              THEN json_extract_string(body, '$.to') ELSE '' END AS recipient
  FROM bodies),
found AS (
  SELECT *, len(list_filter(fields, lambda f: lower(f) IN ('email','phone'))) > 0 AS contact,
         list_filter(fields, lambda f: lower(f) IN {_SENSITIVE})[1] AS sensitive,
         list_filter(fields, lambda f: lower(f) IN {_PROTECTED})[1] AS protected
  FROM parsed),
coded AS (
  SELECT *, CASE WHEN bad THEN 'INVALID|0|invalid arguments' ELSE CASE tool
      WHEN 'search_documents' THEN 'ALLOW|10|read-only search operation'
      WHEN 'read_customer' THEN CASE
        WHEN role = 'analyst' AND contact
          THEN 'DENY|80|analysts cannot access customer contact fields'
        WHEN sensitive IS NOT NULL
          THEN 'DENY|90|sensitive field "' || sensitive || '" cannot be accessed'
        ELSE 'ALLOW|10|requested customer fields are permitted' END
      WHEN 'send_email' THEN CASE
        WHEN role = 'analyst' THEN 'DENY|80|analysts cannot send external email'
        WHEN recipient = '' THEN 'DENY|80|email recipient is required'
        WHEN ends_with(lower(recipient), '@{X.INTERNAL_DOMAIN}')
          THEN 'ALLOW|20|internal email recipient'
        ELSE 'REQUIRE_APPROVAL|60|external email requires human approval' END
      WHEN 'update_customer' THEN CASE
        WHEN protected IS NOT NULL
          THEN 'DENY|90|protected field "' || protected || '" cannot be modified'
        WHEN role = 'analyst' THEN 'DENY|85|analysts cannot modify customer records'
        WHEN role = 'sales' THEN 'REQUIRE_APPROVAL|70|sales customer mutation requires approval'
        ELSE 'ALLOW|30|admin customer mutation permitted' END
      WHEN 'delete_customer' THEN CASE
        WHEN role = 'admin' THEN 'REQUIRE_APPROVAL|95|admin destructive action requires approval'
        ELSE 'DENY|95|only admins may request customer deletion' END
      ELSE 'DENY|90|unknown tools are denied by default' END END AS code
  FROM found),
evaluated AS (
  SELECT call_id, ts, tool, role, arguments, split_part(code, '|', 1) AS decision,
         CAST(split_part(code, '|', 2) AS INTEGER) AS risk, split_part(code, '|', 3) AS reason,
         CASE split_part(code, '|', 1) WHEN 'DENY' THEN 403 WHEN 'REQUIRE_APPROVAL' THEN 202
              WHEN 'INVALID' THEN 400
              ELSE 200 END AS status
  FROM coded)"""

# Traffic: folds as recursive queries, one row of every key per step.
_RANKED = """
ranked AS (SELECT key_id, us, seq, path, handler_status,
                  row_number() OVER (PARTITION BY key_id ORDER BY us, seq) AS rn FROM requests)"""
_SECONDS = "((us - {r}) // 1000000 + ((us - {r}) % 1000000) * 1000 / 1e9)"
_REFILL = ("CASE WHEN us > {r} THEN least({t} + " + _SECONDS
           + f" * {X.BUCKET_RATE!r}, {float(X.BUCKET_CAPACITY)}) ELSE {{t}} END")
_RETRY = (f"greatest(CAST(trunc((1 - {{t}}) / {X.BUCKET_RATE!r} * 1e9) AS BIGINT), 1000000)")
_SECS = "CASE WHEN {ns} IS NOT NULL THEN greatest(({ns} + 500000000) // 1000000000, 1) END"

BUCKET = X.REQUESTS_SQL + "," + _RANKED + f""",
fold AS (
  SELECT key_id, us, seq, rn, TRUE AS allowed, {float(X.BUCKET_CAPACITY)}::DOUBLE - 1 AS tokens,
         us AS refilled
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT key_id, us, seq, rn, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END,
         greatest(us, refilled)
  FROM (SELECT r.key_id, r.us, r.seq, r.rn, f.refilled,
               {_REFILL.format(r='f.refilled', t='f.tokens').replace('us ', 'r.us ').replace('(us', '(r.us')} AS t
        FROM fold f JOIN ranked r ON r.key_id = f.key_id AND r.rn = f.rn + 1))"""

_D, _C, _T = X.DECAY_US, X.COOLDOWN_US, X.THRESHOLD
GUARD = X.REQUESTS_SQL + "," + _RANKED + f""",
fold AS (
  SELECT key_id, CAST(0 AS BIGINT) AS us, CAST(-1 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS path,
         CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS status,
         CAST(NULL AS BIGINT) AS wait_ns, CAST(NULL AS DOUBLE) AS tokens,
         CAST(NULL AS BIGINT) AS refilled, CAST(0 AS BIGINT) AS points,
         CAST(0 AS BIGINT) AS score, FALSE AS entered, CAST(NULL AS BIGINT) AS until_us,
         CAST(NULL AS BIGINT) AS updated_us
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT key_id, us, seq, path, rn, outcome, status, wait_ns, tokens, refilled, points,
         CASE WHEN points > 0 THEN s2 + points ELSE s1 END,
         points > 0 AND s2 + points >= {_T} AND us >= coalesce(until1, us),
         CASE WHEN points > 0 AND s2 + points >= {_T} AND us >= coalesce(until1, us)
              THEN us + {_C} ELSE until1 END,
         CASE WHEN points > 0 THEN us ELSE upd1 END
  FROM (
   SELECT *, CASE WHEN status = 429 AND outcome <> 'COOLDOWN_BLOCKED' THEN 1
                  WHEN status = 403 AND path IN ('/v1/chat/completions', '/v1/rag/chat') THEN 3
                  ELSE 0 END AS points,
          greatest(0, s1 - CASE WHEN upd1 IS NULL THEN 0 ELSE (us - upd1) // {_D} END) AS s2
   FROM (
    SELECT *, CASE WHEN blocked THEN 'COOLDOWN_BLOCKED' WHEN t >= 1 THEN 'ADMITTED'
                   ELSE 'RATE_LIMITED' END AS outcome,
           CASE WHEN blocked OR t < 1 THEN 429 ELSE handler_status END AS status,
           CASE WHEN blocked THEN (until1 - us) * 1000
                WHEN t < 1 THEN {_RETRY.format(t='t')} END AS wait_ns,
           CASE WHEN blocked THEN tokens0 WHEN t >= 1 THEN t - 1 ELSE t END AS tokens,
           CASE WHEN blocked THEN refilled0 ELSE greatest(us, coalesce(refilled0, us)) END
             AS refilled
    FROM (
     SELECT *, CASE WHEN tokens0 IS NULL THEN {float(X.BUCKET_CAPACITY)}
                    ELSE {_REFILL.format(r='refilled0', t='tokens0')} END AS t,
            coalesce(us < until0, FALSE) AS blocked,
            CASE WHEN us < until0 THEN until0 END AS until1
     FROM (
      SELECT r.key_id, r.us, r.seq, r.path, r.rn, r.handler_status, f.tokens AS tokens0,
             f.refilled AS refilled0, f.until_us AS until0,
             greatest(0, f.score - coalesce((r.us - f.updated_us) // {_D}, 0)) AS s1,
             f.updated_us + ((r.us - f.updated_us) // {_D}) * {_D} AS upd1
      FROM fold f JOIN ranked r ON r.key_id = f.key_id AND r.rn = f.rn + 1)))))"""
GUARD_ROWS = GUARD + f""",
guarded AS (
  SELECT key_id, us, seq, rn, path, outcome, CAST(status AS INTEGER) AS status,
         {_SECS.format(ns='wait_ns')} AS retry_after_seconds, tokens,
         CAST(points AS INTEGER) AS points,
         CASE WHEN points = 1 THEN 'rate_limit_violation'
              WHEN points = 3 AND path = '/v1/chat/completions' THEN 'chat_security_block'
              WHEN points = 3 THEN 'rag_security_block' ELSE '' END AS reason,
         CAST(score AS INTEGER) AS score, entered, until_us AS cooldown_until_us, updated_us
  FROM fold WHERE rn > 0)"""

VIOLATIONS = X.REQUESTS_SQL + """,
violations AS (
  SELECT key_id, us, seq, path, handler_status AS status, 3 AS points FROM requests
  WHERE handler_status = 403 AND path IN ('/v1/chat/completions', '/v1/rag/chat')),
vranked AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY us, seq) AS rn
            FROM violations)"""
SCORES = VIOLATIONS + f""",
scored AS (
  SELECT key_id, us, seq, rn, CAST(points AS BIGINT) AS score FROM vranked WHERE rn = 1
  UNION ALL
  SELECT r.key_id, r.us, r.seq, r.rn,
         greatest(0, f.score - (r.us - f.us) // {_D}) + r.points
  FROM scored f JOIN vranked r ON r.key_id = f.key_id AND r.rn = f.rn + 1)"""
COOL = SCORES + f""",
cool AS (
  SELECT key_id, us, seq, rn, score, score >= {_T} AS entered,
         CASE WHEN score >= {_T} THEN us + {_C} END AS until_us
  FROM scored WHERE rn = 1
  UNION ALL
  SELECT r.key_id, r.us, r.seq, r.rn, r.score,
         r.score >= {_T} AND us_ok(r.us, f.until_us),
         CASE WHEN r.score >= {_T} AND us_ok(r.us, f.until_us) THEN r.us + {_C}
              ELSE f.until_us END
  FROM cool f JOIN scored r ON r.key_id = f.key_id AND r.rn = f.rn + 1)""".replace(
    "us_ok(r.us, f.until_us)", "(f.until_us IS NULL OR r.us >= f.until_us)")
GATE = X.REQUESTS_SQL + "," + _RANKED + f""",
pranked AS (SELECT *, CASE WHEN handler_status = 403 AND path IN
              ('/v1/chat/completions', '/v1/rag/chat') THEN 3 ELSE 0 END AS points FROM ranked),
gate AS (
  SELECT key_id, us, seq, rn, FALSE AS blocked, CAST(NULL AS BIGINT) AS wait_ns,
         CAST(points AS BIGINT) AS score,
         CASE WHEN points > 0 THEN us END AS updated_us,
         CASE WHEN points >= {_T} THEN us + {_C} END AS until_us
  FROM pranked WHERE rn = 1
  UNION ALL
  SELECT key_id, us, seq, rn, blocked, CASE WHEN blocked THEN (until1 - us) * 1000 END,
         CASE WHEN blocked OR points = 0 THEN s1 ELSE s1 + points END,
         CASE WHEN blocked OR points = 0 THEN upd1 ELSE us END,
         CASE WHEN NOT blocked AND points > 0 AND s1 + points >= {_T} THEN us + {_C}
              ELSE until1 END
  FROM (
    SELECT r.key_id, r.us, r.seq, r.rn, r.points, coalesce(r.us < f.until_us, FALSE) AS blocked,
           CASE WHEN r.us < f.until_us THEN f.until_us END AS until1,
           greatest(0, f.score - coalesce((r.us - f.updated_us) // {_D}, 0)) AS s1,
           f.updated_us + ((r.us - f.updated_us) // {_D}) * {_D} AS upd1
    FROM gate f JOIN pranked r ON r.key_id = f.key_id AND r.rn = f.rn + 1))"""

# Approvals: life cycle as a recursive query, one attempt of every call per step.
APPROVALS = TOOLS + """,
approvals AS (SELECT call_id AS approval_id, ts AS created_at, tool, arguments, risk, reason
              FROM evaluated WHERE decision = 'REQUIRE_APPROVAL')"""
_OK_SCOPE = ("(len(list_filter(" + SCOPE_LIST.format(s="actor_scopes")
             + ", lambda v: v = '*' OR v = need)) > 0)")
REPLAY = APPROVALS + "," + X.ATTEMPTS_SQL + f""",
needed AS (
  SELECT call_id AS approval_id, ts, o1, o2, o3, o4, action, actor_role, actor_scopes,
         CASE WHEN action IN ('approve', 'reject') THEN 'approvals:write'
              WHEN action = 'claim' THEN 'tools:execute' END AS need,
         row_number() OVER (PARTITION BY call_id ORDER BY ts, o1, o2, o3, o4) AS rn
  FROM attempts),
checked AS (
  SELECT n.*, a.approval_id IS NOT NULL AS known,
         CASE WHEN need IS NOT NULL AND NOT {_OK_SCOPE} THEN 'required scope: ' || need
              WHEN need IS NOT NULL AND actor_role <> 'admin' THEN 'admin role required' END
           AS barred
  FROM needed n LEFT JOIN approvals a USING (approval_id)),
steps AS (
  SELECT approval_id, CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS action,
         CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS barred, FALSE AS known,
         CAST('PENDING' AS VARCHAR) AS prior, CAST('PENDING' AS VARCHAR) AS next
  FROM checked WHERE rn = 1
  UNION ALL
  SELECT c.approval_id, c.rn, c.action, c.ts, c.barred, c.known, s.next,
         CASE WHEN NOT c.known OR c.barred IS NOT NULL THEN s.next
              WHEN s.next = 'PENDING' AND c.action = 'approve' THEN 'APPROVED'
              WHEN s.next = 'PENDING' AND c.action = 'reject' THEN 'REJECTED'
              WHEN s.next = 'APPROVED' AND c.action = 'claim' THEN 'EXECUTING'
              WHEN s.next = 'EXECUTING' AND c.action = 'finish' THEN 'EXECUTED'
              WHEN s.next = 'EXECUTING' AND c.action = 'fail' THEN 'APPROVED'
              ELSE s.next END
  FROM steps s JOIN checked c ON c.approval_id = s.approval_id AND c.rn = s.rn + 1),
classified AS (
  SELECT approval_id, rn, action, ts, known, CASE WHEN known THEN prior END AS prior_status,
         CASE WHEN barred IS NOT NULL THEN barred
              WHEN action IN ('approve', 'reject') AND (NOT known OR prior <> 'PENDING')
                THEN 'approval not found or already resolved'
              WHEN NOT known THEN 'approval not found'
              WHEN action = 'claim' AND prior = 'EXECUTED' THEN 'approval already executed'
              WHEN action = 'claim' AND prior = 'EXECUTING'
                THEN 'approval execution already in progress'
              WHEN action = 'claim' AND prior <> 'APPROVED'
                THEN 'approval must be APPROVED before execution'
              WHEN action IN ('finish', 'fail') AND prior <> 'EXECUTING'
                THEN 'no execution in progress' END AS conflict,
         CASE WHEN known THEN next END AS new_status
  FROM steps WHERE rn > 0),
final AS (
  SELECT a.*, coalesce(l.status, 'PENDING') AS status, l.executed_at
  FROM approvals a LEFT JOIN (
    SELECT approval_id, arg_max(new_status, rn) AS status,
           max(CASE WHEN action = 'finish' THEN ts END) AS executed_at
    FROM classified WHERE conflict IS NULL GROUP BY approval_id) l USING (approval_id))"""
EVENT_NAMES = ("CASE action WHEN 'approve' THEN 'TOOL_APPROVED' WHEN 'reject' THEN "
               "'TOOL_REJECTED' WHEN 'claim' THEN 'TOOL_EXECUTION_STARTED' "
               "ELSE 'TOOL_EXECUTION_SUCCEEDED' END")

AT_US = 1706140800000000
STATE = GUARD_ROWS + f""",
state AS (
  SELECT key_id,
         CAST(greatest(0, s.score - ({AT_US} - s.updated_us) // {_D}) AS INTEGER) AS score,
         s.score AS stored_score,
         s.updated_us + (({AT_US} - s.updated_us) // {_D}) * {_D} AS last_updated_us,
         s.cooldown_until_us AS cooldown_until_us
  FROM (SELECT key_id, arg_max({{'score': score, 'updated_us': updated_us,
                                'cooldown_until_us': cooldown_until_us}}, rn) AS s
        FROM guarded WHERE us <= {AT_US} AND updated_us IS NOT NULL GROUP BY key_id))"""
POSTURE = STATE + "," + X.API_KEYS_SQL + f""",
posture AS (
  SELECT k.id AS key_id, k.name, k.user_id, k.role, k.team, k.scopes,
         coalesce(s.stored_score, 0) AS abuse_score,
         CASE WHEN k.revoked_at IS NOT NULL THEN 'REVOKED'
              WHEN s.cooldown_until_us > {AT_US} THEN 'COOLDOWN'
              WHEN coalesce(s.stored_score, 0) > 0 THEN 'ELEVATED' ELSE 'HEALTHY' END AS status,
         s.cooldown_until_us, epoch_us(k.revoked_at) AS revoked_us
  FROM api_keys k LEFT JOIN state s ON s.key_id = k.id)"""
SUMMARY = """
  SELECT count(*) AS total, count(*) FILTER (WHERE status = 'HEALTHY') AS healthy,
         count(*) FILTER (WHERE status = 'ELEVATED') AS elevated,
         count(*) FILTER (WHERE status = 'COOLDOWN') AS cooldown,
         count(*) FILTER (WHERE status = 'REVOKED') AS revoked
  FROM posture"""

EVAL = X.ATTACKED_SQL + "," + scan_cte("attacked", "text", "inj_s") + "," \
    + pii_cte("attacked", "text", "pii_s") + "," + RAG_GROUPS.lstrip() + f""",
inj_eval AS (
  SELECT conv_id, turn, CASE WHEN k IN {X.ATTACKS} THEN 'BLOCK' ELSE 'ALLOW' END AS expected,
         CASE WHEN fcount > 0 AND fconf >= 60 THEN 'BLOCK' ELSE 'ALLOW' END AS actual
  FROM inj_s),
pii_eval AS (
  SELECT CASE WHEN k IN (11, 13) THEN 3 ELSE 0 END = pcount AS passed FROM pii_s),
rag_eval AS (
  SELECT c.included = e.expected AS passed
  FROM (SELECT request_id, count(*) FILTER (WHERE included) AS included FROM context
        GROUP BY request_id) c
  JOIN (SELECT doc_id // 4 AS request_id, count(*) FILTER (WHERE k NOT IN {X.ATTACKS}) AS expected
        FROM attacked_documents GROUP BY 1) e USING (request_id)),
counted AS (
  SELECT 'prompt_injection' AS suite, count(*) AS total,
         count(*) FILTER (WHERE expected = actual) AS passed,
         count(*) FILTER (WHERE expected = 'BLOCK' AND actual = 'BLOCK') AS tp,
         count(*) FILTER (WHERE expected = 'ALLOW' AND actual = 'BLOCK') AS fp,
         count(*) FILTER (WHERE expected = 'BLOCK' AND actual = 'ALLOW') AS fn FROM inj_eval
  UNION ALL SELECT 'pii', count(*), count(*) FILTER (WHERE passed), 0, 0, 0 FROM pii_eval
  UNION ALL SELECT 'rag', count(*), count(*) FILTER (WHERE passed), 0, 0, 0 FROM rag_eval),
metric AS (
  SELECT suite, total, passed, total - passed AS failed,
         CASE WHEN total > 0 THEN passed / total ELSE 0.0 END AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
         fp AS false_positives, fn AS false_negatives
  FROM counted)"""

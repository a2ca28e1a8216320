"""Retrieval contexts: document access, inspection, cross-document checks, trace and prompt."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.session import new_folder
from . import scan, seams
from .replay import MAX_GROUP_ROWS
from .scan import _once, _with

ADMIN = "admin"
UNTRUSTED = "UNTRUSTED_EXTERNAL"

# Reasons of the trace.
R_RESTRICTED = "restricted document requires admin role"
R_ROLE = "caller role is not authorized for document"
R_TEAM = "cross-team document access denied"
R_PERMITTED = "document access permitted"
R_PASSED = "document passed retrieval security checks"
R_UNTRUSTED = "untrusted document contains prompt injection"
R_FILTERED = "trusted document contained suspicious instructions and was filtered"
R_COMBINED = "combined retrieval context contains prompt injection"
R_SANITIZED = "sanitized retrieval context contains prompt injection"
# Errors of a retrieval answer.
E_FAILED = "model provider request failed"
E_UNSAFE = "model output blocked"


def _access_reason() -> Column:
    """First failing access rule, or NULL. A missing role or team is an empty one: it grants
    nothing."""
    role, team = F.coalesce("role", F.lit("")), F.coalesce("team", F.lit(""))
    is_admin = role == ADMIN
    roles = F.coalesce(F.col("allowed_roles"), F.array().cast("array<string>"))
    owner = F.coalesce(F.col("owner_team"), F.lit(""))
    return (
        F.when((F.upper("classification") == "RESTRICTED") & ~is_admin, R_RESTRICTED)
        .when((F.size(roles) > 0) & ~F.coalesce(
            F.exists(roles, lambda r: F.lower(r) == F.lower(role)), F.lit(False)), R_ROLE)
        .when((owner != "") & (team != owner) & ~is_admin, R_TEAM))


def authorize(docs: DataFrame) -> DataFrame:
    """Append allowed and access_reason; rows carry the caller's role and team."""
    df = _with(docs, _denied=_access_reason())
    return _with(df, allowed=F.col("_denied").isNull(),
                 access_reason=F.coalesce("_denied", F.lit(R_PERMITTED))).drop("_denied")


def inspect(docs: DataFrame, content="content", exempt=None, of_norm=None) -> DataFrame:
    """Append decision, sanitized, findings and reason of each document on its own.

    Line filtering runs only for the documents it applies to. `exempt` and `of_norm` name further
    columns, see `scan.scan_injection`.
    """
    df = _with(docs, _text=text.strip(content))
    df = scan.scan_injection(df, "_text", "findings", "injection_count", "max_confidence",
                             exempt, of_norm)
    clean = F.col("injection_count") == 0
    blocked = F.col("trust_level") == UNTRUSTED
    df = _once(
        df,
        decision=F.when(clean, "ALLOW").when(blocked, "BLOCK").otherwise("FILTER"),
        sanitized=F.when(clean, F.col("_text"))
        .when(~F.coalesce(blocked, F.lit(False)), text.keep_safe_lines("_text")),
        reason=F.when(clean, R_PASSED).when(blocked, R_UNTRUSTED).otherwise(R_FILTERED))
    return df.drop("_text")


def denied_entries(docs: DataFrame) -> DataFrame:
    """Access stage alone: the trace entries of documents the caller may not read."""
    return authorize(docs).filter(~F.col("allowed")).select(
        "request_id", "pos", "id", F.lit("BLOCK").alias("decision"),
        F.lit(False).alias("included"), F.col("access_reason").alias("reason"))


def _stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder: read several times, in columns, and rows keep their number."""
    folder = new_folder(df.sparkSession, "inspected")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _inspected(docs: DataFrame) -> DataFrame:
    """Access and inspection of every document, with its part in both texts of its request.

    `_raw` and `_safe` are digests of the readable and of the admissible text (see
    `operators.seams`), NULL where the document is not in it.
    """
    df = authorize(docs)
    df = _with(df, content=F.when(F.col("allowed"), F.col("content")))
    df = inspect(df, exempt="_excused", of_norm={"_digest": seams.digest})
    allowed, kept = F.col("allowed"), F.col("decision") != "BLOCK"
    filtered = allowed & (F.col("decision") == "FILTER")
    df = _with(df, _filtered=F.when(filtered, F.col("sanitized")),
               _own=(F.col("injection_count") > 0) | F.col("_excused"))
    df = scan.normalize(df, "_filtered", "_norm")
    df = seams.with_hit(df, "_norm", "_rule")
    df = _with(df, _left=F.col("_rule") | text.encoded_payload("_filtered").isNotNull())
    df = scan._once(df, _marked=text.is_framed("content"))
    df = scan._once(
        df, raw=F.when(allowed, text.clean("content")), filtered=F.col("_filtered"),
        _raw=F.when(allowed, F.col("_digest")), _raw_hit=allowed & F.col("_own"),
        _raw_framed=allowed & F.col("_marked"),
        _safe=F.when(filtered, seams.digest("_norm")).when(allowed & kept, F.col("_digest")),
        _safe_hit=F.when(filtered, F.col("_left")).otherwise(allowed & kept & F.col("_own")),
        _safe_framed=F.when(filtered, text.is_framed("_filtered"))
        .otherwise(allowed & kept & F.col("_marked")))
    return df.select(
        "request_id", "pos", "id", "source", "trust_level", "classification", "owner_team",
        "allowed", F.when(allowed, F.col("decision")).otherwise("BLOCK").alias("decision"),
        F.when(allowed, F.col("reason")).otherwise(F.col("access_reason")).alias("reason"),
        "raw", "filtered", *[f"_{v}{c}" for v in ("raw", "safe") for c in ("", "_hit", "_framed")],
        F.monotonically_increasing_id().alias("_n"))


def _safe_text() -> Column:
    return F.when(F.col("_safe").isNotNull(), F.coalesce("filtered", text.strip("raw")))


def _verdicts(rows: DataFrame, chunk, max_group_rows, slices) -> DataFrame:
    """One row per request: readable documents and what both of its combined texts hold."""
    rows = _with(rows, _at=F.struct("pos", "id", "_n"), _chunk=F.expr(f"pos div {int(chunk)}"))
    chunked = bool(rows.agg(F.min("_chunk") < F.max("_chunk")).first()[0])
    # every document is in a view, so that requests without a readable one come out too
    views = F.array_compact(F.array(*[
        F.when(is_in, F.struct(F.lit(v).alias("_view"), *[
            F.col(f"{v}{c}").alias(n) for c, n in (("", "_digest"), ("_hit", "_hit"),
                                                   ("_framed", "_framed"))]))
        for v, is_in in (("_raw", F.lit(True)), ("_safe", F.col("_safe").isNotNull()))]))
    parts = rows.select("request_id", "_at", "_chunk", F.inline(views),
                        F.col("allowed").cast("int").alias("_count"))
    judged = seams.judge_parts(parts, ["request_id", "_view"], chunked)

    def of(view, column):
        return F.max(F.when(F.col("_view") == view, F.col(column)))

    judged = judged.groupBy("request_id").agg(
        of("_raw", "_count").cast("int").alias("authorized"),
        *[F.coalesce(of(v, c), F.lit(False)).alias(v + c)
          for v in ("_raw", "_safe") for c in ("_hit", "_framed")])
    # a single readable document is judged on its own, not as a combination
    judged = _with(judged, _raw_hit=F.col("_raw_hit") & (F.col("authorized") > 1))
    judged = _stored(judged)
    open_views = F.array_compact(F.array(*[
        F.when(F.col(f"{v}_hit") & F.col(f"{v}_framed"), F.lit(v)) for v in ("_raw", "_safe")]))
    asked = judged.select("request_id", F.explode(open_views).alias("_view"))
    if not asked.isEmpty():
        views = F.explode(F.array_compact(F.array(
            F.when(F.col("_raw").isNotNull(), F.struct(
                F.lit("_raw").alias("_view"), F.col("raw").alias("_text"))),
            F.when(F.col("_safe").isNotNull(), F.struct(
                F.lit("_safe").alias("_view"), _safe_text().alias("_text"))))))
        texts = rows.select("request_id", "_at", "_chunk", "_n", views.alias("_v")).select(
            "request_id", "_at", "_chunk", "_n", "_v.*")
        a, t = asked.alias("a"), texts.alias("t")
        texts = t.join(a, F.col("t.request_id").eqNullSafe(F.col("a.request_id"))
                       & (F.col("t._view") == F.col("a._view")), "left_semi")
        texts = texts.select(F.struct("request_id", "_view").alias("_key"), "_at", "_chunk", "_n",
                             "_text")
        free = seams.exempt(texts, "_key", chunked, max_group_rows, slices).groupBy(
            F.col("_key.request_id").alias("_rid")).agg(
            F.collect_set("_key._view").alias("_free"))
        judged = judged.join(free, F.col("request_id").eqNullSafe(F.col("_rid")), "left")
        for v in ("_raw", "_safe"):
            judged = _with(judged, **{f"{v}_hit": F.col(f"{v}_hit") & ~F.coalesce(
                F.array_contains("_free", v), F.lit(False))})
    return judged.select("request_id", "authorized", F.col("_raw_hit").alias("combined_hit"),
                         F.col("_safe_hit").alias("sanitized_hit"))


def cross_document(docs: DataFrame, chunk=seams.CHUNK, max_group_rows=MAX_GROUP_ROWS,
                   slices=None) -> DataFrame:
    """One row per request: authorized, combined_hit and sanitized_hit, without its texts meeting
    in one row or task. `docs` as for `judge_documents`."""
    return _verdicts(_stored(_inspected(docs)), chunk, max_group_rows, slices)


def judge_documents(docs: DataFrame, chunk=seams.CHUNK, max_group_rows=MAX_GROUP_ROWS,
                    slices=None) -> DataFrame:
    """One row per document: its trace entry after all five stages, with the admitted text in
    `content`, and the verdicts on its request.

    docs(request_id, pos, id, source, owner_team, classification, trust_level, content,
    allowed_roles, role, team); pos is a whole number, different within a request.

    Every text is scanned once, where it lies, and stored. A denied document is neither scanned nor
    is its text kept. The combination of a request's documents is judged by the ends of its texts
    (see `operators.seams`), so a request may be larger than any row or task. Documents with the
    same position follow each other by id, then as read.
    """
    rows = _stored(_inspected(docs))
    verdicts = _verdicts(rows, chunk, max_group_rows, slices).withColumnRenamed(
        "request_id", "_rid")
    df = rows.join(verdicts, F.col("request_id").eqNullSafe(F.col("_rid")))
    combined, sanitized = F.col("combined_hit"), F.col("sanitized_hit")
    candidate = F.col("_safe").isNotNull()
    early = combined & F.col("allowed")
    late = ~combined & sanitized & candidate
    included = candidate & ~combined & ~sanitized
    return df.select(
        "request_id", "pos", F.col("id").alias("document_id"), "source", "trust_level",
        "classification", "owner_team",
        F.when(early | late, "BLOCK").otherwise(F.col("decision")).alias("decision"),
        included.alias("included"),
        F.when(early, R_COMBINED).when(late, R_SANITIZED).otherwise(F.col("reason"))
        .alias("reason"),
        F.when(included, _safe_text()).alias("content"),
        "authorized", "combined_hit", "sanitized_hit")


_ENTRY = ("pos", "document_id", "source", "trust_level", "classification", "owner_team",
          "decision", "included", "reason", "content")


def document_context(docs: DataFrame) -> DataFrame:
    """`build_context` straight from the documents: no request's texts meet in a row."""
    return judge_documents(docs).select("request_id", *_ENTRY)


def judge_requests(docs: DataFrame, texts=True) -> DataFrame:
    """One row per request: its entries in input order, decided by all five stages.

    Only the entries meet in the row, with the admitted texts, which a prompt needs; without
    `texts` (for traces) their content is NULL. `docs` as for `judge_documents`.
    """
    df = judge_documents(docs)
    if not texts:
        df = _with(df, content=F.lit(None).cast("string"))
    return df.groupBy("request_id").agg(
        F.max("authorized").alias("authorized"), F.max("combined_hit").alias("combined_hit"),
        F.max("sanitized_hit").alias("sanitized_hit"),
        F.sort_array(F.collect_list(F.struct(*_ENTRY))).alias("entries"))


def build_context(judged: DataFrame) -> DataFrame:
    """One row per document: its trace entry, with the admitted text in `content`."""
    return judged.select("request_id", F.inline_outer("entries"))


def build_trace(judged: DataFrame) -> DataFrame:
    """One row per request: the ordered trace and the number of admitted documents."""
    return judged.select(
        "request_id",
        F.size(F.filter("entries", lambda e: e["included"])).alias("context_count"),
        F.transform("entries", lambda e: e.dropFields("pos", "content")).alias("entries"))


def context_prompt(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query(request_id, query): the model prompt and the number of documents in it.

    A request without admitted documents still gets a prompt.
    """
    admitted = F.filter("entries", lambda e: e["included"])
    block = F.transform(admitted, lambda e: F.concat(
        F.lit("SOURCE: "), e["document_id"], F.lit("\n"), e["content"], F.lit("\n\n")))
    ctx = judged.select("request_id", F.size(admitted).alias("_n"),
                        F.array_join(block, "").alias("_ctx"))
    return queries.join(ctx, "request_id", "left").select(
        "request_id",
        F.concat(F.lit("CONTEXT:\n"), F.coalesce("_ctx", F.lit("")), F.lit("\nQUESTION:\n"),
                 text.clean("query")).alias("prompt"),
        F.coalesce("_n", F.lit(0)).alias("context_count"))


def judge_response(judged: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per responses(request_id, model_response): the verdict on a retrieval answer.

    A missing response is a failed model call. An unsafe one is withheld; a safe one is returned
    redacted, with the number of admitted documents and the trace.
    """
    df = scan.scan_output(responses, "model_response")
    df = df.join(build_trace(judged), "request_id", "left")
    failed = F.col("model_response").isNull()
    ok = ~failed & F.col("output_safe")
    return df.select(
        "request_id",
        F.when(failed, 502).when(~F.col("output_safe"), 403).otherwise(200).alias("status"),
        F.when(failed, E_FAILED).when(~F.col("output_safe"), E_UNSAFE).alias("error"),
        F.when(ok, F.col("output_redacted")).alias("response"),
        F.when(ok, F.coalesce("context_count", F.lit(0))).alias("context_count"),
        F.when(ok, F.col("entries")).alias("context_trace"),
        F.when(~failed, F.col("output_pii_count")).alias("output_pii_count"),
        F.when(~failed, F.col("output_secret_count")).alias("output_secret_count"))


def rag_events(judged: DataFrame, requests: DataFrame) -> DataFrame:
    """Provenance rows: requests(request_id, timestamp, user_id, role, team) plus their trace."""
    t = build_trace(judged).select("request_id", F.to_json("entries").alias("trace"))
    return requests.join(t, "request_id", "left").select(
        "request_id", "timestamp", "user_id", "role", "team",
        F.coalesce("trace", F.lit("[]")).alias("trace"))


def provenance(events: DataFrame, request_id) -> DataFrame:
    """Provenance rows of one request, oldest first."""
    return events.filter(F.col("request_id") == request_id).orderBy("id")

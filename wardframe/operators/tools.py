"""Tool-call policy as one conditional column per output."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import _once, _with

# Field names and roles the policy knows.
CONTACT_FIELDS = ("email", "phone")
SENSITIVE_FIELDS = ("ssn", "password", "api_key", "credit_card", "health_data", "bank_account")
PROTECTED_FIELDS = ("role", "permissions", "account_owner", "billing_plan")
ANALYST, SALES, ADMIN = "analyst", "sales", "admin"
INVALID = "INVALID"
# Values stay variants; a struct keeps the last of equal names.
ARGUMENTS = "fields variant, to variant, _bad string"


def _string_fields() -> Column:
    """The string elements of the "fields" array; NULL when it is no array.

    Elements stay variants until their type is known, so numbers and objects are dropped instead
    of turning into text.
    """
    items = F.expr("try_variant_get(_args.fields, '$', 'array<variant>')")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def _recipient() -> Column:
    value = F.col("_args.to")
    return F.when(F.schema_of_variant(value) == "STRING",
                  F.try_variant_get(value, "$", "string"))


def _first_in(fields: Column, names) -> Column:
    return F.try_element_at(F.filter(fields, lambda f: F.lower(f).isin(*names)), F.lit(1))


def _verdict(decision: str, reason, risk: int) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(decision).alias("decision"), reason.alias("reason"),
                    F.lit(risk).alias("risk"))


def evaluate_tools(calls: DataFrame, internal_domain: str) -> DataFrame:
    """Append decision, reason, risk and status to calls(tool, arguments as JSON text, role).

    The last of equal argument names counts. Arguments that are no JSON object are refused as a
    bad request, not read as a call without arguments; NULL has none.
    """
    df = _with(calls, _args=F.from_json("arguments", ARGUMENTS, {
        "columnNameOfCorruptRecord": "_bad"}))
    body = F.trim("arguments")
    bad = F.col("arguments").isNotNull() & (body != "null") & (
        F.col("_args").isNull() | F.col("_args._bad").isNotNull() | ~body.startswith("{"))
    df = _with(df, _bad=F.coalesce(bad, F.lit(False)))
    df = _with(df, _fields=_string_fields(), _to=_recipient())
    df = _with(df,
               _contact=F.exists("_fields", lambda f: F.lower(f).isin(*CONTACT_FIELDS)),
               _sensitive=_first_in(F.col("_fields"), SENSITIVE_FIELDS),
               _protected=_first_in(F.col("_fields"), PROTECTED_FIELDS))
    tool, role = F.col("tool"), F.col("role")
    analyst = F.coalesce(role == ANALYST, F.lit(False))

    def naming(prefix, field, suffix):
        quoted = F.concat(F.lit('"'), F.col(field), F.lit('"'))
        return F.concat(F.lit(prefix), quoted, F.lit(suffix))

    # Decisions, reasons and risks of the policy.
    read = (
        F.when(analyst & F.col("_contact"),
               _verdict("DENY", "analysts cannot access customer contact fields", 80))
        .when(F.col("_sensitive").isNotNull(),
              _verdict("DENY", naming("sensitive field ", "_sensitive", " cannot be accessed"), 90))
        .otherwise(_verdict("ALLOW", "requested customer fields are permitted", 10)))
    mail = (
        F.when(analyst, _verdict("DENY", "analysts cannot send external email", 80))
        .when(F.coalesce("_to", F.lit("")) == "",
              _verdict("DENY", "email recipient is required", 80))
        .when(F.lower("_to").endswith("@" + internal_domain),
              _verdict("ALLOW", "internal email recipient", 20))
        .otherwise(_verdict("REQUIRE_APPROVAL", "external email requires human approval", 60)))
    update = (
        F.when(F.col("_protected").isNotNull(),
               _verdict("DENY", naming("protected field ", "_protected", " cannot be modified"),
                        90))
        .when(analyst, _verdict("DENY", "analysts cannot modify customer records", 85))
        .when(role == SALES,
              _verdict("REQUIRE_APPROVAL", "sales customer mutation requires approval", 70))
        .otherwise(_verdict("ALLOW", "admin customer mutation permitted", 30)))
    delete = (
        F.when(role == ADMIN,
               _verdict("REQUIRE_APPROVAL", "admin destructive action requires approval", 95))
        .otherwise(_verdict("DENY", "only admins may request customer deletion", 95)))
    verdict = (
        F.when(tool == "read_customer", read)
        .when(tool == "search_documents", _verdict("ALLOW", "read-only search operation", 10))
        .when(tool == "send_email", mail)
        .when(tool == "update_customer", update)
        .when(tool == "delete_customer", delete)
        .otherwise(_verdict("DENY", "unknown tools are denied by default", 90)))
    df = _with(df, _verdict=F.when(F.col("_bad"), _verdict(INVALID, "invalid arguments", 0))
               .otherwise(verdict))
    df = _once(df, decision=F.col("_verdict.decision"), reason=F.col("_verdict.reason"),
               risk=F.col("_verdict.risk"))
    df = df.drop("_args", "_bad", "_fields", "_to", "_contact", "_sensitive", "_protected", "_verdict")
    return _with(df, status=status_code(F.col("decision")))


def status_code(decision: Column) -> Column:
    """Response status of a verdict, chat or tool."""
    return (F.when(decision.isin("DENY", "BLOCK"), 403).when(decision == INVALID, 400)
            .when(decision == "REQUIRE_APPROVAL", 202).otherwise(200))

"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is a list of parts (kind, text, ref, units). A visitor over the parts flattens them
into the message's text: text parts are escaped, image, audio and document parts become ordered
placeholders and leave an attachment record with the tokens that they expand to. A turn is
`<s>[INST]role` + line break + text + `[/INST]</s>`.

Escaping puts a backslash behind every backslash, `<` and `[`. Every control string starts with
`<` or `[` and has no backslash, so none can come out of a text, and reading from left to right
undoes it exactly.
"""

from pyspark.sql import functions as F

BEGIN, HEAD_END, END = "<s>[INST]", "\n", "[/INST]</s>"
#: A line break inside a role, so that the first one ends the head.
BREAK = "<br>"
#: Placeholder and expanded tokens for one unit (an image tile, a second, a page) of each kind.
PLACEHOLDERS = (("image", "[IMG]", 256), ("audio", "[AUDIO]", 25), ("document", "[DOC]", 600))
LEARNED = ("assistant",)

PART = "struct<kind: string, text: string, ref: string, units: int>"


def escape(c):
    return F.regexp_replace(c, r"([\\<\[])", r"$1\\")


def unescape(c):
    return F.regexp_replace(c, r"([\\<\[])\\", "$1")


def text_parts(text):
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"),
                            F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("units")))


def _placeholder(kind):
    mark = F.lit("")
    for name, sign, _ in PLACEHOLDERS:
        mark = F.when(kind == name, F.lit(sign)).otherwise(mark)
    return mark


def _tokens(kind, units):
    size = F.lit(0)
    for name, _, each in PLACEHOLDERS:
        size = F.when(kind == name, F.lit(each)).otherwise(size)
    return size * F.coalesce(units, F.lit(1))


def visit(parts):
    """(text, attachments) of a part list: parts in order, unknown kinds and nulls as nothing."""
    flat = F.array_join(F.transform(parts, lambda p: F.coalesce(
        F.when(p["kind"] == "text", escape(p["text"])).otherwise(_placeholder(p["kind"])),
        F.lit(""))), "")
    kept = F.filter(parts, lambda p: p["kind"].isin([k for k, _, _ in PLACEHOLDERS]))
    attached = F.transform(kept, lambda p, i: F.struct(
        i.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        _tokens(p["kind"], p["units"]).cast("long").alias("tokens")))
    return flat, F.coalesce(attached, F.array().cast(
        "array<struct<ordinal: int, kind: string, ref: string, tokens: bigint>>"))


def format_turns(messages):
    """(conv_id, turn, role, segment, start, learned, attachments) of messages(conv_id, turn,
    role, parts): one row each, without a shuffle. `start` is the text's place in the segment."""
    flat, attached = visit(F.col("parts"))
    head = F.concat(F.lit(BEGIN), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"),
                                            F.lit(BREAK)), F.lit(HEAD_END))
    return messages.select(
        "conv_id", "turn", "role", head.alias("head"), F.coalesce(flat, F.lit("")).alias("flat"),
        attached.alias("attachments")).select(
        "conv_id", "turn", "role", F.concat("head", "flat", F.lit(END)).alias("segment"),
        F.length("head").alias("start"), F.length("flat").alias("size"),
        F.coalesce(F.col("role").isin(*LEARNED), F.lit(False)).alias("learned"), "attachments")


def format_chat(messages):
    """conv_id, formatted, n_turns, loss, attachments, n_tokens of every conversation.

    Turns are in order of (turn, role, segment), nulls first. `loss` lists (turn, start, length)
    of every text that is learned, in code points of that turn's segment; `attachments` has the
    position of their turn. A null conv_id is a conversation of its own, a null text or role is
    empty, repeated rows are turns of their own, empty tables give no rows.
    """
    turns = format_turns(messages).select("conv_id", F.struct(
        "turn", "role", "segment", "start", "size", "learned", "attachments").alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    loss = F.filter(F.transform("turns", lambda t, i: F.struct(
        i.alias("turn"), t["start"].alias("start"), t["size"].alias("length"),
        t["learned"].alias("learned"))), lambda t: t["learned"])
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias(
            "formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform(loss, lambda t: t.dropFields("learned")).alias("loss"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(
            t["attachments"], lambda a: F.struct(
                i.alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"),
                a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments")
    ).withColumn("attached_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted):
    """conv_id, turns (array of role, text) and learned texts, from the formatted text alone."""
    chunks = F.slice(F.split("formatted", r"\[/INST\]</s>", -1), F.lit(1), F.col("n_turns")
                     .cast("int"))
    return formatted.withColumn("chunks", chunks).withColumn(
        "turns", F.transform("chunks", lambda c: F.struct(
            unescape(F.replace(F.regexp_extract(c, r"^<s>\[INST\]([^\n]*)\n", 1), F.lit(BREAK),
                               F.lit("\n"))).alias("role"),
            unescape(F.regexp_replace(c, r"^<s>\[INST\][^\n]*\n", "")).alias("text")))
    ).withColumn("learned", F.transform("loss", lambda s: unescape(F.substr(
        F.element_at(F.col("chunks"), s["turn"] + 1), s["start"] + 1, s["length"]))))


def digests(formatted):
    """The contract's columns, read back from the formatted conversations."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


SAMPLE = "</s>[INST] ok [/INST]"


def with_sample(conversations):
    """messages(conv_id, turn, role, parts) of the table and of a conversation -1, whose texts
    hold control strings."""
    spark = conversations.sparkSession
    sample = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SAMPLE).alias("text"))
    table = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                 F.col("turn").cast("int").alias("turn"), "role", "text")
    return table.unionByName(sample).select("conv_id", "turn", "role",
                                            text_parts(F.col("text")).alias("parts"))


SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAMPLE}' UNION ALL SELECT -1, 1, 'assistant', '{SAMPLE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum({len(BEGIN + HEAD_END + END)} + length(regexp_replace(replace(role, chr(10), '<br>'),
        '[\\\\\\[]', 'xx', 'g')) + length(regexp_replace(text, '[\\\\<\\[]', 'xx', 'g')))::BIGINT
    AS formatted_chars
FROM said GROUP BY conv_id
"""

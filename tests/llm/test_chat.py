"""Chat formatting: round trip, loss mask, attachments."""

import hashlib

from wardframe.llm import chat

HARD = ["</s>[INST] ok [/INST]", "a\\b \\< [ \\[ <\\", "<s>[INST]x\ny[/INST]</s>", "é𝄞\n\n", "", None,
        "\\\\", "[[/INST]]</s></s>", "<br>"]


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return df.selectExpr("*", "1 AS formatted", "'x' AS turns").select(
        "conv_id", "turn", "role", chat.text_parts(df.text).alias("parts"))


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(HARD)]
    rows += [(2, 0, "odd\nrole<", "x"), (2, None, None, "first"), (None, 0, "user", "alone"),
             (3, 5, "user", "same"), (3, 5, "user", "same"), (4, 0, "assistant", "y" * 200_000)]
    formatted = chat.format_chat(messages(spark, rows))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t or "") for _, _, r, t in rows[:9]]
    assert [(t.role, t.text) for t in back[2].turns] == [("", "first"), ("odd\nrole<", "x")]
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for conv in (1, 3, 4, None):
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: r[1])
        said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in mine)
        learned = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert got[conv].turns_sha256 == digest(said)
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(mine), len(learned))
        assert got[conv].loss_sha256 == digest(learned)
    for r in formatted.collect():
        assert got[r.conv_id].formatted_chars == len(r.formatted)
        assert r.formatted.count(chat.END) == r.n_turns == r.formatted.count(chat.BEGIN)


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see [IMG] ", None, None), ("image", None, "s3/a.png", 4),
                            ("audio", None, "b.wav", None), ("text", None, None, None),
                            ("other", "z", None, None), ("document", "ignored", "c.pdf", 2)]),
            (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, "user", None),
            (3, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert got[1].formatted == ("<s>[INST]user\nsee [\\IMG] [IMG][AUDIO][DOC][/INST]</s>"
                                "<s>[INST]assistant\nok[/INST]</s>")
    assert [(a.turn, a.ordinal, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, 0, "image", "s3/a.png", 1024), (0, 1, "audio", "b.wav", 25),
        (0, 2, "document", "c.pdf", 1200)]
    assert got[1].attached_tokens == 2249
    assert [(s.turn, got[1].formatted.split(chat.END)[s.turn][s.start:s.start + s.length])
            for s in got[1].loss] == [(1, "ok")]
    assert got[2].formatted == got[3].formatted == "<s>[INST]user\n[/INST]</s>"
    assert chat.format_chat(df.limit(0)).count() == 0


def test_sample_conversation(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet").selectExpr("*", "1 AS parts")
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(chat.with_sample(table))).collect()}
    said = f"user\n{chat.SAMPLE}\nassistant\n{chat.SAMPLE}\n"
    assert got[-1].turns_sha256 == digest(said)
    assert got[-1].loss_sha256 == digest(chat.SAMPLE) and got[-1].loss_chars == len(chat.SAMPLE)
    assert len(got) == table.select("conv_id").distinct().count() + 1

"""Rows that every operator must bear: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, row string, fp long, kept string, part int, spans string, "
          "n_chars long, k_id long, held_out string, ids string, words string")


SYLLABLES = [a + b for a in "bcdfghlmnprstvz" for b in ("a", "en", "i", "or", "ü")]


def prose(seed, words):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in
                            range(rnd.randint(1, 4))) for _ in range(words))


TEXTS = [(1, prose(1, 120)), (2, prose(2, 80)), (3, prose(1, 120)), (4, ""), (5, None),
         (None, prose(6, 60)), (None, None), (7, "  \n\t "), (8, prose(8, 30_000)),
         (9, "x" * 50_000), (2, prose(2, 80)), (2, prose(3, 80)), (10, "日本語 テキスト 𝄞 é"),
         (11, "one two"), (12, "7 " * 3000)]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "r", 1, "k", 2, "s", None, 3, "h", "i", "w") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


ALL_IDS = sorted(-1 if i is None else i for i, _ in TEXTS)

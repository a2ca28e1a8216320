"""Packing: exact ids, gapless windows, sequences."""

import zlib

import numpy as np
import pytest

from wardframe.llm import packing
from wardframe.llm.common import vocabulary

from . import cases

PATH = vocabulary("word_bpe_49k.json")
HARD = ["It's don't WE'LL !'s '''s x'S 'sa", "a<|endoftext|>b <|ENDOFTEXT|>", "½ ²a ª µ º\xa0a\x85b",
        "É´ ́x \x1c y　z ΑΣ İ", "naïve ÀÉÎ×÷ßÿ 123a4", "", " ", "éÉx…—.,;"]


def wanted(texts):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(PATH)
    return [e.ids for e in model.encode_batch([t or "" for t in texts],
                                              add_special_tokens=False)]


def test_encoder():
    texts = HARD + [t or "" for _, t in cases.TEXTS]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(PATH)(texts)]
    assert got == wanted(texts)


@pytest.mark.parametrize("segment", [32_768, 100])
def test_pieces(spark, segment, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", segment)
    texts = [(i, t) for i, t in cases.TEXTS if i is not None]
    texts = [(100 * n + i, t) for n, (i, t) in enumerate(texts)]
    docs = cases.documents(spark, texts)
    tokens = packing.tokenize(docs, PATH)
    pieces = packing.pack_tokens(tokens)
    rows = pieces.collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for (i, _), ids in zip(texts, wanted([t for _, t in texts])):
        mine = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array([*ids, 1], "<u4").tobytes()
        assert all(r.doc_tokens == len(ids) + 1 for r in mine)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
    last = max(by_window)
    assert sorted(by_window) == list(range(last + 1))
    for w, mine in by_window.items():
        end = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end == packing.LENGTH or w == last
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    for w, r in whole.items():
        full = r.tokens if r.tokens & (r.tokens - 1) == 0 else packing.LENGTH
        assert len(r.ids) == 4 * full
        assert bytes(r.ids)[:4 * r.tokens] == b"".join(
            bytes(p.ids) for p in sorted(by_window[w], key=lambda p: p.offset))
    out = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in out) == sum(r.length for r in rows)
    check = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}
    assert check == {(r.doc_id, r.start): r.ids_crc32 for r in out} or len(out) != len(rows)


def test_nulls_repeats_and_empty(spark):
    out = packing.pack(cases.documents(spark), PATH).collect()
    heads = [r for r in out if r.start == 0]
    assert cases.ids(heads) == cases.ALL_IDS
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in heads)
    assert packing.pack(cases.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("n,padded", [(1, 1), (3, 2048), (1024, 1024), (1000, 2048)])
def test_padding_of_the_last_window(spark, n, padded):
    docs = spark.createDataFrame([(1, "7 " * (n - 1))], "doc_id long, text string")
    row = packing.sequences(packing.pack_tokens(packing.tokenize(docs, PATH))).first()
    assert (row.tokens, len(row.ids)) == (n, 4 * padded)

"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from wardframe.llm import pieces
from wardframe.llm.common import vocabulary

from . import cases

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PATH)


def texts(model):
    rnd = random.Random(4)
    parts = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.vocab_size())]
    out = ["", " ", "  a  b", "a  ", "▁▁x", "\ta ﬁ Å é ｆ　x", "ABABABA", "a" * 40,
           " " * 100 + "the", "x" + " " * 37, "😀🧿 é́", "<s></s><unk><0x41>", "￿�", "a\x00z"]
    for letters, size in ((parts, 30), ("abcdetherins   \n.", 150), ("=-_*# ", 80)):
        out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, size)))
                for _ in range(800)]
    return out + ["".join(chr(rnd.choice([rnd.randint(1, 0xd7ff), rnd.randint(65536, 131071)]))
                          for _ in range(20)) for _ in range(200)]


def test_same_ids_and_text(model):
    vocab = pieces.Vocabulary(PATH)
    encode, decode = pieces.Encoder(vocab), pieces.Decoder(vocab)
    some = texts(model)
    want = model.encode(some, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(some)] == want
    assert [decode(np.array(x)) for x in want] == model.decode(want)
    odd = [[230, 231, 100], [3 + 0xC3, 3 + 0x28, 300], [1, 2], [], [259, 260, 300]]
    assert [decode(np.array(x, np.int64)) for x in odd] == model.decode(odd)


def test_table(spark, model):
    rows = pieces.hashed(pieces.encode(cases.documents(spark), PATH)).collect()

    def line(i, t):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        return (-1 if i is None else i, len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(model.decode(ids).encode()).hexdigest())

    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in rows)
    assert got == sorted(line(i, t) for i, t in cases.TEXTS)
    assert pieces.encode(cases.empty(spark), PATH).count() == 0

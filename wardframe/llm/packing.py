"""Concatenate-and-cut packing of documents into fixed windows of tokens.

Pass one writes every document's token ids with the part it lies in and the tokens before it in
that part. The parts' totals, one row each, are summed up to give each part its global offset.
Pass two is narrow: a document's offset is its part's offset plus its own, and the fixed windows
that it touches are its pieces. A row of a piece is the record of a boundary.
"""

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import raw, small_batches, texts, written

LENGTH = 2048
END_ID = 1
#: Parts of texts whose ids a worker remembers.
REMEMBER = 800_000
#: Tokens of one row of the token table; a longer document has several.
SEGMENT = 32_768


#: What a text of common letters falls into, as the vocabulary's own splitter cuts it.
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
#: Texts with these, or with characters beyond Latin-1, are cut at white space only: control
#: characters, letters and digits that `_PARTS` does not know, and what may be a special token.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0ªµº²³¹¼½¾\u0100-\U0010ffff]|<\\|")


def _byte_letters():
    """How the vocabulary writes each byte: printable ones as themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Texts to ids as little-endian bytes; each part of a text is encoded once.

    The vocabulary lowers case, drops white space and cuts texts into parts that no merge
    crosses, so a text's ids are those of its parts in order.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole, self.known = Tokenizer.from_file(path), {}
        self.model = self.whole.model
        letters = _byte_letters()
        self.spelled = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

    def __call__(self, docs):
        split = [doc.encode().split() if _ODD.search(doc) else _PARTS.findall(doc.lower())
                 for doc in docs]
        known = self.known
        new = {w for words in split for w in words}.difference(known)
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = {w for words in split for w in words}
        merge, spelled = self.model.tokenize, self.spelled
        for w in new:
            if isinstance(w, str):  # already as normalised and cut
                known[w] = array("I", [t.id for t in merge(w.translate(spelled))]).tobytes()
        odd = [w for w in new if isinstance(w, bytes)]
        for w, e in zip(odd, self.whole.encode_batch([w.decode() for w in odd],
                                                     add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=1)
def encoder(path):
    """One encoder for all tasks of a worker, with what it remembers."""
    return Encoder(path)


def _tokens(path, end_id):
    end = array("I", [end_id]).tobytes()

    def run(batches):
        encode, before, part = encoder(path), 0, TaskContext.get().partitionId()
        for batch in small_batches(batches, 4 << 20):
            data, ends = raw(batch.column("text"))
            data = data.tobytes()
            ids = [x + end for x in encode([data[a:b].decode() for a, b in
                                            zip(ends[:-1].tolist(), ends[1:].tolist())])]
            which, start, cut = [], [], []
            for i, x in enumerate(ids):
                for a in range(0, len(x) // 4, SEGMENT):
                    which.append(i)
                    start.append(a)
                    cut.append(x[4 * a:4 * (a + SEGMENT)])
            n = np.fromiter((len(x) // 4 for x in cut), np.int64, len(cut))
            whole = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))[which]
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(which)),
                 pa.array(np.full(len(n), part, np.int32)), pa.array(at),
                 pa.array(start, pa.int64()), pa.array(n), pa.array(whole),
                 pa.array(cut, pa.binary())],
                ["doc_id", "part", "before", "first", "n", "doc_tokens", "ids"])
    return run


def tokenize(docs, path, end_id=END_ID):
    """Segments of all documents' tokens, written: doc_id, part, tokens before it in the part,
    its first token's place in the document, n, doc_tokens, ids (little-endian 32-bit)."""
    return written(texts(docs).mapInArrow(
        _tokens(path, end_id), "doc_id long, part int, before long, first long, n long, "
                               "doc_tokens long, ids binary"), "tokens")


def pack_tokens(tokens, length=LENGTH):
    """Pieces of the windows: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per part of the token table, whatever the parts hold: small enough to broadcast
    base = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0).cast("long")).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select(
        "doc_id", "first", "n", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at"))
    first = F.expr(f"at div {length}")
    last = F.expr(f"(at + n - 1) div {length}")
    pieces = placed.select("doc_id", "first", "n", "doc_tokens", "ids", "at",
                           F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.col("sequence_id") * length - F.col("at"), F.lit(0).cast("long"))
    end = F.least((F.col("sequence_id") + 1) * length - F.col("at"), F.col("n"))
    pieces = pieces.select(
        "doc_id", (F.col("first") + start).alias("start"), start.alias("within"),
        (end - start).alias("length"), "doc_tokens",
        "sequence_id", (F.col("at") + start - F.col("sequence_id") * length).alias("offset"),
        "ids")
    return pieces.withColumn("ids", F.substring(
        "ids", (F.col("within") * 4 + 1).cast("int"),
        (F.col("length") * 4).cast("int"))).drop("within")


def sequences(pieces, length=LENGTH, pad_id=0):
    """sequence_id, ids (little-endian), tokens: the pieces of each window put together.

    The last window is padded to `length` unless it holds a power of two of tokens.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        F.sum("length").alias("tokens"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    power = F.expr("bit_count(tokens) = 1")
    pad = F.when(power, F.lit("")).otherwise(
        F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()),
                 (F.lit(length) - F.col("tokens")).cast("int")))
    return whole.select("sequence_id", F.concat(joined, F.unhex(pad)).alias("ids"), "tokens")


def pack(docs, path, length=LENGTH, end_id=END_ID):
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Every document ends with `end_id`, so an empty or null text is one token; a null doc_id stays
    null and repeated rows are packed as often as they come. Long documents take several windows.
    All windows but the last are full. Empty tables give no rows; other columns are not read.
    """
    return pack_tokens(tokenize(docs, path, end_id), length).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")

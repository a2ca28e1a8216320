"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary is read from the model through its library; encoding and decoding are done here.
A text, with its leading space, falls into words that no merge can cross: before a run of space
marks, and between two characters that no piece has side by side. Words that are not remembered
are encoded together: one flat array of symbols, the ranks of all neighbouring pairs from a sorted
table, each word's smallest rank, all of its leftmost merges at once, compaction, until no pair
remains. A merge that would bring up a pair of equal or smaller rank is the last one of its word
in that round, so the order is that of one merge at a time.
"""

import functools

import numpy as np
import pyarrow as pa

from .common import raw, small_batches, texts

SPACE = "▁"
REMEMBER = 600_000
_FAR = np.int64(1 << 40)


class Vocabulary:
    """Pieces, and the table of pairs that merge."""

    def __init__(self, path):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown, self.begin, self.end = model.unk_id(), model.bos_id(), model.eos_id()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.bytes = np.full(256, self.unknown, np.int64)
        self.spelled = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                special[i] = True
                self.spelled.append(bytes([int(p[3:5], 16)]))
            elif special[i]:
                self.spelled.append(b"")
            else:
                self.spelled.append(p.replace(SPACE, " ").encode())
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        symbols = {p: i for i, p in enumerate(pieces) if not special[i]}
        scores = np.array([model.get_score(i) for i in range(n)])
        # equal scores have equal ranks
        rank = np.unique(-scores, return_inverse=True)[1]
        self.n, self.chars = n, {}
        beside, multi = set(), []
        for p in symbols:
            for c in p:
                self.chars.setdefault(ord(c), symbols.get(c, n + ord(c)))
            if len(p) > 1:
                multi.append(p)
                beside.update(zip(p, p[1:]))
        get = lambda s: symbols.get(s, n + ord(s) if len(s) == 1 else None)
        keys, merged = [], []
        for p in multi:
            for i in range(1, len(p)):
                a, b = get(p[:i]), get(p[i:])
                if a is not None and b is not None:
                    keys.append(self.key(a, b))
                    merged.append(symbols[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.ranks = rank[self.merged].astype(np.int64)
        self.beside = np.sort(np.array([(ord(a) << 21) | ord(b) for a, b in beside], np.int64))
        self.of_char = np.sort(np.array(list(self.chars), np.int64))
        self.char_id = np.array([self.chars[c] for c in self.of_char.tolist()], np.int64)

    @staticmethod
    def key(a, b):
        return (a << 22) | b

    def ranks_of(self, a, b):
        """(rank, merged symbol) of pairs; a pair that does not merge is far off."""
        keys = self.key(a, b)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], _FAR), np.where(hit, self.merged[at], -1)

    def cuts(self, points):
        """Whether a word may end before each code point but the first."""
        pairs = (points[:-1] << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        return self.beside[at] != pairs

    def symbols(self, points):
        at = np.minimum(np.searchsorted(self.of_char, points), len(self.of_char) - 1)
        return np.where(self.of_char[at] == points, self.char_id[at], self.n + points)


@functools.lru_cache(maxsize=1)
def load(path):
    """(encoder, decoder) of a model, for all tasks of a worker, with what it remembers."""
    vocab = Vocabulary(path)
    return Encoder(vocab), Decoder(vocab)


def _last_class(symbols, vocab):
    """One word whose best pairs tie over different pieces: merges one at a time, from the left.

    After each merge the leftmost pair of the best rank is at its place, before it or after it.
    """
    out, rest = [], symbols[::-1]
    while rest:
        out.append(rest.pop())
        while True:
            left = _rank(vocab, out[-2], out[-1]) if len(out) > 1 else (_FAR, -1)
            right = _rank(vocab, out[-1], rest[-1]) if rest else (_FAR, -1)
            if left[0] == _FAR and right[0] == _FAR:
                break
            if left[0] < _FAR:
                out[-2:] = [left[1]]
            else:
                rest.pop()
                out[-1] = right[1]
    return out


def _rank(vocab, a, b):
    rank, merged = vocab.ranks_of(np.array([a]), np.array([b]))
    return int(rank[0]), int(merged[0])


def merge(symbols, starts, vocab):
    """Final symbols of words laid end to end, and where the words start among them."""
    words = len(starts)
    word = np.repeat(np.arange(words), np.diff(np.concatenate([starts, [len(symbols)]])))
    done_symbols, done_words = [], []
    tie = vocab.ranks.max()
    while len(symbols):
        joint = word[1:] == word[:-1]
        rank, merged = vocab.ranks_of(symbols[:-1], symbols[1:])
        rank = np.where(joint, rank, _FAR)
        first = np.flatnonzero(np.concatenate([[True], ~joint]))
        padded = np.concatenate([rank, [_FAR]])
        best = np.minimum.reduceat(padded, first)
        own = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(symbols)]])))
        # words without a pair are done and leave the arrays
        over = best == _FAR
        tied = best == tie
        if over.any() or tied.any():
            for w in np.flatnonzero(tied).tolist():
                a = first[w]
                b = first[w + 1] if w + 1 < len(first) else len(symbols)
                got = _last_class(symbols[a:b].tolist(), vocab)
                done_symbols.append(np.array(got, np.int64))
                done_words.append(np.full(len(got), word[a]))
            gone = over[own]
            done_symbols.append(symbols[gone])
            done_words.append(word[gone])
            stay = ~(over | tied)[own]
            symbols, word = symbols[stay], word[stay]
            continue
        hit = padded == best[own]
        at = np.flatnonzero(hit)
        # of overlapping pairs, those at even places of their row of neighbours
        row = np.concatenate([[True], np.diff(at) != 1])
        begin = np.maximum.accumulate(np.where(row, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        new = merged[at]
        # pairs that the merge brings up, as they are when its turn comes
        w = own[at]
        before = at - 1
        has = (before >= 0) & (own[np.maximum(before, 0)] == w)
        left = symbols[np.maximum(before, 0)]
        follows = np.concatenate([[False], (at[1:] - at[:-1] == 2) & (w[1:] == w[:-1])])
        left = np.where(follows, np.concatenate([[0], new[:-1]]), left)
        up_left = np.where(has, vocab.ranks_of(left, new)[0], _FAR)
        after = np.minimum(at + 2, len(symbols) - 1)
        has = (at + 2 < len(symbols)) & (own[after] == w)
        up_right = np.where(has, vocab.ranks_of(new, symbols[after])[0], _FAR)
        stops = np.minimum(up_left, up_right) <= best[w]
        if stops.any():
            # merges behind the first such one of their word wait
            count = np.cumsum(stops) - stops
            head = np.concatenate([[True], w[1:] != w[:-1]])
            base = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            go = count == count[base]
            at, new = at[go], new[go]
        symbols[at] = new
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word = symbols[keep], word[keep]
    flat = np.concatenate(done_symbols) if done_symbols else symbols
    which = np.concatenate(done_words) if done_words else word
    order = np.argsort(which, kind="stable")
    return flat[order], np.searchsorted(which[order], np.arange(words))


class Encoder:
    """Texts to ids, remembering the ids of words."""

    def __init__(self, vocab):
        self.vocab, self.known = vocab, {}

    def _new(self, words):
        """Ids, as little-endian bytes, of words that are not remembered."""
        vocab = self.vocab
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        edge = np.zeros(len(points), bool)
        edge[1:] = vocab.cuts(points) if len(points) > 1 else False
        edge[starts] = True
        flat, first = merge(vocab.symbols(points), np.flatnonzero(edge), vocab)
        # symbols that are no piece are spelled in bytes
        out, ends = flat, np.append(first, len(flat))[np.searchsorted(
            np.flatnonzero(edge), np.append(starts, len(points)))]
        odd = np.flatnonzero(flat >= vocab.n)
        if len(odd):
            grown, at = [], 0
            more = np.zeros(len(flat) + 1, np.int64)
            for i in odd.tolist():
                spelled = vocab.bytes[list(chr(int(flat[i]) - vocab.n).encode())]
                grown += [flat[at:i], spelled]
                more[i + 1] = len(spelled) - 1
                at = i + 1
            out = np.concatenate([*grown, flat[at:]])
            ends = ends + np.cumsum(more)[ends]
        out = out.astype("<u4").tobytes()
        for w, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist()):
            self.known[w] = out[4 * a:4 * b]

    def __call__(self, docs):
        """Little-endian ids of every text, with begin and end ids."""
        split = []
        for doc in docs:
            doc = " " + doc.replace(SPACE, " ") if doc else ""
            parts = doc.split(" ")
            if "" in parts[1:]:  # runs of spaces stand before the word that follows
                words, run = [], 0
                for p in parts[1:]:
                    run += 1
                    if p:
                        words.append(SPACE * run + p)
                        run = 0
                if run:
                    words.append(SPACE * run)
            else:
                words = [SPACE + p for p in parts[1:]]
            split.append(words)
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list({w for words in split for w in words})
        if new:
            self._new(new)
        vocab, get = self.vocab, self.known.__getitem__
        begin, end = (np.array([i], "<u4").tobytes() for i in (vocab.begin, vocab.end))
        return [b"".join((begin, *map(get, words), end)) for words in split]


class Decoder:
    """Ids to texts: pieces put together, one leading space of the encoder taken off."""

    def __init__(self, vocab):
        self.vocab = vocab
        self.spelled = np.array(vocab.spelled, object)

    def __call__(self, ids):
        parts = self.spelled[ids]
        spelled = np.flatnonzero(self.vocab.is_byte[ids])
        if not len(spelled):
            out = b"".join(parts.tolist()).decode()
        else:  # a broken run of bytes reads as replacement marks, a byte each
            out, at = [], 0
            runs = np.split(spelled, np.flatnonzero(np.diff(spelled) > 1) + 1)
            for run in runs:
                out.append(b"".join(parts[at:run[0]].tolist()).decode())
                out.append(_utf8(b"".join(parts[run].tolist())))
                at = run[-1] + 1
            out.append(b"".join(parts[at:].tolist()).decode())
            out = "".join(out)
        return out[1:] if out[:1] == " " else out


def _utf8(run):
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as e:
            out.append(run[:e.start].decode() + "�")
            run = run[e.start + 1:]
    return "".join(out)


def _encode(path):
    def run(batches):
        encode, decode = load(path)
        for batch in small_batches(batches, 2 << 20):
            data, ends = raw(batch.column("text"))
            data = data.tobytes()
            ids = encode([data[a:b].decode() for a, b in zip(ends[:-1].tolist(),
                                                             ends[1:].tolist())])
            keep = [i for i, k in enumerate(batch.schema.names) if k != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                   pa.array([decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())],
                [batch.schema.names[i] for i in keep] + ["n_tokens", "ids", "decoded"])
    return run


def encode(docs, path):
    """doc_id, n_tokens, ids (little-endian 32-bit, begin and end included), decoded text.

    Null texts are empty: the begin and end ids alone. Repeated rows come out repeated, a null
    doc_id stays null, empty tables give no rows; other columns are not read.
    """
    return texts(docs).mapInArrow(
        _encode(path), "doc_id long, n_tokens long, ids binary, decoded string")


def hashed(encoded):
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    from pyspark.sql import functions as F
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))

"""Minimal perfect hashing of keys that are known by two 64-bit hashes, in numpy.

Keys hash into a bit array of twice their number; a place that one key alone hits is set and is
that key's, all others try again one level deeper in an array of their own. A key's number is the
number of set bits before its place, so numbers run from zero to the number of keys without a gap.
"""

import numpy as np

LOAD = 2
LEVELS = 80

_U = np.uint64


def _places(a, b, level, size):
    h = (a + _U(level * 0x9E3779B97F4A7C15 % (1 << 64))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(30)) ^ b) * _U(0x94D049BB133111EB)
    return ((h ^ (h >> _U(31))) % _U(size)).astype(np.int64)


def fingerprints(a, b):
    """32 bits of a key that its place does not depend on."""
    h = (b ^ (b >> _U(33)) ^ a) * _U(0xD6E8FEB86659FD93)
    return (h >> _U(32)).astype(np.uint32)


class PerfectHash:
    """Numbers of known keys; for other keys a wrong number or -1."""

    def __init__(self, levels):
        self.levels = levels
        self.bits = np.concatenate([*levels, np.zeros(0, bool)])
        self.before = np.cumsum(self.bits) - self.bits
        self.size = int(self.bits.sum())

    @classmethod
    def of(cls, a, b):
        """The function of distinct keys, given as arrays of their two hashes."""
        levels = []
        while len(a):
            if len(levels) == LEVELS:
                raise ValueError("two keys have both hashes in common")
            size = LOAD * len(a) + 1
            at = _places(a, b, len(levels), size)
            times = np.bincount(at, minlength=size)
            levels.append(times == 1)
            again = times[at] > 1
            a, b = a[again], b[again]
        return cls(levels)

    def __call__(self, a, b):
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        base = 0
        for level, bits in enumerate(self.levels):
            at = _places(a[open_], b[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[base + at[hit]]
            open_ = open_[~hit]
            base += len(bits)
        return out

    def dump(self):
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return head.tobytes() + np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def load(cls, data):
        """(the function, what follows it in data)."""
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        total, at = int(sizes.sum()), 8 + 8 * n
        length = -(-total // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=total,
                             bitorder="little").astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if n else []), data[at + length:]

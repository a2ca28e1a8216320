"""Suffix order and longest-previous-factor arrays of byte strings in numpy."""

import numpy as np

FIRST = 8


def _ranks(keys):
    """Dense ranks, equal keys alike."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int32)
    if len(keys):
        new[order[0]] = 0
        new[order[1:]] = np.cumsum(keys[order[1:]] != keys[order[:-1]])
    return new


def prefix_ranks(data, depth):
    """Ranks of all suffixes by their first 8, 24, 72, ... bytes up to `depth`, a dict by length."""
    n = len(data)
    padded = np.zeros(n + FIRST, np.uint64)
    padded[:n] = data
    keys = np.zeros(n, np.uint64)
    for i in range(FIRST):
        keys = (keys << np.uint64(8)) | padded[i:n + i]
    levels, width = {FIRST: _ranks(keys)}, FIRST
    fold = 3 if n < 1 << 21 else 2  # ranks that go into one sort key of 63 bits
    while width < depth:
        rank = levels[width].astype(np.int64) + 1
        keys = rank
        for i in range(1, fold):
            after = np.zeros(n, np.int64)
            if n > i * width:
                after[:n - i * width] = rank[i * width:]
            keys = (keys << (63 // fold)) | after
        width *= fold
        levels[width] = _ranks(keys)
    return levels


def common_prefix(levels, data, a, b):
    """Lengths of the common prefixes of the suffixes at a and b, by ever shorter steps."""
    n = len(data)
    a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    out = np.zeros(len(a), np.int64)
    widths = sorted(levels, reverse=True)
    for width in widths:
        rank = levels[width]
        for _ in range(2):
            ok = (a < n) & (b < n)
            same = ok & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            # a padded tail is never as long as it looks
            same &= np.maximum(a, b) + width <= n
            a, b, out = a + same * width, b + same * width, out + same * width
    for _ in range(FIRST):
        ok = (a < n) & (b < n)
        same = ok & (data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)])
        if not same.any():
            break
        a, b, out = a + same, b + same, out + same
        live = ~same
        a[live], b[live] = n, n
    return out


def nearest_smaller(values):
    """For each place the nearest place to its left with a smaller value, -1 without one."""
    n = len(values)
    link = np.arange(-1, n - 1)
    open_ = np.flatnonzero((link >= 0) & (values[np.maximum(link, 0)] > values))
    while len(open_):
        link[open_] = link[link[open_]]
        at = link[open_]
        open_ = open_[(at >= 0) & (values[np.maximum(at, 0)] > values[open_])]
    return link


def previous_factor(data, starts, depth):
    """Longest previous factors of the suffixes at `starts`, among these alone.

    In suffix order, the earlier suffix that shares most with a suffix is the nearest one above
    or below it that starts earlier: its previous or next smaller position. Returns the lengths
    of the longest earlier match and of the longest later match, found alike from larger
    positions. Lengths of `depth` and more count as `depth`.
    """
    data = np.asarray(data, np.uint8)
    starts = np.asarray(starts, np.int64)
    levels = prefix_ranks(data, depth)
    order = starts[np.argsort(levels[max(levels)][starts], kind="stable")]
    place = {}
    for name, sign in (("earlier", 1), ("later", -1)):
        best = np.zeros(len(order), np.int64)
        for step in (1, -1):
            row = order[::step]
            near = nearest_smaller(sign * row)
            has = np.flatnonzero(near >= 0)
            got = np.zeros(len(row), np.int64)
            got[has] = common_prefix(levels, data, row[has], row[near[has]])
            best = np.maximum(best, got[::step])
        back = np.empty(len(starts), np.int64)
        back[np.argsort(starts, kind="stable")] = best[np.argsort(order, kind="stable")]
        place[name] = np.minimum(back, depth)
    return place["earlier"], place["later"]

"""Suffix arrays by two-stage sorting, in numpy.

A suffix is of type B if it is smaller than the suffix that begins one symbol later, else of type A.  Stage one sorts the B suffixes
directly, by eight symbols at a time, and only what is tied so far.  Stage two induces the A suffixes by a scan over the buckets of
first symbols: the predecessors of the suffixes of a bucket, taken in order, are in order within their own buckets.  A bucket is scanned
as a whole; an A suffix that begins with a run of its bucket's symbol comes after those with a shorter run, so the runs make rounds.

Suffixes are sorted by their first `depth` symbols, which is all that common prefixes up to `depth` need; suffixes that agree that far
are in no particular order.
"""

from __future__ import annotations

import numpy as np

#: Symbols that are compared at once, at first and later; suffixes whose symbols are held at once.
STEP, BLOCK, CHUNK = 8, 64, 1 << 15


def packed(text: np.ndarray) -> np.ndarray:
    """For each place, the eight symbols (bytes) from there as one big-endian number; zeros follow the end."""
    t = np.concatenate([text, np.zeros(STEP, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(t, STEP)[: len(text)].copy().view(">u8").ravel().astype(np.uint64)


def types(text: np.ndarray) -> np.ndarray:
    """Where suffixes are of type B.  The last suffix is of type A: the empty one after it is smaller."""
    n = len(text)
    rises = np.zeros(n, bool)
    if n < 2:
        return rises
    differ = np.flatnonzero(text[1:] != text[:-1])
    up = text[differ + 1] > text[differ]
    nxt = np.searchsorted(differ, np.arange(n))  # a run of one symbol is of the type at its end
    inside = nxt < len(differ)
    rises[inside] = up[nxt[inside]]
    return rises


def rows_of(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """`width` symbols (a multiple of eight) from each place, as rows of big-endian numbers.  text ends in `width` zeros at least."""
    view = np.lib.stride_tricks.as_strided(text, (len(text) - width + 1, width), (1, 1))
    return view[at].view(">u8")


def sort_directly(text: np.ndarray, keys: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `which`, in the order of their first `depth` symbols at least."""
    n = len(text)
    order = which[np.argsort(keys[which], kind="stable")]
    k = keys[order]
    tied = np.zeros(len(order), bool)  # as the one before
    tied[1:] = k[1:] == k[:-1]
    padded = np.concatenate([text, np.zeros(BLOCK + STEP, np.uint8)])
    at = STEP
    while at < depth:
        # words that end by chance agree for a few steps; what agrees longer mostly does so for long
        width = STEP if at < 4 * STEP else BLOCK
        member = tied.copy()
        member[:-1] |= tied[1:]
        rows = np.flatnonzero(member)
        if not len(rows):
            break
        opens = ~tied[rows]
        own = order[rows]
        same = np.zeros(len(rows), bool)
        for a in range(0, len(rows), CHUNK):  # rows of symbols for a part of the suffixes at a time
            x = rows_of(padded, np.minimum(own[max(0, a - 1) : a + CHUNK] + at, n), width)
            eq = (x[1:] == x[:-1]).all(1)
            same[a + (a == 0) : a + CHUNK] = eq
        same &= ~opens
        group = np.cumsum(opens) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[~same & ~opens]] = True
        if mixed.any():  # only groups that fall apart are put in order
            part = np.flatnonzero(mixed[group])
            x = rows_of(padded, np.minimum(own[part] + at, n), width)
            by = np.lexsort([*x.T[::-1], group[part]])
            order[rows[part]] = own[part[by]]
            x = x[by]
            eq = np.zeros(len(part), bool)
            eq[1:] = (x[1:] == x[:-1]).all(1)
            same[part] = eq & ~opens[part]
        tied[rows] = same
        at += width
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text (bytes) in the order of their first `depth` symbols."""
    n = len(text)
    keys = packed(text)
    is_b = types(text)
    b = sort_directly(text, keys, np.flatnonzero(is_b), depth)
    first = text[b]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]  # A suffixes by first symbol, in order
    waiting[text[n - 1]].append(np.array([n - 1]))  # the predecessor of the empty suffix
    out = []

    def pass_on(done: np.ndarray, c: int) -> np.ndarray:
        """Hand the A predecessors of suffixes of bucket c to their buckets; returns those of c itself."""
        before = done[done > 0] - 1
        before = before[~is_b[before]]
        heads = text[before]
        own = before[heads == c]
        rest = heads != c
        before, heads = before[rest], heads[rest]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[text[part[0]]].append(part)
        return own

    for c in range(256):
        own = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(own):  # longer and longer runs of c
            out.append(own)
            own = pass_on(own, c)
        if bounds[c] < bounds[c + 1]:
            out.append(b[bounds[c] : bounds[c + 1]])
            pass_on(out[-1], c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def adjacent_agree(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first: whether its common prefix with the one before it in order has `depth` symbols.  Each has as many."""
    agree = np.zeros(len(order), bool)
    keys = packed(text)
    rows = np.arange(1, len(order))
    for at in range(0, min(depth, 3 * STEP + 1), STEP):  # most differ soon
        at = min(at, max(0, depth - STEP))
        if depth >= STEP:
            rows = rows[keys[order[rows - 1] + at] == keys[order[rows] + at]]
    width = depth + STEP - 1 & -STEP
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(text), depth), (1, 1))
    for a in range(0, len(rows), CHUNK // 8):
        part = rows[a : a + CHUNK // 8]
        x, y = view[order[part - 1]], view[order[part]]
        if depth % STEP == 0:
            x, y = x.view(np.uint64), y.view(np.uint64)
        agree[part] = (x == y).all(1)
    return agree


def repeated_starts(text: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Whether the first `depth` symbols from each place, all within its room, begin at another place too."""
    out = np.zeros(len(text), bool)
    if not len(text):
        return out
    order = suffix_array(text, depth)
    order = order[room[order] >= depth]  # those with too little room could stand between two that agree
    agree = adjacent_agree(text, order, depth)
    out[order[agree]] = True
    out[order[:-1][agree[1:]]] = True
    return out

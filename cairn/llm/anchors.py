"""Anchors: places of a text that depend on what stands around them alone.

Each window of `length` bytes chooses, among its grams of `gram_of(length)` bytes, the one with the least hash, the first of equals.  Equal windows choose
at the same place within them, so two windows can be equal only if the hashes of their anchors are.  Consecutive windows mostly share an
anchor; `anchors` gives each with the range of windows that choose it, and a hash of all the bytes these windows cover."""

from __future__ import annotations

import numpy as np

LENGTH = 400
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A random number for each byte.
SYMBOL = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64((1 << 24) - 1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the information of each number over its bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences give the hash of any run of bytes, and the inverse powers that it takes."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SYMBOL[data] * up[: len(data)], out=prefix[1:])
    return prefix, down


def run_hash(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each size, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def gram_of(length: int) -> int:
    """Bytes of a gram: 128 for windows of 400 bytes, and in proportion."""
    return max(1, length * 8 // 25)


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts with these sizes that lie in data (under 2**24 bytes) one after the other: number of the text, hash of the anchor, first and
    last window that chooses it (as offsets in the text), and hash of the bytes from the first one's start to the last one's end."""
    gram = gram_of(length)
    starts = np.cumsum(sizes) - sizes
    windows = np.maximum(0, sizes - length + 1)
    at = ranges(starts, windows)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    prefix, down = hashed(data)
    grams = mixed((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])
    width = length - gram + 1  # grams of a window
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & PLACE).astype(np.int64)[at]
    opens = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    first, last = at[opens], at[np.concatenate([opens[1:] - 1, [len(at) - 1]])]
    text = np.repeat(np.arange(len(sizes)), windows)[opens]
    context = run_hash(prefix, down, first, last + length)
    return text, grams[place[opens]].view(np.int64), first - starts[text], last - starts[text], context.view(np.int64)

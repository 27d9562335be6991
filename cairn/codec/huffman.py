"""Huffman codes with escapes.

Codes are cut at LIMIT bits: symbols with longer codes share the first LIMIT bits as an escape, and their values lie in a second list.
Ties are put in order by symbol, so codes depend on the counts alone; a lone symbol gets one bit."""

from __future__ import annotations

import heapq

import numpy as np

from . import bits

LIMIT = 12
#: Bits of the table that codes with a flag are decoded by, at most.
LONG = 16
#: Pairs of nodes that are worth merging at once.
FEW = 8


def codebook(symbols: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Full codes and lengths of the symbols, by merging the two least frequent nodes."""
    n = len(symbols)
    if n == 1:
        return [0], [1]
    heap = [(int(c), int(s), i) for i, (s, c) in enumerate(zip(symbols, counts))]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        node = n + len(children)
        children[node] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), node))
    codes, lengths = [0] * n, [0] * n
    stack = [(heap[0][2], 0, 0)]
    while stack:
        node, code, length = stack.pop()
        if node < n:
            codes[node], lengths[node] = code, length
        else:
            left, right = children[node]
            stack += [(left, code << 1, length + 1), (right, code << 1 | 1, length + 1)]
    return codes, lengths


def clipped(codes: list[int], lengths: list[int], limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Codes of at most `limit` bits; a negative length marks an escape."""
    c, w = np.array([c >> max(0, n - limit) for c, n in zip(codes, lengths)], np.int64), np.array(lengths, np.int64)
    return c, np.where(w > limit, -limit, w)


def decoder(symbols: np.ndarray, codes: np.ndarray, lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A table of 2**limit entries: the symbol that a window begins with and its length, negative for escapes."""
    value, width = np.zeros(1 << limit, np.int64), np.zeros(1 << limit, np.int64)
    for s, c, w in zip(symbols.tolist(), codes.tolist(), lengths.tolist()):
        free = limit - abs(w)
        value[c << free : (c + 1) << free], width[c << free : (c + 1) << free] = s, w
    return value, width


def encode(values: np.ndarray, chains: np.ndarray, limit: int = LIMIT) -> dict:
    """values in chains that can each be decoded alone.  chains: where each begins; empty values give an empty stream."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return {"symbols": np.zeros(0, np.int64), "codes": np.zeros(0, np.int64), "lengths": np.zeros(0, np.int64), "data": b"", "at": np.zeros(len(chains), np.int64), "separate": np.zeros(0, np.int64), "separate_at": np.zeros(len(chains), np.int64)}
    symbols, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    codes, lengths = clipped(*codebook(symbols, counts), limit)
    data, at = bits.pack_msb(codes[inverse], np.abs(lengths)[inverse])
    escaped = lengths[inverse] < 0
    before = np.concatenate([[0], np.cumsum(escaped)])
    return {"symbols": symbols, "codes": codes, "lengths": lengths, "data": data.tobytes(), "at": at[chains], "separate": values[escaped], "separate_at": before[chains]}


def decode(stream: dict, counts: np.ndarray, limit: int = LIMIT) -> list[np.ndarray]:
    """The values of each chain, all chains at once, value number by value number."""
    counts = np.asarray(counts)
    out = [np.zeros(n, np.int64) for n in counts.tolist()]
    if not counts.sum():
        return out
    value, width = decoder(stream["symbols"], stream["codes"], stream["lengths"], limit)
    words = bits.windows(np.frombuffer(stream["data"], np.uint8))
    at, extra = np.array(stream["at"], np.int64), np.array(stream["separate_at"], np.int64)
    grid = np.zeros((int(counts.max()), len(counts)), np.int64)
    for i in range(len(grid)):
        live = np.flatnonzero(counts > i)
        window = bits.read_msb(words, at[live], limit)
        v, w = value[window], width[window]
        e = live[w < 0]
        v[w < 0] = stream["separate"][extra[e]]
        extra[e] += 1
        at[live] += np.abs(w)
        grid[i, live] = v
    return [grid[:n, j] for j, n in enumerate(counts.tolist())]


def encode_flagged(values: np.ndarray, top: int) -> dict:
    """The scheme with a flag: 1 and a code for the `top` most frequent symbols, 0 and a value in a second list for others."""
    values = np.asarray(values, np.int64)
    symbols, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    best = np.sort(np.lexsort([symbols, -counts])[:top])
    codes, lengths = codebook(symbols[best], counts[best])
    place = np.full(len(symbols), -1)
    place[best] = np.arange(len(best))
    known = place[inverse] >= 0
    code = np.array(codes, np.int64)[np.maximum(place[inverse], 0)]
    length = np.array(lengths, np.int64)[np.maximum(place[inverse], 0)]
    data, at = bits.pack_msb(np.where(known, (1 << length) | code, 0), np.where(known, length + 1, 1))
    return {"symbols": symbols[best], "codes": codes, "lengths": lengths, "data": data.tobytes(), "bits": int(at[-1]), "separate": values[~known]}


def decode_flagged(stream: dict, n: int) -> np.ndarray:
    """A value at a time, each by one look into a table of what the next bits begin with; codes too long for a table of LONG bits, bit by bit."""
    codes, lengths = stream["codes"], stream["lengths"]
    limit = min(LONG, max(lengths, default=1))
    value, width = decoder(*(np.array([x for x, w in zip(v, lengths) if w <= limit], np.int64) for v in (stream["symbols"].tolist(), codes, lengths)), limit)
    by_code = {(w, c): s for s, c, w in zip(stream["symbols"].tolist(), codes, lengths) if w > limit}
    data = np.frombuffer(stream["data"], np.uint8)
    words, out, rest, at = bits.windows(data), [], iter(stream["separate"].tolist()), 0
    # at every bit: the flag there, and the value and width that the bits after it begin with
    every = np.arange(8 * len(data), dtype=np.int64)
    flags = np.unpackbits(data).tolist()
    after = bits.read_msb(words, every + 1, limit)
    values, widths = value[after].tolist(), width[after].tolist()
    while len(out) < n:
        if not flags[at]:
            out.append(next(rest))
            at += 1
        elif widths[at]:
            out.append(values[at])
            at += 1 + widths[at]
        else:
            at += 1
            code = size = 0
            while (size, code) not in by_code:
                code, size, at = code << 1 | flags[at], size + 1, at + 1
            out.append(by_code[size, code])
    return np.array(out, np.int64)


def fits(values: np.ndarray, top: int, limit: int = LIMIT) -> bool:
    """Whether codes of the `top` most frequent symbols stay within the `limit` bits of a decoder's table."""
    return fits_counted(*np.unique(np.asarray(values, np.int64), return_counts=True), top, limit)


def fits_counted(symbols: np.ndarray, counts: np.ndarray, top: int, limit: int = LIMIT) -> bool:
    best = np.sort(np.lexsort([symbols, -counts])[:top])
    return not len(best) or depth(symbols[best], counts[best]) <= limit


def depth(symbols: np.ndarray, counts: np.ndarray) -> int:
    """The length of the longest code that codebook gives, without codes: nodes merge in the order of (count, smallest symbol), as there, and
    have the height of what is below them.  Merged nodes come after all nodes of less than the two smallest counts together, so those
    merge in pairs at once; when only a few do, one by one."""
    if len(symbols) == 1:
        return 1
    count, least, height = np.asarray(counts, np.int64), np.asarray(symbols, np.int64), np.zeros(len(symbols), np.int64)
    while len(count) > 1:
        order = np.lexsort((least, count))
        count, least, height = count[order], least[order], height[order]
        pairs = int(np.searchsorted(count, count[0] + count[1])) // 2
        if pairs < FEW:
            return depth_one_by_one(count, least, height)
        a, b, rest = slice(0, 2 * pairs, 2), slice(1, 2 * pairs, 2), slice(2 * pairs, None)
        count, least, height = (np.concatenate([x, v[rest]]) for x, v in ((count[a] + count[b], count), (np.minimum(least[a], least[b]), least), (np.maximum(height[a], height[b]) + 1, height)))
    return int(height[0])


def depth_one_by_one(count: np.ndarray, least: np.ndarray, height: np.ndarray) -> int:
    heap = [*zip(count.tolist(), least.tolist(), height.tolist())]  # sorted, so a heap
    while len(heap) > 1:
        c, s, d = heapq.heappop(heap)
        e = heap[0]
        heapq.heapreplace(heap, (c + e[0], min(s, e[1]), max(d, e[2]) + 1))
    return heap[0][2]


def largest_top(values: np.ndarray, limit: int = LIMIT) -> int:
    """A number of symbols whose codes fit the decoder's table, while one more symbol's would not: by halving the range."""
    symbols, counts = np.unique(np.asarray(values, np.int64), return_counts=True)
    low, high = 1, len(symbols) + 1  # low fits; high does not, or there are no more symbols
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits_counted(symbols, counts, mid, limit) else (low, mid)
    return low


def interleaved(lengths: list[np.ndarray], word: int = 32, ahead: int = 2) -> list[tuple[int, int]]:
    """(lane, word): the words of lanes that decode side by side, in the order in which they are read.  Each lane holds `ahead` words; it
    reads another one at the step at which it has used one up.  lengths: the bits of each step of each lane."""
    step, lane, which = [], [], []
    for j, own in enumerate(lengths):
        end = np.cumsum(own)
        words = -(-int(end[-1]) // word) if len(end) else 0
        # word i is read once word i - ahead is used up
        used = np.searchsorted(end, np.maximum(0, np.arange(words) - ahead + 1) * word, side="left") + 1
        used[:ahead] = 0
        step.append(used), lane.append(np.full(words, j)), which.append(np.arange(words))
    step, lane, which = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (step, lane, which))
    order = np.lexsort([which, lane, step])
    return [*zip(lane[order].tolist(), which[order].tolist())]

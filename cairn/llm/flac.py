"""FLAC media columns (operator 1).

`encode` stores the samples of a binary column as mono FLAC streams; `decode` reads streams back: it parses the frames, decodes Rice
residuals, restores the linear predictors (fixed ones of orders 0 to 4 and quantised ones of orders 1 to 32), verifies the CRC-8 of each
header, the CRC-16 of each frame and the MD5 of the whole, and writes PCM with an offset for each block, so that a reader can seek.

Frames are independent, so each step runs on many frames at once, sample number by sample number: a chunk of FRAMES frames bounds the
memory, whatever the length of a stream.  Streams with up to 8 channels, stereo decorrelation, up to 24 bits, any block size, partition
order and escape codes can be read; what this module writes is mono with 8 or 16 bits.

Defined results: null counts as an empty value; an empty value gives a stream without frames; an empty table gives an empty table;
repeated rows give repeated rows; other columns pass through, and names of new columns that clash get underscores in front.  A damaged
stream raises ValueError, which names the frame.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, table, whole

#: Samples of a block, and frames that are worked on at once.
BLOCK, FRAMES = 576, 3072
#: Order of the linear predictors that the query tries beside the fixed ones; each frame takes the smaller.
ORDER = 8
#: Codes of block sizes in a frame's header (fixed values of the format).
SIZES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
SIZE_OF = {c: n for n, c in SIZES.items()}
#: Codes of sample sizes in a frame's header (fixed values of the format); 0 refers to the stream's.
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Coefficients of the fixed predictors (fixed values of the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8, CRC16 = crc_table(0x07, 8).astype(np.uint8), crc_table(0x8005, 16).astype(np.uint16)
#: Zeros at the head of a 16-bit number.
ZEROS = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksums of many runs of data, byte number by byte number."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    got = np.zeros(len(starts), crc.dtype)
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    wide = crc.dtype == np.uint16
    for j, n in enumerate(live.tolist()):
        b = data[starts[:n] + j]
        c = got[:n]
        got[:n] = (c << 8) ^ crc[(c >> 8) ^ b] if wide else crc[c ^ b]
    out = np.empty_like(got)
    out[order] = got
    return out


def number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as the header codes them: bytes in rows of 7, and how many count."""
    n = numbers.astype(np.int64)
    size = np.ones(len(n), np.int64)
    for i, least in enumerate((1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31)):
        size[n >= least] = i + 2
    out = np.zeros((len(n), 7), np.uint8)
    for s in np.unique(size).tolist():
        at = size == s
        if s == 1:
            out[at, 0] = n[at]
            continue
        for j in range(s):
            bits = n[at] >> 6 * (s - 1 - j)
            out[at, j] = bits | (0xFF << (8 - s) & 0xFF) if j == 0 else bits & 63 | 128
    return out, size


def residual(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = x[:, 1:] - x[:, :-1]
    return x


def predictors(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row by Levinson-Durbin recursion: coefficients and shifts."""
    f = x * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(f[:, j:] * f[:, : x.shape[1] - j]).sum(1) for j in range(order + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err *= np.maximum(1 - k * k, 1e-12)
    top = np.abs(a).max(1)
    shift = np.clip(precision - 2 - np.floor(np.log2(np.maximum(top, 1e-9))).astype(np.int64), 0, 15)
    most = (1 << (precision - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int64), shift


def encode_frames(samples: np.ndarray, starts: np.ndarray, size: int, numbers: np.ndarray, bits: int, lpc: int) -> list[bytes]:
    """Frames of `size` samples each that begin at starts."""
    x = samples[starts[:, None] + np.arange(size)].astype(np.int32)
    n = len(x)
    orders = range(min(5, size))
    some = x[:, : max(64, size // 4)]  # a quarter of a frame is enough to choose its fixed predictor by
    kind = np.argmin(np.stack([np.abs(residual(some, o)).sum(1) for o in orders], 1), 1)  # its order
    res = np.zeros((n, size), np.int32)
    for o in orders:
        if (at := kind == o).any():
            res[at, o:] = residual(x[at], o)
    head = kind.copy()  # samples that go before the residuals
    coefs = None
    if lpc and size > lpc:
        coefs, shift = predictors(x, lpc)
        guess = np.zeros((n, size - lpc), np.int64)
        for j in range(lpc):
            guess += coefs[:, j : j + 1] * x[:, lpc - 1 - j : size - 1 - j]
        own = x[:, lpc:] - (guess >> shift[:, None])
        better = np.abs(own).sum(1) * 1.02 + 200 < np.abs(res).sum(1)
        res[better, :lpc], res[better, lpc:] = 0, own[better]
        head[better] = lpc
    else:
        better = np.zeros(n, bool)
    u = res << 1 ^ res >> 31  # 0, -1, 1, -2 .. as 0, 1, 2, 3 ..
    left = np.arange(size)[None, :] >= head[:, None]
    many = size - head
    mean = np.einsum("ij->i", u, dtype=np.int64) / np.maximum(many, 1)  # samples before `head` have residual 0
    near = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int32), 0, 13)
    spent = np.stack([np.einsum("ij->i", u >> (near + d)[:, None], dtype=np.int64) + many * (near + d + 1) for d in (0, 1)], 1)
    k = near + spent.argmin(1).astype(np.int32)
    spent = spent.min(1)
    side = np.where(better, 4 + 5 + lpc * 12, 0)  # bits of the quantised predictor
    body = 8 + head * bits + side + 10 + spent
    constant, verbatim = (x == x[:, :1]).all(1), body >= 8 + bits * size
    body[verbatim] = 8 + bits * size
    body[constant] = 8 + bits
    coded = ~(verbatim | constant)
    num, num_size = number_bytes(numbers)
    extra = 0 if size in SIZES else 2
    top = 4 + num_size + extra + 1  # header bytes, with the CRC-8
    total = top + (body + 7 >> 3) + 2
    begin = np.cumsum(total) - total
    end = int(total.sum())
    out = np.zeros(end + 8, np.uint8)
    out[begin], out[begin + 1], out[begin + 2], out[begin + 3] = 0xFF, 0xF8, SIZES.get(size, 7) << 4 | 4, (1 if bits == 8 else 4) << 1
    for j in range(7):
        at = num_size > j
        out[begin[at] + 4 + j] = num[at, j]
    if extra:
        out[begin + 4 + num_size], out[begin + 5 + num_size] = (size - 1) >> 8, (size - 1) & 255
    out[begin + top - 1] = crcs(out, begin, top - 1, CRC8)
    sub = begin + top
    out[sub] = np.where(constant, 0, np.where(verbatim, 1, np.where(better, 32 | (lpc - 1), 8 | kind))) << 1
    wide = bits // 8
    raw = np.where(constant, 1, np.where(verbatim, size, head))  # samples that are stored as they are
    for w in np.unique(raw).tolist():
        at = np.flatnonzero(raw == w)
        where = sub[at, None] + 1 + np.arange(w) * wide
        for j in range(wide):
            out[where + j] = x[at, :w] >> 8 * (wide - 1 - j) & 255
    words, places, widths = [], [], []

    def put(values, at, width):
        words.append(np.asarray(values, np.int64).ravel()), places.append(np.asarray(at, np.int64).ravel()), widths.append(np.broadcast_to(width, np.shape(values)).ravel())

    at = (sub + 1 + head * wide) * 8
    if (b := better & coded).any():
        put(np.full(int(b.sum()), 11), at[b], 4)
        put(shift[b], at[b] + 4, 5)
        for j in range(lpc):
            put(coefs[b, j] & 0xFFF, at[b] + 9 + 12 * j, 12)
    at = at + side
    put(k[coded], at[coded], 10)
    for o in np.unique(head[coded]).tolist():
        c = np.flatnonzero(coded & (head == o))
        own, kc = u[c, o:], k[c, None]
        q = own >> kc
        stop = np.cumsum(q + (kc + 1), 1, dtype=np.int64) + (at[c, None] + 9)  # the place of each code's last bit
        put(own & ((1 << kc) - 1) | 1 << kc, stop - kc, np.broadcast_to(kc + 1, own.shape))
    words, places, widths = np.concatenate(words), np.concatenate(places), np.concatenate(widths)
    words = words << (24 - (places & 7) - widths)  # no code has over 17 bits, so each lies in three bytes
    places >>= 3
    for j in range(3):
        out[: end + 8] |= np.bincount(places + j, words >> 8 * (2 - j) & 255, end + 8).astype(np.uint8)
    crc = crcs(out, begin, total - 2, CRC16)
    out[begin + total - 2], out[begin + total - 1] = crc >> 8, crc & 255
    whole_ = out.tobytes()
    return [whole_[a : a + t] for a, t in zip(begin.tolist(), total.tolist())]


def encode_streams(values: list[bytes], bits: int = 8, lpc: int = 0, block: int = BLOCK, rate: int = 8000) -> list[bytes]:
    """A FLAC stream for each value; 8-bit samples are bytes less 128, 16-bit ones are little-endian signed pairs."""
    wide = bits // 8
    counts = [len(v) // wide for v in values]
    data = np.frombuffer(b"".join(v[: n * wide] for v, n in zip(values, counts)), np.uint8)
    data = (data.astype(np.int16) - 128) if bits == 8 else data.view("<i2")
    starts, sizes, numbers, at = [], [], [], 0
    for n in counts:
        f = np.arange(0, n, block)
        starts.append(f + at), sizes.append(np.minimum(block, n - f)), numbers.append(np.arange(len(f)))
        at += n
    of = np.repeat(np.arange(len(values)), [len(f) for f in starts])
    starts, sizes, numbers = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (starts, sizes, numbers))
    frames: list[bytes] = [b""] * len(starts)
    for a in range(0, len(starts), FRAMES):
        part = slice(a, a + FRAMES)
        for s in np.unique(sizes[part]).tolist():
            ids = a + np.flatnonzero(sizes[part] == s)
            for i, f in zip(ids.tolist(), encode_frames(data, starts[ids], s, numbers[ids], bits, lpc)):
                frames[i] = f
    out, bounds = [], np.searchsorted(of, np.arange(len(values) + 1)).tolist()
    for i, n in enumerate(counts):
        own = frames[bounds[i] : bounds[i + 1]]
        lengths = np.array([len(f) for f in own], np.int64)
        points = np.zeros(len(own), np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")]))
        points["sample"], points["at"], points["n"] = np.arange(len(own)) * block, np.cumsum(lengths) - lengths, sizes[bounds[i] : bounds[i + 1]]
        signed = (np.frombuffer(values[i], np.uint8) ^ 128).tobytes() if bits == 8 else values[i][: n * wide]
        low, high = (int(lengths.min()), int(lengths.max())) if own else (0, 0)
        info = struct.pack(">HH", block, block) + low.to_bytes(3, "big") + high.to_bytes(3, "big") + (rate << 44 | (bits - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek = points.tobytes()
        out.append(b"fLaC" + (b"\0" if own else b"\x80") + len(info).to_bytes(3, "big") + info + (b"\x83" + len(seek).to_bytes(3, "big") + seek) * bool(own) + b"".join(own))
    return out


def stream_info(stream: bytes) -> dict:
    """Metadata of a stream, and the offset of its first frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, out, last = 4, {}, False
    while not last:
        last, kind, n = stream[at] & 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["points"] = np.frombuffer(body, np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")]))
        at += 4 + n
    return out | {"first": at}


def header(data: np.ndarray, at: int) -> tuple[int, int, int, int, int] | None:
    """Size of the header, frame or sample number, block size, channel code and bits of a frame at `at`; None if no header is there."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    b = data[at : at + 16].tolist()
    n = 1 if b[4] < 128 else 8 - (b[4] ^ 0xFF).bit_length()
    if n > 7 or (n == 1 and b[4] >= 128) or len(b) < 4 + n:
        return None
    number = b[4] & (0x7F if n == 1 else (1 << (7 - n)) - 1)
    for c in b[5 : 4 + n]:
        number = number << 6 | c & 63
    end, code = 4 + n, b[2] >> 4
    if code in (6, 7):
        size = int.from_bytes(bytes(b[end : end + code - 5]), "big") + 1
        end += code - 5
    else:
        size = SIZE_OF.get(code, 0)
    end += {12: 1, 13: 2, 14: 2}.get(b[2] & 15, 0)
    crc = 0
    for c in b[:end]:
        crc = int(CRC8[crc ^ c])
    if not size or end >= len(b) or crc != b[end]:
        return None
    return end + 1, number, size, b[3] >> 4, BITS.get(b[3] >> 1 & 7, 0)


def frames_of(stream: bytes, info: dict) -> list[tuple]:
    """(start, end, header) of each frame: by a seek table that names every frame, else by a search for headers, whose
    candidates count if the checksum of the frame before them holds."""
    data = np.frombuffer(stream, np.uint8)
    if not info["samples"] and info["first"] >= len(stream):
        return []
    p = info.get("points")
    if p is not None and len(p) and int(p["n"].astype(np.int64).sum()) == info["samples"]:
        starts = (p["at"].astype(np.int64) + info["first"]).tolist()
    else:
        near = np.flatnonzero((data[info["first"] : -1] == 0xFF) & (data[info["first"] + 1 :] & 0xFE == 0xF8)) + info["first"]
        starts = []
        for a in near.tolist():
            if header(data, a) and (not starts or frame_ok(data, starts[-1], a)):
                starts.append(a)
    out = []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(stream)])):
        if not (h := header(data, a)):
            raise ValueError(f"frame {i}: bad header")
        out.append((a, b, h))
    return out


def frame_ok(data: np.ndarray, a: int, b: int) -> bool:
    return b - a > 2 and int(crcs(data, np.array([a]), np.array([b - a]), CRC16)[0]) == 0


class Bits:
    """Reads bit fields at many places at once."""

    def __init__(self, data: np.ndarray):
        self.data = d = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.as_strided(d, (len(data) + 8, 8), (1, 1)).copy().view(">u8").astype(np.uint64).ravel()

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (up to 57, by place if an array) as unsigned numbers."""
        n = np.broadcast_to(np.asarray(n, np.int64), at.shape)
        return (self.peek(at) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        v = self.take(at, n)
        n = np.broadcast_to(np.asarray(n, np.int64), at.shape)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 == 1), v - (1 << n), v)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        n = ZEROS[(self.peek(at) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        far = np.flatnonzero(n == 16)
        while len(far):
            more = ZEROS[(self.peek(at[far] + n[far]) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            n[far] += more
            far = far[more == 16]
            if len(far) and (at[far] + n[far] >> 3 >= len(self.words) - 9).any():
                raise ValueError("a code runs past the end")
        return n


def residuals(bits: Bits, at: np.ndarray, size: int, order: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decode Rice residuals of frames with `size` samples into out[sample, frame]; returns the places after them."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    at = at + 6
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    wide = 4 + method
    each = size >> parts
    k, escape = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    one, any_escape, low_order = np.uint64(1), False, int(order.min())
    same = (parts == parts[0]).all() and (order == order[0]).all()
    for i in range(low_order, size):
        opens = (i == order) | ((i > order) & (i % each == 0)) if not same else None
        if same and (i == low_order or i % int(each[0]) == 0) or not same and opens.any():
            sel = slice(None) if same else opens
            k[sel] = bits.take(at[sel], wide[sel])
            at[sel] += wide[sel]
            escape[sel] = k[sel] == (1 << wide[sel]) - 1
            if any_escape := bool(escape.any()):
                e = np.flatnonzero(escape if same else escape & opens)
                k[e] = bits.take(at[e], 5)
                at[e] += 5
        if same and not any_escape:
            word = bits.peek(at)
            q = ZEROS[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            if (far := q == 16).any():
                q[far] = bits.unary(at[far])
                word = np.where(far, bits.peek(at + q), word << q.astype(np.uint64))
            else:
                word = word << q.astype(np.uint64)
            u = q << k | (word << one >> one >> (63 - k).astype(np.uint64)).astype(np.int64)
            at = at + (q + 1 + k)
            out[i] = u >> 1 ^ -(u & 1)
            continue
        live = i >= order
        r = np.flatnonzero(live & ~escape)
        q = bits.unary(at[r])
        u = q << k[r] | bits.take(at[r] + q + 1, k[r])
        at[r] += q + 1 + k[r]
        out[i, r] = u >> 1 ^ -(u & 1)
        e = np.flatnonzero(live & escape)
        out[i, e] = bits.signed(at[e], k[e])
        at[e] += k[e]
    return at


def subframes(bits: Bits, at: np.ndarray, size: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples[sample, frame] of the subframes at `at`, and the places after them."""
    first = bits.take(at, 8)
    kind, at = first >> 1 & 63, at + 8
    wasted = np.zeros(len(at), np.int64)
    if (w := np.flatnonzero(first & 1)).size:
        wasted[w] = bits.unary(at[w]) + 1
        at[w] += wasted[w]
    depth = depth - wasted
    out = np.zeros((size, len(at)), np.int64)
    if (c := np.flatnonzero(kind == 0)).size:
        out[:, c] = bits.signed(at[c], depth[c])
        at[c] += depth[c]
    if (c := np.flatnonzero(kind == 1)).size:
        if (depth[c] == 8).all() and not (at[c] & 7).any():
            out[:, c] = bits.data[(at[c] >> 3) + np.arange(size)[:, None]].view(np.int8)
        else:
            out[:, c] = bits.signed(at[c] + np.arange(size)[:, None] * depth[c], depth[c])
        at[c] += size * depth[c]
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("reserved subframe")
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, -1))
    for o in np.unique(order[order >= 0]).tolist():
        for linear in (False, True):
            c = np.flatnonzero((order == o) & ((kind >= 32) == linear))
            if not c.size:
                continue
            p = at[c]
            for i in range(o):
                out[i, c] = bits.signed(p, depth[c])
                p = p + depth[c]
            if linear:
                precision = bits.take(p, 4) + 1
                shift = np.maximum(bits.signed(p + 4, 5), 0)
                p = p + 9
                coefs = np.zeros((o, len(c)), np.int64)
                for j in range(o):
                    coefs[j] = bits.signed(p, precision)
                    p = p + precision
            own = np.zeros((size, len(c)), np.int64)
            at[c] = residuals(bits, p, size, np.full(len(c), o), own)
            if linear:
                own[:o] = out[:o, c]
                for i in range(o, size):
                    own[i] += (coefs * own[i - o : i][::-1]).sum(0) >> shift
            else:  # sums undo the differences that a fixed predictor leaves
                warm = out[:o, c]
                for d in range(o, 0, -1):
                    seed = np.diff(warm[: d], axis=0, n=d - 1)[0]  # the (d-1)-th difference at sample d-1
                    own[d - 1] = seed
                    np.cumsum(own[d - 1 :], axis=0, out=own[d - 1 :])
                own[:o] = warm
            out[:, c] = own
    return out << wasted, at


def decode_frames(data: np.ndarray, spans: list[tuple], channels: int, wide: int) -> list[bytes]:
    """PCM of frames that have one block size and channel code, with `wide` bytes a sample."""
    starts, ends = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    bad = np.flatnonzero(crcs(data, starts, ends - starts, CRC16))
    if bad.size:
        raise ValueError(f"frame {spans[bad[0]][2][1]}: checksum differs")
    size, code, depth = spans[0][2][2], spans[0][2][3], np.array([s[2][4] for s in spans])
    bits, at = Bits(data), (starts + [s[2][0] for s in spans]) * 8
    got = []
    for c in range(channels):
        side = code == 8 and c == 1 or code == 9 and c == 0 or code == 10 and c == 1
        x, at = subframes(bits, at, size, depth + side)
        got.append(x)
    if code == 8:
        got[1] = got[0] - got[1]
    elif code == 9:
        got[0] = got[0] + got[1]
    elif code == 10:
        mid = got[0] << 1 | got[1] & 1
        got = [mid + got[1] >> 1, mid - got[1] >> 1]
    both = np.stack(got, 2)  # sample, frame, channel
    raw = (both + 128).astype(np.uint8) if wide == 1 else both.astype("<i4")[..., None].view(np.uint8)[..., :wide]
    return [x.tobytes() for x in np.ascontiguousarray(raw.swapaxes(0, 1))]


def decode_streams(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """PCM of each stream (8 bits: bytes around 128; more: little-endian signed, channels interleaved), and (first sample, byte
    offset in the PCM, samples) of each of its blocks."""
    infos = [stream_info(s) for s in streams]
    todo = []
    for i, (s, info) in enumerate(zip(streams, infos)):
        at = 0
        for a, b, h in frames_of(s, info):
            todo.append((i, at, a, b, h if h[4] else (*h[:4], info["bits"])))
            at += h[2]
        if at != info["samples"] and info["samples"]:
            raise ValueError(f"{at} samples in place of {info['samples']}")
    pcm: list[list] = [[] for _ in streams]
    blocks: list[list] = [[] for _ in streams]
    for a in range(0, len(todo), FRAMES):
        part = todo[a : a + FRAMES]
        data = np.frombuffer(b"".join(streams[i][p:q] for i, _, p, q, _ in part), np.uint8)
        ends = np.cumsum([q - p for _, _, p, q, _ in part])
        groups: dict[tuple, list] = {}
        for j, (i, _, p, q, h) in enumerate(part):
            groups.setdefault((h[2], h[3], (infos[i]["bits"] + 7) // 8), []).append(j)
        for (_, code, wide), js in groups.items():
            spans = [(int(ends[j]) - (part[j][3] - part[j][2]), int(ends[j]), part[j][4]) for j in js]
            channels = code + 1 if code < 8 else 2
            for j, raw in zip(js, decode_frames(data, spans, channels, wide)):
                i, at, _, _, h = part[j]
                blocks[i].append((at, at * wide * channels, h[2]))
                pcm[i].append((at, raw))
    out = []
    for i, info in enumerate(infos):
        got = b"".join(raw for _, raw in sorted(pcm[i]))
        signed = (np.frombuffer(got, np.uint8) ^ 128).tobytes() if info["bits"] <= 8 else got
        if info["md5"] != bytes(16) and hashlib.md5(signed).digest() != info["md5"]:
            raise ValueError("the MD5 of the samples differs")
        out.append((got, sorted(blocks[i])))
    return out


def encode(df: DataFrame, value: str, media: str = "media", bits: int = 8, lpc: int = 0) -> DataFrame:
    """df with a column of FLAC streams that hold the samples of the binary column `value`."""
    (media,) = fresh(df.columns, media)
    schema = T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())])

    def run(batches):
        for b in batches:
            got = encode_streams([v or b"" for v in b.column(b.schema.get_field_index(value)).to_pylist()], bits, lpc)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, media])

    return df.mapInArrow(lean(run), schema)


BLOCKS = T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("byte", T.LongType()), T.StructField("n", T.LongType())]))


def decode(df: DataFrame, media: str = "media", pcm: str = "pcm", blocks: str = "blocks", feature: str = "feature") -> DataFrame:
    """df with the PCM of each stream, the offsets of its blocks, and features of its samples: mean, root of the mean square and
    crossings of the middle."""
    pcm, blocks, feature = fresh(df.columns, pcm, blocks, feature)
    schema = T.StructType([*df.schema.fields, T.StructField(pcm, T.BinaryType()), T.StructField(blocks, BLOCKS), T.StructField(feature, T.StringType())])

    def run(batches):
        for b in batches:
            streams = b.column(b.schema.get_field_index(media)).to_pylist()
            got = decode_streams([s for s in streams if s])
            got = iter(got)
            got = [next(got) if s else (b"", []) for s in streams]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in got], pa.binary()), pa.array([[dict(zip(("sample", "byte", "n"), p)) for p in y] for _, y in got], pa.list_(pa.struct([("sample", pa.int64()), ("byte", pa.int64()), ("n", pa.int64())]))), pa.array([describe(x) for x, _ in got])],
                [*b.schema.names, pcm, blocks, feature])

    return df.mapInArrow(lean(run), schema)


def describe(pcm: bytes) -> str:
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    if not len(x):
        return "mean=0.000;rms=0.000;crossings=0"
    return f"mean={x.mean():.3f};rms={np.sqrt((x * x).mean()):.3f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def blocks_of(decoded: DataFrame, *keep: str) -> DataFrame:
    """A row for each PCM block, with the offset of its first sample."""
    return decoded.select(*keep, "pcm", "blocks", F.posexplode("blocks").alias("block", "at")).select(
        *keep, "block", F.col("at.sample").alias("sample"), F.col("at.n").alias("n"), F.expr("substring(pcm, cast(at.byte + 1 as int), cast(coalesce(get(blocks, block + 1).byte, octet_length(pcm)) - at.byte as int))").alias("pcm"))


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, stored as FLAC and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole().alias("text"))
    n = F.octet_length("text")
    padded = F.greatest(F.lit(192), F.ceil(n / 192) * 192).cast("int")
    payload = F.concat(F.col("text").cast("binary"), F.repeat(F.lit(" "), padded - n).cast("binary")).alias("payload")
    out = decode(encode(docs.select("doc_id", n.cast("long").alias("n_bytes"), payload), "payload", lpc=ORDER).drop("payload"))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, greatest(1, octet_length(pcm) - 15), 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature")

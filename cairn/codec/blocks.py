"""Block colour codecs: BC1 (16 colours in 8 bytes) and BC7 mode 6 (16 colours in 16 bytes).  Both lose precision."""

from __future__ import annotations

import numpy as np


def blocks_of(colors: np.ndarray, channels: int) -> np.ndarray:
    """Colours in blocks of 16, the last one filled up with its last colour."""
    c = np.asarray(colors, np.int64).reshape(-1, channels)
    short = -len(c) % 16
    if short:
        c = np.concatenate([c, np.repeat(c[-1:], short, 0)])
    return c.reshape(-1, 16, channels)


def ends(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two colours of each block: the extremes along its longest direction."""
    x = b - b.mean(1, keepdims=True)
    axis = np.ptp(b, axis=1).astype(float)
    for _ in range(4):  # power iteration
        axis = np.einsum("bij,bi->bj", x, np.einsum("bij,bj->bi", x, axis))
        axis /= np.maximum(np.linalg.norm(axis, axis=1, keepdims=True), 1e-12)
    t = np.einsum("bij,bj->bi", x, axis)
    i = np.arange(len(b))
    return b[i, t.argmax(1)], b[i, t.argmin(1)]


def to565(c: np.ndarray) -> np.ndarray:
    r, g, b = (np.rint(c[..., i] * m / 255).astype(np.int64) for i, m in enumerate((31, 63, 31)))
    return r << 11 | g << 5 | b


def from565(v: np.ndarray) -> np.ndarray:
    r, g, b = v >> 11 & 31, v >> 5 & 63, v & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], -1)


def palette1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four colours of blocks; of three and black where the first number is not the greater."""
    x, y = from565(a), from565(b)
    four = (a > b)[:, None, None]
    return np.where(four, np.stack([x, y, (2 * x + y) // 3, (x + 2 * y) // 3], 1), np.stack([x, y, (x + y) // 2, 0 * x], 1))


def encode1(colors: np.ndarray) -> bytes:
    """BC1 blocks of colours (r, g, b), always of four colours or of one."""
    if not len(colors):
        return b""
    block = blocks_of(colors, 3)
    hi, lo = (to565(e) for e in ends(block))
    hi, lo = np.maximum(hi, lo), np.minimum(hi, lo)
    pal = palette1(hi, lo)
    d = ((block[:, :, None, :] - pal[:, None, :, :]) ** 2).sum(-1)
    d[hi == lo, :, 1:] = 1 << 30
    pick = d.argmin(2)
    out = np.zeros(len(block), np.dtype([("a", "<u2"), ("b", "<u2"), ("s", "<u4")]))
    out["a"], out["b"], out["s"] = hi, lo, (pick << 2 * np.arange(16)).sum(1)
    return out.tobytes()


def decode1(data: bytes, n: int) -> np.ndarray:
    """The first n colours (r, g, b) of BC1 blocks."""
    b = np.frombuffer(data, np.dtype([("a", "<u2"), ("b", "<u2"), ("s", "<u4")]))
    pal = palette1(b["a"].astype(np.int64), b["b"].astype(np.int64))
    pick = b["s"].astype(np.int64)[:, None] >> 2 * np.arange(16) & 3
    return np.take_along_axis(pal, pick[:, :, None], 1).reshape(-1, 3)[:n]


def weights() -> np.ndarray:
    """Weights of 16 steps between two colours, in 64ths (fixed values of the format, by their rule)."""
    return np.floor(np.arange(16) * 64 / 15 + 0.5).astype(np.int64)


def encode7(colors: np.ndarray) -> bytes:
    """BC7 mode 6 blocks of colours (r, g, b, a)."""
    if not len(colors):
        return b""
    block = blocks_of(colors, 4)
    out = []
    for pixels, a, b in zip(block, *ends(block)):
        best = None
        for pa in (0, 1):
            for pb in (0, 1):
                ea, eb = (np.clip((e - p + 1) // 2, 0, 127) for e, p in ((a, pa), (b, pb)))
                pal = (ea * 2 + pa) * (64 - weights()[:, None]) + (eb * 2 + pb) * weights()[:, None] + 32 >> 6
                d = ((pixels[:, None] - pal[None]) ** 2).sum(-1)
                if best is None or d.min(1).sum() < best[0]:
                    best = (d.min(1).sum(), ea, eb, pa, pb, d.argmin(1))
        _, ea, eb, pa, pb, pick = best
        if pick[0] >= 8:  # the first index has three bits
            ea, eb, pa, pb, pick = eb, ea, pb, pa, 15 - pick
        v, at = 1 << 6, 7
        for x, y in zip(ea.tolist(), eb.tolist()):
            v |= x << at | y << at + 7
            at += 14
        v |= pa << 63 | pb << 64
        at = 65
        for i, p in enumerate(pick.tolist()):
            v |= p << at
            at += 3 if i == 0 else 4
        out.append(v.to_bytes(16, "little"))
    return b"".join(out)


def decode7(data: bytes, n: int) -> np.ndarray:
    """The first n colours (r, g, b, a) of BC7 mode 6 blocks."""
    out = []
    for i in range(0, len(data), 16):
        v = int.from_bytes(data[i : i + 16], "little")
        if v & 127 != 64:
            raise ValueError("not a block of mode 6")
        a, b = (np.array([(v >> 7 + 14 * c + 7 * s & 127) << 1 | v >> 63 + s & 1 for c in range(4)]) for s in (0, 1))
        pick = np.array([v >> 65 & 7, *((v >> 68 + 4 * j) & 15 for j in range(15))])
        out.append(a * (64 - weights()[pick][:, None]) + b * weights()[pick][:, None] + 32 >> 6)
    return np.concatenate(out)[:n] if out else np.zeros((0, 4), np.int64)


def decode1_columns(block: str, texel: str):
    """The colour of a texel of a BC1 block (four colours), as expressions of a block number (bytes as a little-endian long) and an index."""
    from pyspark.sql import functions as F

    a, b = F.col(block).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(F.col(block), 16).bitwiseAND(F.lit(0xFFFF))
    s = F.expr(f"shiftrightunsigned({block}, cast(32 + 2 * {texel} as int))").bitwiseAND(F.lit(3))
    out = []
    for shift, width in ((11, 5), (5, 6), (0, 5)):
        x, y = (F.shiftright(v, shift).bitwiseAND(F.lit((1 << width) - 1)) for v in (a, b))
        x, y = (F.shiftleft(v, 8 - width).bitwiseOR(F.shiftright(v, 2 * width - 8)) for v in (x, y))
        out.append(F.when(s == 0, x).when(s == 1, y).when(s == 2, F.floor((2 * x + y) / 3)).otherwise(F.floor((x + 2 * y) / 3)).cast("long"))
    return out

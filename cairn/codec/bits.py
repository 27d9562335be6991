"""Bit fields in byte arrays."""

from __future__ import annotations

import numpy as np


def pack_msb(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of 0 to 32 bits one after the other, highest bit first: bytes, and the bit offset of each value and of the end."""
    values, widths = np.asarray(values, np.uint64), np.asarray(widths, np.int64)
    at = np.concatenate([[0], np.cumsum(widths)])
    out = np.zeros((int(at[-1]) + 7 >> 3) + 8, np.uint64)
    place = at[:-1] >> 3
    word = np.where(widths > 0, values, 0).astype(np.uint64) << (40 - (at[:-1] & 7) - widths).astype(np.uint64)  # within five bytes
    for j in range(5):
        np.add.at(out, place + j, word >> np.uint64(8 * (4 - j)) & np.uint64(255))
    return out.astype(np.uint8)[: int(at[-1]) + 7 >> 3], at


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte, the eight bytes from there as one big-endian number."""
    d = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(d, 8)[: len(data) + 8].copy().view(">u8").ravel().astype(np.uint64)


def read_msb(words: np.ndarray, at: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Fields of 0 to 32 bits at bit offsets of data whose `windows` are words."""
    at = np.asarray(at, np.int64)
    widths = np.broadcast_to(np.asarray(widths, np.int64), at.shape)
    return (words[at >> 3] << (at & 7).astype(np.uint64) >> np.uint64(1) >> (63 - widths).astype(np.uint64)).astype(np.int64)


def pack_lsb(values, widths) -> bytes:
    """Values of 1 to 32 bits one after the other, lowest bit first; a value may lie in several bytes."""
    total, at = 0, 0
    for v, w in zip(values, widths):
        total |= (int(v) & (1 << int(w)) - 1) << at
        at += int(w)
    return total.to_bytes(at + 7 >> 3, "little")


def read_lsb(data: bytes, at: int, width: int) -> int:
    """The field of `width` bits at bit offset `at`."""
    first, last = at >> 3, at + width + 7 >> 3
    return int.from_bytes(data[first:last], "little") >> (at & 7) & (1 << width) - 1


#: Bytes of a block that nodes are padded to.
BLOCK = 20


def pack_node(xyz: np.ndarray, bits: tuple[int, int, int]) -> bytes:
    """A node's points at fixed widths, padded to whole blocks; a node without points takes none."""
    flat = np.asarray(xyz, np.uint64).reshape(-1, 3)
    out = pack_lsb(flat.ravel().tolist(), list(bits) * len(flat))
    return out + bytes(-len(out) % BLOCK)


def read_node(data: bytes, n: int, bits: tuple[int, int, int]) -> np.ndarray:
    """The points of a node, by reading three fields for each."""
    step = sum(bits)
    at = np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(int)
    return np.array([[read_lsb(data, i * step + a, w) for a, w in zip(at.tolist(), bits)] for i in range(n)], np.int64).reshape(n, 3)

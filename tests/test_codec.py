import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.codec import bits, blocks, huffman
from cairn.operators import compress

symbols = st.one_of(
    st.lists(st.integers(-5, 5), max_size=300), st.lists(st.integers(-(2**31), 2**31 - 1), max_size=200), st.just([7] * 100), st.just([0] * 999 + [5]), st.just(list(range(5000))), st.just([1, 2] * 40))


@settings(max_examples=40, deadline=None)
@given(symbols, st.integers(1, 70))
def test_huffman_round_trip(values, chain):
    v = np.array(values, np.int64)
    starts = np.arange(0, len(v), chain)
    sizes = np.diff(np.append(starts, len(v)))
    got = huffman.decode(huffman.encode(v, starts), sizes)
    assert np.array_equal(np.concatenate([*got, np.zeros(0, np.int64)]), v)


def test_escapes_have_twelve_bits():
    v = np.repeat(np.arange(5000), 1)
    s = huffman.encode(v, np.array([0]))
    assert (np.abs(s["lengths"]) <= 12).all() and (s["lengths"] < 0).any() and len(s["separate"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.integers(1, 20))
def test_flagged_round_trip(values, top):
    v = np.array(values)
    assert np.array_equal(huffman.decode_flagged(huffman.encode_flagged(v, top), len(v)), v)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 32).flatmap(lambda w: st.tuples(st.integers(0, 2**w - 1), st.just(w))), max_size=100))
def test_bitstreams(fields):
    values, widths = [v for v, _ in fields], [w for _, w in fields]
    data, at = bits.pack_lsb(values, widths), 0
    for v, w in fields:
        assert bits.read_lsb(data, at, w) == v
        at += w
    packed, places = bits.pack_msb(np.array(values, np.uint64), np.array(widths, np.int64))
    assert bits.read_msb(bits.windows(packed), places[:-1], np.array(widths, np.int64)).tolist() == values


def test_node_blocks():
    xyz = np.random.default_rng(1).integers(0, 2**9, (37, 3))
    data = bits.pack_node(xyz, (9, 10, 11))
    assert len(data) % 20 == 0 and np.array_equal(bits.read_node(data, 37, (9, 10, 11)), xyz)
    assert bits.pack_node(np.zeros((0, 3)), (1, 1, 1)) == b""


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 160])
def test_bc1(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 256, 3)
    c = np.clip(base + rng.integers(-6, 7, (n, 1)), 0, 255)
    got = blocks.decode1(blocks.encode1(c), n)
    assert got.shape == (n, 3) and (not n or np.abs(got - c).max() <= 12)


def test_bc1_is_exact_on_its_own_colours():
    c = np.tile([[255, 0, 0]], (16, 1))
    assert np.array_equal(blocks.decode1(blocks.encode1(c), 16), c)


def test_bc7():
    rng = np.random.default_rng(3)
    c = np.clip(np.array([100, 150, 50, 200]) + rng.integers(-20, 21, (40, 1)), 0, 255)
    assert np.abs(blocks.decode7(blocks.encode7(c), 40) - c).max() <= 6


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4097])
@pytest.mark.parametrize("color", ["bc1", "bc7", "none"])
def test_batch(n, color):
    rng = np.random.default_rng(n)
    xyz = rng.integers(-(2**31), 2**31, (n, 3)) if n < 100 else np.cumsum(rng.integers(-9, 10, (n, 3)), 0)
    rgb = rng.integers(0, 256, (n, 3))
    got, colors = compress.decode_batch(compress.encode_batch(xyz, rgb, color=color), color=color)
    assert np.array_equal(got, xyz) and colors.shape == rgb.shape
    if color == "none":
        assert np.array_equal(colors, rgb)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 12), max_size=60), min_size=1, max_size=5))
def test_interleaved_words(lanes):
    """Against lanes that are decoded step by step, each holding two words."""
    lengths = [np.array(x, np.int64) for x in lanes]
    total = [-(-int(x.sum()) // 32) if len(x) else 0 for x in lengths]
    read, want, used = [0] * len(lanes), [], [0] * len(lanes)
    for j, n in enumerate(total):
        read[j] = min(2, n)
        want += [(j, i) for i in range(read[j])]
    for step in range(max(map(len, lanes))):
        for j, x in enumerate(lanes):
            if step < len(x):
                used[j] += x[step]
                while read[j] < total[j] and read[j] - used[j] // 32 < 2:
                    want.append((j, read[j]))
                    read[j] += 1
    assert huffman.interleaved(lengths) == want


def test_largest_top():
    v = np.repeat(np.arange(40), np.minimum(2 ** np.arange(40), 5000))
    top = huffman.largest_top(v, 8)
    assert huffman.fits(v, top, 8) and not huffman.fits(v, top + 1, 8) and huffman.largest_top(np.array([7, 7]), 8) == 1

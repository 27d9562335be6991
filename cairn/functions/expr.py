"""Functions of coordinates, colours, boxes and projections, as columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Num = Column | float | int


def c(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# coordinates


def world(v: Num | str, scale: float, offset: float) -> Column:
    """Lattice coordinate to world coordinate."""
    return c(v) * F.lit(float(scale)) + F.lit(float(offset))


def unsigned(v: Num | str) -> Column:
    """A signed 32-bit number moved to 0 .. 2**32 - 1, in the same order."""
    return c(v).cast("long") + F.lit(1 << 31)


def spread3(v: Column) -> Column:
    """The lower 21 bits of v, two zeros between each."""
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton63(x: Num | str, y: Num | str, z: Num | str, x_first: bool = False) -> Column:
    """Bits of three coordinates of 21 bits in turn; x has the lowest bit, or the highest with x_first."""
    a, b, d = (spread3(c(v)) for v in ((z, y, x) if x_first else (x, y, z)))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(d, 2))


def morton96(x: Num | str, y: Num | str, z: Num | str) -> list[Column]:
    """Three sort keys, highest first, of 32-bit coordinates (moved to unsigned): bits 31-22, 21-11 and 10-0 of each in turn."""
    u = [unsigned(v) for v in (x, y, z)]
    part = lambda low, n: morton63(*(F.shiftright(v, low).bitwiseAND(F.lit((1 << n) - 1)) for v in u))
    return [part(22, 10), part(11, 11), part(0, 11)]


def grid(v: Num | str, low: Num | str, size: Num | str, levels: int) -> Column:
    """The cell of a cube's 2**levels grid along one axis; the upper face belongs to the last cell."""
    n = 1 << levels
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.lit(float(n)) * (c(v) - c(low)) / c(size)))).cast("long")


def quantize(v: Num | str, low: Num | str, size: Num | str, bits: int) -> Column:
    """v as a number of `bits` bits within a box; 0 in a box without extent."""
    return F.when(c(size) > 0, grid(v, low, size, bits)).otherwise(F.lit(0).cast("long"))


def planes(x: Column, y: Column, z: Column) -> list[Column]:
    """Coordinates of 30 bits as three columns of 3 x 10 bits: coarse, medium and fine."""
    part = lambda v, s: F.shiftright(v, s).bitwiseAND(F.lit(1023))
    return [part(x, s).bitwiseOR(F.shiftleft(part(y, s), 10)).bitwiseOR(F.shiftleft(part(z, s), 20)) for s in (20, 10, 0)]


def from_planes(parts: Sequence[Column], axis: int, low: Num | str, size: Num | str) -> Column:
    """The coordinate along an axis that one, two or three planes give."""
    v = F.lit(0).cast("long")
    for p in parts:
        v = F.shiftleft(v, 10).bitwiseOR(F.shiftright(p, 10 * axis).bitwiseAND(F.lit(1023)))
    return v * (c(size) / F.lit(float(1 << 10 * len(parts)))) + c(low)


def pack16(x: Column, y: Column, z: Column) -> Column:
    """Three numbers of 16 bits in one of 48."""
    return x.bitwiseOR(F.shiftleft(y, 16)).bitwiseOR(F.shiftleft(z, 32))


def split20(x: Column, y: Column, z: Column) -> list[Column]:
    """Three numbers of 20 bits in two of 32: x and the low 12 bits of y; z and the high 8."""
    return [x.bitwiseOR(F.shiftleft(y.bitwiseAND(F.lit(4095)), 20)), z.bitwiseOR(F.shiftleft(F.shiftright(y, 12), 20))]


def bits_for(size: Num | str, precision: float = 0.001) -> Column:
    """Bits for a coordinate of a box of that size, at a precision."""
    return F.when(c(size) > precision, F.ceil(F.log2(c(size) / F.lit(precision)))).otherwise(F.lit(1)).cast("long")


def quantize_bits(v: Num | str, low: Num | str, size: Num | str, bits: Column) -> Column:
    n = F.pow(F.lit(2.0), bits)
    return F.when(c(size) > 0, F.least(n - 1, F.floor(n * (c(v) - c(low)) / c(size)))).otherwise(F.lit(0)).cast("long")


def delta_bits(d: Num | str) -> Column:
    """Bits that a difference takes, with its sign; a difference of 0 takes one."""
    return F.when(c(d) == 0, F.lit(1)).otherwise(F.ceil(F.log2(F.abs(c(d)).cast("double"))) + 1).cast("long")


# colours


def color8(v: Num | str) -> Column:
    """A colour of 16 bits, or of 8 bits in 16, as 8 bits."""
    return F.when(c(v) > 255, F.shiftright(c(v), 8)).otherwise(c(v))


def pack_rgb(r: Num | str, g: Num | str, b: Num | str) -> Column:
    return c(r).bitwiseOR(F.shiftleft(c(g), 8)).bitwiseOR(F.shiftleft(c(b), 16))


def unpack_rgb(v: Num | str) -> list[Column]:
    return [F.shiftright(c(v), s).bitwiseAND(F.lit(255)) for s in (0, 8, 16)]


# projection


def clip(m: np.ndarray, x: Num | str, y: Num | str, z: Num | str) -> list[Column]:
    """Clip coordinates x, y and w of a point."""
    row = lambda i: (F.lit(float(m[i, 0])) * c(x) + F.lit(float(m[i, 1])) * c(y)) + (F.lit(float(m[i, 2])) * c(z) + F.lit(float(m[i, 3])))
    return [row(0), row(1), row(3)]


def pixel(ndc: Column, size: int) -> Column:
    return F.floor((ndc * F.lit(0.5) + F.lit(0.5)) * F.lit(float(size))).cast("long")


def plane_distance(plane: Sequence[float], x: Num | str, y: Num | str, z: Num | str) -> Column:
    a, b, d, e = (F.lit(float(v)) for v in plane)
    return ((a * c(x) + b * c(y)) + d * c(z)) + e


def farthest(plane: Sequence[float], box: Sequence[str]) -> Column:
    """The distance from a plane of the corner of a box (min_x .. max_z) that lies farthest on the plane's inner side."""
    return plane_distance(plane, *(box[i + 3] if plane[i] > 0 else box[i] for i in range(3)))


def level_by_pixels(px: Num | str) -> Column:
    return F.when(c(px) < 100, 4).when(c(px) < 200, 3).when(c(px) < 500, 2).when(c(px) < 10000, 1).otherwise(0)


def level_by_ndc(size: Num | str) -> Column:
    return F.when(c(size) < 0.01, 4).when(c(size) < 0.02, 3).when(c(size) < 0.05, 2).when(c(size) < 0.1, 1).otherwise(0)


def lod_fraction(px: Num | str, least: float = 0.1) -> Column:
    """The part of a batch's points that is worth drawing."""
    return F.least(F.lit(1.0), F.greatest(F.lit(float(least)), F.lit(1.8) * c(px) / F.lit(100.0) - F.lit(0.3)))


def foveation(d2: Num | str) -> Column:
    """The weight of a place on the screen by its squared distance from the middle."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.exp(-c(d2) / F.lit(0.2)) + F.lit(0.1)) * F.lit(0.8)))


def priority(radius: Num | str, distance: Num | str, d2: Num | str) -> Column:
    """What a node is worth loading: large, near and in the middle of the view."""
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(10.0) * c(radius) / c(distance)))
    return F.when(c(distance) < c(radius), 1.0).otherwise(near * F.least(F.lit(1.0), F.exp(-c(d2))))


def edl(mean_response: Num | str, strength: float = 300.0) -> Column:
    """The shade of a pixel by how far it lies behind its neighbours."""
    return F.exp(-c(mean_response) * F.lit(strength) * F.lit(0.0005))


def smoothstep(low: float, high: float, v: Num | str) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c(v) - F.lit(float(low))) / F.lit(float(high - low))))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def noise(v: Num | str, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on v and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(c(v), F.lit(seed)), 11) / F.lit(float(1 << 53))


# boxes and spheres


def center(low: Num | str, high: Num | str) -> Column:
    return (c(low) + c(high)) / F.lit(2.0)


def diagonal(box: Sequence[str]) -> Column:
    return F.sqrt(sum((F.pow(c(box[i + 3]) - c(box[i]), F.lit(2.0)) for i in range(1, 3)), F.pow(c(box[3]) - c(box[0]), F.lit(2.0))))


def cube_size(box: Sequence[str]) -> Column:
    return F.greatest(*(c(box[i + 3]) - c(box[i]) for i in range(3)))


def octant(morton: Num | str, levels: int, level: int) -> Column:
    """The child, 0 to 7, that a point lies in below a node of `level`, by its Morton code of `levels` levels."""
    return F.shiftright(c(morton), 3 * (levels - level - 1)).bitwiseAND(F.lit(7))


def octant_at(x: Num | str, y: Num | str, z: Num | str, mid: Sequence[Num | str]) -> Column:
    """The same by coordinates: bit 2 for x, 1 for y, 0 for z; the middle plane belongs to the lower child."""
    return F.when(c(x) > c(mid[0]), 4).otherwise(0) + F.when(c(y) > c(mid[1]), 2).otherwise(0) + F.when(c(z) > c(mid[2]), 1).otherwise(0)


def child_box(box: Sequence[str], child: Num | str) -> list[Column]:
    """The box of a child: bit 2 is the upper half along x, 1 along y, 0 along z."""
    out = []
    for side in (0, 3):
        for i in range(3):
            upper = F.shiftright(c(child), 2 - i).bitwiseAND(F.lit(1)) == 1
            mid = center(box[i], box[i + 3])
            out.append(F.when(upper, mid).otherwise(c(box[i])) if side == 0 else F.when(upper, c(box[i + 3])).otherwise(mid))
    return out


def in_sphere(x: Num | str, y: Num | str, z: Num | str, at: Sequence[float], radius: float) -> Column:
    d2 = (F.pow(c(x) - F.lit(float(at[0])), F.lit(2.0)) + F.pow(c(y) - F.lit(float(at[1])), F.lit(2.0))) + F.pow(c(z) - F.lit(float(at[2])), F.lit(2.0))
    return F.sqrt(d2) < F.lit(float(radius))


def ray_hits(box: Sequence[str], origin: Sequence[float], direction: Sequence[float]) -> Column:
    """Whether a ray meets a box, by the intervals between its slabs."""
    near, far = [], []
    for i in range(3):
        if direction[i] == 0:
            continue
        a, b = ((c(box[i + s]) - F.lit(float(origin[i]))) / F.lit(float(direction[i])) for s in (0, 3))
        near.append(F.least(a, b)), far.append(F.greatest(a, b))
    inside = [(c(box[i]) <= F.lit(float(origin[i]))) & (c(box[i + 3]) >= F.lit(float(origin[i]))) for i in range(3) if direction[i] == 0]
    out = F.greatest(F.lit(0.0), *near) <= F.least(F.lit(float("inf")), *far)
    for x in inside:
        out = out & x
    return out


# rows


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row.  Plain columns are copied into every filter, key and column that names them, as
    often as it does, and the code of a projection that grows beyond what the JVM compiles runs interpreted; a generated row of one
    struct is not copied."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


# text


def grouped(v: Num | str, digits: int = 0) -> Column:
    """A number with its thousands grouped."""
    return F.format_number(c(v), digits)


def left_pad(v: Num | str, n: int, fill: str = " ") -> Column:
    """v filled up on the left to n characters at least."""
    s = c(v).cast("string")
    return F.when(F.length(s) < n, F.lpad(s, n, fill)).otherwise(s)


def right_pad(v: Num | str, n: int, fill: str = " ") -> Column:
    s = c(v).cast("string")
    return F.when(F.length(s) < n, F.rpad(s, n, fill)).otherwise(s)


def ends_with(v: Num | str, suffix: str, ignore_case: bool = False) -> Column:
    return F.lower(c(v)).endswith(suffix.lower()) if ignore_case else c(v).endswith(suffix)


# vectors


def dot(a: Sequence[Num | str], b: Sequence[Num | str]) -> Column:
    return (c(a[0]) * c(b[0]) + c(a[1]) * c(b[1])) + c(a[2]) * c(b[2])


def cross(a: Sequence[Num | str], b: Sequence[Num | str]) -> list[Column]:
    return [c(a[(i + 1) % 3]) * c(b[(i + 2) % 3]) - c(a[(i + 2) % 3]) * c(b[(i + 1) % 3]) for i in range(3)]


def length(a: Sequence[Num | str]) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Sequence[Num | str]) -> list[Column]:
    """A vector of length 1; null for one of length 0."""
    n = length(a)
    return [F.when(n > 0, c(x) / n) for x in a]


def near_cursor(px: Num | str, py: Num | str, at: tuple[float, float], reach: float) -> Column:
    """Whether a place on the image is within a number of pixels of the cursor."""
    return F.sqrt(F.pow(c(px) - F.lit(float(at[0])), F.lit(2.0)) + F.pow(c(py) - F.lit(float(at[1])), F.lit(2.0))) < F.lit(float(reach))


def debug_color(number: Num | str) -> Column:
    """A colour that tells neighbouring batches apart."""
    return (c(number).cast("long") * F.lit(1234567)).bitwiseAND(F.lit(0xFFFFFF))

"""Camera queries: which batches a view needs, which point each pixel shows, and how pixels are finished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..camera import Camera
from ..functions import expr
from ..points import BOX

BACKGROUND = 0x443322
TOLERANCE = 1.01


def projected(df: DataFrame, cam: Camera) -> DataFrame:
    """points(wx, wy, wz, ..) that fall on the image, with depth and pixel_id."""
    x, y, w = expr.clip(cam.transform(), "wx", "wy", "wz")
    rows = expr.once(df, cx=x, cy=y, depth=w).filter("depth > 0")
    rows = rows.withColumns({"nx": F.col("cx") / F.col("depth"), "ny": F.col("cy") / F.col("depth")})
    rows = rows.filter("nx >= -1 and nx <= 1 and ny >= -1 and ny <= 1")
    rows = rows.withColumns({"px": expr.pixel(F.col("nx"), cam.width), "py": expr.pixel(F.col("ny"), cam.height)})
    rows = rows.filter((F.col("px") < cam.width) & (F.col("py") < cam.height))
    return rows.withColumn("pixel_id", F.col("px") + F.col("py") * cam.width).drop("cx", "cy", "nx", "ny")


def nearest(rows: DataFrame, *by: str) -> DataFrame:
    """The nearest point of each pixel, ties by the smaller id."""
    keys = by or ("pixel_id",)
    best = rows.groupBy(*keys).agg(F.min(F.struct("depth", "point_id", "r", "g", "b")).alias("p"))
    return best.select(*keys, "p.depth", "p.point_id", expr.pack_rgb(F.col("p.r"), F.col("p.g"), F.col("p.b")).alias("rgb"))


def depths(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*(by or ("pixel_id",))).agg(F.min("depth").alias("min_depth"))


def blended(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of the colours of the points of each pixel within TOLERANCE of its least depth, and their mean colour."""
    keys = [*(by or ("pixel_id",))]
    near = rows.join(depths(rows, *keys), keys).filter(F.col("depth") <= F.col("min_depth") * TOLERANCE)
    sums = near.groupBy(*keys).agg(F.min("min_depth").alias("min_depth"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"), F.count("*").alias("n"))
    mean = [F.floor(F.col(f"sum_{c}") / F.col("n")).cast("long") for c in "rgb"]
    return sums.withColumn("rgb", expr.pack_rgb(*mean))


def overdraw(rows: DataFrame) -> DataFrame:
    """How many points each pixel gets, and the class that this is drawn as."""
    n = rows.groupBy("pixel_id").agg(F.count("*").alias("n"))
    return n.withColumn("class", F.when(F.col("n") < 10, 0).when(F.col("n") < 250, 1).when(F.col("n") < 1000, 2).when(F.col("n") < 4000, 3).otherwise(4).cast("long"))


def neighbours(fb: DataFrame, cam: Camera, reach: int) -> DataFrame:
    """Each pixel's row, dealt out to all pixels that have it in their window: (target, ox, oy, ..)."""
    offsets = F.array(*(F.struct(F.lit(x).alias("ox"), F.lit(y).alias("oy")) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)))
    rows = fb.withColumns({"px": F.pmod(F.col("pixel_id"), F.lit(cam.width)), "py": F.floor(F.col("pixel_id") / cam.width).cast("long"), "o": F.explode(offsets)})
    rows = rows.withColumns({"tx": F.col("px") - F.col("o.ox"), "ty": F.col("py") - F.col("o.oy")})
    rows = rows.filter((F.col("tx") >= 0) & (F.col("tx") < cam.width) & (F.col("ty") >= 0) & (F.col("ty") < cam.height))
    return rows.withColumns({"target": F.col("tx") + F.col("ty") * cam.width, "ox": F.col("o.ox"), "oy": F.col("o.oy")}).drop("o", "tx", "ty", "px", "py")


def window_depth(fb: DataFrame, cam: Camera, reach: int) -> DataFrame:
    """The least depth in the window around each pixel that has any."""
    return neighbours(fb, cam, reach).groupBy(F.col("target").alias("pixel_id")).agg(F.min("depth").alias("window_depth"))


def window_nearest(fb: DataFrame, cam: Camera, reach: int) -> DataFrame:
    """The nearest point in the window around each pixel: fills holes."""
    best = neighbours(fb, cam, reach).groupBy(F.col("target").alias("pixel_id")).agg(F.min(F.struct("depth", "point_id", "rgb")).alias("p"))
    return best.select("pixel_id", "p.*")


def window_blend(sums: DataFrame, cam: Camera, reach: int, middle: int = 10) -> DataFrame:
    """Weighted mean colours over windows: pixels beyond TOLERANCE of the window's least depth don't count; the middle counts `middle`,
    neighbours at offsets of at most 1 count 2, others 1."""
    rows = neighbours(sums, cam, reach)
    low = rows.groupBy("target").agg(F.min("min_depth").alias("low"))
    weight = F.when((F.col("ox") == 0) & (F.col("oy") == 0), middle).when((F.col("ox") <= 1) & (F.col("oy") <= 1), 2).otherwise(1)
    rows = rows.join(low, "target").filter(F.col("min_depth") <= F.col("low") * TOLERANCE).withColumn("weight", weight)
    total = F.sum(F.col("weight") * F.col("n"))
    mean = [F.floor(F.sum(F.col("weight") * F.col(f"sum_{c}")) / total).cast("long") for c in "rgb"]
    return rows.groupBy(F.col("target").alias("pixel_id")).agg(expr.pack_rgb(*mean).alias("rgb"), F.count("*").alias("pixels"))


def edl_shade(fb: DataFrame, cam: Camera) -> DataFrame:
    """Pixels with the shade that their depth behind the eight neighbours gives."""
    around = neighbours(fb.select("pixel_id", F.col("depth").alias("near")), cam, 1).filter("ox <> 0 or oy <> 0")
    rows = fb.join(around.select(F.col("target").alias("pixel_id"), "near"), "pixel_id", "left")
    behind = F.greatest(F.lit(0.0), F.log2("depth") - F.log2("near"))
    return rows.groupBy("pixel_id").agg(F.coalesce(expr.edl(F.sum(behind) / 8), F.lit(1.0)).alias("shade"))


def visible(batches: DataFrame, cam: Camera) -> DataFrame:
    """Batches whose box the frustum may hold: on no plane's outer side as a whole."""
    out = batches
    for p in cam.planes():
        out = out.filter(expr.farthest(p, BOX) >= 0)
    return out


def loosely_visible(batches: DataFrame, cam: Camera) -> DataFrame:
    """Batches with the least or greatest corner near the image: quick, and may miss large boxes."""
    def near(corner: list[str]) -> Column:
        x, y, w = expr.clip(cam.transform(), *corner)
        return (w > 0) & (x / w >= -1.4) & (x / w <= 1.2) & (y / w >= -1.2) & (y / w <= 1.2)

    return batches.filter(near([*BOX[:3]]) | near([*BOX[3:]]))


def projected_size(batches: DataFrame, cam: Camera) -> DataFrame:
    """batches with `pixels`: how far apart on the image their centre and a point one diagonal to its right are, in view space."""
    view, proj = cam.view(), cam.projection()
    mid = [expr.center(BOX[i], BOX[i + 3]) for i in range(3)]
    row = lambda i: (F.lit(float(view[i, 0])) * mid[0] + F.lit(float(view[i, 1])) * mid[1]) + (F.lit(float(view[i, 2])) * mid[2] + F.lit(float(view[i, 3])))
    out = batches.withColumns({"diagonal": expr.diagonal(BOX), "distance": -row(2)})
    return out.withColumn("pixels", F.when(F.col("distance") > 0, F.col("diagonal") * F.lit(float(proj[0, 0])) / F.col("distance") * F.lit(cam.width / 2.0)).otherwise(F.lit(1e9)))


def with_lod(batches: DataFrame, cam: Camera) -> DataFrame:
    """batches with their level of precision, the part of their points to draw, and so many of each chain's 64."""
    out = projected_size(batches, cam).withColumns({"level": expr.level_by_pixels("pixels").cast("long"), "fraction": expr.lod_fraction("pixels")})
    return out.withColumn("per_chain", F.least(F.lit(64), F.floor(F.col("fraction") * 64)).cast("long"))


def lod_points(chained: DataFrame, lod: DataFrame) -> DataFrame:
    """The first points of each chain of visible batches."""
    return chained.join(lod.select("batch_id", "per_chain"), "batch_id").filter(F.col("pos") < F.col("per_chain")).drop("per_chain")


def stereo(df: DataFrame, cam: Camera, apart: float) -> DataFrame:
    """The nearest points of both eyes' images, by view_id."""
    eyes = [projected(df, cam.shifted(s * apart / 2)).withColumn("view_id", F.lit(i)) for i, s in enumerate((-1, 1))]
    return nearest(eyes[0].unionByName(eyes[1]), "view_id", "pixel_id")


def render(df: DataFrame, cam: Camera) -> DataFrame:
    """A colour for each pixel of the image: the nearest point's, or the background."""
    image = df.sparkSession.range(cam.width * cam.height).withColumnRenamed("id", "pixel_id")
    return image.join(nearest(projected(df, cam)), "pixel_id", "left").select("pixel_id", F.coalesce("rgb", F.lit(BACKGROUND).cast("long")).alias("rgb"), "depth", "point_id")


def brush(df: DataFrame, at: tuple[float, float, float], radius: float, value: bool = True) -> DataFrame:
    """points with `selected` set, or cleared, within a sphere; others keep what they had."""
    old = F.col("selected") if "selected" in df.columns else F.lit(False)
    return df.withColumn("selected", F.when(expr.in_sphere("wx", "wy", "wz", at, radius), F.lit(value)).otherwise(old))


def transformed_boxes(batches: DataFrame, m) -> DataFrame:
    """Boxes of the eight corners of each box after a matrix, with its perspective divide."""
    corners = F.array(*(F.struct(*(F.col(BOX[i + 3 * (bits >> i & 1)]).alias(a) for i, a in enumerate("xyz"))) for bits in range(8)))
    rows = batches.select("batch_id", F.explode(corners).alias("p"))
    row = lambda i: (F.lit(float(m[i, 0])) * F.col("p.x") + F.lit(float(m[i, 1])) * F.col("p.y")) + (F.lit(float(m[i, 2])) * F.col("p.z") + F.lit(float(m[i, 3])))
    rows = rows.select("batch_id", *((row(i) / row(3)).alias(a) for i, a in enumerate("xyz")))
    return rows.groupBy("batch_id").agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"))


def depth_under_cursor(fb: DataFrame, cam: Camera, px: int, py: int, reach: int = 5) -> DataFrame:
    """The least depth in the window around the cursor, and its point."""
    rows = fb.withColumns({"px": F.pmod(F.col("pixel_id"), F.lit(cam.width)), "py": F.floor(F.col("pixel_id") / cam.width)})
    rows = rows.filter(F.col("px").between(px - reach, px + reach) & F.col("py").between(py - reach, py + reach))
    return rows.agg(F.min(F.struct("depth", "point_id")).alias("p")).select("p.depth", "p.point_id").filter("depth is not null")


def debug_colored(df: DataFrame) -> DataFrame:
    """Chained points in a colour for each batch."""
    r, g, b = expr.unpack_rgb(expr.debug_color("batch_id"))
    return df.withColumns({"r": r, "g": g, "b": b})

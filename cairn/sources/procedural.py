"""Points made by formulas: no file is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def samples(spark: SparkSession, n: int) -> DataFrame:
    """(point_id, u, v): an n x n grid of the unit square."""
    i = F.col("id")
    return spark.range(n * n).select(i.alias("point_id"), (F.pmod(i, F.lit(n)) / F.lit(float(n))).alias("u"), (F.floor(i / n) / F.lit(float(n))).alias("v"))


def height_field(spark: SparkSession, n: int) -> DataFrame:
    """A surface that waves around its middle."""
    a, b = ((F.col(c) - 0.5) * F.lit(10.0) for c in "uv")
    return samples(spark, n).select("point_id", ((F.col("u") - 0.5) * F.lit(100.0)).alias("x"), ((F.col("v") - 0.5) * F.lit(100.0)).alias("y"), F.cos(F.lit(2.0) * F.sqrt(a * a + b * b)).alias("z"))


def sphere(spark: SparkSession, n: int, radius: float = 1.0) -> DataFrame:
    """A sphere by its longitudes u and latitudes v."""
    lon, lat = F.col("u") * F.lit(2 * 3.141592653589793), (F.col("v") - 0.5) * F.lit(3.141592653589793)
    r = F.lit(radius)
    return samples(spark, n).select("point_id", (r * F.cos(lat) * F.cos(lon)).alias("x"), (r * F.cos(lat) * F.sin(lon)).alias("y"), (r * F.sin(lat)).alias("z"))


def tiles(spark: SparkSession, n: int, pixels) -> DataFrame:
    """(tile, part, u, v, size): tiles of the unit square, cut into 1, 4, 16 or 64 parts by the pixels that a tile takes (a column of u and v)."""
    cuts = F.when(pixels < 100, 1).when(pixels < 400, 2).when(pixels < 1600, 4).otherwise(8)
    rows = samples(spark, n).withColumnRenamed("point_id", "tile").withColumn("cuts", cuts)
    rows = rows.select("tile", "u", "v", "cuts", F.explode(F.sequence(F.lit(0), F.col("cuts") * F.col("cuts") - 1)).alias("part"))
    size = F.lit(1.0 / n) / F.col("cuts")
    return rows.select("tile", "part", (F.col("u") + F.pmod("part", "cuts") * size).alias("u"), (F.col("v") + F.floor(F.col("part") / F.col("cuts")) * size).alias("v"), size.alias("size"))


def diagonal(spark: SparkSession, n: int) -> DataFrame:
    """A test pattern: n points along the diagonal of the unit cube."""
    t = F.col("id") / F.lit(float(n))
    return spark.range(n).select(F.col("id").alias("point_id"), *(t.alias(a) for a in "xyz"))

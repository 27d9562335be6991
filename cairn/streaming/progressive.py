"""Queries that are answered again and again while batches of points arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..camera import Camera
from ..functions import expr
from ..operators import raster

POINTS = "point_id long, X long, Y long, Z long, r long, g long, b long"


def arriving(spark: SparkSession, folder: str, files: int = 1, schema: str = POINTS) -> DataFrame:
    """A stream of the point files of a folder; a trigger takes so many files, so a slow query isn't overrun."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def image(stream: DataFrame, cam: Camera) -> DataFrame:
    """The nearest point of each pixel so far.  The state has a row for each pixel, whatever arrives."""
    rows = stream.withColumns({f"w{a}": F.col(a.upper()) * F.lit(0.01) + F.lit(0.0) for a in "xyz"})
    return raster.nearest(raster.projected(rows, cam))


def node_counts(stream: DataFrame, low: tuple[float, float, float], size: float, levels: int) -> DataFrame:
    """Points below each octree node so far.  Codes are made once a point, not once a level, and end at the deepest level."""
    rows = expr.once(stream, **{f"_cell{a}": F.shiftright(expr.grid(a, float(v), float(size), 21), 21 - levels) for a, v in zip("XYZ", low)})
    rows = expr.once(rows, _code=expr.morton63(*(f"_cell{a}" for a in "XYZ"))).select("_code", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    return rows.groupBy(F.col("level").cast("long").alias("level"), F.expr(f"shiftright(_code, 3 * ({levels} - level))").alias("prefix")).agg(F.count("*").alias("n"))


def run(result: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None):
    """Starts the query over what is there; its answer is a table of that name, or goes to a function at every step.  stop() ends it."""
    w = result.writeStream.outputMode("complete").trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return (w.foreachBatch(each) if each else w.format("memory").queryName(name)).start()


def by_priority(files: DataFrame, cam: Camera) -> DataFrame:
    """Files (with boxes min_x .. max_z) in the order in which a view wants them."""
    eye = cam.eye()
    mid = [expr.center(f"min_{a}", f"max_{a}") for a in "xyz"]
    d = [F.pow(m - F.lit(float(e)), F.lit(2.0)) for m, e in zip(mid, eye)]
    rows = files.withColumns({"distance": F.sqrt(d[0] + d[1] + d[2]), "radius": expr.diagonal([f"min_{a}" for a in "xyz"] + [f"max_{a}" for a in "xyz"]) / 2})
    x, y, w = expr.clip(cam.transform(), *mid)
    rows = rows.withColumn("d2", F.when(w > 0, F.pow(x / w, F.lit(2.0)) + F.pow(y / w, F.lit(2.0))).otherwise(F.lit(1e3)))
    return rows.withColumn("priority", expr.priority("radius", "distance", "d2")).orderBy(F.desc("priority"))

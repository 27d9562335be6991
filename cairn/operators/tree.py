"""Octrees as prefixes of Morton codes, voxels and samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr
from ..points import tasks
from ..workspace import written

#: Codes that are counted together before they are shuffled.
PIECE = 1 << 18


def prefix_counts(df: DataFrame, levels: int, bits: int) -> DataFrame:
    """Points below each node: (level, prefix, n), from codes of `bits` levels.

    Codes are counted at the deepest level once; each level above adds up eight counts."""
    deep = df.groupBy(F.shiftright("morton", 3 * (bits - levels)).alias("cell")).agg(F.count("*").alias("n"))
    rows = deep.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "cell", "n")
    return rows.groupBy("level", F.expr(f"shiftright(cell, 3 * ({levels} - level))").alias("prefix")).agg(F.sum("n").alias("n")).withColumn("level", F.col("level").cast("long"))


def leaves(counts: DataFrame, capacity: int, levels: int) -> DataFrame:
    """Nodes that hold at most `capacity` points below a parent that holds more; at the deepest level, whatever they hold."""
    parent = counts.select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"), F.col("n").alias("above"))
    rows = counts.withColumn("parent", F.shiftright("prefix", 3)).join(parent, ["level", "parent"], "left")
    leaf = (F.col("n") <= capacity) | (F.col("level") == levels)
    return rows.filter(leaf & (F.coalesce("above", F.lit(capacity + 1)) > capacity)).select("level", "prefix", "n")


def grown(df: DataFrame, capacity: int, bits: int, rows: int | None = None) -> DataFrame:
    """The nodes of the tree that splits whatever holds more than `capacity` points, as deep as codes of `bits` levels go: the root, and
    all children of such nodes.  Only points of equal codes stay in overfull leaves.

    Equal codes are counted in pieces, then codes are dealt out in ranges and put in order.  A range grows its nodes from the top, and its
    first and last node of each level, which neighbours may share, as if they were full; these are added up, and their children dropped if
    they aren't."""

    def count(batches):
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += b.num_rows
            if n >= PIECE:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    def counted(held):
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["morton", "n"])

    def grow(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        code, n = (np.concatenate(x) for x in zip(*held))
        if not len(code):
            return
        edge, first, last = np.ones(len(code), bool), code[0], code[-1]  # codes below a node of the level before that may be shared
        for level in range(bits + 1):
            prefix = code >> 3 * (bits - level)
            start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            total, shared = np.add.reduceat(n, start), edge[start]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), level)), pa.array(prefix[start]), pa.array(total), pa.array(shared)], ["level", "prefix", "n", "shared"])
            ends = (prefix[start] == first >> 3 * (bits - level)) | (prefix[start] == last >> 3 * (bits - level))
            size = np.diff(np.append(start, len(code)))
            on = np.repeat((total > capacity) | ends, size)
            code, n, edge = code[on], n[on], np.repeat(ends, size)[on]
            if not len(code):
                return

    spark = df.sparkSession
    codes = df.select(F.col("morton").cast("long").alias("morton"))
    parts = tasks(spark, codes.count() if rows is None else rows)
    ordered = codes.mapInArrow(count, "morton long, n long").repartitionByRange(parts, "morton").sortWithinPartitions("morton")
    nodes = written(ordered.mapInArrow(grow, "level long, prefix long, n long, shared boolean"), "nodes")
    met = nodes.filter("shared").groupBy("level", "prefix").agg(F.sum("n").alias("n"))  # some for each range and level
    full = met.filter(F.col("n") > capacity).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
    below = met.filter("level > 0").withColumn("parent", F.shiftright("prefix", 3)).join(full, ["level", "parent"]).select("level", "prefix", "n")
    return nodes.filter("not shared").select("level", "prefix", "n").union(met.filter("level = 0")).union(below)


def names(nodes: DataFrame) -> DataFrame:
    """Nodes with their path: r, then the child of each level."""
    digits = F.expr("transform(sequence(1, cast(level as int)), i -> cast(shiftright(prefix, 3 * (cast(level as int) - i)) & 7 as string))")
    return nodes.withColumn("name", F.concat(F.lit("r"), F.when(F.col("level") > 0, F.array_join(digits, "")).otherwise("")))


def dump(nodes: DataFrame) -> DataFrame:
    """Lines of text, indented by level, in the order of the paths (pre-order)."""
    return names(nodes).select("name", F.concat(F.repeat(F.lit(" "), (F.col("level") * 4).cast("int")), F.col("name"), F.lit(": "), F.col("n").cast("string")).alias("line"))


def voxels(df: DataFrame, drop: int) -> DataFrame:
    """Points of each voxel: codes without their lowest `drop` levels."""
    return df.groupBy(F.shiftright("morton", 3 * drop).alias("voxel")).agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


def sample(df: DataFrame, drop: int, last: bool = False) -> DataFrame:
    """One point of each cell: the first by id, or the last."""
    pick = F.max("point_id") if last else F.min("point_id")
    return df.groupBy(F.shiftright("morton", 3 * drop).alias("cell")).agg(pick.alias("point_id"))


def node_boxes(nodes: DataFrame, low: tuple[float, float, float], size: float) -> DataFrame:
    """Boxes of nodes within a cube: from the bits of their prefix."""
    # bit 3*i + axis of the prefix is bit i of the cell along the axis
    cell = lambda axis: F.expr(f"aggregate(sequence(0, 20), 0L, (s, i) -> s | shiftleft(shiftright(prefix, 3 * i + {axis}) & 1, i))")
    edge = F.lit(size) / F.pow(F.lit(2.0), "level")
    out = expr.once(nodes, _cx=cell(0), _cy=cell(1), _cz=cell(2), _edge=edge)
    sides = {f"{m}_{a}": F.lit(low[i]) + (F.col(f"_c{a}") + F.lit(int(m == "max"))) * F.col("_edge") for i, a in enumerate("xyz") for m in ("min", "max")}
    return expr.once(out, **sides).drop("_cx", "_cy", "_cz", "_edge")


def visible_nodes(boxes: DataFrame, cam, least: float = 0.4) -> DataFrame:
    """Nodes in the frustum with their priority, those above `least`."""
    from . import raster

    eye = cam.eye()
    rows = raster.visible(boxes, cam)
    mid = [expr.center(f"min_{a}", f"max_{a}") for a in "xyz"]
    distance = F.sqrt(sum((F.pow(m - F.lit(float(e)), F.lit(2.0)) for m, e in zip(mid[1:], eye[1:])), F.pow(mid[0] - F.lit(float(eye[0])), F.lit(2.0))))
    box = [f"min_{a}" for a in "xyz"] + [f"max_{a}" for a in "xyz"]
    rows = rows.withColumns({"distance": distance, "radius": expr.diagonal(box) / 2})
    x, y, w = expr.clip(cam.transform(), *mid)
    rows = rows.withColumn("d2", F.when(w > 0, F.pow(x / w, F.lit(2.0)) + F.pow(y / w, F.lit(2.0))).otherwise(F.lit(1e3)))
    return rows.withColumn("priority", expr.priority("radius", "distance", "d2")).filter(F.col("priority") > least)


def nested_cells(df: DataFrame, level: int, bits: int) -> DataFrame:
    """Points per child of each node of a level."""
    return df.groupBy(F.shiftright("morton", 3 * (bits - level)).alias("prefix"), expr.octant("morton", bits, level).alias("child")).agg(F.count("*").alias("n"))


def last_change(df: DataFrame, drop: int) -> DataFrame:
    """Runs of equal voxels along the Morton order of each top-level cell: (cell, voxel, start, len)."""
    cell, voxel = F.shiftright("morton", 45), F.shiftright("morton", 3 * drop)
    w = Window.partitionBy("cell").orderBy("morton", "point_id")
    rows = df.withColumns({"cell": cell, "voxel": voxel})
    rows = rows.withColumn("new", F.when(F.lag("voxel").over(w) == F.col("voxel"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("cell", "run").agg(F.min("voxel").alias("voxel"), F.count("*").alias("len"))

"""Writers: LAS files, tables of a workgroup layout, images, depth maps and reports."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..camera import Camera
from ..functions import expr
from ..operators import layout
from ..points import sums_in_order, tasks
from ..sources.octree import PROXY, RECORD
from ..workspace import written

#: Levels of a chunk of an octree's hierarchy; tasks that copy pieces of a file into place.
STEP, MOST_COPIERS = 4, 64


def las_header(n: int, scale, offset, low, high, version: int = 2) -> bytes:
    """The header of a LAS 1.2 or 1.4 file with points of format 2."""
    size = 227 if version < 4 else 375
    h = bytearray(size)
    h[:4], h[24], h[25] = b"LASF", 1, version
    struct.pack_into("<HII", h, 94, size, size, 0)
    struct.pack_into("<BHI", h, 104, 2, 26, min(n, 2**32 - 1) if version < 4 else 0)
    struct.pack_into("<3d3d", h, 131, *scale, *offset)
    struct.pack_into("<6d", h, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    if version >= 4:
        struct.pack_into("<Q", h, 247, n)
    return bytes(h)


def records(xyz: np.ndarray, rgb: np.ndarray) -> bytes:
    out = np.zeros(len(xyz), np.dtype({"names": ["X", "Y", "Z", "r", "g", "b"], "formats": ["<i4"] * 3 + ["<u2"] * 3, "offsets": [0, 4, 8, 20, 22, 24], "itemsize": 26}))
    for i, a in enumerate("XYZ"):
        out[a] = xyz[:, i]
    for i, a in enumerate("rgb"):
        out[a] = rgb[:, i]
    return out.tobytes()


def write_las(points: DataFrame, folder: str, order: list[str], scale=(0.01,) * 3, offset=(0.0,) * 3, version: int = 2, rows: int | None = None) -> list[str]:
    """points as LAS files, one for each task, that are in order as a whole: sort by a Morton code, a coordinate or a hash.  The folder is
    one that all executors mount.  A task writes under a name of its attempt and moves the file into place, so that a lost task leaves none.
    With the number of rows, tasks are of a bounded number."""
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        path = os.path.join(folder, f"part-{t.partitionId():05d}.las")
        own, n, low, high = f"{path}.{t.taskAttemptId()}", 0, [np.inf] * 3, [-np.inf] * 3
        with open(own, "wb") as f:
            f.write(las_header(0, scale, offset, (0,) * 3, (0,) * 3, version))
            for b in batches:
                xyz, rgb = (np.stack([b.column(b.schema.get_field_index(a)).to_numpy(zero_copy_only=False) for a in names], 1) for names in ("XYZ", "rgb"))
                f.write(records(xyz, np.nan_to_num(rgb.astype(float)).astype(np.int64)))
                n += len(xyz)
                low, high = np.minimum(low, xyz.min(0)), np.maximum(high, xyz.max(0))
            f.seek(0)
            f.write(las_header(n, scale, offset, *(np.where(np.isfinite(e), e, 0) * scale + offset for e in (low, high)), version))
        if n:
            os.replace(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "n"])
        else:
            os.remove(own)

    parts = tasks(points.sparkSession, rows or 0)
    rows = points.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("X", "Y", "Z", "r", "g", "b")
    return sorted(r["path"] for r in rows.mapInArrow(run, "path string, n long").collect())


def crop_las(source: str, target: str, n: int) -> int:
    """The first n points of a LAS file, with a header that says how many there are."""
    from ..sources.las import HEADER_BYTES, parse_header, read_range

    h = parse_header(read_range(source, 0, HEADER_BYTES), source)
    there = min(n, h["num_points"], (os.path.getsize(source) - h["offset_to_points"]) // h["record_length"])
    head = bytearray(read_range(source, 0, h["offset_to_points"]))
    if h["version_minor"] >= 4:
        struct.pack_into("<Q", head, 247, there)
    else:
        struct.pack_into("<I", head, 107, there)
    with open(target, "wb") as f:
        f.write(head)
        at, left = h["offset_to_points"], there * h["record_length"]
        while left and (part := read_range(source, at, min(left, 4 << 20))):
            f.write(part)
            at, left = at + len(part), left - len(part)
    return there


def write_workgroups(points: DataFrame, path: str, size: int) -> None:
    """Three tables: batches with box, mean colour and offset; positions as 48-bit words within the whole box; colours.  Points are made once."""
    points = written(points.select("point_id", "X", "Y", "Z", "r", "g", "b"), "points")
    box = layout.box(points).select(*(f"min_{a}" for a in "xyz"), F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"), F.lit(1)).cast("double").alias("size"))
    rows = layout.chained(points, size).join(F.broadcast(box))  # one row
    rows.select("point_id", "batch_id", expr.pack16(*(expr.grid(a.upper(), f"min_{a}", "size", 16) for a in "xyz")).alias("word")).write.parquet(f"{path}/positions")
    rows.select("point_id", "batch_id", expr.pack_rgb("r", "g", "b").alias("rgb")).write.parquet(f"{path}/colors")
    own = layout.chained(points, size).groupBy("batch_id").agg(F.min("point_id").alias("first_point"), F.count("*").alias("num_points"), *(f(a).alias(f"{m}_{a.lower()}") for m, f in (("min", F.min), ("max", F.max)) for a in "XYZ"), *(F.floor(F.avg(c)).cast("long").alias(c) for c in "rgb"))
    layout.running_offsets(own).write.parquet(f"{path}/batches")


def put_together(spark: SparkSession, pieces: list[tuple[str, int]], target: str, size: int) -> None:
    """A file made of pieces (path, offset), which are copied into place side by side and then removed.  The target may begin with bytes of
    its own."""
    with open(target, "r+b" if os.path.exists(target) else "wb") as f:
        f.truncate(size)

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(path, "rb") as piece, open(target, "r+b") as f:
                    f.seek(at)
                    while part := piece.read(4 << 20):
                        f.write(part)
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    if pieces:
        table = pa.table({"path": [p for p, _ in pieces], "at": [at for _, at in pieces]})
        for r in spark.createDataFrame(table).repartition(min(len(pieces), MOST_COPIERS)).mapInArrow(run, "path string").collect():
            os.remove(r["path"])


def write_octree(coded: DataFrame, grown: DataFrame, capacity: int, levels: int, path: str, scale: float = 0.01, rows: int | None = None) -> None:
    """An octree on disk: leaves of grown(level, prefix, n) hold points of coded(morton, X, Y, Z, r, g, b), which are in the order of their
    codes, and so of the leaves.  Ranges of points are written side by side and put together.  The hierarchy is in chunks of STEP levels
    each; a node whose children lie in the next chunk is a proxy there.  The folder is one that all executors mount."""
    spark = coded.sparkSession
    n = coded.count() if rows is None else rows
    target = os.path.join(path, "octree.bin")
    kind = np.dtype([("xyz", "<i4", 3), ("rgb", "<u2", 3)])

    def write(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        own, total = f"{target}.{t.partitionId():05d}.{t.taskAttemptId()}", 0
        with open(own, "wb") as f:
            for b in batches:
                out = np.empty(b.num_rows, kind)
                for i, a in enumerate("XYZ"):
                    out["xyz"][:, i] = b.column(b.schema.get_field_index(a)).to_numpy()
                for i, a in enumerate("rgb"):
                    out["rgb"][:, i] = b.column(b.schema.get_field_index(a)).to_numpy()
                f.write(out.tobytes())
                total += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([t.partitionId()]), pa.array([own]), pa.array([total])], ["part", "path", "n"])

    # rows of equal codes may lie in several ranges, so that no task takes more than its share
    rows_of = coded.select("morton", "X", "Y", "Z", "r", "g", "b", F.monotonically_increasing_id().alias("_tie"))
    ordered = rows_of.repartitionByRange(tasks(spark, n), "morton", "_tie").sortWithinPartitions("morton").select("X", "Y", "Z", "r", "g", "b")
    at, pieces = 0, []
    for r in sorted(ordered.mapInArrow(write, "part long, path string, n long").collect()):
        pieces.append((r["path"], at))
        at += 18 * r["n"]
    put_together(spark, pieces, target, at)

    # nodes: first byte, bits of children, chunk; digits have bit 2 for x on disk
    full = (F.col("n") > capacity) & (F.col("level") < levels)
    swapped = lambda v: F.shiftleft(v.bitwiseAND(F.lit(0o111111111111111111111)), 2).bitwiseOR(v.bitwiseAND(F.lit(0o222222222222222222222))).bitwiseOR(F.shiftright(v.bitwiseAND(F.lit(0o444444444444444444444)), 2))
    nodes = written(grown.select("level", "prefix", "n", full.alias("full")), "grown")
    leaf = nodes.filter("not full").select("level", "prefix", "n", F.expr(f"shiftleft(prefix, cast(3 * ({levels} - level) as int))").alias("_code"))
    count = nodes.count()
    start = sums_in_order(leaf, ("_code",), "n", "before", count).select("level", "prefix", (F.col("before") * 18).alias("start"))
    parent = nodes.filter("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("prefix", 3).alias("prefix"))
    mask = parent.agg(F.expr("cast(sum(shiftleft(1, cast((prefix & 1) * 4 + (prefix & 2) + (shiftright(prefix, 2) & 1) as int))) as long)").alias("mask"))
    rows_of = nodes.join(start, ["level", "prefix"], "left").join(mask, ["level", "prefix"], "left").select("level", "prefix", swapped(F.col("prefix")).alias("place"), "full", F.when(F.col("full"), 0).otherwise(F.col("n")).alias("n"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("mask", F.lit(0)).alias("mask"))
    in_parent = F.expr(f"if(level = 0, 0L, (level - 1) div {STEP} * {STEP})")  # the level of the chunk's root
    top = lambda level: F.expr(f"shiftright(prefix, cast(3 * (level - ({level})) as int))")
    listed = written(rows_of.withColumn("root", in_parent).withColumn("chunk", top("root")).withColumn("proxy", F.expr(f"full and level > 0 and level % {STEP} = 0")), "hierarchy")
    first = listed.filter("proxy").select("level", "prefix", "place", "full", "n", "start", "mask", F.col("level").alias("root"), F.col("prefix").alias("chunk"), F.lit(False).alias("proxy"))
    listed = listed.unionByName(first)
    sizes = sums_in_order(listed.groupBy("root", "chunk").agg((F.count("*") * RECORD.size).alias("bytes")), ("root", "chunk"), "bytes", "offset", count)
    sizes = written(sizes, "chunks")
    own = listed.join(sizes, ["root", "chunk"])
    there = sizes.select(F.col("root").alias("level"), F.col("chunk").alias("prefix"), F.lit(True).alias("proxy"), F.col("bytes").alias("to_bytes"), F.col("offset").alias("to_offset"))
    own = own.join(there, ["level", "prefix", "proxy"], "left")
    head, form = os.path.join(path, "hierarchy.bin"), RECORD.format
    with open(head, "wb") as f:
        f.truncate(sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])

    def chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("level", "ascending"), ("place", "ascending")])
        c = {k: table.column(k).to_pylist() for k in table.column_names}
        out = b"".join(
            struct.pack(form, PROXY, mask, n, to, size) if proxy else struct.pack(form, 0 if full else 1, mask, n, start, 18 * n)
            for mask, n, start, full, proxy, to, size in zip(*(c[k] for k in ("mask", "n", "start", "full", "proxy", "to_offset", "to_bytes"))))
        with open(head, "r+b") as f:
            f.seek(c["offset"][0])
            f.write(out)
        return pa.table({"root": c["root"][:1], "bytes": [len(out)]})

    done = own.groupBy("root", "chunk").applyInArrow(chunk, "root long, bytes long").filter("root = 0").collect()
    box = coded.agg(*(f(a).alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in "XYZ")).first()
    low, size = [box[f"min_{a}"] * scale for a in "XYZ"], max(box[f"max_{a}"] - box[f"min_{a}"] for a in "XYZ") * scale
    meta = {"points": at // 18, "spacing": size / 128, "scale": [scale] * 3, "offset": [0.0] * 3, "boundingBox": {"min": low, "max": [v + size for v in low]}, "hierarchy": {"firstChunkSize": done[0]["bytes"]}, "attributes": [{"name": "position", "size": 12}, {"name": "rgb", "size": 6}]}
    with open(os.path.join(path, "metadata.json"), "w", encoding="utf-8") as f:
        json.dump(meta, f)


def image_of(fb: DataFrame, cam: Camera, background: int = 0x443322) -> np.ndarray:
    """The picture of a framebuffer (pixel_id, rgb): as many values as the image has pixels."""
    out = np.full(cam.width * cam.height, background, np.int64)
    pdf = fb.select("pixel_id", "rgb").toPandas()
    out[pdf["pixel_id"].to_numpy()] = pdf["rgb"].to_numpy()
    return np.stack([out >> s & 255 for s in (0, 8, 16)], -1).astype(np.uint8).reshape(cam.height, cam.width, 3)[::-1]


def png(picture: np.ndarray) -> bytes:
    """A picture as a PNG file."""
    h, w = picture.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in picture)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def depth_map(fb: DataFrame, cam: Camera) -> np.ndarray:
    """Depths by row, the top row first; 0 where nothing is."""
    out = np.zeros(cam.width * cam.height, np.float32)
    pdf = fb.select("pixel_id", "depth").toPandas()
    out[pdf["pixel_id"].to_numpy()] = pdf["depth"].to_numpy()
    return out.reshape(cam.height, cam.width)[::-1]


def exr(depth: np.ndarray) -> bytes:
    """A depth map as an OpenEXR file: one float channel Z, lines one by one, not compressed."""
    h, w = depth.shape
    attribute = lambda name, kind, data: name + b"\0" + kind + b"\0" + struct.pack("<i", len(data)) + data
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    head = struct.pack("<II", 20000630, 2) + attribute(b"channels", b"chlist", b"Z\0" + struct.pack("<iBBBBii", 2, 0, 0, 0, 0, 1, 1) + b"\0") + attribute(b"compression", b"compression", b"\0") + attribute(b"dataWindow", b"box2i", box)
    head += attribute(b"displayWindow", b"box2i", box) + attribute(b"lineOrder", b"lineOrder", b"\0") + attribute(b"pixelAspectRatio", b"float", struct.pack("<f", 1)) + attribute(b"screenWindowCenter", b"v2f", struct.pack("<2f", 0, 0)) + attribute(b"screenWindowWidth", b"float", struct.pack("<f", 1)) + b"\0"
    at = len(head) + 8 * h
    lines = [struct.pack("<ii", y, 4 * w) + depth[y].astype("<f4").tobytes() for y in range(h)]
    return head + b"".join(struct.pack("<Q", at + y * (8 + 4 * w)) for y in range(h)) + b"".join(lines)


def report(batches: DataFrame, path: str) -> None:
    """The number of batches and the summary of their diagonals, as lines of text."""
    s = layout.diagonal_summary(batches).first().asDict()
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k}: {s[k]}\n" for k in ("batches", "least", "q1", "median", "q3", "greatest"))

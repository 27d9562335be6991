"""Queries that write files and read them back, that run codecs there and back, and further functions and layouts."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..codec import bits, blocks, huffman
from ..functions import expr
from ..operators import compress, layout, raster, tree
from ..points import BATCH, BOX, dealt, points, source
from ..sinks import files
from ..sources import batchfile, las, octree, procedural
from ..workspace import workspace
from .queries import _CAP, _DEEP, BATCHES, CAM, CHAINED, CLOSE, DELTAS, POINTS, QUERIES, SQL, _cull_sql, batches, clip_sql, coded_unnumbered, differences, nearest_sql, number, projected_sql, query, world


def folder(spark, name: str) -> str:
    """A folder of its own that all executors mount, as a plain path."""
    at = workspace(spark, name)
    at = "/" + at.split(":", 1)[1].lstrip("/") if at.startswith("file:") else at
    os.makedirs(at, exist_ok=True)
    return at


# files


@query(f"with {POINTS} select row_number() over (order by ix, point_id) - 1 as point_id, ix, iy, iz, r, g, b from points")
def las_sorted(spark, sf_dir):
    """Points as LAS files in the order of a coordinate, read in ranges."""
    at = folder(spark, "las")
    files.write_las(points(spark, sf_dir), at, ["X", "point_id"], rows=source(spark, sf_dir).count())
    return las.read(spark, at, chunk=1000).select("point_id", *(F.col(a.upper()).cast("long").alias(f"i{a}") for a in "xyz"), *(F.col(c).cast("long").alias(c) for c in "rgb"))


@query(f"with {POINTS} select count(*) as n, round(sum(wx), 2) as sx, round(sum(wy), 2) as sy, round(sum(wz), 2) as sz, sum(r + g * 256 + b * 65536)::bigint as colors from world")
def las_doubles(spark, sf_dir):
    """Points of LAS 1.4 files as doubles with packed colours, by the scale and offset of the header."""
    at = folder(spark, "las14")
    files.write_las(points(spark, sf_dir), at, ["Y", "point_id"], version=4, rows=source(spark, sf_dir).count())
    h = las.parse_header(las.read_range(las.files_of(at)[0], 0, las.HEADER_BYTES))
    rows = las.read(spark, at).select(*(expr.world(a.upper(), h[f"s{a}"], h[f"o{a}"]).alias(f"w{a}") for a in "xyz"), expr.pack_rgb("r", "g", "b").alias("rgb"))
    return rows.agg(F.count("*").alias("n"), *(F.round(F.sum(f"w{a}"), 2).alias(f"s{a}") for a in "xyz"), F.sum("rgb").cast("long").alias("colors"))


@query(f"with {POINTS} select count(*) as num_points, " + ", ".join(f"round({f}(w{a}), 4) as {f}_{a}" for f in ("min", "max") for a in "xyz") + " from world")
def las_folder_box(spark, sf_dir):
    """The headers of a folder of LAS files, as one box."""
    at = folder(spark, "boxes")
    files.write_las(points(spark, sf_dir), at, ["point_id"], rows=source(spark, sf_dir).count())
    return las.total_box(las.headers(spark, at)).select("num_points", *(F.round(c, 4).alias(c) for c in BOX))


@query(SQL["quantize_10_10_10"])
def las_planes(spark, sf_dir):
    """Points of LAS files, in batches with their box, as 10-10-10 planes."""
    at = folder(spark, "planes")
    files.write_las(points(spark, sf_dir), at, ["point_id"], rows=source(spark, sf_dir).count())
    rows = las.read(spark, at).select("point_id", *(F.col(a).cast("long").alias(a) for a in "XYZ"))
    rows = rows.withColumns({f"w{a}": expr.world(a.upper(), 0.01, 0.0) for a in "xyz"})
    rows = layout.chained(rows).join(layout.batches(rows), "batch_id")
    q = [expr.quantize(f"w{a}", f"min_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"), 30) for a in "xyz"]
    rows = rows.withColumns(dict(zip(("qx", "qy", "qz"), q)))
    return rows.select("point_id", *(p.alias(n) for n, p in zip(("coarse", "medium", "fine"), expr.planes(*(F.col(f"q{a}") for a in "xyz")))))


@query(f"with {POINTS} select point_id, ix, iy, iz from points where point_id < 100")
def las_crop(spark, sf_dir):
    at = folder(spark, "whole")
    first = files.write_las(points(spark, sf_dir), at, ["point_id"], rows=source(spark, sf_dir).count())[0]
    target = folder(spark, "cropped") + "/crop.las"
    files.crop_las(first, target, 100)
    return las.read(spark, target).select("point_id", *(F.col(a.upper()).cast("long").alias(f"i{a}") for a in "xyz"))


@query(f"with {POINTS} select point_id, ix, iy, iz from points")
def batch_file(spark, sf_dir):
    """Compressed batches in one file with a directory, read back and decoded."""
    path = folder(spark, "batches") + "/batches.bin"
    batchfile.write(compress.compress(points(spark, sf_dir)), path)
    return compress.decompress(batchfile.read(spark, path)).select("point_id", *(F.col(a.upper()).alias(f"i{a}") for a in "xyz"))


_OCTREE_NAME = "'r' || array_to_string(list_transform(range(1, level + 1), lambda i: (((prefix >> (3 * (level - i))) & 1) * 4 + ((prefix >> (3 * (level - i))) & 2) + (((prefix >> (3 * (level - i))) >> 2) & 1))::varchar), '')"


@query(f"""with {_DEEP}, leaf as (select * from grown where n <= {_CAP} or level = 21), held as (select l.level, l.prefix, count(*) as n, sum(ix)::bigint as sx, sum(r)::bigint as sr from leaf l join codes c on c.morton >> (3 * (21 - l.level)) = l.prefix group by all)
select {_OCTREE_NAME} as name, level, n, sx, sr from held""")
def octree_files(spark, sf_dir):
    """An octree on disk: metadata, hierarchy and byte ranges of its nodes' points."""
    at = folder(spark, "octree")
    rows, n = coded_unnumbered(spark, sf_dir), source(spark, sf_dir).count()
    files.write_octree(rows, tree.grown(rows, _CAP, 21, n), _CAP, 21, at, rows=n)
    nodes = octree.nodes(spark, at).filter(f"node_type <> {octree.PROXY} and num_points > 0")
    held = octree.points(spark, at, nodes).groupBy("name").agg(F.count("*").alias("n"), F.sum("X").alias("sx"), F.sum("r").alias("sr"))
    return nodes.join(held, "name").filter("n = num_points").select("name", F.col("level").cast("long").alias("level"), "n", "sx", "sr")


@query(f"""with {POINTS}, c as (select *, point_id // {BATCH} as batch_id from points), w as (select batch_id, min(point_id) as first_point, count(*) as num_points, {', '.join(f'{f}(i{a}) as {f}_{a}' for f in ('min', 'max') for a in 'xyz')},
{', '.join(f'cast(floor(avg({c})) as bigint) as {c}' for c in 'rgb')} from c group by 1) select *, sum(num_points) over (order by batch_id)::bigint - num_points as "offset" from w""")
def workgroup_batches(spark, sf_dir):
    at = folder(spark, "workgroups") + "/out"
    files.write_workgroups(points(spark, sf_dir), at, BATCH)
    return spark.read.parquet(f"{at}/batches")


@query(f"""with {POINTS}, box as (select min(ix) as x0, min(iy) as y0, min(iz) as z0, cast(greatest(max(ix) - min(ix), max(iy) - min(iy), max(iz) - min(iz), 1) as double) as size from points),
s as (select points.*, {', '.join(f"cast(least(65535, greatest(0, floor(65536e0 * (i{a} - {a}0) / size))) as bigint) as s{a}" for a in 'xyz')} from points, box) select point_id, sx + sy * 65536 + sz * 4294967296 as word, r + g * 256 + b * 65536 as rgb from s""")
def workgroup_points(spark, sf_dir):
    at = folder(spark, "workgroups") + "/out"
    files.write_workgroups(points(spark, sf_dir), at, BATCH)
    n = source(spark, sf_dir).count()
    positions, colors = (dealt(spark.read.parquet(f"{at}/{t}").select("point_id", c), n, "point_id") for t, c in (("positions", "word"), ("colors", "rgb")))
    return positions.join(colors, "point_id")


@query(f"""with {POINTS}, {projected_sql(CAM)}, {nearest_sql()} select i.pixel_id, cast(coalesce(rgb, {raster.BACKGROUND}) as bigint) as rgb, depth is not null as hit
from (select unnest(range({CAM.width * CAM.height})) as pixel_id) i left join fb using (pixel_id)""")
def image_files(spark, sf_dir):
    """A PNG and a depth map as files, read back pixel by pixel; both are as large as the image."""
    at, w, h = folder(spark, "images"), CAM.width, CAM.height
    fb = raster.nearest(raster.projected(world(spark, sf_dir), CAM)).select("pixel_id", "rgb", "depth").persist()
    for name, data in (("a.png", files.png(files.image_of(fb, CAM))), ("a.exr", files.exr(files.depth_map(fb, CAM)))):
        with open(f"{at}/{name}", "wb") as f:
            f.write(data)
    fb.unpersist()
    png, exr = (las.read_range(f"{at}/{n}", 0, 1 << 30) for n in ("a.png", "a.exr"))
    lines, p = b"", 8
    while p < len(png):
        size, kind = struct.unpack(">I4s", png[p : p + 8])
        lines += png[p + 8 : p + 8 + size] if kind == b"IDAT" else b""
        p += size + 12
    rgb = np.frombuffer(zlib.decompress(lines), np.uint8).reshape(h, 1 + 3 * w)[::-1, 1:].reshape(h * w, 3).astype(np.int64) @ [1, 256, 65536]
    z = np.frombuffer(exr[-h * (8 + 4 * w) :], np.uint8).reshape(h, 8 + 4 * w)[::-1, 8:].copy().view("<f4").ravel()
    return spark.createDataFrame(pd.DataFrame({"pixel_id": np.arange(h * w), "rgb": rgb, "hit": z > 0}))


@query(SQL["batch_diagonal_summary"])
def report_file(spark, sf_dir):
    """The report's lines of text, read back."""
    path = folder(spark, "report") + "/report.txt"
    files.report(batches(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.split("value", ": ").alias("p")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p")[0], F.col("p")[1]))).alias("m"))
    return lines.select(*(F.col("m")[k].cast("long" if k == "batches" else "double").alias(k) for k in QUERIES["batch_diagonal_summary"](spark, sf_dir).columns))


# codecs


@query(f"with {POINTS}, {DELTAS} select point_id, dx as symbol, true as largest from deltas")
def codec_flagged(spark, sf_dir):
    """Differences of a batch in the scheme with a flag, with as many symbols as fit the decoder's table; and whether one more would not."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["dx"].to_numpy()
        top = huffman.largest_top(v)
        more = top == len(np.unique(v)) or not huffman.fits(v, top + 1)
        return pd.DataFrame({"point_id": pdf["point_id"], "symbol": huffman.decode_flagged(huffman.encode_flagged(v, top), len(v)), "largest": more and huffman.fits(v, top)})

    return differences(spark, sf_dir).select("batch_id", "point_id", "dx").groupBy("batch_id").applyInPandas(run, "point_id long, symbol long, largest boolean")


@query(f"with {POINTS} select point_id, 1 + ix % 32 as width, iy & ((1 << (1 + ix % 32)) - 1) as lsb, iy & ((1 << (1 + ix % 32)) - 1) as msb from points")
def codec_bitfields(spark, sf_dir):
    """Fields of 1 to 32 bits, lowest and highest bit first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = 1 + pdf["X"].to_numpy() % 32
        value = pdf["Y"].to_numpy() & ((1 << width) - 1)
        low, at = bits.pack_lsb(value.tolist(), width.tolist()), np.cumsum(width) - width
        high, place = bits.pack_msb(value.astype(np.uint64), width)
        return pd.DataFrame({"point_id": pdf["point_id"], "width": width, "lsb": [bits.read_lsb(low, a, w) for a, w in zip(at.tolist(), width.tolist())], "msb": bits.read_msb(bits.windows(high), place[:-1], width).astype(np.int64)})

    return layout.chained(points(spark, sf_dir)).select("batch_id", "point_id", "X", "Y").groupBy("batch_id").applyInPandas(run, "point_id long, width long, lsb long, msb long")


@query(f"with {POINTS} select point_id, ix % 512 as x, iy % 1024 as y, iz % 2048 as z from points")
def codec_nodes(spark, sf_dir):
    """Points of a node at fixed widths in whole blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = bits.read_node(bits.pack_node(pdf[["X", "Y", "Z"]].to_numpy() % [512, 1024, 2048], (9, 10, 11)), len(pdf), (9, 10, 11))
        return pd.DataFrame({"point_id": pdf["point_id"], **{a: xyz[:, i] for i, a in enumerate("xyz")}})

    return layout.chained(points(spark, sf_dir)).select("batch_id", "point_id", "X", "Y", "Z").groupBy("batch_id").applyInPandas(run, "point_id long, x long, y long, z long")


@query(f"with {POINTS} select point_id, true as near1, true as near7 from points")
def codec_colors(spark, sf_dir):
    """Blocks of one colour each, encoded and decoded: within 8 of 256 steps as BC1 has them, within 2 as BC7 does."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        c = pdf[["r", "g", "b"]].to_numpy()[np.arange(len(pdf)) // 16 * 16]
        one, seven = blocks.decode1(blocks.encode1(c), len(c)), blocks.decode7(blocks.encode7(np.c_[c, np.full(len(c), 255)]), len(c))
        return pd.DataFrame({"point_id": pdf["point_id"], "near1": np.abs(one - c).max(1) <= 8, "near7": np.abs(seven[:, :3] - c).max(1) <= 2})

    return layout.chained(points(spark, sf_dir)).select("batch_id", "point_id", "r", "g", "b").groupBy("batch_id").applyInPandas(run, "point_id long, near1 boolean, near7 boolean")


# layouts


@query(f"with {POINTS}, {CHAINED}, filled as (select batch_id, ix from chained union all select p.batch_id, p.ix from (select * from chained order by point_id desc limit 1) p, range({BATCH}) r where r.range >= p.point_id % {BATCH} + 1) select batch_id, count(*) as n, sum(ix)::bigint as sx from filled group by 1")
def batch_padded(spark, sf_dir):
    """Batches with the last one filled up by its last point."""
    return layout.padded(points(spark, sf_dir)).groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("X").alias("sx"))


@query(f"with {POINTS}, {CHAINED} select point_id, " + ", ".join(f"ix_{a} - coalesce(lag(ix_{a}) over w, 0) as d{a}" for a in "xyz") + f" from (select *, {', '.join(f'cast(round(w{a} * 1000) as bigint) as ix_{a}' for a in 'xyz')} from chained) window w as (partition by batch_id order by point_id)")
def delta_millimetres(spark, sf_dir):
    return layout.batch_deltas(world(spark, sf_dir)).select("point_id", "dx", "dy", "dz")


@query("select event_type as label, round(min(value), 6) as least, round(max(value), 6) as greatest, round(avg(value), 6) as mean, count(*) as n from events group by 1")
def label_times(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("label"), F.col("value").alias("took"))
    return layout.timings(rows).select("label", *(F.round(c, 6).alias(c) for c in ("least", "greatest", "mean")), "n")


# functions


@query(f"""with {POINTS}, {BATCHES} select batch_id, case when size < 1e-2 then 4 when size < 2e-2 then 3 when size < 5e-2 then 2 when size < 1e-1 then 1 else 0 end as level, round(t * t * (3 - 2 * t), 6) as smooth,
{', '.join(f"case when (batch_id % 8 >> {2 - i}) & 1 = 1 then (min_{a} + max_{a}) / 2 else min_{a} end as low_{a}, case when (batch_id % 8 >> {2 - i}) & 1 = 1 then max_{a} else (min_{a} + max_{a}) / 2 end as high_{a}" for i, a in enumerate('xyz'))}, true as inside,
sqrt(pow(batch_id % 40 - 2e1, 2) + pow(batch_id % 7 - 3e0, 2)) < 1e1 as near from (select *, (batch_id % 13) / 1e2 as size, least(1e0, greatest(0e0, (batch_id % 13 - 2e0) / 8e0)) as t from batches)""")
def node_functions(spark, sf_dir):
    """Levels by size on the screen, a smooth step, boxes of children and whether their parent holds them, and places near the cursor."""
    b = batches(spark, sf_dir).withColumn("size", F.col("batch_id") % 13 / F.lit(100.0))
    child = expr.child_box(BOX, F.col("batch_id") % 8)
    rows = b.select("batch_id", *BOX, F.col("size"), *(v.alias(f"{n}_{a}") for v, (n, a) in zip(child, [(n, a) for n in ("low", "high") for a in "xyz"])))
    inside = [(F.col(f"low_{a}") >= F.col(f"min_{a}")) & (F.col(f"high_{a}") <= F.col(f"max_{a}")) for a in "xyz"]
    return rows.select(
        "batch_id", expr.level_by_ndc("size").cast("long").alias("level"), F.round(expr.smoothstep(2, 10, F.col("batch_id") % 13), 6).alias("smooth"), *(f"{n}_{a}" for n in ("low", "high") for a in "xyz"),
        (inside[0] & inside[1] & inside[2]).alias("inside"), expr.near_cursor(F.col("batch_id") % 40, F.col("batch_id") % 7, (20.0, 3.0), 10.0).alias("near"))


@query("select event_id, cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint) as k from events")
def json_field(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"with {POINTS} select point_id, true as uniform, true as whole, true as noisy, true as again from points")
def random_values(spark, sf_dir):
    """Random numbers of three kinds: within their range, and the same again where they are made from a seed and the row."""
    rows = points(spark, sf_dir).select("point_id", F.rand(3).alias("u"), F.floor(F.rand(4) * 10).alias("i"), expr.noise("point_id", 5).alias("v"), expr.noise("point_id", 5).alias("w"))
    return rows.select("point_id", F.expr("u >= 0 and u < 1").alias("uniform"), F.expr("i between 0 and 9").alias("whole"), F.expr("v >= 0 and v < 1").alias("noisy"), F.expr("v = w").alias("again"))


@query("select i as point_id, i / 1e3 as x, i / 1e3 as y, i / 1e3 as z from (select unnest(range(1000)) as i)")
def procedural_diagonal(spark, sf_dir):
    return procedural.diagonal(spark, 1000)


# the octree's view

_X, _Y, _W = clip_sql(CLOSE.transform(), "mx", "my", "mz")
_EYE = [float(v) for v in CLOSE.eye()]
SQL["octree_view"] = f"""with {_DEEP}, edges as (select grown.*, size * 1e-2 / pow(2, level) as edge, x0 * 1e-2 as ox, y0 * 1e-2 as oy, z0 * 1e-2 as oz,
{', '.join("(" + " + ".join(f"(((prefix >> {3 * i + k}) & 1) << {i})" for i in range(21)) + f") as c{a}" for k, a in enumerate('xyz'))} from grown, box),
boxes as (select level, prefix, n, {', '.join(f'o{a} + c{a} * edge as min_{a}, o{a} + (c{a} + 1) * edge as max_{a}' for a in 'xyz')} from edges),
mids as (select *, {', '.join(f'(min_{a} + max_{a}) / 2 as m{a}' for a in 'xyz')} from boxes where {_cull_sql(CLOSE)}),
seen as (select *, sqrt((pow(mx - {number(_EYE[0])}, 2) + pow(my - {number(_EYE[1])}, 2)) + pow(mz - {number(_EYE[2])}, 2)) as distance, sqrt((pow(max_x - min_x, 2) + pow(max_y - min_y, 2)) + pow(max_z - min_z, 2)) / 2 as radius,
{_X} as cx, {_Y} as cy, {_W} as cw from mids),
rated as (select *, case when distance < radius then 1 else least(1e0, greatest(0e0, 1e1 * radius / distance)) * least(1e0, exp(-(case when cw > 0 then pow(cx / cw, 2) + pow(cy / cw, 2) else 1e3 end))) end as priority from seen)
select level, prefix, n, round(priority, 5) as priority from rated where priority > 1e-1"""

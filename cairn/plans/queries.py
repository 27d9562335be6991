"""The engine's queries: name -> (function of a session and a folder of tables, equivalent SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..camera import PRESETS
from ..functions import expr
from ..operators import compress, layout, nearest, raster, tree
from ..points import BATCH, BOX, CHAIN, points, raw, source, tasks, world_points
from ..sources import procedural
from ..streaming import progressive
from ..workspace import workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CAM = PRESETS["overview"]
CLOSE = PRESETS["close"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# pieces of SQL

POINTS = """points as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as point_id,
  cast(round(l_extendedprice * 100) as bigint) as ix, cast(l_quantity as bigint) * 2000 as iy, cast(l_partkey as bigint) * 50 as iz,
  l_partkey % 256 as r, l_suppkey % 256 as g, l_orderkey % 256 as b from lineitem),
world as (select *, ix * 1e-2 as wx, iy * 1e-2 as wy, iz * 1e-2 as wz from points)"""

CHAINED = f"""chained as (select *, point_id // {BATCH} as batch_id, point_id % {BATCH} // {CHAIN} as chain_id, point_id % {CHAIN} as pos from world)"""
DELTAS = f"""{CHAINED}, deltas as (select *, coalesce(ix - lag(ix) over w, 0) as dx, coalesce(iy - lag(iy) over w, 0) as dy, coalesce(iz - lag(iz) over w, 0) as dz
  from chained window w as (partition by batch_id, chain_id order by pos)),
symbols as (select batch_id, point_id, dx as symbol from deltas union all select batch_id, point_id, dy from deltas union all select batch_id, point_id, dz from deltas),
hist as (select batch_id, symbol, count(*) as n from symbols group by all),
ranked as (select *, row_number() over (partition by batch_id order by n desc, symbol) as rank from hist)"""
BATCHES = f"""{CHAINED}, batches as (select batch_id, min(point_id) as first_point, count(*) as num_points, min(wx) as min_x, min(wy) as min_y, min(wz) as min_z,
  max(wx) as max_x, max(wy) as max_y, max(wz) as max_z from chained group by batch_id)"""


def number(v: float) -> str:
    return f"cast('{float(v)!r}' as double)"


def clip_sql(m, x: str = "wx", y: str = "wy", z: str = "wz") -> list[str]:
    return [f"(({number(m[i, 0])} * {x} + {number(m[i, 1])} * {y}) + ({number(m[i, 2])} * {z} + {number(m[i, 3])}))" for i in (0, 1, 3)]


def projected_sql(cam, name: str = "projected", source: str = "world") -> str:
    x, y, w = clip_sql(cam.transform())
    return f"""{name} as (select *, px + py * {cam.width} as pixel_id from (select *, cast(floor((nx * 5e-1 + 5e-1) * {cam.width}e0) as bigint) as px, cast(floor((ny * 5e-1 + 5e-1) * {cam.height}e0) as bigint) as py
  from (select *, cx / depth as nx, cy / depth as ny from (select *, {x} as cx, {y} as cy, {w} as depth from {source}) where depth > 0)
  where nx >= -1 and nx <= 1 and ny >= -1 and ny <= 1) where px < {cam.width} and py < {cam.height})"""


def nearest_sql(name: str = "fb", source: str = "projected", by: str = "pixel_id") -> str:
    return f"""{name} as (select {by}, depth, point_id, r + g * 256 + b * 65536 as rgb from (select *, row_number() over (partition by {by} order by depth, point_id) as k from {source}) where k = 1)"""


def blend_sql() -> str:
    return """low as (select pixel_id, min(depth) as min_depth from projected group by 1),
sums as (select pixel_id, min_depth, cast(sum(r) as bigint) as sum_r, cast(sum(g) as bigint) as sum_g, cast(sum(b) as bigint) as sum_b, count(*) as n
  from projected join low using (pixel_id) where depth <= min_depth * 101e-2 group by all)"""


def window_sql(source: str, reach: int, cam=CAM) -> str:
    return f"""near as (select s.*, px - ox + (py - oy) * {cam.width} as target, ox, oy from (select *, pixel_id % {cam.width} as px, pixel_id // {cam.width} as py from {source}) s,
  (select unnest(range(-{reach}, {reach + 1})) as ox) a, (select unnest(range(-{reach}, {reach + 1})) as oy) o
  where px - ox between 0 and {cam.width - 1} and py - oy between 0 and {cam.height - 1})"""


def spread_sql(v: str, n: int = 21) -> str:
    return "(" + " + ".join(f"((({v}) >> {i}) & 1) * {1 << 3 * i}" for i in range(n)) + ")"


CUBE = """box as (select min(ix) as x0, min(iy) as y0, min(iz) as z0, cast(greatest(max(ix) - min(ix), max(iy) - min(iy), max(iz) - min(iz), 1) as double) as size from points)"""


def cell_sql(axis: str, bits: int = 21) -> str:
    return f"cast(least({(1 << bits) - 1}, greatest(0, floor({1 << bits}e0 * (i{axis} - {axis}0) / size))) as bigint)"


MORTON = f"""{CUBE}, cells as (select *, {cell_sql('x')} as gx, {cell_sql('y')} as gy, {cell_sql('z')} as gz from world, box),
codes as (select *, {spread_sql('gx')} + {spread_sql('gy')} * 2 + {spread_sql('gz')} * 4 as morton from cells)"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world_points(points(spark, sf_dir))


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points without ids, for queries that need none."""
    return world_points(raw(spark, sf_dir).select("X", "Y", "Z", "r", "g", "b"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.batches(world(spark, sf_dir))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.morton_sorted(world(spark, sf_dir), whole=raw(spark, sf_dir))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.deltas(points(spark, sf_dir), rows=source(spark, sf_dir).count())


def coded_unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.morton_sorted(raw(spark, sf_dir).select("X", "Y", "Z", "r", "g", "b"))


# scans and scalar functions


@query(f"with {POINTS} select point_id, round(wx, 4) as x, round(wy, 4) as y, round(wz, 4) as z from world")
def world_coords(spark, sf_dir):
    return world(spark, sf_dir).select("point_id", *(F.round(f"w{a}", 4).alias(a) for a in "xyz"))


@query("""select l_orderkey * 7 % 65536 as v, case when v > 255 then v >> 8 else v end as v8, r + g * 256 + b * 65536 as rgb, count(*) as n
from (select l_orderkey, l_partkey % 256 as r, l_suppkey % 256 as g, l_orderkey % 256 as b from lineitem) group by all""")
def color_pack(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 7 % 65536).alias("v"), *((F.col(c) % 256).alias(a) for a, c in zip("rgb", ("l_partkey", "l_suppkey", "l_orderkey"))))
    rows = rows.withColumns({"v8": expr.color8("v"), "rgb": expr.pack_rgb("r", "g", "b")})
    return rows.groupBy("v", "v8", "rgb").agg(F.count("*").alias("n"))


@query(f"with {POINTS} select r + g * 256 + b * 65536 as rgb, r, g, b, count(*) as n from points group by all")
def color_unpack(spark, sf_dir):
    rgb = raw(spark, sf_dir).groupBy(expr.pack_rgb("r", "g", "b").alias("rgb")).agg(F.count("*").alias("n"))
    return rgb.select("rgb", *(v.alias(a) for a, v in zip("rgb", expr.unpack_rgb("rgb"))), "n")


@query(f"with {POINTS}, {MORTON} select point_id, morton from codes")
def morton63(spark, sf_dir):
    return coded(spark, sf_dir).select("point_id", "morton")


def _split_sql(v: str, low: int, n: int) -> str:
    return spread_sql(f"(({v} + 2147483648) >> {low}) & {(1 << n) - 1}", n)


@query(f"""with {POINTS}, signed as (select point_id, ix - 5000000 as a, iy - 50000 as b, iz - 50000 as c from points)
select point_id, {', '.join(f"{_split_sql('a', low, n)} + {_split_sql('b', low, n)} * 2 + {_split_sql('c', low, n)} * 4 as {name}" for name, low, n in (('hi', 22, 10), ('mid', 11, 11), ('lo', 0, 11)))} from signed""")
def morton96(spark, sf_dir):
    p = points(spark, sf_dir).select("point_id", (F.col("X") - 5_000_000).alias("a"), (F.col("Y") - 50_000).alias("b"), (F.col("Z") - 50_000).alias("c"))
    return p.select("point_id", *(v.alias(n) for n, v in zip(("hi", "mid", "lo"), expr.morton96("a", "b", "c"))))


_Q30 = ", ".join(f"case when max_{a} > min_{a} then cast(least(1073741823, greatest(0, floor(1073741824e0 * (w{a} - min_{a}) / (max_{a} - min_{a})))) as bigint) else 0 end as q{a}" for a in "xyz")


def _quantized(spark, sf_dir):
    w = world(spark, sf_dir)
    rows = layout.chained(w).join(layout.batches(w), "batch_id")
    return rows.withColumns({f"q{a}": expr.quantize(f"w{a}", f"min_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"), 30) for a in "xyz"})


_QUANTIZED = f"{POINTS}, {BATCHES}, quantized as (select *, {_Q30} from chained join batches using (batch_id))"
_PLANES = ", ".join(f"((qx >> {s}) & 1023) + ((qy >> {s}) & 1023) * 1024 + ((qz >> {s}) & 1023) * 1048576 as {n}" for n, s in (("coarse", 20), ("medium", 10), ("fine", 0)))


@query(f"with {_QUANTIZED} select point_id, {_PLANES} from quantized")
def quantize_10_10_10(spark, sf_dir):
    return _quantized(spark, sf_dir).select("point_id", *(p.alias(n) for n, p in zip(("coarse", "medium", "fine"), expr.planes(*(F.col(f"q{a}") for a in "xyz")))))


_BACK = ", ".join(f"cast(floor(((q{a} >> {30 - 10 * k}) * ((max_{a} - min_{a}) / {1 << 10 * k}e0) + min_{a}) * 1000) as bigint) as {a}{10 * k}" for a in "xyz" for k in (1, 2, 3))


@query(f"with {_QUANTIZED} select point_id, {_BACK} from quantized")
def dequantize_levels(spark, sf_dir):
    rows = _quantized(spark, sf_dir)
    rows = rows.withColumns(dict(zip(("coarse", "medium", "fine"), expr.planes(*(F.col(f"q{a}") for a in "xyz")))))
    out = [F.floor(expr.from_planes([F.col(n) for n in ("coarse", "medium", "fine")[:k]], i, f"min_{a}", F.col(f"max_{a}") - F.col(f"min_{a}")) * 1000).cast("long").alias(f"{a}{10 * k}") for i, a in enumerate("xyz") for k in (1, 2, 3)]
    return rows.select("point_id", *out)


@query(f"""with {POINTS}, {CUBE}, q as (select point_id, {', '.join(f"{cell_sql(a, 16)} as s{a}, {cell_sql(a, 20)} as t{a}" for a in 'xyz')} from points, box)
select point_id, sx + sy * 65536 + sz * 4294967296 as word48, tx + (ty & 4095) * 1048576 as word_a, tz + (ty >> 12) * 1048576 as word_b from q""")
def packed_words(spark, sf_dir):
    p = points(spark, sf_dir)
    box = layout.box(p).select(*(f"min_{a}" for a in "xyz"), F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"), F.lit(1)).cast("double").alias("size"))
    rows = p.join(F.broadcast(box))
    s, t = ([expr.grid(a.upper(), f"min_{a}", "size", n) for a in "xyz"] for n in (16, 20))
    a, b = expr.split20(*t)
    return rows.select("point_id", expr.pack16(*s).alias("word48"), a.alias("word_a"), b.alias("word_b"))


@query(f"""with {POINTS}, {BATCHES}, bits as (select *, {', '.join(f"case when max_{a} - min_{a} > 1e-3 then cast(ceil(log2((max_{a} - min_{a}) / 1e-3)) as bigint) else 1 end as bits_{a}" for a in 'xyz')} from batches)
select point_id, {', '.join(f"bits_{a}, case when max_{a} > min_{a} then cast(least(pow(2e0, bits_{a}) - 1, floor(pow(2e0, bits_{a}) * (w{a} - min_{a}) / (max_{a} - min_{a}))) as bigint) else 0 end as v{a}" for a in 'xyz')}
from chained join bits using (batch_id)""")
def node_bits(spark, sf_dir):
    w = world(spark, sf_dir)
    b = layout.batches(w).withColumns({f"bits_{a}": expr.bits_for(F.col(f"max_{a}") - F.col(f"min_{a}")) for a in "xyz"})
    rows = layout.chained(w).join(b, "batch_id")
    return rows.select("point_id", *(f"bits_{a}" for a in "xyz"), *(expr.quantize_bits(f"w{a}", f"min_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"), F.col(f"bits_{a}")).alias(f"v{a}") for a in "xyz"))


@query("""select event_id, case when length(s) < 8 then lpad(s, 8, '0') else s end as padded, case when length(event_type) < 12 then rpad(event_type, 12, '.') else event_type end as filled,
replace(event_type, 'e', 'E') as replaced, ends_with(lower(event_type), 'k') as suffix, repeat('ab', 2) as twice from (select *, cast(event_id as varchar) as s from events)""")
def text_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", expr.left_pad("event_id", 8, "0").alias("padded"), expr.right_pad("event_type", 12, ".").alias("filled"), F.replace(F.col("event_type"), F.lit("e"), F.lit("E")).alias("replaced"),
                    expr.ends_with("event_type", "K", True).alias("suffix"), F.repeat(F.lit("ab"), 2).alias("twice"))


# batches and culling


@query(f"with {POINTS}, {BATCHES} select batch_id, first_point, num_points, {', '.join(f'round({c}, 4) as {c}' for c in BOX)} from batches")
def batch_bbox(spark, sf_dir):
    return batches(spark, sf_dir).select("batch_id", "first_point", "num_points", *(F.round(c, 4).alias(c) for c in BOX))


@query(f"with {POINTS} select min(ix) as min_x, max(ix) as max_x, min(iy) as min_y, max(iy) as max_y, min(iz) as min_z, max(iz) as max_z from points")
def whole_bbox(spark, sf_dir):
    return layout.box(raw(spark, sf_dir))


def _cull_sql(cam) -> str:
    corner = lambda p: [f"{'max' if p[i] > 0 else 'min'}_{a}" for i, a in enumerate("xyz")]
    return " and ".join(f"(({number(p[0])} * {corner(p)[0]} + {number(p[1])} * {corner(p)[1]}) + {number(p[2])} * {corner(p)[2]}) + {number(p[3])} >= 0" for p in cam.planes())


@query(f"with {POINTS}, {BATCHES} select batch_id, num_points from batches where {_cull_sql(CLOSE)}")
def batch_cull(spark, sf_dir):
    return raster.visible(batches(spark, sf_dir), CLOSE).select("batch_id", "num_points")


def _loose_sql(cam) -> str:
    out = []
    for side in ("min", "max"):
        x, y, w = clip_sql(cam.transform(), *(f"{side}_{a}" for a in "xyz"))
        out.append(f"({w} > 0 and {x} / {w} >= -14e-1 and {x} / {w} <= 12e-1 and {y} / {w} >= -12e-1 and {y} / {w} <= 12e-1)")
    return " or ".join(out)


@query(f"with {POINTS}, {BATCHES} select batch_id from batches where {_loose_sql(CLOSE)}")
def batch_cull_loose(spark, sf_dir):
    return raster.loosely_visible(batches(spark, sf_dir), CLOSE).select("batch_id")


def _lod_sql(cam) -> str:
    v, p = cam.view(), cam.projection()
    mid = [f"((min_{a} + max_{a}) / 2e0)" for a in "xyz"]
    z = f"(({number(v[2, 0])} * {mid[0]} + {number(v[2, 1])} * {mid[1]}) + ({number(v[2, 2])} * {mid[2]} + {number(v[2, 3])}))"
    return f"""lod as (select *, cast(case when pixels < 100 then 4 when pixels < 200 then 3 when pixels < 500 then 2 when pixels < 10000 then 1 else 0 end as bigint) as level, cast(least(64, floor(fraction * 64)) as bigint) as per_chain
  from (select *, least(1e0, greatest(1e-1, 18e-1 * pixels / 1e2 - 3e-1)) as fraction from (select *, case when distance > 0 then diagonal * {number(p[0, 0])} / distance * {cam.width / 2}e0 else 1e9 end as pixels
  from (select *, sqrt((pow(max_x - min_x, 2) + pow(max_y - min_y, 2)) + pow(max_z - min_z, 2)) as diagonal, -{z} as distance from batches))))"""


@query(f"with {POINTS}, {BATCHES}, {_lod_sql(CAM)} select batch_id, level, per_chain, round(fraction, 5) as fraction, round(pixels, 3) as pixels from lod")
def batch_lod_fraction(spark, sf_dir):
    return raster.with_lod(batches(spark, sf_dir), CAM).select("batch_id", "level", "per_chain", F.round("fraction", 5).alias("fraction"), F.round("pixels", 3).alias("pixels"))


@query(f"""with {POINTS}, {BATCHES}, d as (select round(sqrt((pow(max_x - min_x, 2) + pow(max_y - min_y, 2)) + pow(max_z - min_z, 2)), 6) as d from batches), s as (select list(d order by d) as l, count(*) as n from d)
select l[1] as least, l[1 + n // 4] as q1, l[1 + n // 2] as median, l[1 + n * 3 // 4] as q3, l[n] as greatest, n as batches from s""")
def batch_diagonal_summary(spark, sf_dir):
    return layout.diagonal_summary(batches(spark, sf_dir))


@query(f"with {POINTS}, {BATCHES} select batch_id, num_points, cast(sum(num_points) over (order by batch_id) - num_points as bigint) as \"offset\" from batches")
def running_offsets(spark, sf_dir):
    return layout.running_offsets(batches(spark, sf_dir)).select("batch_id", "num_points", "offset")


@query(f"""with recursive {POINTS}, {BATCHES}, fold(batch_id, num_points, bin, total) as (select batch_id, num_points, 0, num_points from batches where batch_id = 0
  union all select b.batch_id, b.num_points, case when f.total > 20000 then f.bin + 1 else f.bin end, case when f.total > 20000 then b.num_points else f.total + b.num_points end from fold f join batches b on b.batch_id = f.batch_id + 1)
select batch_id, num_points, cast(bin as bigint) as bin from fold""")
def greedy_bins(spark, sf_dir):
    return layout.greedy_bins(batches(spark, sf_dir), 20_000)


@query(f"""with {POINTS}, {BATCHES} select batch_id, cast(sum(r) as bigint) // count(*) as r, cast(sum(g) as bigint) // count(*) as g, cast(sum(b) as bigint) // count(*) as b from chained group by batch_id""")
def batch_mean_color(spark, sf_dir):
    rows = layout.chained(points(spark, sf_dir))
    return rows.groupBy("batch_id").agg(*(F.floor(F.sum(c) / F.count("*")).cast("long").alias(c) for c in "rgb"))


# differences


@query(f"with {POINTS}, {DELTAS} select point_id, dx, dy, dz from deltas")
def chain_delta(spark, sf_dir):
    return differences(spark, sf_dir).select("point_id", "dx", "dy", "dz")


@query(f"with {POINTS} select point_id, ix as ux, iy as uy, iz as uz from points")
def chain_undelta(spark, sf_dir):
    return layout.undelta(differences(spark, sf_dir)).select("point_id", "ux", "uy", "uz")


@query(f"with {POINTS}, {CHAINED} select batch_id, part, min(point_id) as start, count(*) as len from (select *, ntile(7) over (partition by batch_id order by point_id) - 1 as part from chained) group by all")
def chain_ntile(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = layout.chained(points(spark, sf_dir)).withColumn("part", (F.ntile(7).over(Window.partitionBy("batch_id").orderBy("point_id")) - 1).cast("long"))
    return rows.groupBy("batch_id", "part").agg(F.min("point_id").alias("start"), F.count("*").alias("len"))


@query(f"with {POINTS}, {DELTAS} select batch_id, symbol, n from hist")
def delta_histogram(spark, sf_dir):
    return layout.histogram(differences(spark, sf_dir))


@query(f"with {POINTS}, {DELTAS} select batch_id, symbol, n, rank from ranked where rank <= 20")
def delta_top_symbols(spark, sf_dir):
    return layout.top_symbols(differences(spark, sf_dir), 20)


@query(f"with {POINTS}, {DELTAS} select batch_id, round(sum(case when rank <= 100 then n else 0 end) / sum(n), 6) as coverage from ranked group by batch_id")
def delta_topk_coverage(spark, sf_dir):
    return layout.coverage(differences(spark, sf_dir), 100).select("batch_id", F.round("coverage", 6).alias("coverage"))


_GOOD = f"{POINTS}, {DELTAS}, good as (select batch_id, point_id, count(t.symbol) = 3 as good from symbols s left join (select batch_id, symbol from ranked where rank <= 500) t using (batch_id, symbol) group by all)"


@query(f"with {_GOOD} select batch_id, count(*) as n, count(*) filter (good) as good from good group by batch_id")
def delta_good_points(spark, sf_dir):
    rows = layout.good_points(differences(spark, sf_dir), 500)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"))


@query(f"""with {_GOOD}, islands as (select *, sum(case when good then 0 else 1 end) over (partition by batch_id order by point_id) as island from good)
select batch_id, min(point_id) as start, count(*) as len from islands where good group by batch_id, island""")
def delta_runs(spark, sf_dir):
    return layout.good_runs(differences(spark, sf_dir), 500)


_COST = lambda d: f"case when {d} = 0 then 1 else cast(ceil(log2(abs({d}))) as bigint) + 1 end"
_WIDTH = lambda a: f"case when max(i{a}) - min(i{a}) > 1 then cast(ceil(log2(max(i{a}) - min(i{a}))) as bigint) else 1 end"


@query(f"""with {POINTS}, {DELTAS}, cost as (select *, {_COST('dx')} + {_COST('dy')} + {_COST('dz')} as bits from deltas)
select batch_id, cast(sum(bits) as bigint) as delta_bits, count(*) * ({_WIDTH('x')} + {_WIDTH('y')} + {_WIDTH('z')}) as fixed_bits, count(*) filter (bits > 30) as jumps from cost group by batch_id""")
def delta_bit_cost(spark, sf_dir):
    return layout.bit_costs(differences(spark, sf_dir))


# orders


@query(f"with {POINTS}, {MORTON}, placed as (select point_id, row_number() over (order by morton, point_id) - 1 as place from codes) select point_id, place, place // {BATCH} as batch_id from placed")
def morton_order(spark, sf_dir):
    return layout.ordered(coded(spark, sf_dir).select("point_id", "morton"), "morton").select("point_id", "place", "batch_id")


@query(f"with {POINTS} select point_id, row_number() over (order by ix, point_id) - 1 as place from points")
def x_order(spark, sf_dir):
    return layout.ordered(points(spark, sf_dir).select("point_id", "X"), "X").select("point_id", "place")


@query()
def block_shuffle(spark, sf_dir):
    return layout.block_shuffled(points(spark, sf_dir)).select("point_id", "block", "block_key")


@query(f"with {POINTS} select * from points where point_id < 1000")
def first_points(spark, sf_dir):
    return points(spark, sf_dir).filter("point_id < 1000").select("point_id", F.col("X").alias("ix"), F.col("Y").alias("iy"), F.col("Z").alias("iz"), "r", "g", "b")


# images


@query(f"with {POINTS}, {projected_sql(CAM)}, {nearest_sql()} select pixel_id, round(depth, 4) as depth, point_id, rgb from fb")
def raster_min(spark, sf_dir):
    return raster.nearest(raster.projected(world(spark, sf_dir), CAM)).withColumn("depth", F.round("depth", 4))


@query(f"with {POINTS}, {projected_sql(CAM)} select pixel_id, round(min(depth), 4) as min_depth from projected group by 1")
def raster_depth(spark, sf_dir):
    return raster.depths(raster.projected(unnumbered(spark, sf_dir), CAM)).withColumn("min_depth", F.round("min_depth", 4))


@query(f"with {POINTS}, {projected_sql(CAM)}, {blend_sql()} select pixel_id, round(min_depth, 4) as min_depth, sum_r, sum_g, sum_b, n, sum_r // n + sum_g // n * 256 + sum_b // n * 65536 as rgb from sums")
def raster_hqs(spark, sf_dir):
    return raster.blended(raster.projected(unnumbered(spark, sf_dir), CAM)).withColumn("min_depth", F.round("min_depth", 4))


@query(f"with {POINTS}, {projected_sql(CAM)} select pixel_id, count(*) as n, cast(case when n < 10 then 0 when n < 250 then 1 when n < 1000 then 2 when n < 4000 then 3 else 4 end as bigint) as class from projected group by 1")
def raster_overdraw(spark, sf_dir):
    return raster.overdraw(raster.projected(unnumbered(spark, sf_dir), CAM))


@query(f"with {POINTS}, {projected_sql(CAM)}, {nearest_sql()}, {window_sql('fb', 3)} select target as pixel_id, round(min(depth), 4) as window_depth from near group by 1")
def raster_window_depth(spark, sf_dir):
    fb = raster.nearest(raster.projected(world(spark, sf_dir), CAM))
    return raster.window_depth(fb, CAM, 3).withColumn("window_depth", F.round("window_depth", 4))


@query(f"""with {POINTS}, {projected_sql(CAM)}, {nearest_sql()}, {window_sql('fb', 2)} select target as pixel_id, round(depth, 4) as depth, point_id, rgb
from (select *, row_number() over (partition by target order by depth, point_id) as k from near) where k = 1""")
def raster_fill_nearest(spark, sf_dir):
    fb = raster.nearest(raster.projected(world(spark, sf_dir), CAM))
    return raster.window_nearest(fb, CAM, 2).withColumn("depth", F.round("depth", 4))


_MEAN = lambda c: f"cast(sum(weight * sum_{c}) as bigint) // cast(sum(weight * n) as bigint)"


@query(f"""with {POINTS}, {projected_sql(CAM)}, {blend_sql()}, {window_sql('sums', 2)}, least_depth as (select target, min(min_depth) as low from near group by 1),
weighted as (select near.*, case when ox = 0 and oy = 0 then 10 when ox <= 1 and oy <= 1 then 2 else 1 end as weight from near join least_depth using (target) where min_depth <= low * 101e-2)
select target as pixel_id, {_MEAN('r')} + {_MEAN('g')} * 256 + {_MEAN('b')} * 65536 as rgb, count(*) as pixels from weighted group by 1""")
def raster_resolve_window(spark, sf_dir):
    return raster.window_blend(raster.blended(raster.projected(unnumbered(spark, sf_dir), CAM)), CAM, 2)


@query(f"""with {POINTS}, {projected_sql(CAM)}, {nearest_sql()}, around as (select f.pixel_id, f.depth, g.depth as other from fb f left join fb g on abs(g.pixel_id % {CAM.width} - f.pixel_id % {CAM.width}) <= 1
  and abs(g.pixel_id // {CAM.width} - f.pixel_id // {CAM.width}) <= 1 and g.pixel_id <> f.pixel_id)
select pixel_id, round(coalesce(exp(-(sum(greatest(0e0, log2(depth) - log2(other))) / 8) * 3e2 * 5e-4), 1e0), 5) as shade from around group by 1""")
def raster_edl(spark, sf_dir):
    return raster.edl_shade(raster.nearest(raster.projected(world(spark, sf_dir), CAM)), CAM).withColumn("shade", F.round("shade", 5))


@query(f"""with {POINTS}, {projected_sql(CAM)}, {nearest_sql()} select i.pixel_id, cast(coalesce(rgb, {raster.BACKGROUND}) as bigint) as rgb, round(depth, 4) as depth, point_id
from (select unnest(range({CAM.width * CAM.height})) as pixel_id) i left join fb using (pixel_id)""")
def raster_image(spark, sf_dir):
    return raster.render(world(spark, sf_dir), CAM).withColumn("depth", F.round("depth", 4))


_EYES = [CAM.shifted(-200.0), CAM.shifted(200.0)]


@query(f"""with {POINTS}, {projected_sql(_EYES[0], 'left_eye')}, {projected_sql(_EYES[1], 'right_eye')}, eyes as (select 0 as view_id, * from left_eye union all select 1, * from right_eye),
{nearest_sql('fb', 'eyes', 'view_id, pixel_id')} select view_id, pixel_id, round(depth, 3) as depth, point_id, rgb from fb""")
def raster_stereo(spark, sf_dir):
    return raster.stereo(world(spark, sf_dir), CAM, 400.0).withColumn("depth", F.round("depth", 3))


@query(f"""with {POINTS}, {BATCHES}, {_lod_sql(CLOSE)}, shown as (select chained.* from chained join lod using (batch_id) where pos < per_chain and {_cull_sql(CLOSE)}), {projected_sql(CLOSE, source='shown')}, {nearest_sql()}
select pixel_id, round(depth, 4) as depth, point_id, rgb from fb""")
def raster_culled_lod(spark, sf_dir):
    w = world(spark, sf_dir)
    lod = raster.with_lod(raster.visible(layout.batches(w), CLOSE), CLOSE)
    shown = raster.lod_points(layout.chained(w), lod)
    return raster.nearest(raster.projected(shown, CLOSE)).withColumn("depth", F.round("depth", 4))


_AT, _WITHIN = (30_000.0, 500.0, 4_000.0), 2_500.0


@query(f"""with {POINTS} select point_id, sqrt((pow(wx - {number(_AT[0])}, 2) + pow(wy - {number(_AT[1])}, 2)) + pow(wz - {number(_AT[2])}, 2)) < {number(_WITHIN)} as selected from world""")
def select_sphere(spark, sf_dir):
    return raster.brush(world(spark, sf_dir), _AT, _WITHIN).select("point_id", "selected")


_EYE, _WAY = tuple(map(float, CLOSE.eye())), (0.6, 0.05, 0.2)


def _ray_sql() -> str:
    lo = ", ".join(f"least((min_{a} - {number(o)}) / {number(d)}, (max_{a} - {number(o)}) / {number(d)})" for a, o, d in zip("xyz", _EYE, _WAY))
    hi = ", ".join(f"greatest((min_{a} - {number(o)}) / {number(d)}, (max_{a} - {number(o)}) / {number(d)})" for a, o, d in zip("xyz", _EYE, _WAY))
    return f"greatest(0e0, {lo}) <= least({hi})"


@query(f"with {POINTS}, {BATCHES} select batch_id, {_ray_sql()} as hit from batches")
def ray_batches(spark, sf_dir):
    return batches(spark, sf_dir).select("batch_id", expr.ray_hits(BOX, _EYE, _WAY).alias("hit"))


@query(f"""with {POINTS}, {BATCHES}, {_lod_sql(CAM)}, w as (select *, (num_points % 100) / 1e2 as d2 from lod) select batch_id, round(least(1e0, greatest(0e0, (exp(-d2 / 2e-1) + 1e-1) * 8e-1)), 6) as weight,
round(case when distance < diagonal then 1 else least(1e0, greatest(0e0, 1e1 * diagonal / distance)) * least(1e0, exp(-d2)) end, 6) as priority from w""")
def node_priority(spark, sf_dir):
    rows = raster.with_lod(batches(spark, sf_dir), CAM).withColumn("d2", F.col("num_points") % 100 / F.lit(100.0))
    return rows.select("batch_id", F.round(expr.foveation("d2"), 6).alias("weight"), F.round(expr.priority("diagonal", "distance", "d2"), 6).alias("priority"))


# trees


_LEVELS, _CAP = 5, 500
_TREE = f"{POINTS}, {MORTON}, " + "nodes as (" + " union all ".join(f"select cast({i} as bigint) as level, morton >> {3 * (21 - i)} as prefix, count(*) as n from codes group by 2" for i in range(_LEVELS + 1)) + ")"
_LEAVES = f"""{_TREE}, leaves as (select c.level, c.prefix, c.n from nodes c left join nodes p on p.level = c.level - 1 and p.prefix = c.prefix >> 3
  where (c.n <= {_CAP} or c.level = {_LEVELS}) and coalesce(p.n, {_CAP + 1}) > {_CAP})"""


@query(f"with {_TREE} select * from nodes")
def octree_prefix_counts(spark, sf_dir):
    return tree.prefix_counts(coded(spark, sf_dir), _LEVELS, 21)


@query(f"with {_LEAVES} select * from leaves")
def octree_leaves(spark, sf_dir):
    return tree.leaves(tree.prefix_counts(coded(spark, sf_dir), _LEVELS, 21), _CAP, _LEVELS)


_DEEP = f"""{POINTS}, {MORTON}, nodes as (select cast(i as bigint) as level, morton >> (3 * (21 - i)) as prefix, count(*) as n from codes, (select unnest(range(22))::int as i) group by all),
grown as (select c.* from nodes c left join nodes p on p.level = c.level - 1 and p.prefix = c.prefix >> 3 where coalesce(p.n, {_CAP + 1}) > {_CAP})"""


@query(f"with {_DEEP} select * from grown where n <= {_CAP} or level = 21")
def octree_deep_leaves(spark, sf_dir):
    return tree.grown(coded_unnumbered(spark, sf_dir), _CAP, 21, source(spark, sf_dir).count()).filter((F.col("n") <= _CAP) | (F.col("level") == 21))


_NAME = "'r' || " + " || ".join(f"case when level >= {i} then cast((prefix >> (3 * greatest(level - {i}, 0))) & 7 as varchar) else '' end" for i in range(1, _LEVELS + 1))


@query(f"with {_TREE} select {_NAME} as name, repeat(' ', level * 4) || {_NAME} || ': ' || n as line from nodes")
def octree_dump(spark, sf_dir):
    return tree.dump(tree.prefix_counts(coded(spark, sf_dir), _LEVELS, 21))


@query(f"with {POINTS}, {MORTON} select morton >> 45 as prefix, (morton >> 42) & 7 as child, count(*) as n from codes group by all")
def octree_children(spark, sf_dir):
    return tree.nested_cells(coded(spark, sf_dir), 6, 21).withColumn("child", F.col("child").cast("long"))


@query(f"with {POINTS}, {MORTON} select morton >> 36 as voxel, count(*) as n, min(point_id) as first_point from codes group by 1")
def voxel_count(spark, sf_dir):
    return tree.voxels(coded(spark, sf_dir), 12)


@query(f"""with {POINTS}, {MORTON}, v as (select morton >> 45 as cell, morton >> 39 as voxel, row_number() over (partition by morton >> 45 order by morton, point_id) as k, morton, point_id from codes)
select cell, voxel, count(*) as len from v group by all""")
def voxel_runs(spark, sf_dir):
    return tree.last_change(coded(spark, sf_dir), 13).select("cell", "voxel", "len")


@query(f"with {POINTS}, {MORTON} select morton >> 42 as cell, min(point_id) as first_id, max(point_id) as last_id from codes group by 1")
def lod_per_cell(spark, sf_dir):
    rows = coded(spark, sf_dir)
    first, last = tree.sample(rows, 14), tree.sample(rows, 14, last=True)
    return first.select("cell", F.col("point_id").alias("first_id")).join(last.select("cell", F.col("point_id").alias("last_id")), "cell")


@query()
def octree_view(spark, sf_dir):
    rows = coded_unnumbered(spark, sf_dir)
    low = layout.box(raw(spark, sf_dir)).first()
    size = max(low["max_x"] - low["min_x"], low["max_y"] - low["min_y"], low["max_z"] - low["min_z"]) * 0.01
    boxes = tree.node_boxes(tree.grown(rows, _CAP, 21, source(spark, sf_dir).count()), tuple(low[f"min_{a}"] * 0.01 for a in "xyz"), size)
    return tree.visible_nodes(boxes, CLOSE, 0.1).select("level", "prefix", "n", F.round("priority", 5).alias("priority"))


# neighbours


_DISTANCE = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(cast(v.embedding[i] as double) - cast(q.embedding[i] as double), 2))))"


@query(f"""select query_id, vec_id, round(distance, 6) as distance, rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from (select q.vec_id as query_id, v.vec_id, {_DISTANCE} as distance
from embeddings q join embeddings v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)) where rank <= 5""")
def knn_embeddings(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.knn(v, v.filter("vec_id % 100 = 0"), 5).withColumn("distance", F.round("distance", 6))


@query(f"""select query_id, count(*) as n, round(min(distance), 6) as least from (select q.vec_id as query_id, {_DISTANCE} as distance from embeddings q join embeddings v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)
where distance < 125e-2 group by 1""")
def radius_embeddings(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.radius_summary(v, v.filter("vec_id % 100 = 0"), 1.25).withColumn("least", F.round("least", 6))


@query(f"""with {POINTS}, c as (select point_id, wx, wy, wz, cast(floor(wx / 3e1) as bigint) as cx, cast(floor(wy / 3e1) as bigint) as cy, cast(floor(wz / 3e1) as bigint) as cz from world),
o as (select unnest(range(-1, 2)) as d) select a.point_id, count(*) as n from (select c.*, cx + i.d as ax, cy + j.d as ay, cz + k.d as az from c, o i, o j, o k) a
join c b on a.ax = b.cx and a.ay = b.cy and a.az = b.cz and a.point_id <> b.point_id where sqrt((pow(a.wx - b.wx, 2) + pow(a.wy - b.wy, 2)) + pow(a.wz - b.wz, 2)) < 3e1 group by 1""")
def radius_points(spark, sf_dir):
    return nearest.grid_neighbours(world(spark, sf_dir), 30.0)


# procedural points


@query("""with p as (select i, i % 256 as iu, i // 256 as iv, (i % 256) / 256e0 as u, (i // 256) / 256e0 as v from (select unnest(range(65536)) as i))
select i as point_id, round((u - 5e-1) * 1e2, 6) as x, round((v - 5e-1) * 1e2, 6) as y, round(cos(2e0 * sqrt(((u - 5e-1) * 1e1) * ((u - 5e-1) * 1e1) + ((v - 5e-1) * 1e1) * ((v - 5e-1) * 1e1))), 6) as z from p""")
def procedural_surface(spark, sf_dir):
    return procedural.height_field(spark, 256).select("point_id", *(F.round(a, 6).alias(a) for a in "xyz"))


# codecs and streams


@query(f"with {POINTS} select point_id, ix, iy, iz from points")
def codec_roundtrip(spark, sf_dir):
    out = compress.decompress(compress.compress(points(spark, sf_dir)))
    return out.select("point_id", *(F.col(a.upper()).alias(f"i{a}") for a in "xyz"))


@query(f"with {POINTS}, {projected_sql(CAM)}, {nearest_sql()} select pixel_id, round(depth, 4) as depth, point_id from fb")
def raster_compressed(spark, sf_dir):
    rows = compress.decompress(compress.compress(points(spark, sf_dir)))
    return raster.nearest(raster.projected(world_points(rows), CAM)).select("pixel_id", F.round("depth", 4).alias("depth"), "point_id")


@query()
def codec_sizes(spark, sf_dir):
    return compress.sizes(compress.compress(points(spark, sf_dir)))


@query()
def codec_ratio(spark, sf_dir):
    return compress.ratios(compress.compress(points(spark, sf_dir)))


@query(f"""with blocks as (select (l_orderkey * 7919 % 1048576) * 4294967296 + (l_partkey * 31 % 65536) * 65536 + l_suppkey * 17 % 65536 as block, l_linenumber as texel, l_orderkey, l_partkey from lineitem),
parts as (select *, block & 65535 as a, (block >> 16) & 65535 as b, (block >> (32 + 2 * texel)) & 3 as s from blocks),
ends as (select *, {', '.join(f"((({v} >> {s}) & {(1 << w) - 1}) << {8 - w}) | ((({v} >> {s}) & {(1 << w) - 1}) >> {2 * w - 8}) as {v}{c}" for v in 'ab' for c, s, w in (('r', 11, 5), ('g', 5, 6), ('b', 0, 5)))} from parts)
select l_orderkey, l_partkey, texel, {', '.join(f"case s when 0 then a{c} when 1 then b{c} when 2 then (2 * a{c} + b{c}) // 3 else (a{c} + 2 * b{c}) // 3 end as {c}" for c in 'rgb')} from ends""")
def bc1_decode(spark, sf_dir):
    from ..codec.blocks import decode1_columns

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    block = (F.col("l_orderkey") * 7919 % 1048576) * (1 << 32) + (F.col("l_partkey") * 31 % 65536) * 65536 + F.col("l_suppkey") * 17 % 65536
    rows = rows.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("texel"), block.alias("block"))
    return rows.select("l_orderkey", "l_partkey", "texel", *(v.alias(c) for c, v in zip("rgb", decode1_columns("block", "texel"))))


def _stream(spark, sf_dir, result) -> DataFrame:
    folder, name = workspace(spark, "arriving"), f"stream_{uuid.uuid4().hex}"
    parts = 4 * -(-tasks(spark, source(spark, sf_dir).count()) // 4)  # files of a bounded number of points, which arrive in four steps
    points(spark, sf_dir).repartitionByRange(parts, "point_id").write.parquet(folder)
    q = progressive.run(result(progressive.arriving(spark, folder, parts // 4)), name, checkpoint=workspace(spark, "progress"))
    q.awaitTermination()
    return spark.table(name)


@query(f"with {POINTS}, {projected_sql(CAM)}, {nearest_sql()} select pixel_id, round(depth, 4) as depth, point_id, rgb from fb")
def stream_raster(spark, sf_dir):
    return _stream(spark, sf_dir, lambda s: progressive.image(s, CAM)).withColumn("depth", F.round("depth", 4))


@query(f"with {POINTS}, cells as (select *, {', '.join(f'cast(least(2097151, greatest(0, floor(2097152e0 * i{a} / 11000000e0))) as bigint) as g{a}' for a in 'xyz')} from points), codes as (select {spread_sql('gx')} + {spread_sql('gy')} * 2 + {spread_sql('gz')} * 4 as morton from cells), "
       + "nodes as (" + " union all ".join(f"select cast({i} as bigint) as level, morton >> {3 * (21 - i)} as prefix, count(*) as n from codes group by 2" for i in range(4)) + ") select * from nodes")
def stream_octree_counts(spark, sf_dir):
    return _stream(spark, sf_dir, lambda s: progressive.node_counts(s, (0.0, 0.0, 0.0), 11_000_000.0, 3))


# further functions


@query(f"""with {_GOOD}, islands as (select *, sum(case when good then 0 else 1 end) over (partition by batch_id order by point_id) as island from good),
runs as (select count(*) as len from islands where good group by batch_id, island), n as (select len, count(*) as runs from runs group by len)
select len, runs, round(sum(len * runs) over (order by len desc) / sum(len * runs) over (), 6) as share from n""")
def delta_run_shares(spark, sf_dir):
    return layout.run_shares(layout.good_runs(differences(spark, sf_dir), 500)).withColumn("share", F.round("share", 6))


@query()
def delta_without_outliers(spark, sf_dir):
    return layout.discard_outliers(differences(spark, sf_dir).select("batch_id", "point_id", "X", "Y", "Z", "dx", "dy", "dz"), 500).groupBy("batch_id").agg(F.count("*").alias("kept"))


@query(f"with {POINTS} select " + ", ".join(f"round({f}(i{a}) * 1e-2, 4) as {n}_{a}" for n, f in (("min", "min"), ("max", "max")) for a in "xyz") + " from points")
def world_bbox(spark, sf_dir):
    return layout.world_box(layout.box(raw(spark, sf_dir)), 0.01, 0.0).select(*(F.round(c, 4).alias(c) for c in BOX))


def _corners_sql(m) -> str:
    rows = [f"(({number(m[i, 0])} * x + {number(m[i, 1])} * y) + ({number(m[i, 2])} * z + {number(m[i, 3])}))" for i in range(4)]
    corners = " union all ".join("select batch_id, " + ", ".join(f"{'max' if bits >> i & 1 else 'min'}_{a} as {a}" for i, a in enumerate("xyz")) + " from batches" for bits in range(8))
    return f"corners as ({corners}), moved as (select batch_id, " + ", ".join(f"{rows[i]} / {rows[3]} as {a}" for i, a in enumerate("xyz")) + " from corners)"


@query(f"with {POINTS}, {BATCHES}, {_corners_sql(CAM.transform())} select batch_id, " + ", ".join(f"round({f}({a}), 6) as {f}_{a}" for f in ("min", "max") for a in "xyz") + " from moved group by 1")
def batch_bbox_clip(spark, sf_dir):
    return raster.transformed_boxes(batches(spark, sf_dir), CAM.transform()).select("batch_id", *(F.round(c, 6).alias(c) for c in BOX))


@query(f"""with {POINTS}, {projected_sql(CAM)}, {nearest_sql()} select round(depth, 4) as depth, point_id from fb where pixel_id % {CAM.width} between {CAM.width // 2 - 20} and {CAM.width // 2 + 20}
and pixel_id // {CAM.width} between {CAM.height // 2 - 20} and {CAM.height // 2 + 20} order by fb.depth, point_id limit 1""")
def depth_under_cursor(spark, sf_dir):
    fb = raster.nearest(raster.projected(world(spark, sf_dir), CAM))
    return raster.depth_under_cursor(fb, CAM, CAM.width // 2, CAM.height // 2, 20).select(F.round("depth", 4).alias("depth"), "point_id")


@query(f"""with {POINTS}, {CHAINED}, colored as (select chained.* exclude (r, g, b), batch_id * 1234567 & 255 as r, (batch_id * 1234567 >> 8) & 255 as g, (batch_id * 1234567 >> 16) & 255 as b from chained),
{projected_sql(CAM, source='colored')}, {nearest_sql()} select pixel_id, point_id, rgb from fb""")
def raster_batches(spark, sf_dir):
    return raster.nearest(raster.projected(raster.debug_colored(layout.chained(world(spark, sf_dir))), CAM)).select("pixel_id", "point_id", "rgb")


@query(f"""with {POINTS} select point_id, round((wx * r + wy * g) + wz * b, 2) as dot, round(wy * b - wz * g, 2) as cx, round(wz * r - wx * b, 2) as cy, round(wx * g - wy * r, 2) as cz, round(sqrt((wx * wx + wy * wy) + wz * wz), 4) as length from world""")
def vector_functions(spark, sf_dir):
    a, b = ("wx", "wy", "wz"), ("r", "g", "b")
    x, y, z = expr.cross(a, b)
    return world(spark, sf_dir).select("point_id", F.round(expr.dot(a, b), 2).alias("dot"), F.round(x, 2).alias("cx"), F.round(y, 2).alias("cy"), F.round(z, 2).alias("cz"), F.round(expr.length(a), 4).alias("length"))


from . import storage  # noqa: E402, F401  adds its queries to QUERIES and SQL

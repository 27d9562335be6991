import numpy as np
from pyspark.sql import functions as F

from cairn.camera import PRESETS
from cairn.functions import expr
from cairn.operators import layout, raster
from cairn.points import numbered, points, world_points


def test_target_is_in_the_middle():
    for cam in PRESETS.values():
        x, y, z, w = cam.transform() @ np.array([*cam.target, 1.0])
        assert abs(x / w) < 1e-9 and abs(y / w) < 1e-9 and abs(w - cam.radius) < 1e-6
        assert (cam.planes() @ np.array([*cam.target, 1.0]) > 0).all()
        assert np.allclose(cam.under_cursor(cam.width / 2 - 0.5, cam.height / 2 - 0.5, cam.radius), cam.target)


def test_culling_changes_no_pixel(spark, sf_dir):
    """A batch that is culled has no point on the image."""
    w = world_points(points(spark, sf_dir))
    for cam in PRESETS.values():
        b = layout.batches(w, 64)
        kept = layout.chained(w, 64).join(raster.visible(b, cam).select("batch_id"), "batch_id", "left_semi")
        a, c = (raster.nearest(raster.projected(x, cam)).orderBy("pixel_id").collect() for x in (w, kept))
        assert a == c


def test_numbering_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 500).alias("a"), "id")
    got = numbered(df, ("a", "id"), rows=37).orderBy("a", "id").collect()
    assert [r["point_id"] for r in got] == list(range(1000))
    assert numbered(df.filter("a < 0"), ("a", "id")).count() == 0


def test_edge_values(spark):
    row = spark.range(1).select(
        expr.grid(F.lit(10.0), 0.0, 10.0, 3).alias("upper"), expr.quantize(F.lit(5.0), 5.0, 0.0, 30).alias("flat"), expr.delta_bits(F.lit(0)).alias("zero"), expr.delta_bits(F.lit(-8)).alias("eight"),
        expr.color8(F.lit(255)).alias("low"), expr.color8(F.lit(65535)).alias("high"), expr.left_pad(F.lit("abcdef"), 3).alias("long"), expr.smoothstep(0, 1, F.lit(0.5)).alias("half")).first()
    assert tuple(row) == (7, 0, 1, 4, 255, 255, "abcdef", 0.5)
    assert 0 <= spark.range(1).select(expr.noise(F.lit(5)).alias("n")).first()["n"] < 1


def test_procedural(spark):
    from cairn.sources import procedural

    r = procedural.sphere(spark, 16, 2.0).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r")).distinct().collect()
    assert all(abs(x["r"] - 2) < 1e-9 for x in r)
    assert procedural.tiles(spark, 4, F.lit(500)).count() == 16 * 16


def test_points_on_the_edge(spark):
    """Points on the image's edges, behind the camera, at its eye, and two at one depth."""
    cam = PRESETS["close"]
    back = np.linalg.inv(cam.transform())
    rows = []
    for i, (x, y) in enumerate([(-1, -1), (1, 0), (0, 1), (0, 0), (0, 0)]):
        w = 5000.0
        z = cam.transform()[2] @ np.linalg.inv(cam.transform()) @ np.array([x * w, y * w, 0, w])
        p = back @ np.array([x * w, y * w, (cam.projection()[2, 2] * -w + cam.projection()[2, 3]) + 0 * z, w])
        rows.append((i, *map(float, p[:3] / p[3]), i, i, i))
    rows.append((10, *map(float, cam.eye()), 1, 1, 1))
    rows.append((11, *map(float, 2 * cam.eye() - np.array(cam.target)), 1, 1, 1))
    df = spark.createDataFrame(rows, "point_id long, wx double, wy double, wz double, r long, g long, b long")
    shown = raster.projected(df, cam).collect()
    assert all(0 <= r["px"] < cam.width and 0 <= r["py"] < cam.height for r in shown) and not {10, 11} & {r["point_id"] for r in shown}
    middle = [r for r in raster.nearest(raster.projected(df.filter("point_id in (3, 4)").withColumn("wx", F.lit(rows[3][1])).withColumn("wy", F.lit(rows[3][2])).withColumn("wz", F.lit(rows[3][3])), cam)).collect()]
    assert [r["point_id"] for r in middle] == [3]


def test_equal_and_flat_points(spark):
    """Equal points, and points on a line: boxes without extent."""
    rows = [(i, 5, 5, 5, 1, 2, 3) for i in range(70)] + [(70 + i, i, 7, 7, 1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "point_id long, X long, Y long, Z long, r long, g long, b long")
    flat = df.filter("point_id < 70")
    assert layout.morton_sorted(flat).select("morton").distinct().collect()[0][0] == 0
    d = layout.deltas(df, 64, 16)
    assert layout.undelta(d).filter("ux <> X or uy <> Y or uz <> Z").count() == 0
    assert layout.bit_costs(layout.deltas(flat, 128, 64)).first()["delta_bits"] == 70 * 3
    from cairn.operators import compress, tree

    assert compress.decompress(compress.compress(df, 64)).join(df, ["point_id", "X", "Y", "Z"]).count() == 130
    assert compress.decompress(compress.compress(df.limit(0))).count() == 0
    leaf = tree.leaves(tree.prefix_counts(layout.morton_sorted(flat), 3, 21), 10, 3).collect()
    assert [(r["level"], r["n"]) for r in leaf] == [(3, 70)]

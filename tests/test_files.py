import json
import os
import struct

import pytest

from cairn.camera import PRESETS
from cairn.operators import compress
from cairn.points import points
from cairn.sinks import files
from cairn.sources import batchfile, las, octree


def write_plain(path, form, length, xyz, rgb, minor):
    head = bytearray(files.las_header(len(xyz), (0.01,) * 3, (1.0, 2.0, 3.0), (0, 0, 0), (9, 9, 9), minor))
    head[104] = form
    struct.pack_into("<H", head, 105, length)
    body = bytearray(length * len(xyz))
    for i, p in enumerate(xyz):
        struct.pack_into("<3i", body, i * length, *p)
        if form in las.COLOR_AT:
            struct.pack_into("<3H", body, i * length + las.COLOR_AT[form], *rgb[i])
    with open(path, "wb") as f:
        f.write(head + body)


@pytest.mark.parametrize(("form", "length", "minor"), [(2, 26, 2), (3, 34, 2), (7, 36, 4), (8, 38, 4), (0, 20, 2)])
def test_las_formats(spark, tmp_path, form, length, minor):
    xyz = [(i, -i, 7 * i) for i in range(100)]
    rgb = [(i, 256 * i, 65535) for i in range(100)]
    write_plain(tmp_path / "a.las", form, length, xyz, rgb, minor)
    write_plain(tmp_path / "b.las", form, length, xyz[:10], rgb[:10], minor)
    got = las.read(spark, str(tmp_path), chunk=33).orderBy("point_id").collect()
    assert [r["point_id"] for r in got] == list(range(110)) and [(r["X"], r["Y"], r["Z"]) for r in got] == xyz + xyz[:10]
    want = [tuple(v >> 8 if v > 255 else v for v in c) for c in rgb + rgb[:10]] if form in las.COLOR_AT else [(None,) * 3] * 110
    assert [(r["r"], r["g"], r["b"]) for r in got] == want
    h = las.headers(spark, str(tmp_path))
    assert [r["num_points"] for r in h.orderBy("path").collect()] == [100, 10] and las.total_box(h).first()["num_points"] == 110
    assert las.read_store(spark, str(tmp_path)).count() == 110
    assert las.read(spark, str(tmp_path / "a.las"), first=95, points=50).count() == 5


def test_las_errors(tmp_path):
    (tmp_path / "x.laz").write_bytes(b"")
    with pytest.raises(NotImplementedError):
        las.files_of(str(tmp_path))
    with pytest.raises(ValueError):
        las.parse_header(b"nothing")


def test_sorted_las_and_crop(spark, sf_dir, tmp_path):
    p = points(spark, sf_dir)
    paths = files.write_las(p, str(tmp_path / "out"), ["X", "point_id"])
    got = las.read(spark, str(tmp_path / "out")).orderBy("point_id").select("X").collect()
    xs = [r["X"] for r in got]
    assert len(xs) == p.count() and xs == sorted(xs)
    n = files.crop_las(paths[0], str(tmp_path / "crop.las"), 17)
    assert n == 17 == las.read(spark, str(tmp_path / "crop.las")).count()


def test_batch_file(spark, sf_dir, tmp_path):
    batches = compress.compress(points(spark, sf_dir), 1000).cache()
    batchfile.write(batches, str(tmp_path / "b.bin"))
    again = batchfile.read(spark, str(tmp_path / "b.bin"))
    a, b = (compress.decompress(x).orderBy("point_id").collect() for x in (batches, again))
    assert a == b and batchfile.directory(str(tmp_path / "b.bin"))[0][:2] == (len(a), batches.count())


def test_octree(spark, tmp_path):
    rec = struct.Struct("<BBIqq")
    meta = {"points": 6, "spacing": 1, "scale": [0.01] * 3, "offset": [0] * 3, "boundingBox": {"min": [0, 0, 0], "max": [8, 8, 8]}, "hierarchy": {"firstChunkSize": 66}, "attributes": [{"name": "position", "size": 12}, {"name": "rgb", "size": 6}]}
    (tmp_path / "metadata.json").write_text(json.dumps(meta))
    first = rec.pack(0, 0b1001, 1, 0, 18) + rec.pack(1, 0, 2, 18, 36) + rec.pack(2, 0, 0, 66, 44)  # r, r0, r3 elsewhere
    (tmp_path / "hierarchy.bin").write_bytes(first + rec.pack(0, 0b10000000, 1, 54, 18) + rec.pack(1, 0, 2, 72, 36))
    (tmp_path / "octree.bin").write_bytes(b"".join(struct.pack("<3i3H", i, i, i, i, 256 * i, 0) for i in range(6)))
    nodes = octree.nodes(spark, str(tmp_path))
    assert [r["name"] for r in nodes.orderBy("name").collect()] == ["r", "r0", "r3", "r37"]
    box = nodes.filter("name = 'r37'").first()
    assert (box["min_x"], box["min_y"], box["min_z"], box["max_x"]) == (2.0, 6.0, 6.0, 4.0)
    got = octree.points(spark, str(tmp_path))
    assert sorted(r["X"] for r in got.collect()) == list(range(6))
    assert octree.points(spark, str(tmp_path), nodes.filter("level = 2")).count() == 2


def test_images(spark, sf_dir, tmp_path):
    from cairn.operators import layout, raster
    from cairn.points import world_points

    cam = PRESETS["overview"]
    w = world_points(points(spark, sf_dir))
    fb = raster.nearest(raster.projected(w, cam)).cache()
    png = files.png(files.image_of(fb, cam))
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (cam.width, cam.height)
    depth = files.depth_map(fb, cam)
    assert (depth > 0).sum() == fb.count() and files.exr(depth)[:4] == struct.pack("<I", 20000630)
    files.report(layout.batches(w), str(tmp_path / "report.txt"))
    assert "median" in (tmp_path / "report.txt").read_text()
    files.write_workgroups(points(spark, sf_dir), str(tmp_path / "wg"), 500)
    assert spark.read.parquet(str(tmp_path / "wg/positions")).count() == 6000 and os.path.isdir(tmp_path / "wg/batches")

"""Steps that must grow no faster than their input: how rows are dealt, and what is shuffled, against brute force on small tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

from cairn import points as p
from cairn.operators import layout
from cairn.plans import queries as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+)\(([^)]*)\)", plan(df))


def test_numbering_shuffles_source_columns_in_bounded_tasks(spark, sf_dir, monkeypatch):
    """coordinates and colours aren't shuffled with the columns that put points in order, and tasks hold a bounded number of rows."""
    monkeypatch.setattr(p, "TASK_ROWS", 500)
    rows = p.points(spark, sf_dir)
    n = p.source(spark, sf_dir).count()
    parts = [int(x) for x in re.findall(r"Exchange hashpartitioning\(_bucket#\d+L?, (\d+)\)", plan(rows))]
    assert max(parts) == -(-n // 500)
    below = plan(rows).split("Exchange hashpartitioning(_bucket")[1]
    assert " AS X#" not in below and " AS r#" not in below
    assert [r["point_id"] for r in rows.orderBy("point_id").collect()] == list(range(n))


def test_order_makes_points_once(spark, sf_dir):
    """a Morton order numbers written keys, not a plan that makes all points again each time that it is asked."""
    text = plan(plans.QUERIES["morton_order"](spark, sf_dir))
    assert "lineitem.parquet" not in text
    assert not re.search(r"\b(X|Y|Z|wx|wy|wz)#", text)


def small(spark, n=300, batch=100):
    """Points in batches of 100, whose differences repeat, and the symbols of each batch."""
    xyz = [(i * i % 7, i % 5 * 3, i // 9) for i in range(n)]
    df = spark.createDataFrame([(i, *v, 0, 0, 0) for i, v in enumerate(xyz)], "point_id long, X long, Y long, Z long, r long, g long, b long").repartition(3)
    d = layout.deltas(df, batch, 10)
    steps = [tuple(a - b for a, b in zip(xyz[i], xyz[i - 1])) if i % 10 else (0, 0, 0) for i in range(n)]
    counts = [Counter(s for v in steps[a : a + batch] for s in v) for a in range(0, n, batch)]
    ranked = [sorted(c.items(), key=lambda x: (-x[1], x[0])) for c in counts]
    return d, xyz, steps, ranked


def one_shuffle(df):
    """Differences are dealt once: a batch needs no shuffle after."""
    keys = [k for kind, k in exchanges(df) if kind == "hashpartitioning"]
    assert len(keys) == 1 and keys[0].startswith("batch_id"), keys


def test_outliers_without_lists_in_rows(spark):
    """the symbols of a batch aren't joined to each of its points."""
    d, xyz, _, ranked = small(spark)
    rows = layout.discard_outliers(d, 3)
    one_shuffle(rows)
    want = []
    for b in range(3):
        good, last = {s for s, _ in ranked[b][:3]}, None
        for i in range(100 * b, 100 * b + 100):
            if last is None or all(x - y in good for x, y in zip(xyz[i], xyz[last])):
                want.append(i)
                last = i
    assert 3 < len(want) < 300 and sorted(r["point_id"] for r in rows.collect()) == want


def test_top_symbols_in_one_shuffle(spark):
    """most symbols of a batch are different, so counts by key in memory hold as many rows as there are differences."""
    d, _, _, ranked = small(spark)
    rows = layout.top_symbols(d, 4)
    one_shuffle(rows)
    want = [(b, s, n, i + 1) for b in range(3) for i, (s, n) in enumerate(ranked[b][:4])]
    assert sorted(map(tuple, rows.collect())) == sorted(want) and rows.columns == ["batch_id", "symbol", "n", "rank"]


def test_histogram_in_one_shuffle(spark):
    """symbols aren't shuffled one by one."""
    d, _, _, ranked = small(spark)
    rows = layout.histogram(d)
    one_shuffle(rows)
    assert sorted(map(tuple, rows.collect())) == sorted((b, s, n) for b in range(3) for s, n in ranked[b])


def test_coverage_in_one_shuffle(spark):
    """the share is made where the batch is counted."""
    d, _, _, ranked = small(spark)
    rows = layout.coverage(d, 3)
    one_shuffle(rows)
    assert dict(map(tuple, rows.collect())) == {b: sum(n for _, n in ranked[b][:3]) / 300 for b in range(3)}


def good(steps, ranked, k):
    return [all(v in {s for s, _ in ranked[i // 100][:k]} for v in steps[i]) for i in range(len(steps))]


def runs_of(flags):
    out = []
    for i, f in enumerate(flags):
        if f and (not i or not flags[i - 1] or i % 100 == 0):
            out.append([i // 100, i, 0])
        if f:
            out[-1][2] += 1
    return sorted(map(tuple, out))


def test_runs_in_one_shuffle(spark):
    """runs of good points without a join of symbols or a window over flags."""
    d, _, steps, ranked = small(spark)
    rows = layout.good_runs(d, 3)
    one_shuffle(rows)
    want = runs_of(good(steps, ranked, 3))
    assert len(want) > 3 and sorted(map(tuple, rows.collect())) == want
    assert sorted(map(tuple, layout.runs(layout.good_points(d, 3)).select("batch_id", "start", "len").collect())) == want


def test_run_shares_of_runs_in_one_shuffle(spark, sf_dir):
    """the shares rest on the same runs; besides their lengths, nothing is shuffled after differences are dealt."""
    keys = [k.split("#")[0] for kind, k in exchanges(plans.QUERIES["delta_run_shares"](spark, sf_dir)) if kind == "hashpartitioning"]
    assert sorted(k for k in keys if not k.startswith("_b")) == ["batch_id", "len"], keys


def test_good_points_in_one_shuffle(spark):
    """the flags of a batch without a join of its symbols."""
    d, _, steps, ranked = small(spark)
    rows = layout.good_points(d, 3)
    one_shuffle(rows)
    assert [r["good"] for r in rows.orderBy("point_id").collect()] == good(steps, ranked, 3)


def test_tree_grows_from_shared_ranges(spark, monkeypatch):
    """nodes that ranges of codes share, and equal codes in many tasks, without a row for each level of each code."""
    from cairn.operators import tree

    codes = [(i * 2654435761) % (1 << 20) << (i % 4 * 14) for i in range(700)] + [123 << 40] * 90
    df = spark.createDataFrame([(c,) for c in codes], "morton long").repartition(5)
    monkeypatch.setattr(p, "TASK_ROWS", 60)
    count = [Counter(c >> 3 * (21 - level) for c in codes) for level in range(22)]
    want = {(level, k, n) for level in range(22) for k, n in count[level].items() if not level or count[level - 1][k >> 3] > 6}
    rows = tree.grown(df, 6, 21)
    got = list(map(tuple, rows.collect()))
    assert len(got) == len(want) and set(got) == want
    assert "Generate explode" not in plan(rows) and "Expand" not in plan(rows)
    assert tree.grown(df.limit(0), 6, 21).count() == 0


def test_view_needs_no_numbers(spark, sf_dir, monkeypatch):
    """the view of an octree numbers no points, and its nodes come from ranges of codes."""
    monkeypatch.setattr(p, "numbered", None)
    rows = plans.QUERIES["octree_view"](spark, sf_dir)
    assert "Generate explode" not in plan(rows) and rows.count() > 0


def test_octree_files_in_chunks(spark, tmp_path, monkeypatch):
    """points and hierarchy are written by tasks, in chunks of levels, and the nodes of an octree that is deeper read back as they were."""
    from cairn.operators import tree
    from cairn.sinks import files
    from cairn.sources import octree

    monkeypatch.setattr(p, "TASK_ROWS", 90)
    monkeypatch.setattr(octree, "READ", 100)
    monkeypatch.setattr(octree, "WAITING", 3)
    codes = [(i * i * 7919) % (1 << 30) << 33 if i % 3 else (5 << 50) + i * i for i in range(600)] + [1 << 45] * 80
    rows = spark.createDataFrame([(c, i, i * 2, i * 3, i % 256, 1, 2) for i, c in enumerate(codes)], "morton long, X long, Y long, Z long, r long, g long, b long").repartition(4)
    collected = []
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *a: collected.append(1))
    grown = tree.grown(rows, 5, 21)
    files.write_octree(rows, grown, 5, 21, str(tmp_path))
    assert not collected and sorted(f.name for f in tmp_path.iterdir()) == ["hierarchy.bin", "metadata.json", "octree.bin"]
    back = octree.nodes(spark, str(tmp_path))
    got = {r["name"]: r for r in back.collect()}
    name = lambda level, prefix: "r" + "".join(str((d & 1) << 2 | d & 2 | d >> 2) for d in (prefix >> 3 * (level - i) & 7 for i in range(1, level + 1)))
    want = {name(r["level"], r["prefix"]): (r["n"] if r["n"] <= 5 or r["level"] == 21 else 0) for r in grown.collect()}
    assert {k: r["num_points"] for k, r in got.items()} == want and max(len(k) for k in want) > 9
    held = octree.points(spark, str(tmp_path), back).collect()
    assert sorted(r["X"] for r in held) == list(range(len(codes)))
    assert all(name(21, codes[r["X"]]).startswith(r["name"]) for r in held)
    meta = octree.metadata(str(tmp_path))
    assert meta["points"] == len(codes) and meta["hierarchy"]["firstChunkSize"] < 22 * len(want)


def test_neighbours_in_tiles(spark, monkeypatch):
    """points are copied at the borders of tiles only, and crowded tiles are divided."""
    import random

    from cairn.operators import nearest

    monkeypatch.setattr(nearest, "TILE", 3)
    monkeypatch.setattr(nearest, "CROWD", 40)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    monkeypatch.setattr(p, "TASK_ROWS", 100)
    r = random.Random(3)
    at = [(r.uniform(-40, 40), r.uniform(-40, 40), r.uniform(-9, 9)) for _ in range(400)] + [(1.0, 2.0, 3.0)] * 60 + [(500.0, 0.0, 0.0)]
    rows = nearest.grid_neighbours(spark.createDataFrame([(i, *v) for i, v in enumerate(at)], "point_id long, wx double, wy double, wz double").repartition(3), 5.0)
    want = {i: n for i, a in enumerate(at) if (n := sum(i != j and ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < 5 for j, b in enumerate(at)))}
    assert dict(map(tuple, rows.collect())) == want and len(want) > 200
    assert "cx" not in "".join(k for _, k in exchanges(rows)) and "SortMergeJoin" not in plan(rows)


def test_vectors_are_compared_in_blocks(spark, sf_dir, monkeypatch):
    """Distances of blocks, not a row for each pair; the same for any size of block."""
    from cairn.operators import nearest

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150).localCheckpoint()
    rows = {x["vec_id"]: x["embedding"] for x in v.collect()}

    def distance(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += (x - y) * (x - y)
        return total**0.5

    q = v.filter("vec_id % 10 = 0")
    want = {i: sorted((distance(rows[i], rows[j]), j) for j in rows if j != i) for i in rows if i % 10 == 0}
    for block, held in ((7, 50_000), (2048, 4)):
        monkeypatch.setattr(nearest, "BLOCK", block)
        monkeypatch.setattr(nearest, "PAIRS", 3 * block)
        monkeypatch.setattr(nearest, "HELD", held)
        knn = nearest.knn(v, q, 3)
        assert "aggregate(" not in plan(knn)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in knn.collect()) == sorted((i, k + 1, j, d) for i, w in want.items() for k, (d, j) in enumerate(w[:3]))
        near = nearest.radius_summary(v, q, 1.3)
        assert "aggregate(" not in plan(near)
        assert sorted(map(tuple, near.collect())) == sorted((i, sum(d < 1.3 for d, _ in w), w[0][0]) for i, w in want.items() if w[0][0] < 1.3)
        assert nearest.radius(v, q, 1.3).count() == sum(d < 1.3 for w in want.values() for d, _ in w)


def test_small_chunks_share_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """chunks of a few points don't make a task each, however many there are; no chunk is divided."""
    from cairn.sinks import files
    from cairn.sources import las

    n = p.source(spark, sf_dir).count()
    files.write_las(p.points(spark, sf_dir), str(tmp_path), ["X", "point_id"], rows=n)
    parts = las.LasReader({"path": str(tmp_path), "chunk": "3"}).partitions()
    assert len(parts) <= las.TASKS + len(las.files_of(str(tmp_path))) and sum(r.n for r in parts) == n
    assert all(r.first % 3 == 0 for r in parts)
    monkeypatch.setattr(las, "CHUNK", 30)
    parts = las.LasReader({"path": str(tmp_path), "chunk": "3"}).partitions()
    assert max(r.n for r in parts) == 30 and sum(r.n for r in parts) == n
    assert [r["X"] for r in las.read(spark, str(tmp_path), chunk=100).orderBy("point_id").collect()] == sorted(r["X"] for r in p.points(spark, sf_dir).collect())


def test_records_do_not_pass_the_driver(spark, sf_dir, tmp_path, monkeypatch):
    """tasks write the records; the driver gets their sizes."""
    from cairn.operators import compress
    from cairn.sources import batchfile

    batches = compress.compress(p.points(spark, sf_dir), 100).localCheckpoint()
    passed = []
    monkeypatch.setattr(type(batches), "toLocalIterator", lambda *a: passed.append(1))
    monkeypatch.setattr(batchfile, "TOGETHER", 7)
    batchfile.write(batches, str(tmp_path / "b.bin"))
    assert not passed and [f.name for f in tmp_path.iterdir()] == ["b.bin"]
    want = b"".join(batchfile.dump(r.asDict()) for r in batches.orderBy("batch_id").collect())
    head, places = batchfile.directory(str(tmp_path / "b.bin"))
    data = (tmp_path / "b.bin").read_bytes()
    assert head[:2] == (p.source(spark, sf_dir).count(), batches.count()) and data[places[0][0] :] == want
    assert head[2:] == tuple(batches.selectExpr(f"sum({v})").first()[0] for v in ("octet_length(encoding)", "4 * size(separate)", "octet_length(color)"))
    assert batchfile.read(spark, str(tmp_path / "b.bin")).count() == batches.count()


def test_arriving_files_are_bounded(spark, sf_dir, monkeypatch):
    """files that arrive hold a bounded number of points, and arrive in four steps."""
    from cairn.streaming import progressive

    monkeypatch.setattr(p, "TASK_ROWS", 500)
    seen = []
    own = progressive.arriving

    def arriving(session, folder, files=1, **more):
        rows = [r[0] for r in session.read.parquet(folder).groupBy(F.input_file_name()).count().select("count").collect()]
        seen.append((rows, files))
        return own(session, folder, files, **more)

    monkeypatch.setattr(progressive, "arriving", arriving)
    got = plans.QUERIES["stream_octree_counts"](spark, sf_dir)
    assert got.filter("level = 0").first()["n"] == 6000
    rows, files = seen[0]
    assert len(rows) == 12 and files == 3 and max(rows) < 1500


def test_raster_of_arriving_files(spark, sf_dir, monkeypatch):
    """the image of files of a bounded number of points is that of all points."""
    from cairn.streaming import progressive

    monkeypatch.setattr(p, "TASK_ROWS", 500)
    seen = []
    own = progressive.arriving
    monkeypatch.setattr(progressive, "arriving", lambda session, folder, files=1: seen.append(files) or own(session, folder, files))
    got = plans.QUERIES["stream_raster"](spark, sf_dir).select("pixel_id", "point_id").collect()
    want = plans.QUERIES["raster_min"](spark, sf_dir).select("pixel_id", "point_id").collect()
    assert seen == [3] and sorted(got) == sorted(want)


def test_code_depths_without_codes(monkeypatch):
    """F16: the depth of a code, in pairs at once, is that of the codes; and flagged codes are read by a table, long ones bit by bit."""
    import random

    import numpy as np

    from cairn.codec import huffman

    r = random.Random(5)
    for n in (1, 2, 3, 9, 40, 500):
        for most in (1, 3, 1000, 2**n if n < 50 else 10**6):
            symbols = np.array(sorted(r.sample(range(-9 * n, 9 * n), n)))
            counts = np.array([r.randint(1, most) for _ in range(n)])
            assert huffman.depth(symbols, counts) == max(huffman.codebook(symbols, counts)[1])
    v = np.repeat(np.arange(14), 1 << np.arange(14))
    monkeypatch.setattr(huffman, "LONG", 5)
    assert max(huffman.codebook(np.arange(14), 1 << np.arange(14))[1]) > 5
    for top in (14, 9, 1):
        assert (huffman.decode_flagged(huffman.encode_flagged(v, top), len(v)) == v).all()


def test_workgroups_make_points_once(spark, sf_dir, tmp_path, monkeypatch):
    """three tables from points that are numbered and written once; rows meet in tasks of a bounded number."""
    from cairn.sinks import files

    monkeypatch.setattr(p, "TASK_ROWS", 500)
    kept = []
    own = files.written
    monkeypatch.setattr(files, "written", lambda df, name: kept.append(name) or own(df, name))
    rows = plans.QUERIES["workgroup_points"](spark, sf_dir)
    assert kept == ["points"] and rows.count() == 6000
    assert [k.split(", ")[1] for kind, k in exchanges(rows) if k.startswith("point_id")] == ["12", "12"]

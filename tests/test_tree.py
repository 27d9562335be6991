"""Octrees that split as deep as their codes go."""

from collections import Counter

from pyspark.sql import functions as F

from cairn.operators import tree


def test_grown_splits_to_the_last_level(spark):
    codes = [*range(40), *[1 << 40] * 9, *((5 << 60) + (i << 33) for i in range(30))]
    rows = tree.grown(spark.createDataFrame([(c,) for c in codes], "morton long"), 4, 21).collect()
    got = {(r["level"], r["prefix"]): r["n"] for r in rows}
    want, todo = {}, [(0, 0)]
    count = [Counter(c >> 3 * (21 - level) for c in codes) for level in range(22)]
    while todo:
        level, prefix = todo.pop()
        if n := count[level][prefix]:
            want[level, prefix] = n
            if n > 4 and level < 21:
                todo += [(level + 1, prefix * 8 + i) for i in range(8)]
    assert len(rows) == len(got) and got == want
    leaves = {k: n for k, n in got.items() if n <= 4 or k[0] == 21}
    assert sum(leaves.values()) == len(codes) and {k: n for k, n in leaves.items() if n > 4} == {(21, 1 << 40): 9}


def test_view_is_deeper_than_five_levels(spark, sf_dir):
    from cairn.plans import queries as plans

    rows = tree.grown(plans.coded(spark, sf_dir), 4, 21)
    assert rows.agg(F.max("level")).first()[0] > 5


def test_numbers_of_clustered_rows(spark, monkeypatch):
    """Rows that mostly share one value of the order's first column, and a constant column: numbered as sorted."""
    from cairn import points as p

    monkeypatch.setattr(p, "UNEVEN", 2)
    for values in ([7] * 900 + [10**12, 0, 8], [5] * 300, list(range(400))):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a long, b long").repartition(5)
        got = {(r["a"], r["b"]): r["n"] for r in p.numbered(df, ("a", "b"), "n", 50).collect()}
        assert got == {x: i for i, x in enumerate(sorted((v, i) for i, v in enumerate(values)))}


def test_sums_before(spark, monkeypatch):
    from cairn import points as p

    monkeypatch.setattr(p, "COARSE", 4)
    got = p.sums_before(spark.createDataFrame([(i, i * i) for i in range(0, 30, 2)], "k long, v long"), "k", "v", "s").orderBy("k").collect()
    assert [r["s"] for r in got] == [sum(j * j for j in range(0, r["k"], 2)) for r in got]


def test_queries_in_blocks(spark, sf_dir, monkeypatch):
    from cairn.operators import nearest

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = nearest.knn(v, v.filter("vec_id % 10 = 0"), 3).collect()
    monkeypatch.setattr(nearest, "HELD", 2)
    assert sorted(nearest.knn(v, v.filter("vec_id % 10 = 0"), 3).collect()) == sorted(want) and len(want) % 3 == 0


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from cairn.workspace import workspace

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        workspace(bare)

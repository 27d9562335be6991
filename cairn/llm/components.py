"""Connected components of a graph that no machine holds: alternating large-star and small-star steps.

Each step is a minimum for each node (summed where the edges are, so that a hub costs no more than a leaf) and a join by node, whose hot
keys adaptive execution splits.  Edges of a task are first contracted to a forest.  Each round is written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, spool, unspool


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the edges a-b that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def contract(edges: DataFrame) -> DataFrame:
    """The edges of each task, replaced by a forest of stars with the same components."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) >= 1 << 20:
                a, b = forest(a, b)
                if len(a) >= 1 << 19:  # too many to hold: passed on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for each node a of edges(a, b) that is not the least of its component, the least node b.  Nodes are longs, not null."""
    now = spool(contract(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now
        seen = mark
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = spool(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = spool(large)
        unspool(low)
        low = spool(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small = large.filter("b <> a").join(low, F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b")
        new = spool(contract(small).distinct())
        unspool(now, large, low)
        now = new

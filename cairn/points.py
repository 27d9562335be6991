"""The points that queries run on: a lattice view of the order lines, numbered in a total order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of a block of prefix sums; how much more than its share a range may hold; partitions of sampled bounds at most.
COARSE, UNEVEN, MOST_PARTS = 4096, 8, 100_000
#: Scale and offset of the lattice, points of a batch and of a chain, rows that one task numbers.
SCALE, OFFSET, BATCH, CHAIN, BUCKET = 0.01, 0.0, 4096, 64, 65536
#: Rows that a task takes from a shuffle, about.
TASK_ROWS = 1 << 20
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
BOX = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


def tasks(spark: SparkSession, n: int) -> int:
    """Tasks for a shuffle of n rows: about TASK_ROWS rows each, or as many tasks as the session has for shuffles."""
    return max(-(-n // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df(n rows), dealt by a key to tasks of about TASK_ROWS rows: as many tasks as the session has for shuffles, or more."""
    parts = tasks(df.sparkSession, n)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def sums_before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df(key, value, ..), one row for each key, with the sum of the values of lower keys: within blocks of keys, and over blocks."""
    block = F.floor(F.col(key) / COARSE)
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    rows = df.withColumn("_block", block)
    coarse = rows.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(coarse, "_block").withColumn(name, F.col("_base") + F.col("_inner")).drop("_block", "_base", "_inner")


def sums_in_order(df: DataFrame, order: tuple[str, ...], value: str, name: str, n: int) -> DataFrame:
    """df(n rows) with the sum of the values of the rows before, in a total order: within sorted ranges of rows, and over ranges."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from .workspace import written

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).to_numpy()
            before = total + np.cumsum(v) - v
            total += int(v.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part)), pa.array(before.astype(np.int64))], [*b.schema.names, "_part", "_own"])

    parts = tasks(df.sparkSession, n)
    fields = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, f"{fields}, _part long, _own long"), "sums")
    base = sums_before(rows.groupBy("_part").agg(F.sum(value).alias("_total")), "_part", "_total", "_from").drop("_total")
    return rows.join(F.broadcast(base), "_part").withColumn(name, (F.col("_own") + F.col("_from")).cast("long")).drop("_part", "_own", "_from")  # a row for each range


def numbered(df: DataFrame, order: tuple[str, ...], name: str = "point_id", rows: int = BUCKET) -> DataFrame:
    """df with the position of each row, from 0, in a total order that begins with a column of numbers.

    Rows fall into ranges of that column, ranges are numbered each on its own, and the counts of the ranges before are added: only the
    counts meet.  Ranges of equal width serve if none holds over UNEVEN times its share; else rows are dealt by sampled bounds of all of
    the order's columns, which splits clustered and equal values, too."""
    lead = order[0]
    low, high, n = df.agg(F.min(lead), F.max(lead), F.count("*")).first()
    if not n:
        return df.withColumn(name, F.lit(0).cast("long"))
    parts = max(1, -(-n // rows))
    bucket = F.coalesce(F.floor((F.col(lead) - F.lit(low)).cast("double") * float(parts) / (float(high - low) + 1.0)), F.lit(-1)).cast("long")
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    if parts > 1 and sizes.agg(F.max("_n")).first()[0] > UNEVEN * rows:
        return numbered_by_range(df, order, name, min(parts, MOST_PARTS))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return dealt(bucketed, n, "_bucket").withColumn("_own", own).join(F.broadcast(sums_before(sizes, "_bucket", "_n", "_before").drop("_n")), "_bucket").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_bucket", "_own", "_before")


def numbered_by_range(df: DataFrame, order: tuple[str, ...], name: str, parts: int) -> DataFrame:
    """The same by sorted partitions of sampled bounds.  They are written to the shared folder, because bounds are sampled anew whenever a
    plan runs."""
    from .workspace import workspace

    spark, path = df.sparkSession, workspace(df.sparkSession, "ranges")
    place = F.monotonically_increasing_id()  # the partition's number, and below it 33 bits of the row's place in the partition
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(place, 33), "_own": place.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = spark.read.parquet(path)
    before = sums_before(rows.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n", "_before").drop("_n")
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that points are made from."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, "l_quantity")


def lattice() -> list[Column]:
    """X, Y, Z, r, g and b of a source row."""
    part = lambda name: F.pmod(F.col(name), F.lit(256)).cast("long")
    return [
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("X"), (F.col("l_quantity").cast("long") * 2000).alias("Y"), (F.col("l_partkey").cast("long") * 50).alias("Z"),
        part("l_partkey").alias("r"), part("l_suppkey").alias("g"), part("l_orderkey").alias("b")]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(X, Y, Z, r, g, b) and the columns that put points in order."""
    return source(spark, sf_dir).select(*ORDER, *lattice())


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(point_id, X, Y, Z, r, g, b), in the order of ORDER.  Coordinates and colours are made after rows are numbered: fewer columns are shuffled."""
    return numbered(source(spark, sf_dir), ORDER).select("point_id", *lattice())


def world_points(df: DataFrame, scale: float = SCALE, offset: float = OFFSET) -> DataFrame:
    """points with world coordinates x, y and z."""
    return df.withColumns({f"w{a}": F.col(a.upper()) * F.lit(scale) + F.lit(offset) for a in "xyz"})


def batch_of(size: int = BATCH) -> Column:
    return F.floor(F.col("point_id") / size).cast("long")


def chained(df: DataFrame, batch: int = BATCH, chain: int = CHAIN) -> DataFrame:
    """points with batch_id, chain_id (within the batch) and pos (within the chain)."""
    at = F.pmod(F.col("point_id"), F.lit(batch))
    return df.withColumns({"batch_id": batch_of(batch), "chain_id": F.floor(at / chain).cast("long"), "pos": F.pmod(at, F.lit(chain)).cast("long")})

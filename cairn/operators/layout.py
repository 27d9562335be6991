"""Batches, chains, orders and differences of points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr
from ..points import BATCH, BOX, CHAIN, chained, dealt, sums_before
from ..workspace import written


def batches(df: DataFrame, size: int = BATCH) -> DataFrame:
    """A row for each batch of points: first point, number of points, world box."""
    rows = chained(df, size)
    low = {f"min_{a}": F.min(f"w{a}") for a in "xyz"}
    high = {f"max_{a}": F.max(f"w{a}") for a in "xyz"}
    return rows.groupBy("batch_id").agg(F.min("point_id").alias("first_point"), F.count("*").alias("num_points"), *(v.alias(k) for k, v in (low | high).items()))


def box(df: DataFrame, *by: str) -> DataFrame:
    """The lattice box of each group."""
    aggs = [f(a).alias(f"{n}_{a.lower()}") for n, f in (("min", F.min), ("max", F.max)) for a in "XYZ"]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def deltas(df: DataFrame, batch: int = BATCH, chain: int = CHAIN, rows: int | None = None) -> DataFrame:
    """points with differences dx, dy, dz from the point before in the same chain; 0 at its start.  Batches stay whole from here on, so what
    is asked of a batch needs no further shuffle; with the number of rows, they are dealt to tasks of a bounded number."""
    w = Window.partitionBy("batch_id", "chain_id").orderBy("pos")
    own = chained(df, batch, chain)
    own = own.repartition("batch_id") if rows is None else dealt(own, rows, "batch_id")
    return own.withColumns({f"d{a.lower()}": F.coalesce(F.col(a) - F.lag(a).over(w), F.lit(0)) for a in "XYZ"})


def batch_deltas(df: DataFrame, batch: int = BATCH) -> DataFrame:
    """points with differences dx, dy, dz in millimetres from the point before in the same batch; from 0 at its start."""
    w = Window.partitionBy("batch_id").orderBy("point_id")
    rows = chained(df, batch).withColumns({f"_{a}": F.round(F.col(f"w{a}") * 1000).cast("long") for a in "xyz"})
    return rows.withColumns({f"d{a}": F.col(f"_{a}") - F.coalesce(F.lag(f"_{a}").over(w), F.lit(0)) for a in "xyz"}).drop("_x", "_y", "_z")


def padded(df: DataFrame, batch: int = BATCH) -> DataFrame:
    """points in batches, the last of which its last point fills up."""
    last = chained(df.orderBy(F.desc("point_id")).limit(1), batch)
    missing = F.lit(batch - 1).cast("long") - F.pmod(F.col("point_id"), F.lit(batch))
    more = last.filter(missing > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), missing))).drop("_copy")
    return chained(df, batch).unionByName(more)


def timings(df: DataFrame, label: str = "label", took: str = "took") -> DataFrame:
    """The least, greatest and mean duration of each label, and how many there are."""
    return df.groupBy(label).agg(F.min(took).alias("least"), F.max(took).alias("greatest"), F.avg(took).alias("mean"), F.count("*").alias("n"))


def undelta(df: DataFrame) -> DataFrame:
    """The coordinates of a chain from its start value and differences: running sums."""
    w = Window.partitionBy("batch_id", "chain_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("batch_id", "chain_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"u{a.lower()}": F.first(a).over(first) + F.sum(f"d{a.lower()}").over(w) for a in "XYZ"})


def symbols(df: DataFrame) -> DataFrame:
    """A row for each difference: (batch_id, symbol)."""
    return df.select("batch_id", F.explode(F.array("dx", "dy", "dz")).alias("symbol"))


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a batch, in the order of its points."""
    if "point_id" in table.column_names:
        ids = table.column("point_id").to_numpy()
        if (ids[1:] < ids[:-1]).any():
            table = table.sort_by("point_id")
    return [table.column(n).to_numpy() for n in names]


def counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a batch, how often it holds each, their ranks from 0 (the most frequent first, ties by the smaller symbol), and for
    each point the places of its three symbols."""
    found, place, n = np.unique(np.stack(numbers(table, "dx", "dy", "dz"), 1), return_inverse=True, return_counts=True)
    rank = np.empty(len(found), np.int64)
    rank[np.lexsort((found, -n))] = np.arange(len(found))
    return found, n, rank, place.reshape(-1, 3)


def of_batch(table: pa.Table, **columns) -> pa.Table:
    """Rows of a batch: its number and these columns."""
    n = len(next(iter(columns.values())))
    return pa.table({"batch_id": pa.array(np.full(n, table.column("batch_id")[0].as_py(), np.int64)), **columns})


def histogram(df: DataFrame) -> DataFrame:
    """How often each batch holds each symbol.  A batch is counted as a whole by one task: its points are bounded, and most of its symbols
    are different, so that their counts would be no less to shuffle than they are."""

    def run(table: pa.Table) -> pa.Table:
        found, n, _, _ = counted(table)
        return of_batch(table, symbol=found, n=n)

    return df.select("batch_id", "dx", "dy", "dz").groupBy("batch_id").applyInArrow(run, "batch_id long, symbol long, n long")


def top_symbols(df: DataFrame, k: int) -> DataFrame:
    """The k most frequent symbols of each batch, ties by the smaller symbol."""

    def run(table: pa.Table) -> pa.Table:
        found, n, rank, _ = counted(table)
        best = np.argsort(rank)[:k]
        return of_batch(table, symbol=found[best], n=n[best], rank=np.arange(1, len(best) + 1))

    return df.select("batch_id", "dx", "dy", "dz").groupBy("batch_id").applyInArrow(run, "batch_id long, symbol long, n long, rank long")


def coverage(df: DataFrame, k: int) -> DataFrame:
    """The share of each batch's differences that its k most frequent symbols cover."""

    def run(table: pa.Table) -> pa.Table:
        _, n, rank, _ = counted(table)
        return of_batch(table, coverage=np.array([int(n[rank < k].sum()) / int(n.sum())]))

    return df.select("batch_id", "dx", "dy", "dz").groupBy("batch_id").applyInArrow(run, "batch_id long, coverage double")


def flags(table: pa.Table, k: int) -> np.ndarray:
    """Whether all three differences of each point of a batch are among its k most frequent."""
    _, _, rank, place = counted(table)
    return (rank < k)[place].all(1)


def good_points(df: DataFrame, k: int) -> DataFrame:
    """Points with a flag: all three differences are among the k most frequent of their batch."""

    def run(table: pa.Table) -> pa.Table:
        return of_batch(table, point_id=numbers(table, "point_id")[0], good=flags(table, k))

    return df.select("batch_id", "point_id", "dx", "dy", "dz").groupBy("batch_id").applyInArrow(run, "batch_id long, point_id long, good boolean")


def good_runs(df: DataFrame, k: int) -> DataFrame:
    """The same as runs(good_points(df, k)), without a table of flags between."""

    def run(table: pa.Table) -> pa.Table:
        edge = np.diff(np.concatenate([[0], flags(table, k).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return of_batch(table, start=numbers(table, "point_id")[0][start], len=end - start)

    return df.select("batch_id", "point_id", "dx", "dy", "dz").groupBy("batch_id").applyInArrow(run, "batch_id long, start long, len long")


def runs(flagged: DataFrame, flag: str = "good") -> DataFrame:
    """Maximal runs of flagged points within a batch: (batch_id, start, len)."""
    w = Window.partitionBy("batch_id").orderBy("point_id")
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("island", breaks).filter(flag).groupBy("batch_id", "island").agg(F.min("point_id").alias("start"), F.count("*").alias("len")).drop("island")


def bit_costs(df: DataFrame) -> DataFrame:
    """For each batch: bits of its differences, bits at the fixed widths of its box, and points that take over 30 bits."""
    own = expr.delta_bits("dx") + expr.delta_bits("dy") + expr.delta_bits("dz")
    width = sum((expr.bits_for((F.max(a) - F.min(a)).cast("double"), 1.0) for a in "YZ"), expr.bits_for((F.max("X") - F.min("X")).cast("double"), 1.0))
    return df.withColumn("bits", own).groupBy("batch_id").agg(F.sum("bits").alias("delta_bits"), (F.count("*") * width).alias("fixed_bits"), F.sum(F.when(F.col("bits") > 30, 1).otherwise(0)).alias("jumps"))


def diagonal_summary(b: DataFrame) -> DataFrame:
    """Least, quartiles and greatest diagonal of batches, by position in the sorted list.

    Positions are found among counts of equal diagonals, so that the rows that meet in one task are different values, not batches."""
    d = b.select(F.round(expr.diagonal(BOX), 6).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    ranked = d.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * q), F.col("all") - 1), F.col("d")))
    return ranked.agg(F.min("d").alias("least"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("d").alias("greatest"), F.sum("n").alias("batches"))


def morton_sorted(df: DataFrame, bits: int = 21, whole: DataFrame | None = None) -> DataFrame:
    """points with their Morton code within the whole cube; `whole` has the same points, if its coordinates cost less to make."""
    b = (df if whole is None else whole).agg(*(f(a).alias(f"{n}{a}") for n, f in (("low", F.min), ("high", F.max)) for a in "XYZ"))
    size = F.greatest(*(F.col(f"high{a}") - F.col(f"low{a}") for a in "XYZ"), F.lit(1)).cast("double")
    rows = df.join(F.broadcast(b.select(*(f"low{a}" for a in "XYZ"), size.alias("size"))))  # one row
    rows = expr.once(rows, **{f"_cell{a}": expr.grid(a, f"low{a}", "size", bits) for a in "XYZ"})
    return rows.withColumn("morton", expr.morton63(*(f"_cell{a}" for a in "XYZ"))).drop("lowX", "lowY", "lowZ", "size", *(f"_cell{a}" for a in "XYZ"))


def ordered(df: DataFrame, key: str, batch: int = BATCH) -> DataFrame:
    """points with their position in the order of (key, point_id), and the batch that this makes.  Numbering asks for the rows several times,
    and may put all their columns in order in files, so give those that are needed only."""
    from ..points import numbered

    return numbered(written(df, "unordered"), (key, "point_id"), "place").withColumn("batch_id", F.floor(F.col("place") / batch).cast("long"))


def block_shuffled(df: DataFrame, block: int = 128, seed: int = 1) -> DataFrame:
    """points with a key that puts blocks of neighbours in a random order: sort by (block_key, point_id)."""
    b = F.floor(F.col("point_id") / block).cast("long")
    return df.withColumn("block_key", F.xxhash64(b, F.lit(seed))).withColumn("block", b)


def running_offsets(b: DataFrame, size: str = "num_points") -> DataFrame:
    """batches with the sum of the sizes before each."""
    return sums_before(b, "batch_id", size, "offset").select(*b.columns, F.col("offset").cast("long").alias("offset"))


def greedy_bins(b: DataFrame, limit: int) -> DataFrame:
    """Bins of consecutive nodes: a bin ends with the node that takes its points over the limit.  Each bin depends on the one before, so
    one task passes over the list of nodes in order, two numbers a node, and holds a batch of it."""

    def run(parts):
        number = total = 0
        for part in parts:
            out = []
            for n in part.column(1).to_pylist():
                out.append(number)
                total += n
                if total > limit:
                    number, total = number + 1, 0
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int64())], ["batch_id", "num_points", "bin"])

    rows = b.select(F.col("batch_id").cast("long"), F.col("num_points").cast("long"))
    return rows.repartition(1).sortWithinPartitions("batch_id").mapInArrow(run, "batch_id long, num_points long, bin long")


def run_shares(run_rows: DataFrame) -> DataFrame:
    """Lengths of runs, longest first, how many there are of each, and the share of points in runs at least as long.  Runs of a length are
    counted first, so what is put in order are different lengths."""
    n = run_rows.groupBy("len").agg(F.count("*").alias("runs"))
    w = Window.orderBy(F.desc("len"))
    total = F.sum(F.col("len") * F.col("runs"))
    return n.withColumn("share", total.over(w) / total.over(Window.partitionBy()))


def discard_outliers(df: DataFrame, k: int) -> DataFrame:
    """Points of each batch without those that differ from the last kept point by a difference that is not among the batch's k most frequent.

    Each decision depends on the one before, so a batch is worked through in order by one task; batches are independent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        found, _, rank, _ = counted(table)
        keep = kept(np.stack(numbers(table, "X", "Y", "Z"), 1), found[rank < k])
        return table.filter(pa.array(keep))

    return df.groupBy("batch_id").applyInArrow(run, df.schema)


def kept(xyz: np.ndarray, good: np.ndarray, step: int = 16) -> np.ndarray:
    """Which points are kept: the first, and each that differs from the last kept one by good (sorted) differences only.  From a kept point
    the next is looked for in pieces that double in size, so that points are compared a few times at most, however far apart they are."""
    out = np.zeros(len(xyz), bool)
    at = 0
    while at < len(xyz):
        out[at], first, size = True, at + 1, step
        last, at = xyz[at], len(xyz)
        while first < len(xyz):
            hit = np.arange(first, min(first + size, len(xyz)))
            for axis in range(3):
                d = xyz[hit, axis] - last[axis]
                hit = hit[good[np.minimum(np.searchsorted(good, d), len(good) - 1)] == d]
            if len(hit):
                at = int(hit[0])
                break
            first, size = first + size, 2 * size
    return out


def world_box(lattice_box: DataFrame, scale: float, offset: float) -> DataFrame:
    """A lattice box in world coordinates."""
    return lattice_box.withColumns({f"{m}_{a}": expr.world(f"{m}_{a}", scale, offset) for m in ("min", "max") for a in "xyz"})

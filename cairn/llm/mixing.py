"""Mixing sources to target weights (operator 2).

Each source gets a target of words; `targets` shares a budget by weight and pours what a source cannot take over the others.  A source
gives whole epochs first.  What is left of its target is filled by Efraimidis-Spirakis sampling: a document's key is an exponential
number divided by its quality weight, documents are sorted by key within their source, and the prefix sums of their sizes are cut at
the rest of the budget, at the document that comes nearest.

A source of any size is sorted in pieces: a document falls into a bucket that rises with its key, buckets are summed where the rows are,
the prefix sums of buckets (in two levels) find the one that holds the cut, and only that bucket's documents are put in order.  What is
kept is the key at the cut of each source, so texts are never shuffled.

The random numbers come from a hash of SEED, the document's id and its text: reruns agree.

Defined results: null text counts as empty, with size 0; documents without words are taken as their order says and add nothing; a null
source is a source, the last one; ties of keys are put in order by the hash of id and text, and equal rows stand or fall together, where
that keeps the sum nearest; an empty table gives an empty mix; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spool, table, whole

SEED = 17
#: Weights of the sources by code point, repeating; the budget against all words; the most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: The least and the greatest quality weight.
LEAST, MOST = 0.1, 1e6
#: Documents of a bucket, about, and buckets of a coarse one.
BUCKET, COARSE = 256, 512
SPACE = r"[\x20\x09-\x0D]+"


def size() -> F.Column:
    """Words of a text: one more than there are spaces between them.  No list of words is made, so a long text takes little more memory."""
    line = F.trim(F.regexp_replace(whole(), SPACE, " "))
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).cast("long")


def weight(quality: str | None = None) -> F.Column:
    """The quality weight of a document: what the column `quality` says (a classifier's score, say), LEAST at least, and LEAST for null or NaN.
    Without such a column, from 0.1 to 1, the share of its characters that are neither symbols nor digits."""
    if quality is not None:
        q = F.col(quality).cast("double")
        return F.when(q.isNull() | F.isnan(q), F.lit(LEAST)).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), q)))
    plain = F.length(F.translate(whole(), "#*$%&|<>{}[]\\^~=+_0123456789", ""))
    return F.greatest(F.lit(LEAST), plain / F.greatest(F.lit(1), F.length(whole())))


def keyed(docs: DataFrame, quality: str | None = None) -> DataFrame:
    """docs with `size`, `weight`, `key` (ascending order is the order of the draw) and `tie`."""
    tie = F.xxhash64(F.lit(SEED), F.col("doc_id"), whole())
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), tie), 11).cast("double") + 0.5) / float(1 << 53)
    out = docs.withColumns({"size": size(), "weight": weight(quality), "tie": tie})
    return out.withColumn("key", -F.log(u) / F.col("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    A target is the least of EPOCHS sizes and a level times its weight; sources in order of EPOCHS * size / weight are full until the
    level that shares the rest of the budget is below the next one's."""
    n = len(WEIGHTS)
    by_code = Window.orderBy(F.col("source").isNull(), F.hex(F.col("source").cast("binary")))  # UTF-8 sorts as code points do
    of = F.array(*map(F.lit, WEIGHTS))
    s = sizes.withColumn("w", F.element_at(of, ((F.row_number().over(by_code) - 1) % n + 1).cast("int")).cast("double")).withColumn("most", F.col("source_size") * float(EPOCHS))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (SHARE * F.sum("source_size").over(everything) - full) / left)
    s = s.withColumn("fits", F.col("level") * F.col("w") <= F.col("most")).withColumn("at", F.min(F.when(F.col("fits"), F.col("most") / F.col("w"))).over(everything))
    s = s.withColumn("final", F.max(F.when(F.col("fits") & (F.col("most") / F.col("w") == F.col("at")), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("w"))).alias("target"))


def sources(drawn: DataFrame) -> DataFrame:
    """(source, source_size, n, classes): classes are the mean and the number of the source's weights, two classes to each doubling."""
    by_class = drawn.groupBy("source", F.floor(2 * F.log2("weight")).alias("class")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("weight").alias("weight"))
    return by_class.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.collect_list(F.struct("weight", "n")).alias("classes"))


def in_buckets(drawn: DataFrame, goal: DataFrame) -> DataFrame:
    """drawn with `rest` and `bucket`, from goal(source, n, classes, rest).  A bucket is how many keys of the source are expected below a
    document's, in steps of BUCKET, so buckets stay small however far the weights lie apart."""
    d = drawn.join(goal.select(F.col("source").alias("source_"), "n", "classes", "rest"), drawn["source"].eqNullSafe(F.col("source_"))).drop("source_")
    many = F.ceil(F.col("n") / BUCKET)
    below = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["n"] * (1 - F.exp(-F.col("key") * c["weight"])))
    return d.withColumn("bucket", F.least(many - 1, F.floor(many * below / F.col("n"))).cast("long")).drop("classes")


def plan(drawn: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_tie, inside) from keyed(source, size, weight, key, tie): the mix takes `epochs` of each
    document, and one more of those up to the cut (null: none)."""
    sums = sources(drawn)
    goal = targets(sums.select("source", "source_size"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    goal = spool(goal.alias("g").join(sums.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.*", "s.n", "s.classes"))
    d = in_buckets(drawn, goal)
    fine = d.groupBy("source", "bucket").agg(F.sum("size").alias("size")).withColumn("coarse", F.floor(F.col("bucket") / COARSE))
    up = lambda by, order: F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("size").alias("size")).withColumn("base", up(["source"], "coarse"))
    fine = fine.withColumn("inner", up(["source", "coarse"], "bucket"))
    f, c = fine.alias("f"), coarse.alias("c")
    fine = f.join(c, F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.coarse") == F.col("c.coarse"))).select("f.source", "f.bucket", "f.size", (F.col("c.base") + F.col("f.inner")).alias("base"))
    g = goal.select(F.col("source").alias("source_"), "rest")
    # the buckets whose documents can be the one at which the sum comes nearest to the rest: where it is passed, and the last before
    near = fine.join(g, fine["source"].eqNullSafe(F.col("source_"))).filter((F.col("base") <= F.col("rest")) & (F.col("size") > 0)).groupBy("source").agg(F.max("bucket").alias("bucket"))
    near = near.alias("n").join(fine.alias("f"), F.col("n.source").eqNullSafe(F.col("f.source")) & (F.col("n.bucket") == F.col("f.bucket"))).select(F.col("n.source").alias("source_"), F.col("n.bucket").alias("bucket_"), "f.base")
    one = d.join(near, d["source"].eqNullSafe(F.col("source_")) & (d["bucket"] == F.col("bucket_")))
    one = one.groupBy("source", "bucket", "base", "rest", "key", "tie").agg(F.sum("size").alias("size"))  # equal rows go together
    one = one.withColumn("end", F.col("base") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "tie")))
    fits = F.col("rest") > F.col("end") - F.col("size") / 2.0
    cut = one.filter(fits).groupBy("source").agg(F.max(F.struct("key", "tie")).alias("cut"))
    low = near.join(d.groupBy("source", "bucket").agg(F.min(F.struct("key", "tie")).alias("low")).withColumnRenamed("source", "s"), F.col("source_").eqNullSafe(F.col("s")) & (F.col("bucket_") == F.col("bucket"))).select("source_", "low")
    out = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").join(low, F.col("g.source").eqNullSafe(F.col("source_")), "left")
    # without a document of that bucket, the cut lies just before the bucket's first
    return spool(out.select("g.source", "g.source_size", "g.target", "g.epochs", F.coalesce("c.cut.key", "low.key").alias("cut_key"), F.coalesce("c.cut.tie", F.lit(None).cast("long")).alias("cut_tie"), F.col("c.cut").isNotNull().alias("inside")))


def copies(drawn: DataFrame, made: DataFrame) -> DataFrame:
    """keyed rows with `copies`, how many times the mix holds each, and their source's `source_size` and `target`."""
    p = made.select(F.col("source").alias("source_"), "source_size", "target", "epochs", "cut_key", "cut_tie", "inside")
    d = drawn.join(p, drawn["source"].eqNullSafe(F.col("source_")))
    upto = F.when(F.col("inside"), (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie")))).otherwise(F.col("key") < F.col("cut_key"))
    more = (F.col("target") > F.col("epochs") * F.col("source_size")) & F.coalesce(upto, F.lit(False))
    return d.withColumn("copies", F.col("epochs") + more.cast("long")).drop("source_", "epochs", "cut_key", "cut_tie", "inside")


def mix(docs: DataFrame, quality: str | None = None) -> DataFrame:
    """The rows of docs(doc_id, text, source, ..), each as many times as the mix holds it; quality is a column of weights (see `weight`)."""
    own = F.lit(None).cast("double") if quality is None else F.col(quality)
    rest = docs.select("doc_id", "text", "source", own.alias("_quality"), F.struct(*docs.columns).alias("_row"))
    drawn = keyed(rest, quality and "_quality")
    made = plan(spool(drawn.select("source", "size", "weight", "key", "tie")))
    out = copies(drawn, made).filter(F.col("copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all documents takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = spool(keyed(docs).select("doc_id", "source", "size", "weight", "key", "tie"))
    out = copies(drawn, plan(drawn))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "weight", "key")

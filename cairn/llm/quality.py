"""Quality rules (operator 7): fixed rules, then robust multivariate outliers.

`measure` counts words, symbols, repeated lines and repeated words of whole texts.  `fit` makes a minimum-covariance-determinant estimate
of location and scatter for each language and source, as FAST-MCD does for large tables: from many random starts of a few rows,
concentration steps on a SUBSET of a group's rows find the BEST candidates; these are concentrated over all rows of the group until the
determinant falls no further, and the one of least determinant counts.  A step re-estimates mean and covariance from the part KEPT of the
rows with the least Mahalanobis distances.  `judge` rejects rows whose distance from their group's estimate is beyond the CUT quantile of
the chi-square distribution.

All rows count in every step over a group.  A step counts rows by bins of distance, which gives the distance that KEPT of the rows are
within, and then sums these rows and the products of their statistics, as integers (statistics are fixed-point numbers), so that the
result doesn't depend on the order of the rows.  A group of any size is summed where its rows are.

A ridge stands for differences that say nothing about quality: without it a statistic that is 0 in nearly every text, as symbols are,
would have no scatter, and any other value would be an outlier.

Defined results: null text counts as empty, with no words; null and empty languages or sources are groups of their own; an estimate is
drawn to that of all rows by PRIOR rows, so that a group of few rows has one, too; repeated rows count each and are judged alike; an empty table gives an empty
table; other columns pass through, and names of new columns that clash get underscores in front.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import fresh, lean, spool, table, unspool

#: Characters that count as symbols, and the ASCII white space between words.
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The transformed statistics and the least scale of each: mean word length (log), the share of symbols in characters, in percent
#: (log(1 + x)), and the shares of repeated lines in lines and of repeated words in words.  Any of them can reject alone: the largest
#: shares that pass the fixed rules lie beyond the CUT.
STATS = ("f_length", "f_symbols", "f_lines", "f_repeats")
RIDGE = (0.06, 0.35, 0.15, 0.09)
#: Fixed-point units of a statistic; the part of a group that an estimate rests on; rows that the estimate of all rows counts for in a group.
UNIT, KEPT, PRIOR, SEED = 1024, 0.75, 50, 29
#: Rows of a group that starts are searched among, random starts, and those that go on; steps at most, and the part by which a determinant
#: must fall for another one; bins of distance for each doubling, and in all.
SUBSET, TRIES, BEST, MOST, GAIN, OCTAVE, BINS = 300, 20, 2, 20, 1e-3, 64, 1920
#: Rows of a model (under 1 KB each) that may be broadcast; salts of a larger one.
FEW, SALTS = 20_000, 64
#: The group of all rows.
EVERY = ""
#: The 0.9999 quantile and the median of the chi-square distribution with 4 degrees of freedom.
CUT, MEDIAN = 23.5127, 3.3567


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n > 50_000:  # by numbers: tuples would take too much memory
        ids: dict = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(count[at] > 1)
        marked = np.zeros(len(words), bool)
        for j in range(3):
            marked[hit + j] = True
        return int(marked.sum())
    windows = [*zip(words, words[1:], words[2:])]
    count = Counter(windows)
    if len(count) == n:
        return 0
    covered = end = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def all_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def counts_of(text: str) -> tuple[int, ...]:
    """The COUNTS of a text but for its lines."""
    return all_counts(text)[:5]


def measure(df: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df with the COUNTS of each text as long columns."""
    keep = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    names = fresh([f.name for f in keep], *COUNTS)
    schema = T.StructType([*keep, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for b in batches:
            got = [all_counts(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(f.name)) for f in keep), *(pa.array([g[i] for g in got], pa.int64()) for i in range(len(names)))], [*(f.name for f in keep), *names])

    return df.mapInArrow(lean(run), schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics(df: DataFrame) -> DataFrame:
    """df with the transformed statistics of its COUNTS, in units of 1 / UNIT."""
    words, chars = (F.greatest(F.lit(1), F.col(c)).cast("double") for c in ("n_words", "word_chars"))
    lines = F.greatest(F.lit(1), F.col("n_lines")).cast("double")
    values = (F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words)
    return df.withColumns({n: F.round(v * UNIT).cast("long") for n, v in zip(STATS, values)})


def distance() -> F.Column:
    """The squared Mahalanobis distance of a row beside its group's estimate."""
    d = [F.col(s) / float(UNIT) - F.col("center")[i] for i, s in enumerate(STATS)]
    n = len(STATS)
    return reduce(lambda a, b: a + b, (F.col("inverse")[i * n + j] * d[i] * d[j] for i in range(n) for j in range(n)))


def bin_of(d2: F.Column) -> F.Column:
    return F.least(F.lit(BINS), F.floor(F.log2(1 + F.greatest(F.lit(0.0), d2)) * OCTAVE)).cast("int")


def estimate(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter, in units of the statistics, of rows with these sums of fixed-point numbers and of their products."""
    mean = sums / n
    return mean / UNIT, (products / n - np.outer(mean, mean)) / UNIT**2


def concentrate(x: np.ndarray, center: np.ndarray, cov: np.ndarray, kept: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step in memory: the estimate of the nearest part of the rows x, and its determinant."""
    d = x - center
    d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + np.diag(np.square(RIDGE))), d)
    near = x[np.argsort(d2, kind="stable")[: max(1, math.ceil(kept * len(x)))]]
    center, cov = near.mean(0), np.cov(near.T, bias=True).reshape(len(STATS), -1) if len(near) > 1 else np.zeros((len(STATS),) * 2)
    return center, cov, float(np.linalg.det(cov + np.diag(np.square(RIDGE))))


def search(x: np.ndarray, seed: int, kept: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The BEST estimates of least determinant that concentration reaches on rows x from TRIES random starts of len(STATS) + 1 rows."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(TRIES):
        some = x[rng.choice(len(x), min(len(x), len(STATS) + 1), replace=False)]
        at = some.mean(0), np.cov(some.T, bias=True).reshape(len(STATS), -1) if len(some) > 1 else np.zeros((len(STATS),) * 2)
        for _ in range(2):
            *at, det = concentrate(x, *at, kept)
        found.append((det, len(found), at))
    out = []
    for det, _, at in sorted(found, key=lambda f: f[:2])[:BEST]:
        for _ in range(MOST):
            *new, less = concentrate(x, *at, kept)
            if less >= det * (1 - GAIN):
                break
            at, det = new, less
        out.append(tuple(at))
    return out


MODEL = [T.StructField("center", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))]


def model_row(center: np.ndarray, cov: np.ndarray) -> dict:
    full = cov + np.diag(np.square(RIDGE))
    return {"center": center.tolist(), "cov": cov.ravel().tolist(), "inverse": np.linalg.inv(full).ravel().tolist()}


def beside(rows: DataFrame, model: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with what a spooled model has for their keys.  A model of up to FEW rows is broadcast; a larger one is joined by keys and a
    salt, for one group may have most rows."""
    if model.count() <= FEW:
        return rows.join(F.broadcast(model), keys, how)
    salted = model.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*STATS), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def starts(base: DataFrame, group: str) -> DataFrame:
    """(group, start, center, cov, inverse): where the concentration of each group begins, from SUBSET of its rows by hash."""
    hashed = F.xxhash64(F.lit(SEED), *STATS, "n_words")
    slots = base.groupBy(group, F.pmod(hashed, F.lit(SUBSET)).alias("slot")).agg(F.min(F.struct(hashed.alias("h"), F.array(*STATS).alias("x"))).alias("one"))
    lists = slots.groupBy(group).agg(F.collect_list("one.x").alias("x"))  # SUBSET at most
    schema = T.StructType([base.schema[group], T.StructField("start", T.IntegerType()), *MODEL])

    def run(batches):
        kind = to_arrow_schema(schema)
        for b in batches:
            for g, x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (group, "x"))):
                found = search(np.array(sorted(x), float) / UNIT, xxh64_intdigest(str(g), SEED), KEPT)
                yield pa.RecordBatch.from_pylist([{group: g, "start": i, **model_row(*at)} for i, at in enumerate(found)], kind)

    return lists.mapInArrow(lean(run), schema)


def step(base: DataFrame, model: DataFrame, group: str) -> DataFrame:
    """One concentration step of each estimate over all rows: (group, start, size, center, cov, inverse, det).  The nearest part has KEPT of
    a group's rows: whole bins of distance, and of the bin at its edge as large a share as is wanting."""
    n = len(STATS)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    near = beside(base, model.select(group, "start", "center", "inverse"), [group]).withColumn("bin", bin_of(distance()))
    counts = near.groupBy(group, "start", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group, "start")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("size", F.sum("n").over(w)).withColumn("want", F.ceil(F.col("size") * KEPT))
    edge = ranked.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    edge = spool(edge.select(group, "start", F.col("bin").alias("edge"), "size", ((F.col("want") - F.col("upto") + F.col("n")) / F.col("n")).alias("share")))
    both = beside(near, edge, [group, "start"]).filter(F.col("bin") <= F.col("edge"))
    parts = {"n": F.lit(1), **{f"s{i}": F.col(STATS[i]) for i in range(n)}, **{f"p{i}{j}": F.col(STATS[i]) * F.col(STATS[j]) for i, j in pairs}}
    names = [*parts]
    sums = both.groupBy(group, "start").agg(F.first("size").alias("size"), F.first("share").alias("share"), *(F.sum(F.when(F.col("bin") < F.col("edge"), x)).alias(f"in_{k}") for k, x in parts.items()), *(F.sum(F.when(F.col("bin") == F.col("edge"), x)).alias(f"at_{k}") for k, x in parts.items()))
    schema = T.StructType([base.schema[group], T.StructField("start", T.IntegerType()), T.StructField("size", T.LongType()), *MODEL, T.StructField("det", T.DoubleType())])

    def run(batches):
        kind = to_arrow_schema(schema)
        for b in batches:
            out = []
            for r in b.to_pylist():
                v = {k: (r[f"in_{k}"] or 0) + r["share"] * (r[f"at_{k}"] or 0) for k in names}
                products = np.zeros((n, n))
                for i, j in pairs:
                    products[i, j] = products[j, i] = v[f"p{i}{j}"]
                center, cov = estimate(v["n"], np.array([v[f"s{i}"] for i in range(n)]), products)
                out.append({group: r[group], "start": r["start"], "size": r["size"], **model_row(center, cov), "det": float(np.linalg.det(cov + np.diag(np.square(RIDGE))))})
            yield pa.RecordBatch.from_pylist(out, kind)

    out = spool(sums.mapInArrow(lean(run), schema))
    unspool(edge)
    return out


def concentrated(base: DataFrame, group: str) -> DataFrame:
    """(group, size, center, cov): the estimate of least determinant for each group of base.  Estimates are concentrated until the
    determinant falls by less than the part GAIN; only those that still fall take part in a step."""
    model = spool(starts(base, group))
    done = [step(base, model, group)]
    active = done[0]
    unspool(model)
    for _ in range(MOST - 1):
        new = step(base, active, group)
        done.append(new)
        old = active.select(F.col(group).alias("_g"), F.col("start").alias("_s"), F.col("det").alias("was"))
        active = new.join(old, (F.col(group) == F.col("_g")) & (F.col("start") == F.col("_s"))).filter(F.col("det") < F.col("was") * (1 - GAIN)).drop("_g", "_s", "was")
        if active.isEmpty():
            break
    best = reduce(DataFrame.unionByName, done).groupBy(group).agg(F.min_by(F.struct("size", "center", "cov"), F.struct("det", "start")).alias("best"))
    out = spool(best.select(group, "best.*"))
    unspool(*done)
    return out


def fit(df: DataFrame, group: str) -> DataFrame:
    """Estimates (group, center, inverse, scale) from the statistics of all rows of df.  A group's estimate is drawn to that of all rows
    as far as PRIOR further rows would draw it, whatever its size."""
    own = spool(df.select(group, *STATS, "n_words"))
    every = own.withColumn(group, F.lit(EVERY))
    found = concentrated(own.union(every), group)
    n = len(STATS)
    pool = found.filter(F.col(group) == EVERY).select("center", "cov").first()  # null if there are no rows at all
    pooled = pool and pool.asDict()
    schema = T.StructType([df.schema[group], *MODEL])

    def run(batches):
        kind = to_arrow_schema(schema)
        for b in batches:
            out = []
            for r in b.to_pylist():
                part = r["size"] / (r["size"] + PRIOR)
                mixed = [part * np.array(r[k]) + (1 - part) * np.array(pooled[k]) for k in ("center", "cov")]
                out.append({group: r[group], **model_row(mixed[0], mixed[1].reshape(n, n))})
            yield pa.RecordBatch.from_pylist(out, kind)

    model = spool(found.filter(F.col(group) != EVERY).mapInArrow(lean(run), schema))
    counts = beside(own, model, [group]).groupBy(group, bin_of(distance()).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    mid = ranked.filter(F.col("upto") * 2 >= F.col("all")).groupBy(group).agg(F.min("bin").alias("mid"))
    out = spool(model.join(mid, group).select(group, "center", "inverse", F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("mid") + 0.5) / OCTAVE) - 1) / MEDIAN).alias("scale")))
    unspool(own, found, model)
    return out


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """df with COUNTS, `base_failed`, `d2` and `kept`.  The counts are made once and written to the shared folder."""
    measured = measure(df, text, not keep_text)
    names = dict(zip(fresh([c for c in df.columns if keep_text or c != text], *COUNTS), COUNTS))
    rest = [c for c in measured.columns if c not in names]
    own = spool(measured.select(F.struct(*rest).alias("row"), F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))).alias("pair"), *(F.col(a).alias(b) for a, b in names.items())))
    rows = statistics(own.withColumn("base_failed", base_failed()))
    model = fit(rows.filter(~F.col("base_failed")), "pair")
    out = beside(rows, model, ["pair"], "left").withColumn("d2", distance() / F.col("scale"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True)))
    back = {b: a for a, b in names.items()}
    last = fresh([*rest, *names], "base_failed", "d2", "kept")
    return out.select("row.*", *(F.col(c).alias(back[c]) for c in COUNTS), *(F.col(a).alias(b) for a, b in zip(("base_failed", "d2", "kept"), last)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdicts on it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, keep_text=False).select("doc_id", *COUNTS[:5], "base_failed", "kept", "d2", "n_lines")

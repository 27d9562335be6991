"""Toxicity by compression distance (operator 3).

Two dictionaries, one of ordinary text and one of toxic text, serve zstandard, and each window of a text is compressed with both.
Where the toxic dictionary saves bytes that the ordinary one does not, the window says what toxic texts say.  A text's distances - the
largest, the mean of the largest three, how many reach 3 and 4 bytes, the mean of all - become a probability by thresholds and slopes that
are calibrated on a third of the labelled rows, which the dictionaries are not made from.

A dictionary helps by the strings that it holds.  zstandard's own trainer takes the strings that recur most, and those of toxic texts are
mostly those of all texts; `train_by_zstandard` makes such dictionaries, and the README has what they reach.  So the ordinary
dictionary holds the words that recur in ordinary text, and the toxic dictionary the same ones behind those words that labels tell apart:
words with significantly more different contexts (the words before and after) in toxic than in ordinary texts.  Contexts are counted
rather than occurrences, because one text with many copies would make all of its words look toxic.  As the shared part lies at the
same distance from the window in both dictionaries, ordinary windows come out equally long.

The training rows are a bounded sample: PER_CLASS labelled texts of each class.  Every whole text is scored.

Defined results: null and empty texts have one empty window, with distance 0; without labelled rows of both classes, for the dictionaries
and for the calibration, every score is the share of toxic rows (0 without rows); repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import fresh, lean, spool, table, unspool
from .labelled import remainder, sample

PER_CLASS, SEED = 2500, 11
#: Features of a text's distances; contexts that a task holds before it passes them on.
FEATURES, HELD = 5, 200_000
#: Words of a window; bytes of the dictionaries' shared part and of the toxic one's own; compression level.
WINDOW, SHARED, OWN, LEVEL = 5, 8192, 8192, 5
#: Words count as toxic if their frequencies have this ratio at least and are significant: of the words chosen, no more than FALSE may be
#: expected by chance.  Texts with copies vary more than independent words, so the likelihood ratio counts for its part SPREAD only.
TIMES, FALSE, SPREAD = 3.0, 0.05, 0.67
_strip = b".,;:!?\"'()"


def windows(text: str) -> list[bytes]:
    w = text.lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)] or [b""]


def contexts(texts: DataFrame) -> DataFrame:
    """(word, a, b): in how many different contexts each word of texts(text, toxic) stands, in toxic and in ordinary texts."""

    def run(batches):
        names = ["toxic", "word", "around"]
        give = lambda seen: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen), (pa.int32(), pa.binary(), pa.int64()))], names)
        for batch in batches:
            seen: set = set()
            for t, toxic in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
                w = [b"", *(x.strip(_strip) for x in (t or "").lower().encode("utf-8", "surrogatepass").split()), b""]
                for at in range(1, len(w) - 1):
                    seen.add((toxic, w[at], xxh3_64_intdigest(w[at - 1] + b" " + w[at + 1]) >> 1))
                    if len(seen) == HELD:
                        yield give(seen)
                        seen = set()
            if seen:
                yield give(seen)

    pairs = texts.mapInArrow(lean(run), "toxic int, word binary, around long").distinct()
    return pairs.groupBy("word").agg(F.count_if(F.col("toxic") == 1).cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b"))


def train(texts: DataFrame) -> tuple[bytes, bytes]:
    """The contents of the ordinary and the toxic dictionary, from texts(text, toxic).  No more words come to the driver than fit in."""
    words = spool(contexts(texts))
    na, nb, n = words.agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0)), F.count("*")).first()
    if not na or not nb:
        unspool(words)
        return b"", b""
    part = lambda x, of: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / ((F.col("a") + F.col("b")) * (of / (na + nb))))).otherwise(0.0)
    rated = words.withColumn("gain", 2 * (part("a", na) + part("b", nb))).withColumn("ratio", ((F.col("a") + 0.5) / (na + 1)) / ((F.col("b") + 0.5) / (nb + 1)))
    apart = rated.filter(F.col("ratio") > TIMES).orderBy(F.desc("gain"), "word").limit(OWN // 2).select("word", "gain").collect()
    usual = rated.filter((F.col("ratio") < 2) & (F.col("b") > 0) & (F.octet_length("word") > 0)).orderBy(F.desc("b"), F.desc("word")).limit(SHARED // 2).select("word").collect()
    unspool(words)
    chance = np.array([math.erfc(math.sqrt(max(0.0, r["gain"]) * SPREAD / 2)) for r in apart]) * n
    enough = np.flatnonzero(chance <= FALSE * np.arange(1, len(apart) + 1))
    told = [bytes(r["word"]) for r in apart[: enough[-1] + 1]] if len(enough) else []
    join = lambda best, size: (b" " + b" ".join(best[::-1]) + b" ")[-size:]  # noqa: E731  best last
    shared = join([bytes(r["word"]) for r in usual], SHARED)
    return shared, join(told, OWN) + shared if told else shared


def train_by_zstandard(toxic: list[bytes], ordinary: list[bytes], size: int = SHARED + OWN) -> tuple[bytes, bytes]:
    """Contents of two dictionaries that zstandard's trainer makes from windows, each from those of its class."""
    return tuple(zstandard.train_dictionary(size, windows).as_bytes() for windows in (ordinary, toxic))


@functools.lru_cache(maxsize=8)
def compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def distances(text: str, dictionaries: tuple[bytes, bytes]) -> list[float]:
    """What the distances of a text's windows say: the largest, the mean of the largest three, numbers of large ones, and the mean."""
    ordinary, toxic = map(compressor, dictionaries)
    d = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
    top = np.sort(d)[::-1][:3]
    return [float(top[0]), float(top.mean()), math.log1p((d >= 3).sum()), math.log1p((d >= 4).sum()), float(d.mean())]


def measured(texts: DataFrame, dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Rows of the distances of texts(text, toxic) and whether each is toxic, in the order of ids."""

    def run(batches):
        for b in batches:
            x = [distances(t or "", dictionaries) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("toxic")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(lean(run), f"doc_id {kind}, toxic int, x array<double>").orderBy("doc_id").collect()
    return np.array([[*r["x"], r["toxic"]] for r in rows]).reshape(-1, FEATURES + 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, weights: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30)))


def fit(texts: DataFrame, share: float) -> dict:
    """Dictionaries and calibration from texts(doc_id, text, toxic).  share: how many of all labelled rows are toxic, for the sample holds
    both classes alike."""
    texts = spool(texts)
    third = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(3)) == 0
    dictionaries = train(texts.filter(~third))
    rest = measured(texts.filter(third), dictionaries) if dictionaries[0] else np.zeros((0, FEATURES + 1))
    unspool(texts)
    x, y = rest[:, :-1], rest[:, -1]
    if not 0 < y.sum() < len(y):
        return {"dictionaries": (b"", b""), "weights": [0.0] * FEATURES + [math.log((share + 1e-6) / (1 - share + 1e-6))]}
    w = logistic(x, y)
    w[-1] += math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(y.sum() / (len(y) - y.sum()))
    return {"dictionaries": dictionaries, "weights": w.tolist()}


def score(df: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """df without its texts, with the probability that each is toxic."""
    keep = [f for f in df.schema.fields if f.name != text]
    (name,) = fresh([f.name for f in keep], name)

    def run(batches):
        for b in batches:
            x = np.array([distances(t or "", model["dictionaries"]) for t in b.column(b.schema.get_field_index(text)).to_pylist()]).reshape(-1, FEATURES)
            p = probability(x, model["weights"])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), pa.array(p)], [*(f.name for f in keep), name])

    return df.mapInArrow(lean(run), T.StructType([*keep, T.StructField(name, T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; rows whose id has crc32 modulo 5 equal to 0 are not learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter((remainder("doc_id", 5) != 0) & F.col("toxic").isNotNull())
    share = labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    own = [sample(docs, labels.filter(F.col("toxic") == c), PER_CLASS, 3).withColumn("toxic", F.lit(c)) for c in (1, 0)]
    model = fit(own[0].union(own[1]), share)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

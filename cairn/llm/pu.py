"""Quality classification from positive and unlabelled text (operator 8).

Trusted texts are the positives; a sample of the whole corpus, whatever its labels, is the unlabelled text.  `prior` estimates the share of
good texts among the unlabelled: probe models tell positives from unlabelled ones, and the share is the least ratio of the parts of
both that score above a threshold, with an allowance for chance.  `fit` then minimises the non-negative unbiased risk of a small
network: with prior p, losses l, positives P and unlabelled U it is p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]); where the second
part would fall below zero, the step goes the other way.  With the logistic loss, the network's output is the log odds of a good text.

Features are statistics of whole texts, as quality rules count them; they are counted on the executors.  The training rows are bounded
samples of texts of any length: POSITIVE labelled texts, and UNLABELLED of all texts, whose mean loss stands for the mean over all.  Every
whole text is scored.

Defined results: null text counts as empty; without positives every score is 0.5; repeated rows score alike; an empty table gives an empty
table; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, table
from .labelled import remainder, sample
from .quality import counts_of

POSITIVE, UNLABELLED = 3000, 6000
HIDDEN, ROUNDS, RATE, DECAY, SEED = 24, 400, 0.02, 1e-3, 5


def features(text: str) -> list[float]:
    n, chars, symbols, dup_lines, repeats = counts_of(text)
    words, letters = max(n, 1), max(chars, 1)
    count = Counter(text.split())
    common = count.most_common(1)[0][1] if count else 0
    digits = sum(map(text.count, "0123456789"))
    stops = sum(map(text.count, ".,;:!?"))
    log = np.log1p
    return [
        log(n), log(letters / words), log(100 * symbols / letters), log(100 * dup_lines / words), log(100 * repeats / words), len(count) / words,
        log(100 * common / words), log(100 * digits / letters), log(100 * stops / letters), log(100 * text.count("\n") / words), float(n < 50)]


def start(width: int, rng: np.random.Generator) -> list[np.ndarray]:
    return [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]


def forward(net: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ net[0] + net[1])
    return h @ net[2] + net[3], h


def backward(net: list[np.ndarray], x: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients, from the slope of the risk by each output."""
    inner = (slope[:, None] * net[2]) * (1 - h * h)
    return [x.T @ inner, inner.sum(0), h.T @ slope, slope.sum(keepdims=True)]


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def minimise(pos: np.ndarray, unl: np.ndarray, share: float | None) -> list[np.ndarray]:
    """A network of least non-negative risk for a prior; without one, one that tells positives from unlabelled texts."""
    rng = np.random.default_rng(SEED)
    net = start(pos.shape[1], rng)
    first, second = ([np.zeros_like(w) for w in net] for _ in range(2))
    for step in range(1, ROUNDS + 1):
        gp, hp = forward(net, pos)
        gu, hu = forward(net, unl)
        up, down = -sigmoid(-gp) / len(gp), sigmoid(gp) / len(gp)  # slopes of the losses of a positive as positive and as negative
        other = sigmoid(gu) / len(gu)
        if share is None:
            parts = backward(net, pos, hp, up), backward(net, unl, hu, other)
            grad = [a + b for a, b in zip(*parts)]
        else:
            rest = np.logaddexp(0, gu).mean() - share * np.logaddexp(0, gp).mean()
            negative = [a - share * b for a, b in zip(backward(net, unl, hu, other), backward(net, pos, hp, down))]
            grad = [-a for a in negative] if rest < 0 else [share * a + b for a, b in zip(backward(net, pos, hp, up), negative)]
        for i, g in enumerate(grad):
            g = g + DECAY * net[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net[i] = net[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The estimated share of positives among the unlabelled: probes are fitted on either half and score the other one.  Above a threshold
    that most positives pass, the part of the unlabelled that passes is the share times theirs, and more if negatives pass too; so the
    least ratio counts, with half a standard error added because it is the least of many."""
    p, u = np.zeros(len(pos)), np.zeros(len(unl))
    for half in (0, 1):
        net = minimise(pos[half::2], unl[half::2], None)
        p[1 - half :: 2], u[1 - half :: 2] = forward(net, pos[1 - half :: 2])[0], forward(net, unl[1 - half :: 2])[0]
    cuts = np.quantile(p, np.linspace(0.02, 0.3, 60))
    p, u = np.sort(p), np.sort(u)
    above_p, above_u = (1 - np.searchsorted(s, cuts) / len(s) for s in (p, u))
    chance = np.sqrt(above_u * (1 - above_u) / len(u))
    return float(np.clip(((above_u + chance / 2) / np.maximum(above_p, 1e-9)).min(), 0.01, 0.99))


def featured(texts: DataFrame) -> np.ndarray:
    """The features of the sampled rows, in the order of their ids; the texts stay on the executors."""

    def run(batches):
        for b in batches:
            x = [features(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(lean(run), f"doc_id {kind}, x array<double>").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").collect()
    return np.array([r["x"] for r in rows])


def fit(positive: DataFrame, unlabelled: DataFrame) -> dict | None:
    """A model from two samples (doc_id, text)."""
    pos, unl = featured(positive), featured(unlabelled)
    if len(pos) < 8 or len(unl) < 8:
        return None
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    share = prior(pos, unl)
    return {"mean": mean, "scale": scale, "prior": share, "net": minimise(pos, unl, share)}


def predict(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x = (np.array([features(t) for t in texts]) - model["mean"]) / model["scale"]
    return sigmoid(forward(model["net"], x)[0])


def score(df: DataFrame, model: dict | None, text: str = "text", name: str = "score") -> DataFrame:
    """df without its texts, with the probability that each is good."""
    keep = [f for f in df.schema.fields if f.name != text]
    (name,) = fresh([f.name for f in keep], name)

    def run(batches):
        for b in batches:
            p = predict(model, [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), pa.array(p, pa.float64())], [*(f.name for f in keep), name])

    return df.mapInArrow(lean(run), T.StructType([*keep, T.StructField(name, T.DoubleType())]))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of rows whose id has crc32 modulo 4 equal to 2 are not learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter((remainder("doc_id", 4) != 2) & (F.col("quality") == 1))
    model = fit(sample(docs, good, POSITIVE, 8), sample(docs, docs.select("doc_id"), UNLABELLED, 9))
    return score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

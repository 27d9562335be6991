"""Bounded samples of labelled rows, and how they are held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole


def remainder(doc_id: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo `of`; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(0))


def sample(docs: DataFrame, ids: DataFrame, n: int, seed: int) -> DataFrame:
    """(doc_id, text) of at most n ids, those with the least hashes: reruns agree.  Texts of any length are learnt from, and stay on the
    executors.  Of rows with one id, the least text counts."""
    some = ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)
    chosen = docs.sparkSession.createDataFrame(some.collect(), ids.select("doc_id").schema)  # n rows at most, so they can be broadcast
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))

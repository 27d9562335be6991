"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, mixing, BPE.

Each stage calls one operator of cairn.llm, works on all rows that the stage before kept, and is written as Parquet and read again.
All but the last return the columns of documents.  Rows with nulls, empty texts, repeated rows and empty tables have the results that the
operators' docstrings define; a text that a stage shortens gets a new n_chars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, common, mixing, quality, simhash, substrings

#: Bytes of a passage that the third stage removes.  Passages of over 50 words have 250 bytes and more.
PASSAGE = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    common.configure(spark)
    with common.stage(docs):
        out = quality.judge(docs)
        (kept,) = [c for c in out.columns if c not in docs.columns and c.lstrip("_") == "kept"]
        return out.filter(kept).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    common.configure(spark)
    with common.stage(docs):
        return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that occur anywhere else go from the texts."""
    common.configure(spark)
    with common.stage(docs):
        out = substrings.remove(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources holds it."""
    common.configure(spark)
    with common.stage(docs):
        return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers."""
    common.configure(spark)
    with common.stage(docs):
        own = docs.select("doc_id", common.whole().alias("text"), *(c for c in ("lang", "source") if c in docs.columns))
        out = bpe.encode(own, bpe.public_path())
    return out.select(*(c for c in own.columns if c != "text"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mix sources", mix_sources), ("encode", encode_texts)]

#: SQL has neither the estimates of the first stage nor the tokens of the last; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = common.spool(out)
        if before is not None and i < len(STAGES) - 1:
            common.unspool(before)
        docs, before = out, out
    return docs

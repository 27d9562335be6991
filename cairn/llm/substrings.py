"""Suffix-array dedup (operator 10): bytes covered by strings of `length` bytes (LENGTH, if none is given) that begin anywhere else too.

No machine can sort all suffixes of a corpus, so places that can't match are told apart first (`anchors`): each window of `length` bytes
chooses an anchor by its content, and equal windows choose equal anchors.  An anchor with the windows that choose it and the bytes that
these cover is a context.

1. Equal texts become one, with a count; the texts are written in buckets of their key, so that later joins don't move them again.
2. Anchors that occur once are dropped.  Contexts that are equal, byte for byte, repeat with all their windows.
3. Of each anchor with several different contexts, one of each is fetched.  Contexts that share an anchor are put into one block of text,
   whose suffix array two-stage sorting makes (`suffix`); suffixes whose common prefix with a neighbour has `length` bytes are repeated.
4. An anchor with over CROWD different contexts - a passage that many documents share, each with other surroundings - would need a block
   as large as its crowd.  Its windows are counted by hash, where they are first, instead: the exact way for what blocks can't hold.
5. Repeated windows of a text are joined to runs and removed.

Hashes have 64 bits and are compared only among texts that agree in another one of 64 bits.

Defined results: null text counts as empty; texts with under `length` bytes lose nothing; equal texts with `length` bytes or more lose all;
texts may repeat within themselves, with overlaps; repeated rows give repeated rows; an empty table gives an empty table.  `remove` passes
other columns on and keeps whole characters: a run that begins or ends within a character is shortened to the next whole one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import LENGTH, anchors, hashed, ranges, run_hash
from .common import lean, partitions, remember, shared_dir, spool, table, unspool, whole
from .suffix import repeated_starts

#: Different contexts of an anchor that one block may hold; bytes of a block that further anchors may join; bytes hashed at once.
CROWD, BLOCK, PIECE = 2048, 1 << 19, 1 << 20


def key(text: str, seed: int):
    return F.xxhash64(F.lit(seed), whole(text))


def bucketed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, in buckets of k1 and k2."""
    spark, name = df.sparkSession, f"cairn_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(partitions(spark), "k1", "k2").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._cairn_path = path
    remember(spark, path, name)
    return out


def pieces(texts: list[bytes], length: int = LENGTH):
    """(numbers of texts, offset, bytes): texts together up to PIECE bytes; a longer text in parts that overlap by length - 1."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > PIECE:
            for at in range(0, len(t) - length + 1, PIECE - length + 1):
                yield [i], at, [t[at : at + PIECE]]
            continue
        if size + len(t) > PIECE:
            yield some, 0, [texts[j] for j in some]
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some, 0, [texts[j] for j in some]


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(h, c, k1, k2, lo, hi): the anchors of each text, as `anchors` says."""

    def run(batches):
        for b in batches:
            values = [t or b"" for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            k1, k2 = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("k1", "k2"))
            for which, offset, own in pieces(values, length):
                n, h, first, last, context = anchors(np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own]), length)
                of = np.array(which)[n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, context, k1[of], k2[of], first + offset, last + offset)], ["h", "c", "k1", "k2", "lo", "hi"])

    return texts.mapInArrow(lean(run), "h long, c long, k1 long, k2 long, lo long, hi long")


def fetch(wanted: DataFrame, length: int) -> DataFrame:
    """(h, crowd, many, k1, k2, lo, data): the bytes of contexts, from rows of (k1, k2, text, need)."""

    def run(batches):
        names = ["h", "crowd", "many", "k1", "k2", "lo", "data"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            out = []
            for k1, k2, text, need in zip(*(b.column(b.schema.get_field_index(x)) for x in ("k1", "k2", "text", "need"))):
                text, k1, k2 = text.as_py().encode(), k1.as_py(), k2.as_py()
                for x in need.as_py():
                    out.append((x["h"], x["crowd"], x["many"], k1, k2, x["lo"], text[x["lo"] : x["hi"] + length]))
                    if len(out) == 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return wanted.mapInArrow(lean(run), "h long, crowd long, many boolean, k1 long, k2 long, lo long, data binary")


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def in_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): windows that repeat among contexts of one anchor, by a suffix array for each block of anchors.  Windows of contexts
    that have equals elsewhere are known to repeat, so only others are reported."""

    def solve(block):
        data = np.frombuffer(b"".join(x[4] for x in block), np.uint8)
        size = np.array([len(x[4]) for x in block])
        room = np.repeat(np.cumsum(size), size) - np.arange(len(data))
        hit = repeated_starts(data, room, length)
        start = np.cumsum(size) - size
        hit &= ~np.repeat(np.array([x[0] for x in block]), size)
        first, last = runs(hit)  # a run ends with its context: no window begins in a context's last bytes
        of = np.searchsorted(start, first, side="right") - 1
        k1, k2, lo = (np.array([x[i] for x in block])[of] for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, lo + first - start[of], lo + last - start[of])], ["k1", "k2", "lo", "hi"])

    def run(batches):
        block, size, last = [], 0, None
        for b in batches:
            for h, *x in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("h", "many", "k1", "k2", "lo", "data"))):
                if size >= BLOCK and h != last:
                    yield solve(block)
                    block, size = [], 0
                block.append(x)
                size += len(x[4])
                last = h
        if block:
            yield solve(block)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(lean(run), "k1 long, k2 long, lo long, hi long")


def by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): windows that repeat among contexts of one anchor, by counts of their hashes."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                data = [x.as_py() for x in part.column(part.schema.get_field_index("data"))]
                size = np.array([len(x) for x in data])
                prefix, down = hashed(np.frombuffer(b"".join(data), np.uint8))
                start, n = np.cumsum(size) - size, size - length + 1
                at = ranges(start, n)
                of = np.repeat(np.arange(len(data)), n)
                h, k1, k2, lo = (part.column(part.schema.get_field_index(x)).to_numpy()[of] for x in ("h", "k1", "k2", "lo"))
                w = run_hash(prefix, down, at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, w, k1, k2, lo + at - start[of])], ["h", "w", "k1", "k2", "lo"])

    windows = contexts.mapInArrow(lean(run), "h long, w long, k1 long, k2 long, lo long")
    twice = spool(windows.groupBy("h", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "w"))
    return windows.join(twice, ["h", "w"]).select("k1", "k2", "lo", F.col("lo").alias("hi"))


def repeated(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): runs of windows, by their starts, that begin elsewhere too, among the distinct texts(k1, k2, text)."""
    spark = texts.sparkSession
    all_anchors = spool(anchor_rows(texts.select("k1", "k2", "text"), length))
    twice = spool(all_anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))  # on its own, so that the join can split hot keys
    met = spool(all_anchors.join(twice, "h"))
    unspool(all_anchors, twice)
    kinds = met.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one"))
    kinds = spool(kinds.select("h", "c", (F.col("n") > 1).alias("many"), "one.*"))
    direct = spool(met.join(kinds.filter("many").select("h", "c"), ["h", "c"]).select("k1", "k2", "lo", "hi"))
    unspool(met)
    crowd = spool(kinds.groupBy("h").agg(F.count("*").alias("crowd")).filter("crowd > 1"))
    need = kinds.join(crowd, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "crowd", "many", "lo", "hi")).alias("need"))
    contexts = spool(fetch(texts.join(need, ["k1", "k2"]), length))
    spark._jvm.System.gc()  # so that shuffle files nobody reads any more leave the disks
    found = spool(in_blocks(contexts.filter(F.col("crowd") <= CROWD), length).union(by_hash(contexts.filter(F.col("crowd") > CROWD), length)))
    unspool(kinds, crowd, contexts)
    return direct.union(found)


def removed(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, spans, kept): what each of texts(k1, k2, n, text) loses; spans are (start, end) in bytes."""
    spans = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    rows = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.octet_length("text") - length).cast("long").alias("hi")))).otherwise(F.col("found")).alias("found"))

    def run(batches):
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for text, found in zip(*(b.column(b.schema.get_field_index(x)) for x in ("text", "found"))):
                text, spans = (text.as_py() or "").encode(), []
                if found.is_valid and len(text) >= length:
                    flat = found.values.flatten()
                    lo, hi = (np.asarray(f) for f in flat)
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
                    cut = np.flatnonzero(lo[1:] > end[:-1])
                    spans = [*zip(lo[np.concatenate([[0], cut + 1])].tolist(), end[np.concatenate([cut, [len(end) - 1]])].tolist())]
                at, kept = 0, []
                for a, z in spans:
                    kept.append(text[at:a])
                    at = z
                out.append((len(text), sum(z - a for a, z in spans), [{"start": a, "end": z} for a, z in spans], b"".join([*kept, text[at:]])))
            cols = [*zip(*out)] or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(x)) for x in ("k1", "k2")), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pair), pa.array(cols[3], pa.binary())], ["k1", "k2", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(lean(run), "k1 long, k2 long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, n, text): each different text and how many rows hold it; equal texts become one before they are shuffled."""
    rows = df.select(key(text, 1).alias("k1"), key(text, 2).alias("k2"), whole(text).alias("text"))
    out = bucketed(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("text").alias("text")))
    df.sparkSession._jvm.System.gc()
    return out


def deduplicate(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, spans, kept) for each different text of df; k1 and k2 are `key`s of a text with seeds 1 and 2."""
    texts = distinct_texts(df, text)
    return removed(texts, repeated(texts, length), length)


def remove(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """df without the repeated bytes of its texts, in whole characters."""

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(b.schema.get_field_index("_text")).to_pylist(), b.column(b.schema.get_field_index("spans")).to_pylist()):
                t, at, kept = t.encode(), 0, []
                for s in spans:
                    a, z = s["start"], s["end"]
                    while a < z and t[a] & 0xC0 == 0x80:
                        a += 1
                    while z > a and z < len(t) and t[z] & 0xC0 == 0x80:
                        z -= 1
                    kept.append(t[at:a])
                    at = z
                out.append(b"".join([*kept, t[at:]]).decode())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in ("_1", "_2")] + [pa.array(out, pa.string())], ["_1", "_2", "_new"])

    texts = distinct_texts(df, text)
    lost = removed(texts, repeated(texts, length), length).filter("n_removed > 0").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "spans")
    rows = df.select(F.struct(*df.columns).alias("_row"), key(text, 1).alias("_k1"), key(text, 2).alias("_k2"))
    both = texts.select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), F.col("text").alias("_text")).join(lost, (F.col("_a") == F.col("_1")) & (F.col("_b") == F.col("_2"))).select("_1", "_2", "_text", "spans")
    new = both.mapInArrow(lean(run), "_1 long, _2 long, _new string")
    out = rows.join(new, (F.col("_k1") == F.col("_1")) & (F.col("_k2") == F.col("_2")), "left")
    return out.select(*(F.coalesce("_new", f"_row.{c}").alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in df.columns))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses, as counts, a digest of what it keeps and the removed runs themselves, as (start, end) in bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate(docs)
    out = out.select("k1", "k2", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans")
    rows = docs.select("doc_id", key("text", 1).alias("k1"), key("text", 2).alias("k2"))
    return rows.join(out, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")

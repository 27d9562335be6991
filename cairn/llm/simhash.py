"""SimHash near-duplicates by the generalised pigeonhole principle (operator 6).

`fingerprints` makes 64-bit SimHash values of word shingles.  `plan` splits the 64 bits into partitions: correlated bits go together, so
that partitions are as independent of each other as they can be, and thresholds t_1 .. t_m with sum(t) = radius - m + 1 are allocated by
dynamic programming on estimated candidate counts (t = -1: a partition is not probed).  Two fingerprints within the radius agree within
t_i bits in some partition i; `links` probes these and verifies each candidate.

A partition with threshold 1 or 2 is probed at one bit from both sides.

The estimates come from a sample of SAMPLE distinct fingerprints; the plan decides the cost alone, never the result.

Equal fingerprints are one node from the start.  A bucket that holds over CROWD distinct fingerprints - a large family of near copies, or
bits that hardly vary - is not compared by pairs: each of its fingerprints is dealt out under itself and its neighbours within half the
radius.  Two fingerprints are within the radius if and only if they meet under some number, and only so many can meet (65 for radius 2,
2081 for radius 4), so hot buckets cost time in proportion to their size.  The radius is even.

The query links fingerprints of words in threes at 2 bits.  `deduplicate` links texts whose sets of five-word shingles have a similarity of
0.8 or more (`resemblance`), unless it is given a radius: such texts lie about 10 of 64 bits apart, which no probing of 64 bits can afford.

Defined results: null and empty texts, and texts of white space, have fingerprint 0, which links like any other; a text with fewer words
than a shingle counts as one shingle; null ids don't count as the smallest id of a component, which is null if it has no other; repeated
rows are all in one component; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import fresh, lean, spool, table, unspool, whole
from .components import components, forest
from .resemblance import resembling

WORDS, SEED, RADIUS = 3, 42, 2
SAMPLE, CROWD, MOST_PARTS, MOST_T = 3000, 128, 6, 2
#: Words of a shingle of near-duplicates, where no contract says otherwise.
NEAR_WORDS = 5


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a text; a number from 0 to 2**64 - 1."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both are of ASCII only
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(w) - words + 1], ends[words - 1 :]
    count, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        part = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist())]
        count += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", words: int = WORDS) -> DataFrame:
    """df without its texts and with the fingerprint of each as a (signed) long."""
    keep = [f for f in df.schema.fields if f.name != text]
    (name,) = fresh([f.name for f in keep], name)

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t or "", words) for t in b.column(b.schema.get_field_index(text)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), pa.array(got)], [*(f.name for f in keep), name])

    return df.mapInArrow(lean(run), T.StructType([*keep, T.StructField(name, T.LongType())]))


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of nearly equal size, each grown from its most correlated bits."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(float)
    scatter = bits.std(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs(np.nan_to_num(((bits - bits.mean(0)).T @ (bits - bits.mean(0))) / max(1, len(bits)) / np.outer(scatter, scatter)))
    np.fill_diagonal(c, 0)
    left, out = list(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        part = [left.pop(int(np.argmax(c[np.ix_(left, left)].sum(1))))]
        while len(part) < size:
            part.append(left.pop(int(np.argmax(c[np.ix_(left, part)].sum(1)))))
        out.append(sorted(part))
    return out


def mask_of(part: list[int]) -> int:
    return sum(1 << b for b in part)


def candidate_rates(sample: np.ndarray, part: list[int]) -> list[float]:
    """Estimated shares of pairs that differ in at most 0, 1 .. MOST_T bits of a partition: the sample's, or what independent bits would
    give if that is more."""
    s = sample & np.uint64(mask_of(part))
    rates = np.zeros(MOST_T + 1)
    pairs = max(1, len(s) * (len(s) - 1) // 2)
    for i in range(len(s) - 1):
        d = np.bitwise_count(s[i + 1 :] ^ s[i])
        rates += [(d <= t).sum() for t in range(MOST_T + 1)]
    bits = (sample[:, None] >> np.array(part, np.uint64) & np.uint64(1)).mean(0) if len(sample) else np.full(len(part), 0.5)
    differ = np.zeros(len(part) + 1)
    differ[0] = 1
    for p in 2 * bits * (1 - bits):
        differ[1:] = differ[1:] * (1 - p) + differ[:-1] * p
        differ[0] *= 1 - p
    return np.maximum(rates / pairs, np.cumsum(differ)[: MOST_T + 1]).tolist()


def keys_for(width: int, t: int) -> int:
    """Rows that a fingerprint becomes in a partition with threshold t."""
    return 0 if t < 0 else 1 if t == 0 else 1 + width


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 to MOST_T, one for each partition, that sum up to total at least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, MOST_T + 1):
                if s + t not in new or cost + c[t + 1] < new[s + t][0]:
                    new[s + t] = (cost + c[t + 1], [*ts, t])
        best = new
    return best.get(total, (float("inf"), []))


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe among n distinct fingerprints, by estimated rows and candidate pairs."""
    choices, sample = [], sample if len(sample) else np.zeros(1, np.uint64)
    for m in range(1, MOST_PARTS + 1):
        parts = group_bits(sample, m)
        costs = []
        for p in parts:
            rates = candidate_rates(sample, p)
            costs.append([0.0] + [20.0 * n * keys_for(len(p), t) + rates[MOST_T * (t > 0)] * n * n / 2 for t in range(MOST_T + 1)])
        cost, ts = allocate(costs, radius - m + 1)
        choices.append((cost, m, [(p, t) for p, t in zip(parts, ts) if t >= 0]))
    return min(choices)[2]


def flips(value: F.Column, bits: list[int], most: int = 1) -> F.Column:
    """The value and those that differ from it in at most `most` of the bits."""
    masks = [mask_of(list(c)) for k in range(most + 1) for c in itertools.combinations(bits, k)]
    text = ",".join(f"{m - (1 << 64 if m >> 63 else 0)}" for m in masks)
    return F.transform(F.split(F.lit(text), ",").cast("array<bigint>"), lambda x: value.bitwiseXOR(x))


def spans_of(groups: DataFrame, radius: int) -> DataFrame:
    """Verified links of each row's fingerprints, as a forest: (a, b) with at most a link for each fingerprint."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            sizes = np.diff(at)
            out_a, out_b = [], []
            two = at[:-1][sizes == 2]  # most have two
            a, b = flat[two], flat[np.minimum(two + 1, len(flat) - 1)]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            out_a.append(a[near]), out_b.append(b[near])
            for i in np.flatnonzero(sizes > 2).tolist():
                v = flat[at[i] : at[i + 1]]
                x, y = np.nonzero(np.triu(np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64)) <= radius, 1))
                if len(x):
                    a, b = forest(v[x], v[y])
                    out_a.append(a), out_b.append(b)
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.mapInArrow(lean(run), "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among distinct fingerprints nodes(fp) whose components are those of all pairs within `radius` bits."""
    n = nodes.count()
    rows = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    chosen = plan(np.array([r[0] for r in rows], np.int64).view(np.uint64), n, radius)
    probes = []
    for i, (bits, t) in enumerate(chosen):
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits) - (1 << 64 if 63 in bits else 0)).cast("long"))
        keys = F.array(own) if t == 0 else flips(own, bits)
        probes.append(F.transform(keys, lambda k, i=i: F.struct(F.lit(i).alias("part"), k.alias("key"))))
    dealt = nodes.select("fp", F.explode(F.concat(*probes)).alias("at")).select("fp", "at.part", "at.key")
    many = spool(dealt.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1"))  # on its own, so that the join can split hot keys
    met = spool(dealt.join(many, ["part", "key"]))
    usual = met.filter(F.col("n") <= CROWD).groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    crowded = met.filter(F.col("n") > CROWD).select("fp").distinct()
    near = crowded.select("fp", F.explode(flips(F.col("fp"), list(range(64)), radius // 2)).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").filter(F.size("fps") > 1)
    out = spool(spans_of(usual.union(near), radius).distinct())
    unspool(met, many)
    return out


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(k1, k2, doc_id, fp, component_id, stays) for each row of df: k1 and k2 hash id and text; of each component one pair of them stays,
    that of the smallest id."""
    ids = df.select(F.xxhash64(doc_id, whole(text)).alias("k1"), F.xxhash64(F.lit(1), whole(text), doc_id).alias("k2"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = spool(fingerprints(ids, words=words))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = spool(rows.groupBy("fp").agg(F.min(lead).alias("lead")))
    tree = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(tree, F.col("fp") == F.col("a"), "left").select("fp", "lead", F.coalesce("b", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    of = rooted.select("fp", "root").join(first, "root").select("fp", "first")
    out = rows.join(of, "fp")
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    return out.select("k1", "k2", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), stays.alias("stays"))


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = NEAR_WORDS, radius: int | None = None) -> DataFrame:
    """The rows of df, one of each component of near-duplicates: the one with the smallest id.  With a radius, fingerprints of 64 bits
    are compared, otherwise shingles."""
    near = resembling(df, text, doc_id, words) if radius is None else near_duplicates(df, text, doc_id, words, radius)
    stay = near.filter("stays").select(F.col("k1").alias("_s1"), F.col("k2").alias("_s2")).distinct()
    row = df.select(F.struct(*df.columns).alias("_row"), F.xxhash64(doc_id, whole(text)).alias("_k1"), F.xxhash64(F.lit(1), whole(text), doc_id).alias("_k2"))
    kept = row.join(stay, (F.col("_k1") == F.col("_s1")) & (F.col("_k2") == F.col("_s2")), "left_semi")
    w = Window.partitionBy("_k1", "_k2").orderBy(F.xxhash64(*(f"_row.`{c}`" for c in df.columns)))  # of rows with one id and text, the same one each time
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("_row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and the smallest id of its component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

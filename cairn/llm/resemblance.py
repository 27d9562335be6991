"""Near-duplicates by shingle similarity: long SimHash sketches probed by partitions, every candidate verified exactly.

64 bits can't be probed out to a similarity of 0.8, where they differ in 9.7 bits.  `sketch` makes as many bits as `layout` asks for: parts
of equal width, in which a fingerprint and those one bit away are probed from both sides, so that two texts meet where a part differs in
at most 2 bits.  There are so many parts that texts of exactly SIMILARITY meet in one with probability RECALL, more similar ones more
often; the width grows with the number of texts, so that unlike texts seldom meet.  64 further bits, and then the whole sketch, discard
those that did.  What remains is verified by the exact Jaccard similarity of the sets of shingles.

A bucket with over CROWD texts, or a bucket of whole parts with over CLOSE, is not compared as it is; `crowded_links` takes the texts of
all such buckets.  They are dealt into random
blocks of bounded size, and within a block all links are found exactly; the texts with most links, one of each component of a block, are
dealt out again.  Families of copies become one component by this, in time proportional to their size.  What can still be missing are
links between different components.  Texts that are connected by crowded buckets make a family; those outside a family's largest
component are compared with all of the family, block by block, from their sets of shingles, so that no pair but a link is ever a row.

Defined results: null and empty texts have an empty set and are alike; a text with fewer words than a shingle is one shingle; repeated
shingles count once.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .anchors import ranges
from .common import lean, spool, unspool, whole
from .components import components, forest

SEED, SIMILARITY, RECALL = 42, 0.8, 0.995
CROWD, CLOSE, BLOCK = 32, 4, 256
#: Rounds of blocks at most, and texts of a family that a block is compared with in one task.
LEVELS, SPLIT = 6, 4096
#: Bits of 64 in which texts of SIMILARITY hardly ever differ (5 standard deviations), and that share of a whole sketch.
CHECK_BITS, FAR = 24, 0.25
#: Rows of keys that a task sorts, about, and tasks at most: beyond, tasks sort more, and spill.
TASK, TASKS = 1 << 19, 1 << 16


def shingles(text: str, words: int) -> np.ndarray:
    """The hashes of the different shingles of a text, sorted."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(w) - words + 1], ends[words - 1 :]
    out = [np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist())), np.uint64) for i in range(0, len(starts), 1 << 16)]
    return np.unique(np.concatenate(out))


def meets(width: int, similarity: float = SIMILARITY) -> float:
    """The probability that a part of two sketches differs in at most 2 bits."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(3))


def layout(n: int) -> tuple[int, int]:
    """(width, parts) at least estimated rows and pairs among n texts."""

    def parts(w: int) -> int:
        return math.ceil(math.log(1 - RECALL) / math.log1p(-meets(w)))

    def cost(w: int) -> float:
        return parts(w) * (n * (w + 1) + (1 + w + math.comb(w, 2)) / 2**w * n * n / 2)

    w = min(range(12, 33), key=cost)
    return w, parts(w)


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of shingles in words of 64 bits."""
    count = np.zeros(64 * words, np.int64)
    steps = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for i in range(0, len(hashes), 255 * 16):
        x = hashes[i : i + 255 * 16, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):
            count += bits[j : j + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes)).view(np.uint64)


def sketched(df: DataFrame, text: str, doc_id: str, words: int, size: int) -> DataFrame:
    """(k1, k2, doc_id, node, n, sketch) for each row; equal sets of shingles have equal nodes."""
    ids = df.select(F.xxhash64(doc_id, whole(text)).alias("k1"), F.xxhash64(F.lit(1), whole(text), doc_id).alias("k2"), F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def run(batches):
        for b in batches:
            node, n, made = [], [], []
            for t in b.column(3).to_pylist():
                s = shingles(t, words)
                node.append(xxh64_intdigest(s.tobytes(), SEED)), n.append(len(s)), made.append(sketch(s, size).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(made, pa.binary())], ["k1", "k2", "doc_id", "node", "n", "sketch"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(lean(run), f"k1 long, k2 long, doc_id {kind}, node long, n long, sketch binary")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, size)


def keys_of(sketches: np.ndarray, width: int, parts: int) -> np.ndarray:
    """The key of each part of each sketch."""
    bits = np.unpackbits(sketches.view(np.uint8), axis=1)[:, 64 : 64 + width * parts].reshape(len(sketches), parts, width)
    return (bits @ (1 << np.arange(width, dtype=np.int64))) + (np.arange(parts, dtype=np.int64) << 32)


def close(nodes: DataFrame, width: int, parts: int, size: int) -> DataFrame:
    """(a, b): texts a and marks b < 0 of the buckets of whole parts that over CLOSE texts share."""

    def run(batches):
        for b in batches:
            ids, s = np.asarray(b.column(0)), matrix(b.column(1), size)
            for i in range(0, len(ids), 256):
                keys = keys_of(s[i : i + 256], width, parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[i : i + 256], parts))], ["key", "id"])

    own = spool(nodes.select("id", "sketch").mapInArrow(lean(run), "key long, id long"))
    many = spool(own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CLOSE).select("key"))
    out = spool(own.join(many, "key").select(F.col("id").alias("a"), (-1 - F.col("key")).alias("b")))
    unspool(own, many)
    return out


def dealt(nodes: DataFrame, width: int, parts: int, size: int) -> DataFrame:
    """(key, id, mark, family): each of nodes(id, sketch, family) under its parts and those one bit away."""
    flip = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)

    def run(batches):
        for b in batches:
            ids, s, family = np.asarray(b.column(0)), matrix(b.column(1), size), np.asarray(b.column(2))
            for i in range(0, len(ids), 256):
                few = s[i : i + 256]
                keys = (keys_of(few, width, parts)[:, :, None] ^ flip).reshape(len(few), -1)
                k = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, k)) for x in (ids[i : i + 256], few[:, 0].view(np.int64), family[i : i + 256]))], ["key", "id", "mark", "family"])

    return nodes.select("id", "sketch", "family").mapInArrow(lean(run), "key long, id long, mark long, family long")


def whole_groups(batches, by: int):
    """Columns of sorted batches, joined so that rows that agree in the first `by` columns stay together."""
    held, rows = [], 0
    for batch in batches:
        part = [np.asarray(c) for c in batch.columns]
        if not len(part[0]):
            continue
        held.append(part)
        rows += len(part[0])
        if rows < 1 << 16:
            continue
        now = [np.concatenate(x) for x in zip(*held)]
        same = np.logical_and.reduce([x == x[-1] for x in now[:by]])
        end = int(np.argmax(same))  # the last group may go on
        held, rows = [[x[end:] for x in now]], len(now[0]) - end
        if end:
            yield [x[:end] for x in now]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def met(keys: DataFrame, rows: int) -> DataFrame:
    """Pairs a < b of different families that share a key and whose marks are near; for a in a crowded bucket, b is below 0 and says which
    one.  There are `rows` keys at most, which are dealt to so many tasks that each holds a bounded part."""

    def pairs(key, ids, mark, family):
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([new, [len(key)]]))
        crowd = np.repeat(sizes > CROWD, sizes)
        lone = np.unique(np.stack([ids[crowd], -1 - key[crowd]], 1), axis=0)
        many = ~crowd & np.repeat(sizes > 1, sizes)
        key, ids, mark, family = key[many], ids[many], mark[many].view(np.uint64), family[many]
        out, at, d = [], np.arange(len(key)), 1
        while True:  # at: rows whose bucket goes on for d rows
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            near = at[(family[at] != family[at + d]) & (np.bitwise_count(mark[at] ^ mark[at + d]) <= CHECK_BITS)]
            out.append(np.stack([np.minimum(ids[near], ids[near + d]), np.maximum(ids[near], ids[near + d])], 1))
            d += 1
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        got = np.concatenate([got, lone])
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    def run(batches):
        for held in whole_groups(batches, 1):
            yield pairs(*held)

    return keys.repartition(min(TASKS, -(-rows // TASK)), "key").sortWithinPartitions("key").mapInArrow(lean(run), "a long, b long")


def plausible(pairs: DataFrame, nodes: DataFrame, family: DataFrame, size: int) -> DataFrame:
    """The pairs whose sizes and whole sketches allow SIMILARITY, but for those within a family: all of these are compared elsewhere."""
    one = nodes.join(family, F.col("id") == F.col("a"), "left").select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"), F.col("b").alias("f_a"))
    two = one.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("s_a").alias("s_b"), F.col("f_a").alias("f_b"))
    apart = ~F.coalesce(F.col("f_a") == F.col("f_b"), F.lit(False))
    fit = (F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b") - 1e-6) & apart
    both = pairs.join(one, "a").join(two, "b").filter(fit).select("a", "b", "s_a", "s_b")

    def run(batches):
        for b in batches:
            near = np.bitwise_count(matrix(b.column(2), size) ^ matrix(b.column(3), size)).sum(1, dtype=np.int64) <= FAR * 64 * size
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(lean(run), "a long, b long")


def held_sets(wanted: DataFrame, df: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """(a, s_a): the sets of shingles of wanted(a, k1, k2), as a table of its own."""
    texts = df.select(F.xxhash64(doc_id, whole(text)).alias("k1"), F.xxhash64(F.lit(1), whole(text), doc_id).alias("k2"), whole(text).alias("text")).join(wanted, ["k1", "k2"]).select("a", "text")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["a", "s_a"])

    return spool(texts.mapInArrow(lean(sets), "a long, s_a binary").dropDuplicates(["a"]))


def leads(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, k1, k2): a row that has the set of each of ids(a)."""
    return ids.distinct().join(nodes.select(F.col("id").alias("a"), "lead"), "a").select("a", F.col("lead.k1").alias("k1"), F.col("lead.k2").alias("k2"))


def verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """The pairs of exact similarity SIMILARITY or more, as a table of its own."""
    pairs = spool(pairs)
    held = held_sets(leads(pairs.select("a").union(pairs.select("b")), nodes), df, text, doc_id, words)

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= SIMILARITY * (len(x) + len(y) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(held, "a").join(held.select(F.col("a").alias("b"), F.col("s_a").alias("s_b")), "b").select("a", "b", "s_a", "s_b")
    out = spool(both.mapInArrow(lean(run), "a long, b long"))
    unspool(pairs, held)
    return out


def similar(index: tuple[np.ndarray, np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """Which sets of an index (sorted shingles, whose they are, sizes of the sets) have SIMILARITY or more to s."""
    flat, owner, size = index
    lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
    same = np.bincount(owner[ranges(lo, hi - lo)], minlength=len(size))
    return same >= SIMILARITY * (size + len(s) - same) - 1e-9


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of sets that have SIMILARITY or more, the smaller place first."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    index = flat[order], owner[order], size
    out_a, out_b = [], []
    for i, s in enumerate(sets):
        j = np.flatnonzero(similar(index, s))
        j = j[j > i]
        out_a.append(np.full(len(j), i)), out_b.append(j)
    return np.concatenate(out_a), np.concatenate(out_b)


def block_links(sets: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(a, b): the links within random blocks of sets(a, s_a), as forests; and (a, null) for one text of each component of a block."""

    def run(batches):
        for batch in batches:
            for xs in batch.column(0).to_pylist():
                ids, own = np.array([x["a"] for x in xs], np.int64), [np.frombuffer(x["s_a"], np.uint64) for x in xs]
                x, y = alike(own)
                degree = np.bincount(np.concatenate([x, y]), minlength=len(ids))
                a, b = forest(x, y) if len(x) else (x, y)
                root = np.arange(len(ids))
                root[a] = b
                best = np.lexsort([ids, -degree, root])
                first = best[np.concatenate([[True], root[best][1:] != root[best][:-1]])]
                null = np.concatenate([np.zeros(len(a), bool), np.ones(len(first), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate([a, first])]), pa.array(ids[np.concatenate([b, first])], mask=null)], ["a", "b"])

    rows = sets.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "a"), F.lit(blocks)))
    return rows.groupBy("block").agg(F.collect_list(F.struct("a", "s_a")).alias("xs")).select("xs").mapInArrow(lean(run), "a long, b long")


def contracted(sets: DataFrame, n: int) -> DataFrame:
    """(a, b): links among sets(a, s_a) that blocks find, block after block of those that lead, until there is one block or little falls."""
    now, links, drop = sets, [], []
    for level in range(LEVELS):
        got = spool(block_links(now, -(-n // BLOCK), level))
        links.append(got.filter("b is not null"))
        drop.append(got)
        lead = got.filter("b is null").select("a")
        before, n = n, lead.count()
        if before <= BLOCK or n > 0.9 * before:
            break
        now = now.join(lead, "a")
    out = spool(functools.reduce(DataFrame.union, links))
    unspool(*drop)
    return out


def across(known: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different roots of a family in known(id, family, root), as forests of the blocks in which they are found."""
    sums = known.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    sums = spool(sums.filter(F.col("all") > F.col("main.n")).select("family", F.col("main.root").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("g"), F.ceil(F.col("all") / SPLIT).alias("h")))
    rows = known.join(sums, "family").join(sets, F.col("id") == F.col("a")).select("family", "id", "root", "main", "g", "h", "s_a")
    some, one = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)), lambda of: F.pmod(F.xxhash64("id"), F.col(of))
    outside = rows.filter(F.col("root") != F.col("main")).withColumn("i", one("g")).withColumn("j", some("h")).withColumn("side", F.lit(0))
    every = rows.withColumn("i", some("g")).withColumn("j", one("h")).withColumn("side", F.lit(1))
    both = outside.unionByName(every).select("family", "i", "j", "side", "id", "root", "s_a").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side")

    def run(batches):
        group, ids, roots, held, index, got = None, [], [], [], None, []

        def links():
            x, y = np.array(got, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (forest(x, y) if len(x) else (x, y))], ["a", "b"])

        for b in batches:
            for family, i, j, side, own, root, data in zip(*(c.to_pylist() for c in b.columns)):
                if group != (family, i, j):
                    if got:
                        yield links()
                    group, ids, roots, held, index, got = (family, i, j), [], [], [], None, []
                s = np.frombuffer(data, np.uint64)
                if side == 0:
                    ids.append(own), roots.append(root), held.append(s)
                    continue
                if not held:
                    continue
                if index is None:
                    size = np.array([len(x) for x in held])
                    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), size)
                    order = np.argsort(flat, kind="stable")
                    index, other = (flat[order], owner[order], size), np.array(roots)
                got += [(ids[k], own) for k in np.flatnonzero(similar(index, s) & (other != root)).tolist()]
        if got:
            yield links()

    return both.mapInArrow(lean(run), "a long, b long").distinct()


def crowded_links(crowded: DataFrame, n: int, links: DataFrame, sets: DataFrame) -> DataFrame:
    """links and further ones that join the components of crowded(id, family) as all links would."""
    links = spool(links.union(contracted(sets, n)))
    tree = components(links)
    known = spool(crowded.join(tree, F.col("id") == F.col("a"), "left").select("id", "family", F.coalesce("b", "id").alias("root")))
    out = spool(links.union(across(known, sets)))
    unspool(tree, known, links)
    return out


def resembling(df: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """(k1, k2, stays) for each row of df: of each component of texts with a similarity of SIMILARITY or more, the pair of the smallest id
    stays."""
    n = max(2, df.count())
    width, parts = layout(n)
    size = 1 + -(-width * parts // 64)
    rows = spool(sketched(df, text, doc_id, words, size))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = spool(rows.groupBy("node").agg(F.min(lead).alias("lead"), F.min("n").alias("n"), F.min("sketch").alias("sketch")).withColumn("id", F.monotonically_increasing_id()))
    near = close(nodes, width, parts, size)
    first = components(near)
    grouped = nodes.join(first, F.col("id") == F.col("a"), "left").select("id", "sketch", F.coalesce("b", "id").alias("family"))
    found = spool(met(dealt(grouped, width, parts, size), n * parts * (width + 1)).distinct())
    family = components(near.union(found.filter("b < 0")))
    unspool(near, first)
    crowded = spool(family.filter("a >= 0").select(F.col("a").alias("id"), F.col("b").alias("family")))
    n = crowded.count()
    links = verified(plausible(found.filter("b >= 0"), nodes, family, size), nodes, df, text, doc_id, words)
    if n:
        sets = held_sets(leads(crowded.select(F.col("id").alias("a")), nodes), df, text, doc_id, words)
        links = crowded_links(crowded, n, links, sets)
        unspool(sets)
    unspool(family)
    tree = components(links)
    unspool(found, crowded, links)
    rooted = nodes.join(tree, F.col("id") == F.col("a"), "left").select("node", "lead", F.coalesce("b", "id").alias("root"))
    first = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    of = rooted.select("node", "root").join(first, "root").select("node", "first")
    return rows.join(of, "node").select("k1", "k2", ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("stays"))

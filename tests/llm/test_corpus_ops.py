"""Operators that compare documents: against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import anchors, components, mixing, quality, resemblance, simhash, substrings, suffix


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, n):
    return " ".join("".join(rng.choices("aeinorstl", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def family():
    """Texts with copies, near copies, shared passages, texts that repeat themselves, short, empty and null ones."""
    rng = random.Random(7)
    base = [prose(rng, 150) for _ in range(12)]
    passage = prose(rng, 110)
    out = [*base, base[0], base[0], base[1]]
    for i in range(8):
        w = base[2].split()
        w[10 * i + 3] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(6)]
    out += [base[3] + " " + base[3], "x y " * 300, "é" * 500, "short", "short", "", None, None, " \n ", "a" * 399, "a" * 400, "b" * 900]
    return [(i if i != 5 else None, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


# suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 3), max_size=80), st.lists(st.integers(0, 255), max_size=80), st.builds(lambda a, n: a * n, st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12))), st.integers(1, 25))
def test_suffix_array(symbols, depth):
    t = np.array(symbols, np.uint8)
    s = t.tobytes()
    order = suffix.suffix_array(t, depth).tolist() if len(t) else []
    heads = [s[i : i + depth].ljust(depth, b"\0") for i in order]
    assert sorted(order) == list(range(len(t))) and heads == sorted(heads)
    count = Counter(s[i : i + depth] for i in range(len(s) - depth + 1))
    want = [i + depth <= len(s) and count[s[i : i + depth]] > 1 for i in range(len(s))]
    assert suffix.repeated_starts(t, len(t) - np.arange(len(t)), depth).tolist() == want


def test_anchors_depend_on_content_alone():
    rng = random.Random(1)
    shared = prose(rng, 200).encode()
    a, b = prose(rng, 30).encode() + shared, prose(rng, 77).encode() + shared + b" end"
    t, h, lo, hi, _ = anchors.anchors(np.frombuffer(a + b, np.uint8), np.array([len(a), len(b)]))
    chosen = [{}, {}]
    for n, x, i, j in zip(t.tolist(), h.tolist(), lo.tolist(), hi.tolist()):
        chosen[n].update(dict.fromkeys(range(i, j + 1), x))
    assert [len(c) for c in chosen] == [len(a) - 399, len(b) - 399]
    for i in range(len(shared) - 399):
        assert chosen[0][len(a) - len(shared) + i] == chosen[1][b.find(shared) + i]


def brute_removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        spans = []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(spans)
    return data, out


@pytest.mark.parametrize("length", [40, 240])
def test_substrings_of_other_lengths(spark, family, length):
    df = docs(spark, family)
    texts = [t for _, t, *_ in family]
    data, want = brute_removed(texts, length)
    got = {(r["k1"], r["k2"]): r for r in substrings.deduplicate(df, length=length).collect()}
    for r in df.select("text", substrings.key("text", 1).alias("k1"), substrings.key("text", 2).alias("k2")).collect():
        assert [[s["start"], s["end"]] for s in got[r["k1"], r["k2"]]["spans"]] == want[texts.index(r["text"])]


@pytest.mark.parametrize("crowd", [2048, 1])
@pytest.mark.parametrize("block", [1 << 20, 1])
def test_substrings(spark, family, monkeypatch, crowd, block):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "BLOCK", block)
    df = docs(spark, family)
    data, want = brute_removed([t for _, t, *_ in family])
    got = {(r["k1"], r["k2"]): r for r in substrings.deduplicate(df).collect()}
    rows = df.select("text", substrings.key("text", 1).alias("k1"), substrings.key("text", 2).alias("k2")).collect()
    for r in rows:
        i = [t for _, t, *_ in family].index(r["text"])
        g = got[r["k1"], r["k2"]]
        assert [[s["start"], s["end"]] for s in g["spans"]] == want[i], (i, want[i])
        at, kept = 0, b""
        for a, z in want[i]:
            kept += data[i][at:a]
            at = z
        assert bytes(g["kept"]) == kept + data[i][at:] and g["n_removed"] == sum(z - a for a, z in want[i]) and g["n_bytes"] == len(data[i])


def test_substrings_of_long_texts(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 1000)
    texts = [b"x" * 100, bytes(range(256)) * 12, b"y" * 500]
    got = []
    for which, offset, own in substrings.pieces(texts):
        n, _, lo, hi, _ = anchors.anchors(np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own]))
        got += [(which[k], w) for k, a, b in zip(n.tolist(), lo.tolist(), hi.tolist()) for w in range(a + offset, b + offset + 1)]
    assert sorted(got) == [(i, w) for i, t in enumerate(texts) for w in range(len(t) - 399)]


def test_substrings_removed_in_characters(spark, family):
    df = docs(spark, family).withColumn("_row", F.lit(1))
    out = substrings.remove(df)
    assert out.columns == df.columns and out.count() == len(family)
    assert out.filter("doc_id = 0").first()["text"] == "" and out.filter("text is null").count() == 2
    assert substrings.remove(df.limit(0)).count() == 0


# SimHash


def brute_fingerprint(text, words=3):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB éÉ\n\t\x0b\x85 xyz", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [2, 4])
@pytest.mark.parametrize("crowd", [128, 3])
def test_links(spark, monkeypatch, radius, crowd):
    """Chains and clusters of fingerprints, with the crowded path and without."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(radius)
    values = []
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            values.append(v)
            for b in rng.sample(range(64), rng.choice([1, radius, radius + 1])):
                v ^= 1 << b
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    tree = {r["a"]: r["b"] for r in components.components(simhash.links(nodes, radius)).collect()}
    groups = {}
    for v, c in zip(signed, brute_components(values, radius)):
        groups.setdefault(c, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(tree.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_plans_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    for sample in (rng.integers(0, 2**63, 400).astype(np.uint64), np.zeros(5, np.uint64), np.zeros(0, np.uint64)):
        for radius in (2, 4):
            for n in (10, 10**6, 10**9):
                chosen = simhash.plan(sample, n, radius)
                bits = [b for p, _ in chosen for b in p]
                m_all = [m for m in range(1, simhash.MOST_PARTS + 1) if sum(t + 1 for _, t in chosen) == radius + 1]
                assert len(bits) == len(set(bits)) and m_all and all(t >= 0 for _, t in chosen)


def test_near_duplicates(spark, family):
    df = docs(spark, family)
    fps = [brute_fingerprint(t) for _, t, *_ in family]
    roots = brute_components(fps, 2)
    smallest = {}
    for (i, *_), c in zip(family, roots):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, 10**9))
    want = Counter((i, f"{f:016x}", smallest.get(c)) for (i, *_), f, c in zip(family, fps, roots))
    out = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert Counter(map(tuple, out.collect())) == want
    left = simhash.deduplicate(df.union(df), words=3, radius=2)
    assert left.columns == df.columns and left.count() == len(set(roots))
    assert simhash.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [64, 3])
def test_similar_texts(spark, monkeypatch, crowd):
    """Copies of a similarity of 0.8 or more go, as brute force over exact similarities says; less similar ones stay."""
    monkeypatch.setattr(resemblance, "CROWD", crowd)
    monkeypatch.setattr(resemblance, "BLOCK", 8)
    monkeypatch.setattr(resemblance, "SPLIT", 2)
    rng, texts = random.Random(3), ["", None, "short", "Short ", "one two three four five six"]
    for i in range(40):
        base = prose(rng, 160).split()
        for changed in {0: [0, 1, 2, 3, 4, 5, 6], 1: [0, 3]}.get(i % 2):
            w = list(base)
            for at in rng.sample(range(2, 150, 6), changed):
                w[at] = "changed" + str(rng.randrange(10**6))
            texts.append(" ".join(w))
    sets = [{" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    want = {min(j for j in range(len(texts)) if root[j] == r) for r in set(root)}
    df = docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    left = simhash.deduplicate(df.union(df))
    assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=8), min_size=1, max_size=12))
def test_alike(values):
    sets = [np.array(sorted(v), np.uint64) for v in values]
    a, b = resemblance.alike(sets)
    want = {(i, j) for j in range(len(values)) for i in range(j) if len(values[i] & values[j]) >= 0.8 * len(values[i] | values[j]) - 1e-9}
    assert {*zip(a.tolist(), b.tolist())} == want


def test_large_family(spark, monkeypatch):
    """A family of copies much larger than a block, some of them too far from all others, against brute force."""
    monkeypatch.setattr(resemblance, "CROWD", 10)
    monkeypatch.setattr(resemblance, "BLOCK", 16)
    rng, base = random.Random(9), prose(random.Random(8), 150).split()
    texts = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(2, 148, 4), 30 if i % 15 == 0 else rng.randint(0, 5)):
            w[at] = "new" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    left = simhash.deduplicate(docs(spark, rows).repartition(5))
    assert {r["doc_id"] for r in left.collect()} == brute_near([*enumerate(texts)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (-5, 300)]
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(50)}, 300: -5, 299: -5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 30):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 5, 100, 3000]) for i in range(n)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i if i % 50 else None, prose(rng, rng.choice([0, 3, 40])) if i % 20 else None, None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 1) for i in range(1500)]
    df = docs(spark, rows + rows[:30]).withColumn("key", F.lit("clash"))
    small = mixing.BUCKET
    mixing.BUCKET = 40
    try:
        out = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(7)).collect()
    finally:
        mixing.BUCKET = small
    assert Counter(out) == Counter(again) and out[0].asDict().keys() == set(df.columns)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in df.collect():
        sizes[r["source"]] += words(r["text"])
    for r in out:
        taken[r["source"]] += words(r["text"])
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 40, (s, taken[s], t)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_by_quality(spark, monkeypatch):
    """Weights that a column gives, far apart, null, NaN, zero and below: rows that weigh more come first, and no bucket holds a class of them."""
    weights = [0.1, 1e5, None, float("nan"), 0.0, -3.0]
    df = docs(spark, [(i, "one two three four", None, "a", 1) for i in range(6000)]).withColumn("_quality", F.element_at(F.array(*(F.lit(w).cast("double") for w in weights)), (F.col("doc_id") % 6 + 1).cast("int")))
    monkeypatch.setattr(mixing, "SHARE", 1 / 12)
    out = mixing.mix(df, "_quality").collect()
    assert 490 <= len(out) <= 510 and {r["doc_id"] % 6 for r in out} == {1} and out[0].asDict().keys() == set(df.columns)
    drawn = mixing.keyed(df, "_quality")
    rows = mixing.in_buckets(drawn, mixing.sources(drawn).withColumn("rest", F.lit(0.0)))
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 2 * mixing.BUCKET
    order = [r["bucket"] for r in rows.orderBy("key").collect()]
    assert order == sorted(order) and mixing.mix(df.limit(0), "_quality").count() == 0


def test_mix_takes_by_key(spark):
    """What is taken beyond whole epochs are the least keys: brute force over all rows."""
    rng = random.Random(8)
    df = docs(spark, [(i, prose(rng, rng.randint(1, 30)), None, rng.choice("aab"), 1) for i in range(600)])
    drawn = mixing.keyed(df).cache()
    made = {r["source"]: r for r in mixing.plan(drawn).collect()}
    rows = mixing.copies(drawn, mixing.plan(drawn)).collect()
    for s, p in made.items():
        own, total = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["key"], r["tie"])), 0
        rest = p["target"] - p["epochs"] * p["source_size"]
        for r in own:
            total += r["size"]
            assert r["copies"] == p["epochs"] + (rest > total - r["size"] / 2), (s, r, rest, total)


# quality


def test_judge(spark):
    rng = random.Random(9)
    good = [(i, prose(rng, rng.randint(60, 200)) + "." * rng.randint(0, 3), rng.choice(["en", "de"]), "s", 1) for i in range(300)]
    junk = [(1000 + i, "### | " + " | ".join(prose(rng, 1) for _ in range(80)), "en", "s", 1) for i in range(20)]
    odd = [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "a b c " * 60, "en", "s", 1), (2003, prose(rng, 100), None, "", 1)]
    df = docs(spark, good + junk + odd + odd).withColumn("n_words", F.lit("clash"))
    out = quality.judge(df)
    rows = out.collect()
    assert out.columns[:6] == df.columns and "_n_words" in out.columns and len(rows) == 328
    kept = Counter((r["doc_id"] // 1000, r["kept"]) for r in rows)
    assert kept[0, True] >= 297 and kept[1, True] == 0
    assert [r["kept"] for r in sorted(rows, key=lambda r: r["doc_id"])[-8:]] == [False] * 6 + [True] * 2
    assert quality.judge(df.limit(0)).count() == 0


def brute_mcd(x, kept, ridge, tries=200):
    """The least determinant that exact concentration reaches from many starts, with its centre and scatter."""
    rng, best = np.random.default_rng(0), None
    h, extra = int(np.ceil(kept * len(x))), np.diag(np.square(ridge))
    for _ in range(tries):
        some = x[rng.choice(len(x), 5, replace=False)]
        c, s = some.mean(0), np.cov(some.T, bias=True)
        for _ in range(30):
            d = x - c
            near = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(s + extra), d), kind="stable")[:h]]
            c, s = near.mean(0), np.cov(near.T, bias=True)
        det = np.linalg.det(s + extra)
        if best is None or det < best[0]:
            best = det, c, s
    return best


@pytest.mark.parametrize("few", [20_000, 0])
def test_estimates_against_numpy(spark, monkeypatch, few):
    """Robust estimates of two groups with outliers, some rows few enough to begin from all: as the best of many starts by brute force."""
    monkeypatch.setattr(quality, "PRIOR", 0)
    monkeypatch.setattr(quality, "FEW", few)
    rng = np.random.default_rng(3)
    groups = {}
    for g, n in (("a", 900), ("b", 200)):
        mix = rng.normal(0, 1, (4, 4))
        x = rng.normal(0, 1, (n, 4)) @ mix + rng.normal(0, 3, 4)
        x[: n // 5] = rng.normal(0, 0.3, (n // 5, 4)) + 15  # a tight cluster that classical estimates follow
        groups[g] = np.round(x * 1024).astype(int)
    rows = [(g, *map(int, r), i) for g, x in groups.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{s} long" for s in quality.STATS) + ", n_words long").repartition(7)
    got = {r["g"]: r for r in quality.fit(df, "g").collect()}
    for g, x in groups.items():
        det, c, s = brute_mcd(x / 1024, quality.KEPT, quality.RIDGE)
        cov = np.array(got[g]["inverse"]).reshape(4, 4)
        assert np.linalg.det(np.linalg.inv(cov)) <= det * 1.02 and np.allclose(got[g]["center"], c, atol=0.15)
        d = x / 1024 - got[g]["center"]
        assert (np.einsum("ij,jk,ik->i", d, cov, d)[: len(x) // 5] / got[g]["scale"] > quality.CUT).all()


def test_plain_estimates_against_numpy(spark, monkeypatch):
    """With all rows kept, centre and scatter are numpy's mean and covariance; a group's is drawn to that of all rows as PRIOR says."""
    monkeypatch.setattr(quality, "KEPT", 1.0)
    rng = np.random.default_rng(4)
    x = {"a": np.round(rng.normal(0, 1, (500, 4)) * 1024).astype(int), "b": np.round(rng.normal(1, 2, (30, 4)) * 1024).astype(int), "c": np.array([[5, 6, 7, 8]])}
    df = spark.createDataFrame([(g, *map(int, r), 1) for g, v in x.items() for r in v], "g string, " + ", ".join(f"{s} long" for s in quality.STATS) + ", n_words long")
    got = {r["g"]: r for r in quality.fit(df, "g").collect()}
    every = np.concatenate([*x.values()]) / 1024
    assert got.keys() == x.keys()
    for g, v in x.items():
        v, part = v / 1024, len(v) / (len(v) + quality.PRIOR)
        center = part * v.mean(0) + (1 - part) * every.mean(0)
        cov = part * (np.cov(v.T, bias=True) if len(v) > 1 else 0) + (1 - part) * np.cov(every.T, bias=True)
        assert np.allclose(got[g]["center"], center) and np.allclose(np.linalg.inv(np.array(got[g]["inverse"]).reshape(4, 4)), cov + np.diag(np.square(quality.RIDGE)))


def test_each_statistic_rejects_alone(spark):
    """Long words, symbols, repeated lines and repeated words: each far share is rejected among clean texts, one repeated line is not."""
    rng = random.Random(12)
    good = [(i, "\n".join(prose(rng, rng.randint(9, 14)) for _ in range(8)), "en", "s", 1) for i in range(300)]
    line = prose(rng, 3)
    odd = [
        (1000, " ".join("".join(rng.choices("abcdef", k=14)) for _ in range(120)), "en", "s", 1),
        (1001, " ".join(f"{prose(rng, 1)}|" for _ in range(120)), "en", "s", 1),
        (1002, "\n".join([line] * 17 + [prose(rng, 60)]), "en", "s", 1),
        (1003, "\n".join(prose(rng, 11) for _ in range(5)) + "\n" + " ".join([(p := prose(rng, 24)), "x", p]), "en", "s", 1)]
    once = [(2000, good[0][1] + "\n" + good[0][1].split("\n")[0], "en", "s", 1)]
    rows = {r["doc_id"]: r for r in quality.judge(docs(spark, good + odd + once)).collect()}
    assert not any(rows[i]["base_failed"] for i in (1000, 1001, 1002, 1003, 2000))
    assert [rows[i]["kept"] for i in (1000, 1001, 1002, 1003, 2000)] == [False] * 4 + [True], [(i, rows[i]["d2"]) for i in (1000, 1001, 1002, 1003, 2000)]
    assert sum(rows[i]["kept"] for i in range(300)) >= 298


# queries


def test_contract_queries(spark, sf_dir, duck):
    from tokenizers import Tokenizer

    from cairn.llm import bpe, registry

    rows = dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_flac"](spark, sf_dir).collect()}
    import zlib

    for i, t in rows.items():
        b = t.encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    tok = Tokenizer.from_file(bpe.public_path())
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_bpe"](spark, sf_dir).collect()}
    for i, t in rows.items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_substrings"](spark, sf_dir).collect()}
    data, spans = brute_removed([*rows.values()])
    for i, t, s in zip(rows, data, spans):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(t), sum(b - a for a, b in s), len(s))


def brute_near(rows, words=5, least=0.8):
    """Ids that stay of (id, text): the smallest of each component of texts whose shingles have this similarity."""
    sets = [{" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    return {min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root)}


def test_pipeline_of_odd_tables(spark, sf_dir):
    """Nulls in every column, an empty and a very long text, repeated rows, names that clash, and an empty table pass all stages."""
    import corpus_pipeline as p

    from cairn.llm import common

    rng = random.Random(14)
    same = prose(rng, 60)
    rows = [(i, prose(rng, 150), "en", "s", 1) for i in range(40)] + [(i, f"{prose(rng, 80)}\n{same} {prose(rng, 80)}", None, None, None) for i in range(40, 46)]
    rows += [(None, prose(rng, 100), "de", "t", 5), (60, None, None, None, None), (61, "", "en", "s", 0), (62, prose(rng, 60_000), "en", "s", 1)]
    df = docs(spark, rows + rows[:3]).withColumns({c: F.lit(c) for c in ("kept", "_kept", "key", "_row", "size", "ids", "k1", "spans", "copies")})
    for some in (df, df.limit(0)):
        out = some
        for _, stage in p.STAGES[:4]:
            out = common.spool(stage(spark, out, sf_dir))
            assert out.columns == df.columns
        last = p.STAGES[4][1](spark, out, sf_dir).collect()
        assert bool(last) == (some is df)
    assert all(same[:200] not in r["text"] for r in out.collect()) and {"doc_id", "n_tokens", "ids"} <= set(p.STAGES[4][1](spark, df.drop("lang", "source"), sf_dir).columns)


def test_pipeline_passages(spark, sf_dir):
    """Passages of 51 to 63 words that documents share go, and only these."""
    import corpus_pipeline as p

    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, clean = [], {}
    for n in range(51, 64, 2):
        passage = words(n)
        for _ in range(3):
            a, b = words(200), words(150)
            clean[len(rows)] = a, b, passage
            rows.append((len(rows), f"{a} {passage} {b}", "en", "s", 1))
    for r in p.substring_dedup(spark, docs(spark, rows), sf_dir).collect():
        a, b, passage = clean[r["doc_id"]]
        assert r["text"].startswith(a[:-4]) and r["text"].endswith(b[4:]) and len(r["text"]) <= len(a) + len(b) + 2  # neighbours may agree by chance


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from cairn.llm import bpe, common

    assert [n for n, _ in p.STAGES] and len(p.STAGES) == 5
    d0 = common.table(spark, sf_dir, "documents")
    outs = [d0]
    for _, stage in p.STAGES[:4]:
        out = common.spool(stage(spark, outs[-1], sf_dir))
        assert out.columns == d0.columns
        outs.append(out)
    ids = [Counter(r["doc_id"] for r in o.select("doc_id").collect()) for o in outs]
    verdict = {r["doc_id"] for r in quality.op7_quality(spark, sf_dir).filter("kept").collect()}
    assert set(ids[1]) == verdict
    own = sorted((r["doc_id"], r["text"]) for r in outs[1].collect())
    assert set(ids[2]) == brute_near(own)
    rows = {r["doc_id"]: r["text"] for r in outs[2].collect()}
    data, spans = brute_removed([*rows.values()], p.PASSAGE)
    left = {r["doc_id"]: r for r in outs[3].collect()}
    for i, t, s in zip(rows, data, spans):
        cut = b"".join(t[a:b] for a, b in zip([0, *(z for _, z in s)], [*(a for a, _ in s), len(t)]))
        assert abs(len(left[i]["text"].encode()) - len(cut)) <= 6 * len(s) and left[i]["n_chars"] == len(left[i]["text"])
    assert max(ids[4].values()) <= 2 and set(ids[4]) <= set(ids[3])
    tok = Tokenizer.from_file(bpe.public_path())
    last = p.STAGES[4][1](spark, outs[4], sf_dir).collect()
    assert Counter(r["doc_id"] for r in last) == ids[4]
    assert all(np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tok.encode(left[r["doc_id"]]["text"], add_special_tokens=False).ids for r in last[:50])
    final = p.run(spark, sf_dir)
    assert Counter(r["doc_id"] for r in final.select("doc_id").collect()) == ids[4]

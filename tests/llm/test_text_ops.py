"""Operators that work on one text at a time: against libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import attribution, bpe, chat, flac, pu, quality, toxicity

texts = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ae#1é|ñ<x>"), st.characters(codec="utf-8")), max_size=200)
SOME = ["", " ", "a", "<|endoftext|>", "x<|endoftext|>y", "ab" * 3000, "#" * 500, "don't we'll", " \n\n  x", "é" * 100, "日本語 text", "a b " * 50, "\x00\x1c\x85"]


def prose(rng, n):
    return " ".join("".join(rng.choices("aeinorstl", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.public_path())


def test_bpe_fixed(reference, codec):
    for t, got in zip(SOME, codec.encode(SOME)):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids and codec.decode(got) == reference.decode(ids, skip_special_tokens=False) == t


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=4))
def test_bpe(reference, codec, values):
    for t, got in zip(values, codec.encode(values)):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids and codec.decode(got) == t


def test_bpe_short_and_long_words_agree(codec):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdetns", k=rng.randint(1, bpe.SHORT))).encode() for _ in range(500)]
    assert codec.short(words) == [codec.long(w) for w in words]


def test_bpe_remembers_only_so_many(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    values = [f"w{i} x{i}" for i in range(40)]
    assert [codec.decode(x) for x in codec.encode(values)] == values and len(codec.known) <= 200
    assert [codec.decode(x) for x in codec.encode(["other"])] == ["other"]


@settings(max_examples=100, deadline=None)
@given(texts, st.sampled_from(attribution.RULES))
def test_attribution(reference, codec, text, rule):
    """Against the library's offsets, token by token."""
    ids = codec.encode([text])[0]
    lengths = np.array([len(x) for x in codec.bytes_of])
    first, end = attribution.spans(text, ids, lengths) if ids else (np.zeros(0, np.int64),) * 2
    data, at, want = text.encode(), 0, []
    chars = [i for i, ch in enumerate(text) for _ in ch.encode()]
    for i in np.frombuffer(ids, "<u4").tolist():
        n = len(codec.bytes_of[i])
        want.append((chars[at], chars[at + n - 1] + 1))
        at += n
    assert at == len(data) and [*zip(first.tolist(), end.tolist())] == want
    starts = attribution.paragraph_starts(text)
    got = attribution.attribute(first, end, starts, len(text), rule)
    count = np.zeros(len(starts))
    for a, b in want:
        met = Counter(int(np.searchsorted(starts, x, side="right")) - 1 for x in range(a, b))
        if rule == "split":
            for s, n in met.items():
                count[s] += n / (b - a)
        else:
            count[{"first": min(met), "last": max(met), "most": max(met, key=lambda s: (met[s], -s))}[rule]] += 1
    assert np.allclose(got, count) and np.isclose(got.sum(), len(want))


def test_bpe_columns(spark, reference):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x y " * 20_000, "c"), (4, "é!", "d"), (4, "é!", "d")], "id long, text string, ids string")
    out = bpe.encode(df, bpe.public_path(), decoded="decoded")
    assert out.columns == ["id", "text", "ids", "_ids", "decoded"] and bpe.encode(df.limit(0), bpe.public_path()).count() == 0
    for r in out.collect():
        assert np.frombuffer(bytes(r["_ids"]), "<u4").tolist() == reference.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert bpe.decode(out, bpe.public_path(), "_ids", "text").columns[-1] == "_text"


def test_attribution_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "one two\n\nthree " * 3000, "c"), (4, "x", "d"), (4, "x", "d")], "id long, text string, n_tokens string")
    out = attribution.token_counts(df, bpe.public_path())
    rows = out.orderBy("id").collect()
    assert len(rows) == 5 and rows[3] == rows[4] and attribution.token_counts(df.limit(0), bpe.public_path()).count() == 0
    name = [c for c in out.columns if c.lstrip("_") == "n_tokens"][-1]
    sections = [c for c in out.columns if c.lstrip("_") == "sections"][-1]
    assert name != "n_tokens" and [r[name] for r in rows][:2] == [0, 0] and all(np.isclose(sum(s["n_tokens"] for s in r[sections]), r[name]) for r in rows)


def test_attribution_of_fields(spark):
    df = spark.createDataFrame([(1, "one two", None, "three"), (2, "", "x", "")], "id long, a string, b string, c string")
    out = attribution.token_counts(attribution.join_fields(df, ["a", "b", "c"]), bpe.public_path(), starts="starts").orderBy("id").collect()
    assert [[s["n_tokens"] for s in r["sections"]][1] for r in out] == [1.0, 2.0] and all(sum(s["n_tokens"] for s in r["sections"]) == r["n_tokens"] for r in out)


# FLAC


def wave(n, bits, rng):
    x = np.sin(np.arange(n) / 9) * (100 if bits == 8 else 9000) + rng.normal(0, 3, n)
    return (x + 128).astype(np.uint8).tobytes() if bits == 8 else x.astype("<i2").tobytes()


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("lpc", [0, 2, 8])
@pytest.mark.parametrize("block", [192, 576, 1000, 4096])
def test_flac_round_trip(bits, lpc, block):
    rng = np.random.default_rng(bits + lpc)
    values = [f(n) for n in (0, 1, 5, 192, 576, 577, 5000) for f in (lambda n: wave(n, bits, rng), lambda n: rng.bytes(n * bits // 8), lambda n: b"A" * (n * bits // 8))]
    streams = flac.encode_streams(values, bits, lpc, block)
    for v, (pcm, blocks) in zip(values, flac.decode_streams(streams)):
        assert pcm == v and sum(n for _, _, n in blocks) == len(v) * 8 // bits and [b[1] for b in blocks] == [b[0] * bits // 8 for b in blocks]
    bare = [s[:4] + b"\x80" + s[5:42] + s[flac.stream_info(s)["first"] :] for s in streams]  # frames found without a seek table
    assert [p for p, _ in flac.decode_streams(bare)] == values


def test_flac_damage():
    s = flac.encode_streams([wave(5000, 8, np.random.default_rng(1))])[0]
    for at in (-1, -700, -1500):
        x = bytearray(s)
        x[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(x)])


def test_flac_partitions_and_escapes():
    """A hand-made frame: two Rice partitions, one of them with raw residuals, and a fixed predictor."""
    samples = [3, 5, 4, 4, 7, 90, -90, 12, 0, 1, 2, 3, 2, 1, 0, -1]
    res = [b - a for a, b in zip(samples, samples[1:])]
    bits = "00010010" + f"{samples[0] & 255:08b}" + "00" + "0001" + "1111" + "01001"  # order 1; method 0, two partitions; raw with 9 bits
    bits += "".join(f"{r & 511:09b}" for r in res[:7]) + "0001"
    for r in res[7:]:
        u = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 1) + "1" + str(u & 1)
    head = bytes([0xFF, 0xF8, 6 << 4 | 4, 1 << 1, 0, 15])
    crc = 0
    for c in head:
        crc = int(flac.CRC8[crc ^ c])
    body = head + bytes([crc]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    sum16 = int(flac.crcs(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), flac.CRC16)[0])
    info = b"\0\x10\0\x10" + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body + sum16.to_bytes(2, "big")
    assert [b - 128 for b in flac.decode_streams([stream])[0][0]] == samples


def test_flac_columns(spark):
    df = spark.createDataFrame([(1, b"abc" * 64, "x"), (2, None, None), (3, b"", "y"), (1, b"abc" * 64, "x")], "id long, media binary, pcm string")
    out = flac.decode(flac.encode(df, "media"), "_media").orderBy("id").collect()
    assert [bytes(r["_pcm"]) for r in out] == [b"abc" * 64, b"abc" * 64, b"", b""] and out[0]["pcm"] == "x"
    rows = flac.blocks_of(flac.decode(flac.encode(df.drop("pcm"), "media"), "_media"), "id").filter("id = 1").collect()
    assert bytes(rows[0]["pcm"]) == b"abc" * 64 and rows[0]["sample"] == 0
    assert flac.encode(df.limit(0), "media").count() == 0


# chat


control = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "a", "<", "[", "s>", "é"]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(control, control)
def test_template(role, text):
    segment, start, n = chat.render_message(role, text, (role,))
    assert chat.read_message(segment) == (role, text) and chat.unescape(segment[start : start + n]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_fold(spark):
    e = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "he"), (1, 2, "delta", None, None, "llo"), (1, 3, "edit", 0, None, "hi!"), (1, 4, "message", None, "user", "again"),
        (1, 5, "regenerate", 1, "assistant", "new"), (1, 6, "delta", 1, None, "er"), (1, 7, "delta", 9, None, "lost"), (1, 8, "edit", None, None, "lost"), (1, 9, "other", None, None, "lost"),
        (2, 0, "delta", None, None, "x"), (2, None, None, None, None, None), (None, 0, "message", None, "user", "n")]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, target long, role string, text string").repartition(5)
    got = {}
    for r in chat.fold(df).collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["last"]))
    assert got == {1: [("user", "hi!", False), ("assistant", "newer", True)], 2: [("", "x", True)], None: [("user", "n", True)]}
    assert chat.fold(df.limit(0)).count() == 0


def test_log_of_turns(spark):
    """Drafts, edits, regenerations and deltas fold into the turns that were written as a log: ties, repeats, nulls, long texts."""
    rng = random.Random(6)
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "é" * 10 + "<s>"), (1, 1, "assistant", "tie"), (1, 2, None, None), (1, 2, None, None), (1, None, "user", "first"), (2, 0, "assistant", ""), (2, 5, "user", "x"), (3, 0, "assistant", prose(rng, 30_000)), (None, 0, "tool", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.as_events(df)
    assert {r["kind"] for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    got = {}
    for r in chat.fold(log).orderBy("pos").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {}
    for c, _, role, text in sorted(turns, key=lambda t: (t[0] or -1, -1 if t[1] is None else t[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: Counter(x) for c, x in got.items()} == {c: Counter(x) for c, x in want.items()} and got[1][:2] == want[1][:2] and got[3] == want[3]
    digests = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    assert digests == {c: len(x) for c, x in want.items()} and chat.as_events(df.limit(0)).count() == 0


def test_large_conversations_leave_memory(monkeypatch, tmp_path):
    monkeypatch.setattr(chat, "SPOOLED", 100)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path},/nowhere")
    c = chat.Conversation()
    for i in range(50):
        c.apply("message", None, "user", f"text {i} " * 10)
    assert [t for _, t in c] == [f"text {i} " * 10 for i in range(50)] and c.file._rolled
    monkeypatch.setenv("SPARK_LOCAL_DIRS", "/nowhere")
    c = chat.Conversation()
    with pytest.raises(FileNotFoundError):
        c.apply("message", None, "user", "long " * 100)


def test_op9(spark, sf_dir, duck):
    got = {r["conv_id"]: r for r in chat.op9_chat(spark, sf_dir).collect()}
    rows = {}
    for c, role, text in duck.execute("select conv_id, role, coalesce(text, '') from conversations order by conv_id, turn").fetchall():
        rows.setdefault(c, []).append((role, text))
    rows[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(rows)
    for c, turns in rows.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


# counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#", " ", "\n", "\x0b", "é", "|x", "a b a b"]), max_size=60).map("".join))
def test_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    want = (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))
    assert quality.counts_of(text) == want


def test_repeated_words_of_long_texts():
    rng = random.Random(2)
    words = rng.choices([b"a", b"b", b"c", b"d", *(b"%d" % i for i in range(30_000))], k=50_100)
    count = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if count[w] > 1 for j in (i, i + 1, i + 2)}
    assert quality.repeated_words(words) == len(covered)


# classifiers


def test_toxicity_learns_words(spark):
    rng = random.Random(3)
    plain = lambda: rng.choices([f"word{i}" for i in range(400)], k=80)
    ordinary = [" ".join(plain()) for _ in range(300)]

    def bad():
        w = plain()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(["zorblax", "quimfret", "vexnoid"]))
        return " ".join(w)

    toxic = [bad() for _ in range(300)]
    rows = [(i, t, int(i < 200)) for i, t in enumerate(toxic[:200] + ordinary[:200])]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), 0.5)
    p = toxicity.probability(np.array([toxicity.distances(t, model["dictionaries"]) for t in toxic[200:] + ordinary[200:]]), model["weights"])
    assert ((p >= 0.5) == np.repeat([True, False], 100)).mean() > 0.95
    assert toxicity.distances("", model["dictionaries"])[:2] == [0.0, 0.0]
    # the scorer against its definition, and tables with odd rows
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, toxic[250] * 400, "c"), (4, toxic[251], "d"), (4, toxic[251], "d"), (5, ordinary[250], "e")], "doc_id long, text string, score string")
    got = toxicity.score(df, model, name="score")
    assert got.columns == ["doc_id", "score", "_score"] and toxicity.score(df.limit(0), model).count() == 0
    import zstandard

    for r, (_, t, _) in zip(sorted(got.collect(), key=lambda r: r["doc_id"]), sorted(df.collect())):
        long = []
        for d in model["dictionaries"]:
            z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=toxicity.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            long.append(np.array([len(z.compress(w)) for w in toxicity.windows(t or "")]))
        d = np.sort(long[0] - long[1])[::-1].astype(float)
        x = [d[0], d[:3].mean(), np.log1p((d >= 3).sum()), np.log1p((d >= 4).sum()), d.mean()]
        assert abs(r["_score"] - 1 / (1 + np.exp(-(np.dot(x, model["weights"][:-1]) + model["weights"][-1])))) < 0.02
    ordinary_d, toxic_d = toxicity.train_by_zstandard([w for t in toxic for w in toxicity.windows(t)], [w for t in ordinary for w in toxicity.windows(t)], 4096)
    assert ordinary_d != toxic_d


def test_contexts(spark):
    """Against sets of pairs."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("ab c. d! E".split(), k=30)), i % 2) for i in range(9)] + [(20, None, 1), (21, "", 0)]
    want = {}
    for _, t, k in rows:
        w = [b"", *(x.strip(toxicity._strip) for x in (t or "").lower().encode().split()), b""]
        for i in range(1, len(w) - 1):
            want.setdefault(w[i], (set(), set()))[k].add((w[i - 1], w[i + 1]))
    got = toxicity.contexts(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()
    assert {bytes(r["word"]): (r["a"], r["b"]) for r in got} == {w: (len(x[1]), len(x[0])) for w, x in want.items()}


def test_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    for few in (none, spark.createDataFrame([(1, "a b c", 1), (2, None, 1)], none.schema), spark.createDataFrame([(i, "", i % 2) for i in range(9)], none.schema)):
        model = toxicity.fit(few, 0.25)
        assert all(abs(r["score"] - 0.25) < 1e-3 for r in toxicity.score(df, model).collect())
    assert [r["score"] for r in pu.score(df, None).collect()] == [0.5, 0.5]


def test_positive_unlabelled(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choices("abcdeilnorst", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 300))) + "."
    junk = lambda: rng.choice(["spam ", "### | ", "$$$ x "]) * rng.randint(60, 300)
    sample = lambda texts: spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    model = pu.fit(sample([good() for _ in range(200)]), sample([good() if rng.random() < 0.7 else junk() for _ in range(499)] + [None]))
    assert 0.5 < model["prior"] < 0.9
    p = pu.predict(model, [good() for _ in range(100)] + [junk() for _ in range(100)])
    assert (p[:100] >= 0.5).mean() > 0.95 and (p[100:] < 0.5).mean() > 0.95
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, good() * 500, "c"), (4, junk(), "d"), (4, junk(), "d")], "doc_id long, text string, score string")
    got = pu.score(df, model).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "score", "_score"} and all(0 <= r["_score"] <= 1 for r in got) and got[0]["_score"] == got[1]["_score"]
    assert pu.score(df.limit(0), model).count() == 0 and pu.fit(sample(["x"]), sample(["y"])) is None


def test_non_negative_risk_by_hand():
    """The gradient that `minimise` follows, against differences of the risk."""
    rng = np.random.default_rng(2)
    pos, unl, share = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (90, 3)), 0.4
    net = pu.start(3, rng)

    def risk(net):
        gp, gu = pu.forward(net, pos)[0], pu.forward(net, unl)[0]
        return share * np.logaddexp(0, -gp).mean() + np.logaddexp(0, gu).mean() - share * np.logaddexp(0, gp).mean()

    gp, hp = pu.forward(net, pos)
    gu, hu = pu.forward(net, unl)
    up, down, other = -pu.sigmoid(-gp) / len(gp), pu.sigmoid(gp) / len(gp), pu.sigmoid(gu) / len(gu)
    grad = [share * a + b - share * c for a, b, c in zip(pu.backward(net, pos, hp, up), pu.backward(net, unl, hu, other), pu.backward(net, pos, hp, down))]
    for i, at in ((0, (1, 2)), (1, (3,)), (2, (5,)), (3, (0,))):
        more, less = [w.copy() for w in net], [w.copy() for w in net]
        more[i][at] += 1e-5
        less[i][at] -= 1e-5
        assert abs((risk(more) - risk(less)) / 2e-5 - grad[i][at]) < 1e-6


def test_samples(spark):
    from cairn.llm import labelled

    docs = spark.createDataFrame([(i, "x" * (i * 3000)) for i in range(40)] + [(3, "twice"), (None, "none"), (50, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in labelled.sample(docs, docs.select("doc_id"), 100, 1).collect()}
    assert len(got) == 41 and len(got[39]) == 117000 and got[3] == "twice" and got[50] == ""
    some = labelled.sample(docs, docs.select("doc_id"), 7, 1).collect()
    assert len(some) == 7 and sorted(some) == sorted(labelled.sample(docs.repartition(5), docs.select("doc_id"), 7, 1).collect())


@pytest.mark.parametrize("name", ["op3_toxicity", "op8_pu_quality"])
def test_scores(spark, sf_dir, name):
    from cairn.llm import registry

    rows = registry.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows) and 0 < sum(r["held_out"] for r in rows) < 200

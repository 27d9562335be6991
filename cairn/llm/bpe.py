"""Byte-level BPE encoding and decoding (operator 4).

A text is cut at added tokens, then by the pre-tokenizer's pattern into words.  A word of at most SHORT bytes is merged in a
contiguous rank array: part boundaries and the ranks of adjacent parts lie side by side, the least rank is found by a scan, its
boundary is deleted and the ranks beside it are looked up anew.  The arrays of all words that a batch holds for the first time lie
under each other, so that one scan serves all.  Longer words keep their parts in a linked list and their ranks in a heap, so that a
text without a space costs n log n.  Words that recur come from a table of bounded size.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give repeated rows; an empty table gives an
empty table; columns that aren't asked for pass through `encode` unchanged, and the names of new columns get underscores in front if
they clash.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, table, whole

#: The pattern of the byte-level pre-tokenizer (fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and white space up to U+00FF, for a pattern that means the same in texts without other characters.
LETTER, DIGIT, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words of more bytes are merged by a heap.
SHORT = 48
#: Words that a worker remembers; the table is emptied when it is full.
REMEMBERED = 300_000
#: Characters of the texts that are split into words at once, about; a longer text alone.
TOGETHER = 1 << 19
NONE = np.int32(2**31 - 1)


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return out


class Codec:
    """Encodes and decodes as a byte-level BPE file of the tokenizers library says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        as_byte = {c: b for b, c in enumerate(chars)}
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(as_byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.id_of_byte = np.array([vocab[c] for c in chars], np.int32)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.empty(len(self.keys), np.int32)
        self.merged[self.ranks] = [self.pairs[k][1] for k in self.keys.tolist()]
        # an open-addressed table of the pairs: one or two probes instead of a binary search
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        for k, r in zip(self.keys.tolist(), self.ranks.tolist()):
            s = self.slot(k)
            while self.slots[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slots[s], self.slot_rank[s] = k, r
        self.any_words = regex.compile(PATTERN).findall
        self.latin_words = re.compile(LATIN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[str, bytes] = {}
        for token, i in self.added.items():
            self.known[token] = np.array([i], "<u4").tobytes()

    def forget(self) -> None:
        """Drop the words that are remembered: a worker that waits holds only the vocabulary."""
        self.known = {w: self.known[w] for w in self.added}

    def slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge."""
        key = a.astype(np.int64) << 20 | b
        s = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out, todo = np.full(len(key), NONE, np.int32), np.arange(len(key))
        while len(todo):
            at = self.slots[s[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.slot_rank[s[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
            s[todo] = (s[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most SHORT bytes, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        n = np.array([len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(n, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
            width = int(n[rows[0]])
            if not width:
                continue
            flat = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), width)
            parts = self.id_of_byte[flat]
            ranks = np.full((len(rows), width), NONE, np.int32)
            if width > 1:
                ranks[:, :-1] = self.rank_of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(rows), width - 1)
            for have in range(width, 0, -1):  # parts in each word that is left
                least = ranks.argmin(1)
                i = np.arange(len(rows))
                low = ranks[i, least]
                if (over := low == NONE).any():
                    ended = parts[over, :have].astype("<u4")
                    for row, ids in zip(rows[over].tolist(), ended):
                        out[row] = ids.tobytes()
                    rows, parts, ranks, least, low = rows[~over], parts[~over], ranks[~over], least[~over], low[~over]
                    i = np.arange(len(rows))
                if not len(rows):
                    break
                parts[i, least] = self.merged[low]
                moved = np.arange(have - 1)[None, :]
                moved = moved + (moved > least[:, None])  # without the boundary after the part that grew
                parts = np.take_along_axis(parts, moved, 1)
                ranks = np.take_along_axis(ranks, moved, 1)
                if have > 2:
                    right = least < have - 2
                    ranks[i[~right], least[~right]] = NONE
                    r, at = i[right], least[right]
                    ranks[r, at] = self.rank_of(parts[r, at], parts[r, at + 1])
                    left = least > 0
                    r, at = i[left], least[left]
                    ranks[r, at - 1] = self.rank_of(parts[r, at - 1], parts[r, at])
                else:
                    ranks[:] = NONE
        return out

    def long(self, word: bytes) -> bytes:
        """Ids of a word of any length, by a heap of ranks over linked parts."""
        ids = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after, pairs = [*range(-1, n - 1)], [*range(1, n), -1], self.pairs
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a << 20 | b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := pairs.get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_words(text)
        return self.latin_words(text)

    def split(self, text: str) -> list[str]:
        if not self.cut or not (hits := [*self.cut.finditer(text)]):
            return self.words(text)
        out, at = [], 0
        for m in hits:
            out += [*self.words(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.  The words of TOGETHER characters are held at once."""
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t) > TOGETHER:
                out += self.together(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self.together(some)

    def together(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        known = self.known
        new = set().union(*split).difference(known)
        if len(known) + len(new) > REMEMBERED:
            self.forget()
            known = self.known
            new = set().union(*split).difference(known)
        short, longer = [], []
        for w in new:
            b = w.encode()
            (short if len(b) <= SHORT else longer).append((w, b))
        known.update(zip([w for w, _ in short], self.short([b for _, b in short])))
        apart = {w: self.long(b) for w, b in longer}  # long words rarely recur
        if apart:
            get = lambda w: known.get(w) or apart[w]
            return [b"".join(map(get, words)) for words in split]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with a binary column of ids (little-endian unsigned 32-bit); with decoded, also the text that these ids give back.

    path is the tokenizer's file, at the same place on every executor."""
    ids, *more = fresh(df.columns, ids, *[decoded] * bool(decoded))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType()), *[T.StructField(m, T.StringType()) for m in more]])

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            got = c.encode(texts)
            arrays = [pa.array(got, pa.binary())] + [pa.array([c.decode(x) for x in got], pa.string())] * bool(more)
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, ids, *more])
        c.forget()

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give an empty text."""
    (text,) = fresh(df.columns, text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        c = codec(path)
        for b in batches:
            got = [c.decode(x or b"") for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, text])

    return df.mapInArrow(lean(run), schema)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text that they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole().alias("text"))
    out = encode(docs, public_path(), decoded="decoded")
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

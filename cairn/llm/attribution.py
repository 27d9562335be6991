"""Token counts by offset-mapped attribution (operator 5).

A document is encoded once, as a whole, so that no token differs from those a model will see.  Each token has a span of characters; the
sections of the document (paragraphs, or fields that were joined to one text) have spans too.  Both lists are in order and spans of one
kind do not overlap, so the interval join of a document is one merge: the sections that a token meets are found by binary search for its
first and last character.  A token within one section counts there.  A token that crosses a boundary is allocated by RULE:

* `first`, `last`: to the first or last section that it meets,
* `most`: to the one with most of its characters, the first of equals,
* `split`: to each by its share of the token's characters.

Characters between sections, such as the line feeds that end paragraphs, belong to the section before them, those before the first
section to the first one, so every token counts once and the counts add up to the document's.

Defined results: a null text counts as empty; an empty text has one section (paragraphs) without tokens; empty and null fields are
sections without characters, which get no tokens; tokens that stand for part of a character have that character's span; repeated rows
give repeated rows; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Codec, public_path
from .common import fresh, lean, table

RULES = ("first", "last", "most", "split")
RULE = "most"
SECTIONS = T.ArrayType(T.StructType([T.StructField("section", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.DoubleType())]))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def spans(text: str, ids: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one character of each token: of the characters that hold its bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum(data & 0xC0 != 0x80) - 1  # the character of each byte
    end = np.cumsum(lengths[np.frombuffer(ids, "<u4")])
    return char[end - lengths[np.frombuffer(ids, "<u4")]], char[end - 1] + 1


def paragraph_starts(text: str) -> np.ndarray:
    """Starts of the lines that have other characters than white space; the first section begins with the text."""
    starts, at, seen = [0], 0, False
    for line in text.split("\n"):
        if line.strip():
            if seen:
                starts.append(at)
            seen = True
        at += len(line) + 1
    return np.array(starts, np.int64)


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, total: int, rule: str = RULE) -> np.ndarray:
    """Tokens of each section.  Sections begin at starts, each ends where the next begins; empty ones get none."""
    n = len(starts)
    count = np.zeros(n)
    if not len(first):
        return count
    bounds = np.append(starts, max(total, int(end[-1])))
    bounds[0] = 0
    a, b = (np.searchsorted(bounds[:-1], x, side="right") - 1 for x in (first, end - 1))
    inside = a == b
    count += np.bincount(a[inside], minlength=n)
    for i in np.flatnonzero(~inside).tolist():
        met = np.arange(a[i], b[i] + 1)
        part = np.minimum(bounds[met + 1], end[i]) - np.maximum(bounds[met], first[i])
        met, part = met[part > 0], part[part > 0]
        if rule == "first":
            count[met[0]] += 1
        elif rule == "last":
            count[met[-1]] += 1
        elif rule == "most":
            count[met[part.argmax()]] += 1
        else:
            count[met] += part / part.sum()
    return count


def token_counts(df: DataFrame, path: str, text: str = "text", starts: str | None = None, rule: str = RULE, name: str = "sections") -> DataFrame:
    """df without its texts and with the sections of each: number, start, end and tokens.  starts: a column of arrays with the starts of
    the sections, in order; without it, sections are paragraphs."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    keep = [f for f in df.schema.fields if f.name != text]
    name, total = fresh([f.name for f in keep], name, "n_tokens")
    schema = T.StructType([*keep, T.StructField(name, SECTIONS), T.StructField(total, T.LongType())])

    def run(batches):
        kind = pa.list_(pa.struct([("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())]))
        c = codec(path)
        lengths = np.array([len(x) for x in c.bytes_of])
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            given = b.column(b.schema.get_field_index(starts)).to_pylist() if starts else None
            out, sums = [], []
            for i, (t, ids) in enumerate(zip(texts, c.encode(texts))):
                first, end = spans(t, ids, lengths) if ids else (np.zeros(0, np.int64),) * 2
                s = paragraph_starts(t) if given is None else np.array(given[i] or [0], np.int64)
                count = attribute(first, end, s, len(t), rule)
                ends = np.append(s[1:], max(len(t), int(s[-1])))
                out.append([{"section": j, "start": x, "end": y, "n_tokens": k} for j, (x, y, k) in enumerate(zip(s.tolist(), ends.tolist(), count.tolist()))])
                sums.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), pa.array(out, kind), pa.array(sums, pa.int64())], [*(f.name for f in keep), name, total])
        c.forget()

    return df.mapInArrow(lean(run), schema)


def join_fields(df: DataFrame, fields: list[str], between: str = "\n", text: str = "text", starts: str = "starts") -> DataFrame:
    """df with its string fields joined to one text, and where each begins; null fields count as empty."""
    values = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    sizes = [F.lit(0).cast("long"), *(F.length(v).cast("long") + len(between) for v in values[:-1])]
    at, ends = F.lit(0).cast("long"), []
    for s in sizes:
        at = at + s
        ends.append(at)
    text, starts = fresh(df.columns, text, starts)
    return df.withColumns({text: F.concat_ws(between, *values), starts: F.array(*ends)})


def op5_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every paragraph of every document, as counts in the paragraphs' order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, public_path())
    return out.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), F.transform("sections", lambda s: s["n_tokens"].cast("long")).alias("section_tokens"))

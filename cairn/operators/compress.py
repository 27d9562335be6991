"""Compressed batches: differences of chains in a Huffman code, colours in blocks.  Work is per batch, on as many tasks as there are batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import blocks, huffman
from ..points import BATCH, CHAIN, batch_of

COMPRESSED = (
    "batch_id long, first_point long, num_points int, start_values array<long>, chain_bits array<long>, table_symbols array<long>, table_codes array<long>, table_lengths array<int>, "
    "encoding binary, separate array<long>, separate_at array<long>, color binary, min_x long, min_y long, min_z long, max_x long, max_y long, max_z long"
)
DECODED = "batch_id long, point_id long, X long, Y long, Z long, r long, g long, b long"


def encode_batch(xyz: np.ndarray, rgb: np.ndarray, chain: int = CHAIN, color: str = "bc1") -> dict:
    """The compressed form of a batch of lattice points."""
    n = len(xyz)
    starts = np.arange(0, n, chain)
    d = np.zeros_like(xyz)
    d[1:] = xyz[1:] - xyz[:-1]
    d[starts] = 0
    s = huffman.encode(d.ravel(), starts * 3)
    packed = {"bc1": lambda: blocks.encode1(rgb), "bc7": lambda: blocks.encode7(np.c_[rgb, np.full(n, 255)]), "none": lambda: rgb.astype(np.uint8).tobytes()}[color]()
    return {"num_points": n, "start_values": xyz[starts].ravel(), "chain_bits": s["at"], "table_symbols": s["symbols"], "table_codes": s["codes"], "table_lengths": s["lengths"].astype(np.int32), "encoding": s["data"],
            "separate": s["separate"], "separate_at": s["separate_at"], "color": packed, **{f"{m}_{a}": int(v) for m, f in (("min", np.min), ("max", np.max)) for a, v in zip("xyz", f(xyz, axis=0))}}


def decode_batch(row: dict, chain: int = CHAIN, color: str = "bc1") -> tuple[np.ndarray, np.ndarray]:
    """The points and colours of a compressed batch."""
    n = int(row["num_points"])
    sizes = np.diff(np.append(np.arange(0, n, chain), n))
    stream = {"symbols": np.asarray(row["table_symbols"]), "codes": np.asarray(row["table_codes"]), "lengths": np.asarray(row["table_lengths"]), "data": bytes(row["encoding"]), "at": row["chain_bits"], "separate": np.asarray(row["separate"]), "separate_at": row["separate_at"]}
    start = np.asarray(row["start_values"]).reshape(-1, 3)
    xyz = np.concatenate([s + np.cumsum(d.reshape(-1, 3), 0) for s, d in zip(start, huffman.decode(stream, sizes * 3))])
    data = bytes(row["color"])
    rgb = {"bc1": lambda: blocks.decode1(data, n), "bc7": lambda: blocks.decode7(data, n)[:, :3], "none": lambda: np.frombuffer(data, np.uint8).reshape(-1, 3)}[color]()
    return xyz, rgb.astype(np.int64)


def compress(points: DataFrame, batch: int = BATCH, color: str = "bc1") -> DataFrame:
    """points(point_id, X, Y, Z, r, g, b) as compressed batches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        out = encode_batch(pdf[["X", "Y", "Z"]].to_numpy(np.int64), pdf[["r", "g", "b"]].to_numpy(np.int64), color=color)
        return pd.DataFrame([{"batch_id": int(pdf["batch_id"].iloc[0]), "first_point": int(pdf["point_id"].iloc[0])} | out])

    return points.withColumn("batch_id", batch_of(batch)).groupBy("batch_id").applyInPandas(run, COMPRESSED)


def decompress(batches: DataFrame, color: str = "bc1") -> DataFrame:
    """The points of compressed batches; colours are what their blocks hold."""

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                xyz, rgb = decode_batch(row, color=color)
                ids = row["first_point"] + np.arange(len(xyz))
                yield pd.DataFrame({"batch_id": row["batch_id"], "point_id": ids, "X": xyz[:, 0], "Y": xyz[:, 1], "Z": xyz[:, 2], "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return batches.mapInPandas(run, DECODED)


def sizes(batches: DataFrame) -> DataFrame:
    """Bytes of each part of each batch, against the bytes of the points."""
    words = lambda c, n: F.size(c) * n
    return batches.select(
        "batch_id", "num_points", (F.col("num_points") * 12).cast("long").alias("raw_bytes"), F.octet_length("encoding").cast("long").alias("encoding_bytes"), words("separate", 4).cast("long").alias("separate_bytes"),
        (words("table_symbols", 4) + words("table_lengths", 1)).cast("long").alias("table_bytes"), (words("start_values", 4) + words("chain_bits", 4)).cast("long").alias("chain_bytes"), F.octet_length("color").cast("long").alias("color_bytes"))


def ratios(batches: DataFrame) -> DataFrame:
    """Totals and the ratio of compression."""
    s = sizes(batches)
    parts = ["encoding_bytes", "separate_bytes", "table_bytes", "chain_bytes"]
    total = s.agg(F.count("*").alias("batches"), F.sum("num_points").alias("points"), *(F.sum(c).alias(c) for c in ["raw_bytes", *parts, "color_bytes"]))
    own = F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]) + F.col(parts[3])
    return total.withColumns({"ratio": F.col("raw_bytes") / own, "bits_per_point": own * 8 / F.col("points")})

"""Compressed batches in one file: a header of five long numbers, the size of each record, and the records.

Parquet is the engine's own format for the same table; this one is for exchange.  Records are read by byte range, many at a time."""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.compress import COMPRESSED
from ..workspace import written

#: Batches that a task of the reader or writer has, about.
TOGETHER = 128
SCALARS = ("batch_id", "first_point", "num_points", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
ARRAYS = (("start_values", "<i8"), ("chain_bits", "<i8"), ("table_symbols", "<i8"), ("table_codes", "<i8"), ("table_lengths", "<i4"), ("separate", "<i8"), ("separate_at", "<i8"))
BLOBS = ("encoding", "color")


def dump(row: dict) -> bytes:
    """A record: nine numbers, then each array and byte string after its length."""
    out = [struct.pack("<9q", *(int(row[n]) for n in SCALARS))]
    for name, kind in ARRAYS:
        a = np.asarray(row[name], kind)
        out += [struct.pack("<q", len(a)), a.tobytes()]
    for name in BLOBS:
        out += [struct.pack("<q", len(row[name])), bytes(row[name])]
    return b"".join(out)


def load(data: bytes) -> dict:
    out, at = dict(zip(SCALARS, struct.unpack_from("<9q", data))), 72
    for name, kind in ARRAYS:
        n = struct.unpack_from("<q", data, at)[0]
        out[name] = np.frombuffer(data, kind, n, at + 8)
        at += 8 + n * np.dtype(kind).itemsize
    for name in BLOBS:
        n = struct.unpack_from("<q", data, at)[0]
        out[name] = data[at + 8 : at + 8 + n]
        at += 8 + n
    if at != len(data):
        raise ValueError("a record has another length than its parts")
    return out


def write(batches: DataFrame, path: str) -> None:
    """One file of all batches, in order.  Tasks write the records of ranges of batches, and put them into place in the file; the driver has
    the size of each record, which the file's directory holds.  The folder is one that all executors mount."""
    from ..sinks.files import put_together

    def run(frames):
        from pyspark import TaskContext

        t = TaskContext.get()
        own, sizes, totals = f"{path}.{t.partitionId():05d}.{t.taskAttemptId()}", [], [0, 0, 0, 0]
        with open(own, "wb") as f:
            for pdf in frames:
                for row in pdf.to_dict("records"):
                    sizes.append(f.write(dump(row)))
                    for i, v in enumerate((row["num_points"], len(row["encoding"]), 4 * len(row["separate"]), len(row["color"]))):
                        totals[i] += int(v)
        yield pd.DataFrame({"part": [t.partitionId()], "path": [own], "sizes": [np.array(sizes, "<i8").tobytes()], "totals": [totals]})

    # bounds are sampled and records made from what is written once
    rows = written(batches, "batches")
    parts = max(-(-rows.count() // TOGETHER), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = sorted(rows.repartitionByRange(parts, "batch_id").sortWithinPartitions("batch_id").mapInPandas(run, "part int, path string, sizes binary, totals array<long>").collect())
    sizes = b"".join(bytes(r["sizes"]) for r in done)
    totals = [sum(r["totals"][i] for r in done) for i in range(4)]
    at = 40 + len(sizes)
    with open(path, "wb") as f:
        f.write(struct.pack("<5q", totals[0], len(sizes) // 8, *totals[1:]) + sizes)
    pieces = []
    for r in done:
        pieces.append((r["path"], at))
        at += int(np.frombuffer(r["sizes"], "<i8").sum())
    put_together(batches.sparkSession, pieces, path, at)


def directory(path: str) -> tuple[tuple[int, ...], list[tuple[int, int]]]:
    """The header, and offset and size of each record."""
    head, table = table_of(path)
    return head, [*map(tuple, table.tolist())]


def table_of(path: str) -> tuple[tuple[int, ...], np.ndarray]:
    with open(path, "rb") as f:
        head = struct.unpack("<5q", f.read(40))
        sizes = np.frombuffer(f.read(8 * head[1]), "<i8")
    at = 40 + 8 * head[1] + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return head, np.stack([at[:-1], sizes], 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The compressed batches of a file, for `operators.compress.decompress`."""
    names = [c.split()[0] for c in COMPRESSED.split(", ")]

    def run(frames):
        for pdf in frames:
            rows = []
            with open(path, "rb") as f:
                for at, size in zip(pdf["at"], pdf["size"]):
                    f.seek(at)
                    rows.append(load(f.read(size)))
                    if len(rows) == TOGETHER:
                        yield pd.DataFrame(rows)[names]
                        rows = []
            if rows:
                yield pd.DataFrame(rows)[names]

    at, sizes = table_of(path)[1].T
    table = pa.table({"at": at, "size": sizes})
    return spark.createDataFrame(table).repartition(max(1, min(len(table), max(spark.sparkContext.defaultParallelism, -(-len(table) // TOGETHER))))).mapInPandas(run, COMPRESSED)

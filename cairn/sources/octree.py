"""Octrees on disk: metadata, hierarchy of nodes and their points."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RECORD = struct.Struct("<BBIqq")
#: A node of this type stands for a part of the hierarchy that lies elsewhere in the file (fixed value of the format).
PROXY = 2
#: Bytes of points that are read at once; chunks of a hierarchy that are left to tasks, at least, if there are as many.
READ, WAITING = 1 << 20, 64
NODES = "name string, level int, node_type int, num_points long, byte_offset long, byte_size long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def metadata(path: str) -> dict:
    with open(os.path.join(path, "metadata.json"), encoding="utf-8") as f:
        return json.load(f)


def child_box(box: list[float], child: int) -> list[float]:
    """The box of a child: bit 2 is the upper half along x, bit 1 along y, bit 0 along z."""
    out = list(box)
    for i in range(3):
        mid = (box[i] + box[i + 3]) / 2
        out[i if child >> (2 - i) & 1 else i + 3] = mid
    return out


def read_chunk(path: str, name: str, box: list[float], at: int, size: int) -> tuple[list[tuple], list[tuple]]:
    """The nodes of a chunk of the hierarchy, and the chunks that its proxies stand for: (name, box, offset, size)."""
    with open(os.path.join(path, "hierarchy.bin"), "rb") as f:
        f.seek(at)
        data = f.read(size)
    queue, out, chunks = [(name, box)], [], []
    for i in range(size // RECORD.size):
        name, box = queue[i]
        kind, mask, n, offset, length = RECORD.unpack_from(data, i * RECORD.size)
        if kind == PROXY and i:
            chunks.append((name, box, offset, length))
            continue
        out.append((name, len(name) - 1, kind if kind != PROXY else 0, n, offset, length, *map(float, box)))
        queue += [(f"{name}{c}", child_box(box, c)) for c in range(8) if mask >> c & 1]
    return out, chunks


def hierarchy(path: str, chunks: list[tuple]) -> Iterator[list[tuple]]:
    """The nodes of chunks and of all below them, chunk by chunk."""
    chunks = list(chunks)
    while chunks:
        out, more = read_chunk(path, *chunks.pop())
        chunks += more
        yield out


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of an octree.  The driver follows proxies until there are some chunks for each task; the tasks read them and what is below."""
    meta = metadata(path)
    box = [*map(float, meta["boundingBox"]["min"]), *map(float, meta["boundingBox"]["max"])]
    waiting, single = [("r", box, 0, meta["hierarchy"]["firstChunkSize"])], []
    while waiting and len(waiting) < WAITING:
        more = read_chunk(path, *waiting[0])[1]
        single.append(waiting.pop(0))
        waiting += more
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 6]
        for b in batches:
            for name, box, at, size, below in zip(*(b.column(i).to_pylist() for i in range(5))):
                for rows in hierarchy(path, [(name, box, at, size)]) if below else [read_chunk(path, name, box, at, size)[0]]:
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    rows = [(*c, False) for c in single] + [(*c, True) for c in waiting]
    table = pa.table(dict(zip(("name", "box", "at", "size", "below"), zip(*rows))))
    parts = min(len(rows), max(WAITING, spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(table).repartition(parts).mapInArrow(run, NODES)


def points(spark: SparkSession, path: str, node_rows: DataFrame | None = None) -> DataFrame:
    """The points of nodes (all, or those of a filtered table of nodes), each read from its byte range."""
    meta = metadata(path)
    sizes = [(a["name"], a["size"]) for a in meta["attributes"]]
    stride, at = sum(s for _, s in sizes), {n: sum(s for _, s in sizes[:i]) for i, (n, _) in enumerate(sizes)}
    names, kinds, places = ["X", "Y", "Z"], ["<i4"] * 3, [at["position"] + 4 * i for i in range(3)]
    if "rgb" in at:
        names, kinds, places = names + ["r", "g", "b"], kinds + ["<u2"] * 3, places + [at["rgb"] + 2 * i for i in range(3)]
    file = os.path.join(path, "octree.bin")

    def pieces(batches):
        """Ranges of nodes, many small ones or a part of a large one together: about READ bytes."""
        held, total = [], 0
        most = max(1, READ // stride) * stride
        for b in batches:
            for name, start, size in sorted(zip(*(b.column(i).to_pylist() for i in range(3))), key=lambda x: x[1]):
                for at in range(start, start + size, most):
                    own = min(most, start + size - at)
                    held.append((name, at, own))
                    total += own
                    if total >= most:
                        yield held
                        held, total = [], 0
        if held:
            yield held

    def run(batches):
        kind = np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": stride})
        with open(file, "rb") as f:
            for held in pieces(batches):
                data = []
                for _, start, size in held:
                    f.seek(start)
                    data.append(f.read(size))
                p, own = np.frombuffer(b"".join(data), kind), np.repeat(np.arange(len(held)), [len(d) // stride for d in data])
                color = [np.where(p[c].astype(np.int32) > 255, p[c].astype(np.int32) >> 8, p[c].astype(np.int32)).astype(np.int32) if c in names else None for c in "rgb"]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]).take(pa.array(own)), *(pa.array(np.ascontiguousarray(p[a])) for a in "XYZ"), *(pa.nulls(len(p), pa.int32()) if c is None else pa.array(c) for c in color)], ["name", "X", "Y", "Z", "r", "g", "b"])

    rows = (nodes(spark, path) if node_rows is None else node_rows).filter("num_points > 0 and byte_size > 0").select("name", "byte_offset", "byte_size")
    return rows.mapInArrow(run, "name string, X int, Y int, Z int, r int, g int, b int")

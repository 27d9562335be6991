"""LAS point files: header, ranges of points as a data source, and files from any store."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

#: Byte offsets of colours in the records of point formats (fixed values of the format); other formats have none.
COLOR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
HEADER_BYTES = 375
#: Points that one task reads; tasks from which on small chunks share one.
CHUNK, TASKS = 1 << 20, 64
HEADER = "path string, version_major int, version_minor int, offset_to_points long, point_format int, record_length int, num_points long, sx double, sy double, sz double, ox double, oy double, oz double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
POINTS = "file_id int, point_id long, X int, Y int, Z int, r int, g int, b int"


def parse_header(data: bytes, path: str = "") -> dict:
    """The header of a LAS file, from its first bytes."""
    if data[:4] != b"LASF" or len(data) < 227:
        raise ValueError(f"{path or 'data'}: not a LAS file")
    major, minor = data[24], data[25]
    at, form, length, legacy = *struct.unpack_from("<I", data, 96), data[104], *struct.unpack_from("<H", data, 105), *struct.unpack_from("<I", data, 107)
    if form & 128:
        raise NotImplementedError(f"{path}: LAZ needs a decoder that isn't installed; convert the file to LAS")
    n = legacy if major == 1 and minor < 4 else struct.unpack_from("<Q", data, 247)[0]
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    box = struct.unpack_from("<6d", data, 179)  # max and min of each axis in turn
    return {"path": path, "version_major": major, "version_minor": minor, "offset_to_points": at, "point_format": form, "record_length": length, "num_points": n, **dict(zip(("sx", "sy", "sz", "ox", "oy", "oz"), scale + offset)),
            "min_x": box[1], "min_y": box[3], "min_z": box[5], "max_x": box[0], "max_y": box[2], "max_z": box[4]}


def record_type(header: dict) -> np.dtype:
    names, kinds, at = ["X", "Y", "Z"], ["<i4"] * 3, [0, 4, 8]
    if header["point_format"] in COLOR_AT:
        names, kinds, at = names + ["r", "g", "b"], kinds + ["<u2"] * 3, at + [COLOR_AT[header["point_format"]] + 2 * i for i in range(3)]
    return np.dtype({"names": names, "formats": kinds, "offsets": at, "itemsize": header["record_length"]})


def decode_points(data: bytes, header: dict, file_id: int, first: int) -> pa.RecordBatch:
    """Points from whole records; colours of 16 bits become 8; formats without colours have null ones."""
    kind = record_type(header)
    p = np.frombuffer(data, kind, len(data) // kind.itemsize)
    n = len(p)
    cols = [pa.array(np.full(n, file_id, np.int32)), pa.array(first + np.arange(n, dtype=np.int64)), *(pa.array(np.ascontiguousarray(p[a])) for a in "XYZ")]
    for a in "rgb":
        if a in kind.names:
            v = p[a].astype(np.int32)
            cols.append(pa.array(np.where(v > 255, v >> 8, v).astype(np.int32)))
        else:
            cols.append(pa.nulls(n, pa.int32()))
    return pa.RecordBatch.from_arrays(cols, ["file_id", "point_id", "X", "Y", "Z", "r", "g", "b"])


def files_of(path: str) -> list[str]:
    """The LAS files that a path, a folder or a pattern names, in order."""
    found = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
    if any(f.lower().endswith(".laz") for f in found):
        raise NotImplementedError("LAZ needs a decoder that isn't installed; convert the files to LAS")
    found = [f for f in found if f.lower().endswith(".las")]
    if not found:
        raise FileNotFoundError(path)
    return found


def read_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file from start, as many as there are up to size."""
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(size)


class Range(InputPartition):
    def __init__(self, file_id: int, header: dict, first: int, n: int, base: int):
        self.file_id, self.header, self.first, self.n, self.base = file_id, header, first, n, base


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.first, self.limit = int(options.get("first", 0)), int(options.get("points", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        found, base = [], 0
        for i, f in enumerate(files_of(self.path)):
            h = parse_header(read_range(f, 0, HEADER_BYTES), f)
            there = (os.path.getsize(f) - h["offset_to_points"]) // h["record_length"]
            end = min(h["num_points"], there, self.first + self.limit)
            found.append((i, h, end, base))
            base += min(h["num_points"], there)
        # small chunks are read one after the other by a task, up to CHUNK points, once there are enough tasks
        chunks = sum(max(0, -(-(end - self.first) // self.chunk)) for _, _, end, _ in found)
        step = self.chunk * max(1, min(CHUNK // self.chunk, -(-chunks // TASKS)))
        return [Range(i, h, a, min(step, end - a), base) for i, h, end, base in found for a in range(self.first, end, step)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        h = p.header
        for a in range(p.first, p.first + p.n, 1 << 16):
            n = min(1 << 16, p.first + p.n - a)
            yield decode_points(read_range(h["path"], h["offset_to_points"] + a * h["record_length"], n * h["record_length"]), h, p.file_id, p.base + a)


class LasSource(DataSource):
    """spark.read.format("las").option("chunk", n).load(path): points of one or many files on a file system that all executors mount.
    point_id counts through all files.  Options first and points take a range of each file.  A chunk isn't divided between tasks, but a task
    may read several."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("las").options(**options).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file's header."""
    return spark.createDataFrame([tuple(parse_header(read_range(f, 0, HEADER_BYTES), f).values()) for f in files_of(path)], HEADER)


def total_box(header_rows: DataFrame) -> DataFrame:
    """The box of all files."""
    return header_rows.agg(F.count("*").alias("files"), F.sum("num_points").alias("num_points"), *(f(f"{m}_{a}").alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in "xyz"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Points of files in any store that Spark reads; each file (under 2 GB) is decoded by one task, and point_id counts within it."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_py()
                h = parse_header(data[:HEADER_BYTES], name)
                body = data[h["offset_to_points"] : h["offset_to_points"] + h["num_points"] * h["record_length"]]
                step = h["record_length"] << 16
                for i, a in enumerate(range(0, len(body) // h["record_length"] * h["record_length"], step)):
                    part = decode_points(body[a : a + step], h, 0, i << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), *part.columns[1:]], ["path", *part.schema.names[1:]])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content").mapInArrow(run, "path string, point_id long, X int, Y int, Z int, r int, g int, b int")

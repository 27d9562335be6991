"""What the operators of this subpackage share: reading tables, batch sizes, tables cut from their lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of an Arrow batch that goes to Python; a batch ends at whichever comes first.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000


def configure(spark: SparkSession) -> SparkSession:
    """Bound the batches that Python workers get, so that long texts don't add up in one worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  A session on one machine (tests) that has none gets a temporary folder; on a cluster, where
    executors could not see it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables that are there: path to (session, name in the catalogue or None, whether a stage of a pipeline wrote it).
_there: dict[str, tuple[SparkSession, str | None, bool]] = {}
_in_stage = False


def remember(spark: SparkSession, path: str, name: str | None = None) -> None:
    _there[path] = (spark, name, _in_stage)


def forget(path: str) -> None:
    """Remove a table from the shared folder, and from the catalogue."""
    spark, name, _ = _there.pop(path)
    if name:
        spark.sql(f"drop table if exists {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def stage(docs: DataFrame) -> Iterator[None]:
    """While a stage of a pipeline is set up: its predecessors' tables go first, but for what docs reads.  A stage's own result is read
    later, so its tables stay until the next stage."""
    global _in_stage
    old = [path for path, (_, _, staged) in _there.items() if staged]
    if old:
        read = docs.inputFiles()
        for path in old:
            if not any(path.split("/")[-1] in f for f in read):
                forget(path)
    _in_stage = True
    try:
        yield
    finally:
        _in_stage = False


@atexit.register
def forget_all() -> None:
    """What queries have left for their results to read goes with the program."""
    for path in [*_there]:
        try:
            forget(path)
        except Exception:  # noqa: BLE001  the session has ended before
            _there.pop(path, None)


def spool(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read that: its lineage ends there, so a lost
    executor costs no more than the tasks since.  `unspool` removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    remember(spark, path)
    return out


def unspool(*tables: DataFrame) -> None:
    """Remove tables that `spool` wrote and that no later step reads."""
    for df in tables:
        if df._cairn_path in _there:
            forget(df._cairn_path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the Python worker gives its free memory back: workers wait for further tasks, and several share an executor."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def whole(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(taken, *names: str) -> list[str]:
    """The names, with underscores put before those that clash with taken ones."""
    used, out = {x.lower() for x in taken}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""What the operators need from the session: a shared folder to cut lineage in, and their own code on the workers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = str(Path(tempfile.gettempdir(), "lodestone-checkpoints"))
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and a lost executor costs one task."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a cut() table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/cut-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one operator's run that its result does not read; drop() deletes those made so far.

    It also asks the driver's JVM to collect, which lets Spark's cleaner delete the shuffle files of what is done; by itself
    it would do so only when the driver happens to run short of memory.
    """

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.held.append(cut(df))
        return self.held[-1]

    def drop(self) -> None:
        spark = self.held[0].sparkSession if self.held else None
        while self.held:
            drop_cut(self.held.pop())
        if spark:
            spark._jvm.System.gc()


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by PYTHONPATH anyway.

    Also makes Arrow batches small enough for long texts, in settings that the session still has at their defaults.
    """
    for key, (default, small) in BATCH.items():
        if spark.conf.get(key, default) in (default, default.rstrip("b")):
            spark.conf.set(key, small)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(ROOT) in known or app in _shipped:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(), "lodestone.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "lodestone").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow; when a task ends, its worker gives freed memory back instead of keeping it for the next one."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def trim() -> None:
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: nothing to give back


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

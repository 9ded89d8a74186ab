"""Where intermediate tables are kept: Spark's checkpoints, in a folder that driver and executors share. And how this
package comes to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one, for one machine, only where that setting is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and written to spark.checkpoint.dir; its lineage ends there, its partitioning stays known.

    Spark deletes the files with the frame (spark.cleaner.referenceTracking.cleanCheckpoints). A temporary folder is used
    only where that setting is unset, on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(spark))
    return df.checkpoint()


def near(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """`rows`, kept, and sent to every task of a join if they are no more than `most`: a join by a key of few values would
    bring all rows of a value to one task."""
    found = kept(rows)
    return F.broadcast(found) if found.count() <= most else found


def dealt(rows: DataFrame, *keys: str, most: int = 1_000_000) -> DataFrame:
    """`rows` dealt by keys into parts of about `most` rows, so that what a task sorts doesn't grow with the table."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, rows.count() // most + 1), *keys)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once, unless they find it by PYTHONPATH anyway."""
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(ROOT) in known or app in _sent:
        return
    _sent.add(app)
    target = Path(tempfile.mkdtemp(), "package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in Path(__file__).parent.rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))

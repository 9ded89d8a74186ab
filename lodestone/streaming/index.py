"""Incremental indexing: files of documents arrive, each micro-batch is cut into windows and published once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import windows

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def index_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, per_batch: int = 16) -> StreamingQuery:
    """Windows of new documents below `folder`, partitioned by micro-batch below `target`.

    A batch that runs again overwrites its own partition, so each window is published once. Stops when all is read.
    """

    def publish(batch: DataFrame, number: int) -> None:
        made = windows(batch.select("doc_id", "text", "source")).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    rows = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(folder)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by hour and type; batch or stream, late rows to the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

"""Keeping archive summaries current while entries arrive.

A stream of documents is folded into listings with watermarks, and its micro-batches can be appended to a
Parquet archive index. Batches are idempotent: a replayed batch rewrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive as ar
from ..operators import minhash


def read_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_totals(stream: DataFrame) -> DataFrame:
    """(lang, source, n_files, total_size) over all documents so far; for complete or update mode."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return stream.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_size"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per tumbling window; rows later than the watermark are dropped, state is bounded by it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def index_batches(stream: DataFrame, index: str, checkpoint: str, **options):
    """Append MinHash sketches of arriving documents to ``index``, a folder per batch; returns the running query."""

    def write(batch: DataFrame, epoch: int) -> None:
        e = ar.entries_of_documents(batch).filter("entry_type = 'file'").withColumn("file_id", F.xxhash64("name"))
        minhash.build(e, **options).write.mode("overwrite").parquet(f"{index}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

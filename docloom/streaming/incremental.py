"""Structured Streaming: compiling documents as they come, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def compile_incrementally(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Files that appear under ``source`` go through ``step`` once; keys already in ``out`` are skipped, and of rows with one
    key in a batch the largest stays, column by column (columns that have no order, maps, are not compared).

    Each batch is written under its number, so a batch that is run again after a failure replaces itself. Of what is in
    ``out`` only the keys are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = F.struct(*[F.col(c) for c in batch.columns if not batch.schema[c].dataType.simpleString().startswith(("map", "variant"))])
        one = batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*batch.columns), order).alias("_row"))
        batch = one.select("_row.*")
        if _exists(spark, out):
            done = spark.read.parquet(out).where(F.col("batch") != number).select(key).distinct()
            batch = batch.join(done, key, "left_anti")
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which needs a timestamp with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by event time; on a stream, rows later than the watermark are left out."""
    d = _watermarked(events, late)
    g = d.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer pause."""
    d = _watermarked(events, late)
    return d.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")

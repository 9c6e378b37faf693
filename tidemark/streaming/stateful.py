"""Micro-batch processing: due windows, seen keys, retries, late outcomes, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import insert_if_absent, upsert
from tidemark.sources.readers import exists, replace


def due_windows(games: DataFrame, kickoff: str, now: Column, low: int = 5, high: int = 90, early: int = 90, late: int = 30) -> DataFrame:
    """Games that begin in ``low`` to ``high`` minutes, with their checkpoint: the early one over ``late`` minutes before,
    the late one after."""
    minutes = (F.unix_micros(F.col(kickoff).cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(60_000_000.0)
    rows = games.withColumn("minutes", minutes).filter(F.col("minutes").between(low, high))
    return rows.withColumn("checkpoint", F.when(F.col("minutes") > late, early).otherwise(late))


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows whose key no stored row has, one for each key, oldest first."""
    from tidemark.operators.relational import keep_first

    return keep_first(rows.join(seen.select(key).distinct(), key, "left_anti"), [key], order)


def retry_state(attempts: DataFrame, key: str, time: str, ok: str, now: Column, pause: int = 600) -> DataFrame:
    """State of each key from its attempts: done, waiting until its last failure is ``pause`` seconds ago, or due."""
    rows = attempts.groupBy(key).agg(F.max(F.when(F.col(ok), F.col(time))).alias("done_at"), F.max(F.when(~F.col(ok), F.col(time))).alias("failed_at"), F.count(F.lit(1)).alias("attempts"))
    waits = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("failed_at").cast("timestamp")) < pause
    return rows.withColumn("state", F.when(F.col("done_at").isNotNull(), "done").when(waits, "waiting").otherwise("due"))


def crossed(current: DataFrame, previous: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Keys whose value crossed a threshold since the snapshot before, and which way."""
    both = current.select(key, F.col(value).alias("now")).join(previous.select(key, F.col(value).alias("before")), key, "full")
    up = (F.coalesce("now", F.lit(0.0)) >= threshold) & (F.coalesce("before", F.lit(0.0)) < threshold)
    down = (F.coalesce("now", F.lit(0.0)) < threshold) & (F.coalesce("before", F.lit(0.0)) >= threshold)
    return both.withColumn("alert", F.when(up, "above").when(down, "below")).filter("alert is not null")


def revealed(rows: DataFrame, order: str, started: Column, now: Column, pace_seconds: float) -> DataFrame:
    """The prefix of a numbered sequence that a pace has let through by now."""
    n = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(started.cast("timestamp"))) / F.lit(float(pace_seconds)))
    return rows.filter(F.col(order) <= n)


def upsert_sink(path: str, keys: Sequence[str], only_new: bool = False):
    """A foreachBatch function that keeps one row for each key in a table: later batches win, or only new keys are added.
    A batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(keys))
        if exists(spark, path):
            old = spark.read.parquet(path)
            rows = insert_if_absent(old, rows, keys) if only_new else upsert(old, rows, keys)
        replace(rows, path)

    return write


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def session_counts(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its sink back."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)

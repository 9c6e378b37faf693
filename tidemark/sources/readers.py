"""Scans and sinks: seasons, documents, versions, read-through caches, atomic and partitioned writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CacheMissError(RuntimeError):
    """Offline and nothing cached."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def season_table(spark: SparkSession, path: str, seasons: Sequence[int], schema: T.StructType | None = None) -> DataFrame:
    """A table partitioned by season; the filter prunes partitions. Columns of all seasons are merged unless given."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(path).filter(F.col("season").isin(list(seasons)))


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType, null: str = "NA", header: bool = True) -> DataFrame:
    """Delimited text by an explicit schema; unreadable values become null."""
    return spark.read.schema(schema).csv(path, header=header, nullValue=null, mode="PERMISSIVE")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame] | None) -> DataFrame:
    """The table at ``path``, fetched and written first if it is missing; without ``fetch`` a miss is an error."""
    if not exists(spark, path):
        if fetch is None:
            raise CacheMissError(path)
        replace(fetch(), path)
    return spark.read.parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write a table beside the old one, then swap: readers see the old or the new one, and a failed write neither."""
    spark = df.sparkSession
    staging, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(staging)
    fs, target = _fs(spark, path)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    if fs.exists(target):
        fs.rename(target, at(old))
    if not fs.rename(at(staging), target):
        fs.rename(at(old), target)
        raise OSError(f"cannot move {staging} to {path}")
    fs.delete(at(old), True)


def overwrite_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_json(spark: SparkSession, payload: Mapping | Sequence, path: str) -> None:
    """A small document, swapped in at once."""
    fs, target = _fs(spark, path)
    staging = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staging, True)
    out.write(bytearray(json.dumps(payload, indent=2, sort_keys=True, default=str).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(staging, target):
        raise OSError(f"cannot write {path}")


def version_before(versions: DataFrame, time: str, version: str, cutoff: Column) -> DataFrame:
    """The last version strictly earlier than a cutoff."""
    return versions.filter(F.col(time) < cutoff).agg(F.max_by(version, F.struct(time, version)).alias(version), F.max(time).alias(time))


def staleness(fetched: datetime | None, now: datetime, hours: float | None, strict: bool = False) -> str:
    """fresh, stale, missing or no_policy; ``strict`` raises on stale."""
    if fetched is None:
        return "missing"
    if hours is None:
        return "no_policy"
    if (now - fetched).total_seconds() <= hours * 3600:
        return "fresh"
    if strict:
        raise CacheMissError(f"older than {hours} hours")
    return "stale"


def worst(statuses: Sequence[str], order: Sequence[str] = ("failed", "degraded", "skipped", "healthy")) -> str:
    return next((s for s in order if s in statuses), order[-1])

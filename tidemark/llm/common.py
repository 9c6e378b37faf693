"""Shared pieces: reading tables, the shared work folder, row batches cut to a bounded number of text bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: Bytes of text that a Python worker handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once, where the session has not set its own.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Where it is unset a local master, which has no
    other machines, gets a temporary folder; any other raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_work_dir_when_unset", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, True)
            found = "file://" + folder
            spark.sparkContext._work_dir_when_unset = found
    return found.rstrip("/")


_held: dict = {}


def worker_state(key, make: Callable[[], object]):
    """What a Python worker keeps between tasks: tables and caches of one operator at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _tidied(run):
    """``run``, giving freed memory back to the system at the end of a task: workers wait for the next one beside a heap."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` on workers that have this package, by batches of a few megabytes: with Spark's own limit of 64 MB long
    texts fill the memory beside an executor's heap."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_ARROW, "64MB") in ("67108864b", "64MB"):  # the session's own setting stays; it is read when a plan runs
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    return df.mapInArrow(_tidied(run), schema)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, by zstd at ``level``, and read it back: later stages start from files
    that outlive executors. The folder is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    atexit.register(_quietly_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def level_of(counts: DataFrame, column: str, most: int) -> int:
    """The least count from which on there are at most ``most`` rows, to a sixteenth of an octave: a histogram of counts
    finds it, so that the rows themselves can be filtered before they reach the driver."""
    step = F.floor(F.log2(column) * 16).cast("int")
    total, level = 0, 1 << 62
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("least")).orderBy(F.desc("step")).collect():
        total += r["rows"]
        if total > most:
            break
        level = r["least"]
    return level


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with columns c0, c1, ... and a row_key that stays the same however often it is read: a bare scan of Parquet files
    is keyed by file and row in it, which do not depend on how files are split into partitions; anything else is written
    first."""
    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]
    files = _file_numbers(df) if len({c.lower() for c in df.columns}) == len(columns) else None
    if files is None:
        return written(df.toDF(*(f"c{k}" for k in range(len(columns)))).withColumn("row_key", F.monotonically_increasing_id()), name)
    place = df.metadataColumn("_metadata")
    keyed = df.select(*columns, place["file_path"].alias("__file"), place["row_index"].alias("__row"))
    names = [f"c{k}" for k in range(len(columns))]
    return keyed.join(F.broadcast(files), "__file").select(*names, (F.shiftleft("__number", 40) + F.col("__row")).alias("row_key"))  # a row a file


def _file_numbers(df: DataFrame) -> DataFrame | None:
    """__file, __number of the files of a bare Parquet scan, None for anything else or if a file is read twice."""
    if df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        place = df.metadataColumn("_metadata")
        rows = df.select(place["file_path"].alias("__file"), place["row_index"].alias("__row"))
    except AnalysisException:  # not files, or not Parquet
        return None
    found = sorted((r[0], r[1], r[2]) for r in rows.groupBy("__file").agg(F.count(F.lit(1)), F.max("__row")).collect())
    if any(n != last + 1 for _, n, last in found):
        return None
    return df.sparkSession.createDataFrame([(f, k) for k, (f, _, _) in enumerate(found)], "__file string, __number long")


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit, then the folder's owner clears it
        pass


def whole_text(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them, without copying. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    where = where.astype(np.int64) if len(where) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all items of ranges that begin at ``starts`` and have ``lengths``, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)

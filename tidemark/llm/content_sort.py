"""Exact dedup by content sort.

Texts are normalised (white space deleted). Each input partition is sorted externally by content and neighbouring rows
are compared whole, so a text leaves a partition once, however often it occurs there. What is left is range-partitioned
by sampled splitters over the first bytes of the content and a hash of all of it (the hash only splits contents that
begin alike; equality is always of whole texts), sorted externally again, and neighbours are compared once more: of each
run of equal texts the row with the most code points, then the smallest id, stays.

Cases: null and empty texts are equal to each other and to texts of white space only; ties go to the smallest doc_id (a
null id last); of repeated rows one stays; very long texts are compared whole; an empty table gives no row; extra columns
pass by unread in :func:`content_groups`, and are all kept in :func:`drop_duplicates_by_content`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, whole_text, written

#: Code points of the normalised text that range partitioning compares, before the hash.
PREFIX = 32


def _keys(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def _local_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by content, best row first: each row's run, and the text on the run's best row alone. That row comes
    once its run has ended and its size is known."""
    part = TaskContext.get().partitionId()
    names = ["doc_id", "row_key", "points", "run", "run_rows", "prefix", "hash", "norm"]
    run, head, size = (part << 36) - 1, None, 0
    for b in batches:
        out: list[tuple] = []
        for doc_id, key, points, prefix, digest, norm in zip(*(b.column(k).to_pylist() for k in range(5)), _keys(b.column(5)), strict=True):
            if head is not None and digest == head[5] and norm == head[6]:
                size += 1
                out.append((doc_id, key, points, run, None, None, None, None))
                continue
            if head is not None:
                out.append((*head[:4], size, *head[4:]))
            run, size = run + 1, 1
            head = (doc_id, key, points, run, prefix, digest, norm)
        if out:
            yield _batch(out, names)
    if head is not None:
        yield _batch([(*head[:4], size, *head[4:])], names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"norm": pa.binary(), "prefix": pa.string(), "text_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def _global_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local runs sorted by content, best first: each one's keeper and the group's size. A text has one run in each
    partition of the first sort at most, so what is held of a group is bounded by their number."""
    names = ["run", "keep_run", "keep_id", "group_size", "text_sha256"]
    runs, head, size, norm_held, digest_held = [], None, 0, None, None

    def close() -> list[tuple]:
        sha = hashlib.sha256(norm_held).hexdigest()
        return [(r, head[0], head[1], size, sha) for r in runs]

    for b in batches:
        out: list[tuple] = []
        for run, doc_id, rows, digest, norm in zip(*(b.column(k).to_pylist() for k in range(4)), _keys(b.column(4)), strict=True):
            if head is not None and digest == digest_held and norm == norm_held:
                runs.append(run)
                size += rows
                continue
            if head is not None:
                out += close()
            runs, head, size, norm_held, digest_held = [run], (run, doc_id), rows, norm, digest
        if out:
            yield _batch(out, names)
    if head is not None:
        yield _batch(close(), names)


def _grouped(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, kept, keep_id, group_size, text_sha256 of rows with doc_id, row_key and text."""
    text = whole_text()
    norm = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    work = rows.select("doc_id", "row_key", F.length(text).cast("long").alias("points"), norm.alias("norm"))
    work = work.select("doc_id", "row_key", "points", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash"), F.col("norm"))
    best = [F.desc("points"), F.asc_nulls_last("doc_id"), "row_key"]
    local = work.sortWithinPartitions("prefix", "hash", "norm", *best)
    local = local.transform(arrow, _local_runs, "doc_id long, row_key long, points long, run long, run_rows long, prefix string, hash long, norm binary")
    local = written(local, "content-runs")
    heads = local.filter("run_rows is not null").repartitionByRange("prefix", "hash")
    heads = heads.sortWithinPartitions("prefix", "hash", "norm", *best).select("run", "doc_id", "run_rows", "hash", "norm")
    groups = heads.transform(arrow, _global_runs, "run long, keep_run long, keep_id long, group_size long, text_sha256 string")
    members = local.select("doc_id", "row_key", "run", F.col("run_rows").isNotNull().alias("leads"))
    return members.join(groups, "run").withColumn("kept", F.col("leads") & (F.col("run") == F.col("keep_run")))


def content_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), "text")
    return _grouped(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by content, those that differ from the row before. The last two columns are hash and text."""
    last = None
    for b in batches:
        rows = []
        for k, key in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), _keys(b.column(b.num_columns - 1)), strict=True)):
            if key != last:
                rows.append(k)
                last = key
        yield b.take(pa.array(rows, pa.int64()))


def drop_duplicates_by_content(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    of = {n.lower(): f"c{k}" for k, n in enumerate(names)}
    text = F.coalesce(F.col(of["text"]), F.lit(""))
    own = [f"c{k}" for k in range(len(names))]
    norm = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    best = ["prefix", "hash", "norm", F.desc("points"), F.asc_nulls_last(of["doc_id"])]
    work = docs.toDF(*own).select(*own, F.length(text).alias("points"), norm.alias("norm"))
    work = work.select(*own, "points", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash"), "norm")
    local = written(work.sortWithinPartitions(*best).transform(arrow, _firsts, work.schema).drop("norm"), "content-firsts")
    spread = local.repartitionByRange("prefix", "hash").select(*own, "points", "prefix", "hash", norm.alias("norm"))
    return spread.sortWithinPartitions(*best).transform(arrow, _firsts, work.schema).select(*own).toDF(*names)


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source's target is its share of the budget by weight, at most ``cap`` times its size; what is over goes to the
others by weight until none is above its cap (closed form: with sources by size / weight, the level at which capped sizes
and the weights of the rest use up the budget). Complete epochs come first: floor(target / size) copies of everything.
The rest is sampled without replacement: document i has the key -ln(u_i) / w_i, an exponential variate scaled by its
quality weight w_i, and documents are taken by ascending key until the running sum of sizes meets the rest; the document
at the border gives only the words still missing.

The running sum is in two levels: per source and key bin, then within a bin. The number of bins grows with the rows and no bin
has much more than its share, so a source with any share of the rows is spread over many tasks.

u_i comes from a hash of doc_id, so reruns agree and rows of one doc_id have one key.

Cases: a null text has size 0 and takes nothing; a null source is a source, the last one; ties of key go by doc_id, then
size; repeated rows are each sampled; a source without words has target 0; an empty table gives no row; texts of any length
are counted whole; extra columns pass by unread in :func:`mix`, and are all kept in :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, written

#: The least quality weight.
LEAST = 0.25
#: Bins of the keys of a source, at least, and rows for which there is one more. Each bin is one window partition and has
#: 1 / LEAST times its share of a source's rows, at most.
BINS, BIN_ROWS = 1024, 25_000
WORD = "[^\\x20\\x09-\\x0D]+"


def uniform(column: Column) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of a value's text."""
    return (F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def quality_weight(text: Column) -> Column:
    """A document's quality weight, from 0.25 to 1: its share of code points that are letters of any script, blanks, full
    stops or commas, or 0.25 where that is less. Exact in quarters, so that engines agree."""
    plain = F.length(F.regexp_replace(text, "[\\x21-\\x2B\\x2D\\x2F-\\x40\\x5B-\\x60\\x7B-\\x7E]+", ""))
    return F.greatest(F.lit(1), F.floor(4 * plain / F.greatest(F.length(text), F.lit(1)))) / F.lit(1 / LEAST)


def targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """source, source_size, target of rows source, source_size. Sources by code point, null last, weigh 1, 2, .. cycle."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))
    weighted = weighted.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(0, Window.unboundedFollowing)
    # the words a unit of weight gets if all before a source are capped: it rises while that is right, then falls
    level = (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    final = weighted.withColumn("level", level).withColumn("final", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("final") * F.col("weight"), cap * F.col("source_size"))
    return final.select("source", "source_size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def _taken(rows: DataFrame, cap: float, cycle: int, bins: int | None) -> DataFrame:
    """rows (row_key, doc_id, source, size, weight) with source_size, target, epochs, extra and taken."""
    bins = bins or max(BINS, rows.count() // BIN_ROWS)
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("weight"))
    # even for rows of the least weight; rows of weight 1 are densest in the first bins, LEAST times as wide in their keys
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key") * LEAST)) * bins), F.lit(bins - 1)).cast("int"))
    cells = rows.groupBy("source", "bin").agg(F.sum("size").alias("cell"))
    goal = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), cap, cycle)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "bin", F.coalesce(F.sum("cell").over(ahead), F.lit(0)).alias("before_cell"))
    plan = cells.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "bin", "before_cell", "source_size", "target", "epochs", "rest")
    met = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bin") == F.col("p.bin")))
    met = met.select("r.*", "before_cell", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    ahead_of = F.col("before_cell") + F.sum("size").over(within) - F.col("size")
    extra = F.least(F.col("size"), F.greatest(F.col("rest") - ahead_of, F.lit(0)))
    return met.withColumn("extra", extra).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select("row_key", "doc_id", "source", size.alias("size"), quality_weight(text).alias("weight"))


def mix(docs: DataFrame, cap: float = 3.0, cycle: int = 3, bins: int | None = None) -> DataFrame:
    """doc_id, source, size, weight, source_size, target, epochs, taken of every row."""
    rows = docs.select(F.lit(0).cast("long").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = written(_sized(rows), "sizes")
    return _taken(rows, cap, cycle, bins).select("doc_id", "source", "size", "weight", "source_size", "target", "epochs", "taken")


def mixed_documents(docs: DataFrame, cap: float = 3.0, cycle: int = 3, bins: int | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it has complete epochs, once more if it is
    sampled whole, and cut after its last word taken if it is at the border. ``docs`` is written once, unless it is a
    bare scan, so that its rows have fixed keys."""
    names = docs.columns
    of = {n.lower(): f"c{k}" for k, n in enumerate(names)}
    keyed = numbered(docs, "mix-rows")
    rows = written(_sized(keyed.select("row_key", F.col(of["doc_id"]).cast("long").alias("doc_id"), F.col(of["source"]).cast("string").alias("source"), F.col(of["text"]).alias("text"))), "sizes")
    decided = _taken(rows, cap, cycle, bins).filter("taken > 0").select("row_key", "size", "epochs", "extra")
    copies = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    out = keyed.join(decided, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.regexp_extract_all(of["text"], F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("extra").cast("int")), "")
    partly = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    return out.withColumn(of["text"], F.when(partly, cut).otherwise(F.col(of["text"]))).select(*of.values()).toDF(*names)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    greatest(1, floor(4 * length(regexp_replace(coalesce(text, ''), '[\\x21-\\x2B\\x2D\\x2F-\\x40\\x5B-\\x60\\x7B-\\x7E]+', '', 'g'))
      / greatest(length(coalesce(text, '')), 1))) / 4.0 AS weight,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / {float(1 << 48)} AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - 3.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, least(max(level) OVER () * weight, 3.0 * source_size) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.source, d.size, d.weight, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size) AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size::BIGINT AS size, weight::DOUBLE AS weight, source_size::BIGINT AS source_size, target::DOUBLE AS target,
  epochs::BIGINT AS epochs, (epochs * size + least(size, greatest(rest - ahead, 0)))::BIGINT AS taken
FROM p
"""

"""Combining several sources of projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import trimmed_mean


def trimmed_consensus(df: DataFrame, keys: Sequence[str], value: str, n_sources: int, trim: float = 0.2) -> DataFrame:
    """Trimmed mean, population deviation and coverage over a key's sources."""
    rows = df.groupBy(*keys).agg(F.collect_list(value).alias("__values"), F.stddev_pop(value).alias("dispersion"), F.count(value).alias("n_sources"))
    return rows.select(*keys, trimmed_mean(F.col("__values"), trim).alias("consensus"), "dispersion", "n_sources", (F.col("n_sources") / F.lit(float(n_sources))).alias("coverage"))


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str = "rank") -> DataFrame:
    """Ordinal rank, best first, ties by a stated key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)))


def reference_curve(df: DataFrame, group: str, source: str, value: str, tie: str) -> DataFrame:
    """Median over sources of the value at each rank of a group."""
    return ranked(df, [source, group], value, tie).groupBy(group, "rank").agg(F.median(value).alias("points"))


def ranks_to_points(ranks: DataFrame, curve: DataFrame, group: str, rank: str, out: str) -> DataFrame:
    """Points of a curve at a rank rounded half to even, null beyond the curve."""
    at = curve.select(group, F.col("rank").cast("long").alias("__rank"), F.col("points").alias(out))
    return ranks.withColumn("__rank", F.bround(rank).cast("long")).join(at, [group, "__rank"], "left").drop("__rank")


def rank_summary(df: DataFrame, keys: Sequence[str], source: str, sources: Sequence, rank: str) -> DataFrame:
    """Mean, median, population deviation and one column of each source's rank."""
    each = [F.max(F.when(F.col(source) == F.lit(s), F.col(rank))).alias(f"rank_{s}") for s in sources]
    return df.groupBy(*keys).agg(F.avg(rank).alias("mean_rank"), F.median(rank).alias("median_rank"), F.stddev_pop(rank).alias("sd_rank"), *each)


def inverse_error_weights(performance: DataFrame, group: str, error: str, floor: float = 0.25, out: str = "weight") -> DataFrame:
    """Weights in inverse proportion to an error, summing to 1 in each group."""
    inverse = 1 / F.greatest(F.col(error), F.lit(floor))
    return performance.withColumn(out, inverse / F.sum(inverse).over(Window.partitionBy(group)))


def capped_weights(weights: DataFrame, group: str, tie: str, most: float = 0.7, weight: str = "weight") -> DataFrame:
    """Groups of at least two sources; a leader over ``most`` gives what is over to the others in proportion."""
    by = Window.partitionBy(group)
    lead = F.row_number().over(by.orderBy(F.desc(weight), tie)) == 1
    rows = weights.withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__lead", lead).withColumn("__top", F.max(weight).over(by))
    w = F.col(weight)
    capped = F.when(F.col("__top") <= most, w).when(F.col("__lead"), F.lit(most)).otherwise(w * F.lit(1 - most) / (1 - F.col("__top")))
    return rows.filter("__n >= 2").withColumn(weight, capped).drop("__n", "__lead", "__top")


def blended(values: Sequence[Column], weights: Sequence[Column], least: int = 2) -> tuple[Column, Column]:
    """Weighted mean over the sources that have both a value and a weight, null with fewer than ``least``; their number."""
    have = [v.isNotNull() & w.isNotNull() for v, w in zip(values, weights, strict=True)]
    n = sum((h.cast("int") for h in have), F.lit(0))
    top = sum((F.when(h, v * w).otherwise(0.0) for h, v, w in zip(have, values, weights, strict=True)), F.lit(0.0))
    bottom = sum((F.when(h, w).otherwise(0.0) for h, w in zip(have, weights, strict=True)), F.lit(0.0))
    return F.when(n >= least, F.try_divide(top, bottom)), n


def off_scale_sources(df: DataFrame, source: str, value: str, factor: float = 0.35) -> DataFrame:
    """Sources whose median is below ``factor`` of the upper middle of the other sources' medians."""
    medians = df.groupBy(source).agg(F.median(value).alias("median"))
    pairs = medians.alias("a").join(medians.alias("b"), F.col(f"a.{source}") != F.col(f"b.{source}"), "left")
    others = pairs.groupBy(F.col(f"a.{source}").alias(source), F.col("a.median").alias("median")).agg(F.sort_array(F.collect_list("b.median")).alias("__others"))
    middle = F.try_element_at("__others", (F.floor(F.size("__others") / 2) + 1).cast("int"))
    return others.select(source, "median", middle.alias("others"), F.coalesce(F.col("median") < factor * middle, F.lit(False)).alias("off_scale"))

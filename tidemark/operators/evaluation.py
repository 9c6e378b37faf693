"""Forecast metrics, calibration, movement, audits, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import average_rank, clip, share

ALL = "ALL"


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    """n, mae, rmse, bias over rows that have both."""
    error = predicted - actual
    return [F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias")]


def by_group_and_all(df: DataFrame, keys: Sequence[str], group: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates for each group and, under ALL, for all groups together: grouping sets in one shuffle."""
    name = F.when(F.grouping(group) == 1, F.lit(ALL)).otherwise(F.col(group)).alias("__group")
    found = df.groupingSets([[*map(F.col, keys), F.col(group)], [*map(F.col, keys)]], *map(F.col, keys), F.col(group)).agg(name, *aggregates)
    return found.drop(group).withColumnRenamed("__group", group)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Rank correlation in each group of rows that have both, null for groups without variation."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    by = Window.partitionBy(*keys)
    for name, c in (("__rx", x), ("__ry", y)):
        rows = rows.withColumn(name, average_rank(c, by.orderBy(c), Window.partitionBy(*keys, c)))
    # from sums, so that constant groups give null and do not raise
    n, sx, sy = F.count(F.lit(1)).cast("double"), F.sum("__rx"), F.sum("__ry")
    sxy, sxx, syy = F.sum(F.col("__rx") * F.col("__ry")), F.sum(F.col("__rx") * F.col("__rx")), F.sum(F.col("__ry") * F.col("__ry"))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    value = F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy).otherwise(1.0)))
    return rows.groupBy(*keys).agg(value.alias(out), F.count(F.lit(1)).alias("n"))


def top_k_precision(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, tie: str, k: int) -> DataFrame:
    """Share of the k best predicted that are among the k best; groups with fewer than k rows are left out."""
    by = Window.partitionBy(*keys)
    rows = df.withColumn("__a", F.row_number().over(by.orderBy(F.desc(actual), tie))).withColumn("__p", F.row_number().over(by.orderBy(F.desc(predicted), tie)))
    return rows.groupBy(*keys).agg((F.count_if((F.col("__a") <= k) & (F.col("__p") <= k)) / F.lit(float(k))).alias("precision"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)


def pair_accuracy(df: DataFrame, keys: Sequence[str], entity: str, actual: str, predicted: str) -> DataFrame:
    """Share of pairs within a group whose better one was predicted; pairs equal in either are left out.

    Pairs are found by an equi-join on the group's keys, so groups must be of bounded size (line-ups, weekly teams)."""
    a, b = df.alias("a"), df.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    on += [F.col(f"a.{entity}") < F.col(f"b.{entity}"), F.col(f"a.{predicted}") != F.col(f"b.{predicted}"), F.col(f"a.{actual}") != F.col(f"b.{actual}")]
    right = (F.col(f"a.{predicted}") > F.col(f"b.{predicted}")) == (F.col(f"a.{actual}") > F.col(f"b.{actual}"))
    return a.join(b, on).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(share(right).alias("accuracy"), F.count(F.lit(1)).alias("pairs"))


def pinball(actual: Column, predicted: Column, quantile: float) -> Column:
    e = actual - predicted
    return F.avg(F.when(e >= 0, quantile * e).otherwise((quantile - 1) * e))


def brier(probability: Column, happened: Column) -> Column:
    return F.avg((probability - happened.cast("double")) * (probability - happened.cast("double")))


def calibration_bins(df: DataFrame, probability: str, happened: Column, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forecast, mean outcome and size of equal-width bins; empty bins are left out."""
    which = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.filter(F.col(probability).isNotNull() & happened.isNotNull()).groupBy(*keys, which).agg(F.avg(probability).alias("mean_forecast"), share(happened).alias("mean_outcome"), F.count(F.lit(1)).alias("n"))


def bootstrap_interval(df: DataFrame, cluster: str, numerator: Column, denominator: Column, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of a ratio of sums under resampling of whole clusters with replacement.

    Rows are first summed to clusters; each replicate draws as many clusters as there are, by number, and draws join the
    sums. Draws come from a hash of (replicate, draw), so reruns agree. Rows made: replicates x clusters."""
    sums = df.groupBy(cluster).agg(F.sum(numerator).alias("__top"), F.sum(denominator).alias("__bottom"))
    numbered = sums.withColumn("__k", F.row_number().over(Window.orderBy(cluster)) - 1)
    size = sums.agg(F.count(F.lit(1)).alias("__n"))
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "__r").join(size).select("__r", "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__d"))
    draws = draws.select("__r", F.pmod(F.xxhash64(F.lit(seed), "__r", "__d"), F.col("__n")).cast("int").alias("__k"))
    each = draws.join(numbered, "__k").groupBy("__r").agg(F.try_divide(F.sum("__top"), F.sum("__bottom")).alias("__value"))
    point = sums.agg(F.try_divide(F.sum("__top"), F.sum("__bottom")).alias("value"), F.count(F.lit(1)).alias("clusters"))
    tail = (1 - level) / 2
    return point.join(each.agg(F.percentile("__value", F.lit(tail)).alias("low"), F.percentile("__value", F.lit(1 - tail)).alias("high"), F.count("__value").alias("replicates")))


def intraclass_correlation(df: DataFrame, entity: str, value: str, cell: Sequence[str], group: str, least: int = 2) -> DataFrame:
    """One-way ANOVA estimate for unequal numbers, of values less their cell's mean, per group."""
    centred = df.withColumn("__x", F.col(value) - F.avg(value).over(Window.partitionBy(*cell)))
    each = centred.groupBy(group, entity).agg(F.count("__x").alias("n"), F.sum("__x").alias("s"), F.sum(F.col("__x") * F.col("__x")).alias("q")).filter(F.col("n") >= least)
    agg = each.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("a"), F.sum("n").cast("double").alias("N"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"),
        F.sum("s").alias("S"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("q").alias("Q"),
    )
    n0 = (F.col("N") - F.try_divide(F.col("n2"), F.col("N"))) / (F.col("a") - 1)
    msb = F.try_divide(F.col("between") - F.col("S") * F.col("S") / F.col("N"), F.col("a") - 1)
    msw = F.try_divide(F.col("Q") - F.col("between"), F.col("N") - F.col("a"))
    return agg.filter("a > 1").select(group, F.col("a").cast("long").alias("entities"), clip(F.try_divide(msb - msw, msb + (n0 - 1) * msw), 0.0, 1.0).alias("icc"))


def variance_ratio(n: Column, rho: Column) -> Column:
    """Variance of a sum of n equally correlated values over that of independent ones."""
    return 1 + (n - 1) * rho


def movements(df: DataFrame, entity: str, time: str, tie: str, value: str, threshold: float) -> DataFrame:
    """First and last value of each entity, their difference and the class of the move."""
    first, last = F.min(F.struct(time, tie, value)), F.max(F.struct(time, tie, value))
    rows = df.groupBy(entity).agg(first.alias("__first"), last.alias("__last"), F.count(F.lit(1)).alias("snapshots")).filter("snapshots >= 2")
    change = F.col(f"__last.{value}") - F.col(f"__first.{value}")
    signal = F.when(change >= threshold, "up").when(change <= -threshold, "down").otherwise("steady")
    return rows.select(entity, F.col(f"__first.{value}").alias("first_value"), F.col(f"__last.{value}").alias("last_value"), change.alias("change"), signal.alias("signal"), "snapshots")


def replayed_bias(df: DataFrame, group: str, week: str, actual: str, predicted: str, weeks: int = 4, least_rows: int = 10, least_weeks: int = 2, most: float = 3.0) -> DataFrame:
    """Each row's forecast corrected by its group's mean error over the ``weeks`` weeks before, if they hold enough."""
    error = F.col(actual) - F.col(predicted)
    per = df.groupBy(group, week).agg(F.sum(error).alias("__e"), F.count(error).alias("__n"))
    before = Window.partitionBy(group).orderBy(week).rangeBetween(-weeks, -1)
    enough = (F.sum("__n").over(before) >= least_rows) & (F.count(F.lit(1)).over(before) >= least_weeks)
    bias = F.when(enough, clip(F.sum("__e").over(before) / F.sum("__n").over(before), -most, most))
    return df.join(per.select(group, week, bias.alias("bias")), [group, week], "left").withColumn("corrected", F.col(predicted) + F.coalesce("bias", F.lit(0.0)))


def recent_patterns(df: DataFrame, group: str, week: str, condition: Column, weeks: int = 6, least: int = 3) -> DataFrame:
    """Groups where the condition holds in at least ``least`` of their last ``weeks`` weeks."""
    per = df.groupBy(group, week).agg(F.max(condition.cast("int")).alias("__hit"))
    recent = per.withColumn("__back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(week)))).filter(F.col("__back") <= weeks)
    return recent.groupBy(group).agg(F.sum("__hit").alias("hits"), F.count(F.lit(1)).alias("weeks")).filter(F.col("hits") >= least)


def trend(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Slope of a line through the values over the first value, and its class."""
    rows = df.groupBy(*keys).agg(F.regr_slope(value, time).alias("slope"), F.min_by(value, time).alias("first_value"), F.count(F.lit(1)).alias("n"))
    relative = F.try_divide(F.col("slope"), F.col("first_value"))
    return rows.withColumn("relative", relative).withColumn("trend", F.when(relative < -0.02, "declining").when(relative.isNotNull(), "flat"))


def refresh_class(df: DataFrame, source: str, period: str, content: Column) -> DataFrame:
    """How often a source's content changed: distinct contents over distinct periods."""
    rows = df.groupBy(source).agg(F.count_distinct(period).alias("periods"), F.count_distinct(content).alias("contents"))
    kind = F.when(F.col("periods") < 2, "too_few").when(F.col("contents") == 1, "static").when(F.col("contents") >= F.col("periods"), "every_period").otherwise("partial")
    return rows.withColumn("refresh", kind)


def error_quantiles(df: DataFrame, group: str, error: Column, alphas: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of the error in each group."""
    return df.groupBy(group).agg(*(F.percentile(error, F.lit(a)).alias(f"q{round(100 * a)}") for a in alphas))


def letter_grades(df: DataFrame, group: str, value: str, letters: str = "FDCBA", out: str = "grade") -> DataFrame:
    """Average-rank percentile within a group dealt into equal letters."""
    by = Window.partitionBy(group)
    rank = average_rank(value, by.orderBy(value), Window.partitionBy(group, value))
    n = F.count(F.lit(1)).over(by)
    place = F.when(n > 1, (rank - 1) / F.when(n > 1, n - 1).otherwise(1)).otherwise(0.5)
    which = F.least(F.floor(place * len(letters)), F.lit(len(letters) - 1)).cast("int")
    return df.withColumn(out, F.element_at(F.array(*(F.lit(x) for x in letters)), which + 1))

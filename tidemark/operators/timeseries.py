"""Point-in-time operators on rows keyed by entity and period. Every window has an explicit order."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_ewm(df: DataFrame, columns: Mapping[str, tuple[str, float]], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exponentially weighted means (out: value, span) with normalised weights, alpha = 2 / (span + 1), up to and including
    the row.

    Each is the quotient of two running sums of weights that grow by 1 / (1 - alpha) from row to row, so all of them share
    one sort and one window. Nulls get no weight but still age the rows before them; the result is null at a null. So that
    weights stay finite, a key's rows are summed in blocks, each after the last rows of the block before whose weights could
    change a double; a key may have any number of rows.
    """
    decays = {out: 1 - 2.0 / (span + 1) for out, (_, span) in columns.items()}
    rates = [-math.log(d) for d in decays.values() if d > 0] or [1.0]
    block, history = int(345 / max(rates)), math.ceil(40 / min(rates))
    if history > block:  # spans too far apart for common blocks
        for out, column in columns.items():
            df = with_ewm(df, {out: column}, keys, order)
        return df
    w = ordered(keys, order)
    rows = df.withColumn("__age", F.row_number().over(w) - 1)
    own = F.floor(F.col("__age") / block).cast("int")
    ends = F.col("__age") % block >= block - history
    rows = rows.withColumn("__block", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))))
    place = (F.col("__age") - (F.col("__block") - 1) * block).cast("double")
    running = ordered([*keys, "__block"], ["__age"]).rowsBetween(Window.unboundedPreceding, 0)
    sums, means = {}, {}
    for k, (out, (value, _)) in enumerate(columns.items()):
        known = F.col(value).isNotNull()
        if decays[out] <= 0:  # only the row itself counts
            means[out] = F.col(value).cast("double")
            continue
        weight = F.when(known, F.pow(F.lit(1 / decays[out]), place))
        sums |= {f"__num_{k}": F.sum(F.col(value) * weight).over(running), f"__den_{k}": F.sum(weight).over(running)}
        means[out] = F.when(known, F.col(f"__num_{k}") / F.col(f"__den_{k}"))
    rows = rows.withColumns(sums) if sums else rows
    return rows.withColumns(means).filter(F.col("__block") == own).drop("__age", "__block", *sums)


def lagged_ewm(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], span: float, out: str) -> DataFrame:
    """The exponentially weighted mean of the rows before."""
    return with_ewm(df, {out: (value, span)}, keys, order).withColumn(out, F.lag(out).over(ordered(keys, order)))


def expanding_mean(value: Column | str, keys: Sequence[str], order: Sequence[str], lag: int = 1) -> Column:
    """Mean of non-null values up to ``lag`` rows before."""
    return F.avg(value).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -lag))


def rolling_std(value: str, keys: Sequence[str], order: Sequence[str], window: int, least: int = 2) -> Column:
    """Sample standard deviation of the last ``window`` rows, null with fewer than ``least`` values."""
    frame = ordered(keys, order).rowsBetween(1 - window, 0)
    return F.when(F.count(value).over(frame) >= least, F.stddev_samp(value).over(frame))


def rolling_mean(value: Column | str, keys: Sequence[str], order: Sequence[str], first: int, last: int, least: int = 1) -> Column:
    frame = ordered(keys, order).rowsBetween(first, last)
    return F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))


def prior_season_mean(df: DataFrame, value: str, entity: str, season: str, out: str) -> DataFrame:
    """The entity's mean over the season before."""
    before = df.groupBy(entity, season).agg(F.avg(value).alias(out)).withColumn(season, F.col(season) + 1)
    return df.join(before, [entity, season], "left")


def lag_shift_join(grid: DataFrame, features: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], lag: int = 1) -> DataFrame:
    """Features of the period number ``lag`` before, by equality: a missing period gives null, unlike a lag by rows."""
    shifted = features.select(*keys, (F.col(period) + lag).alias(period), *columns)
    return grid.join(shifted, [*keys, period], "left")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], strict: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """For each left row the last right row of its keys at or before (``strict``: before) its ``on``, null where none.

    Both sides are put into one sequence per key, and the last right row is carried forward: one shuffle and one sort.
    ``order`` breaks ties of right rows. A key null on either side matches nothing.
    """
    carried = F.struct(*columns)
    left_rows = left.select(*left.columns, F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__carried"), F.lit(0 if strict else 1).alias("__side"))
    left_rows = left_rows.select(*keys, F.col(on), F.struct(*left.columns).alias("__left"), "__carried", "__side", *(F.lit(None).cast(right.schema[c].dataType).alias(f"__tie_{c}") for c in order))
    right_rows = right.select(*keys, F.col(on), F.lit(None).cast(left_rows.schema["__left"].dataType).alias("__left"), carried.alias("__carried"), F.lit(1 if strict else 0).alias("__side"), *(F.col(c).alias(f"__tie_{c}") for c in order))
    for k in keys:
        right_rows = right_rows.filter(F.col(k).isNotNull())
    w = ordered(keys, [on, "__side", *(f"__tie_{c}" for c in order)]).rowsBetween(Window.unboundedPreceding, 0)
    met = left_rows.unionByName(right_rows).withColumn("__found", F.last("__carried", ignorenulls=True).over(w))
    return met.filter(F.col("__left").isNotNull()).select("__left.*", *(F.col(f"__found.{c}").alias(c) for c in columns))


def forward_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """For each left row the first right row of its keys at or after its ``on``."""
    flipped = lambda df: df.withColumn("__back", -F.unix_micros(F.col(on).cast("timestamp")))
    return asof_join(flipped(left), flipped(right), keys, "__back", columns, order=order).drop("__back")


def periods_in_role(df: DataFrame, value: str, keys: Sequence[str], period: str, threshold: float, out: str) -> DataFrame:
    """Periods since the value last moved by more than ``threshold`` from one row to the next, or since the first."""
    w = ordered(keys, [period])
    moved = F.abs(F.col(value) - F.lag(value).over(w)) > threshold
    marked = df.withColumn("__change", F.when(moved, F.col(period)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    since = F.coalesce(F.last("__change", ignorenulls=True).over(running), F.first(period).over(running))
    return marked.withColumn(out, F.col(period) - since).drop("__change")


def runs(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Runs of rows where ``flag`` holds: keys, run, length."""
    w = ordered(keys, order)
    begins = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    numbered = df.withColumn("__begins", begins).withColumn("run", F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.filter(F.col(flag)).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("length"))


def seasons_before(df: DataFrame, amount: Column, entity: str, season: str, out: str, seasons: Sequence[int] = (1, 2)) -> DataFrame:
    """Sum of an amount over the seasons before, 0 where there were none."""
    sums = df.groupBy(entity, season).agg(F.sum(amount).alias("__amount"))
    for k in seasons:
        df = df.join(sums.select(entity, (F.col(season) + k).alias(season), F.col("__amount").alias(f"__amount_{k}")), [entity, season], "left")
    total = sum((F.coalesce(F.col(f"__amount_{k}"), F.lit(0)) for k in seasons), F.lit(0))
    return df.withColumn(out, total).drop(*(f"__amount_{k}" for k in seasons))


def weeks_since(flag: Column, keys: Sequence[str], period: str, default: int = 99) -> Column:
    """Periods since the flag last held on an earlier row, ``default`` if it never did."""
    w = ordered(keys, [period]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col(period) - F.last(F.when(flag, F.col(period)), ignorenulls=True).over(w), F.lit(default))


def pooled_prior_means(df: DataFrame, group: str, season: str, period: str, values: Mapping[str, Column | str]) -> DataFrame:
    """A group's means (out: value) over all rows of earlier periods of the season; before the first, over the season
    before. All values share one aggregation, to a row for each group and period."""
    values = {out: F.col(v) if isinstance(v, str) else v for out, v in values.items()}
    sums = df.groupBy(group, season, period).agg(*(x for k, v in enumerate(values.values()) for x in (F.sum(v).alias(f"__s{k}"), F.count(v).alias(f"__n{k}"))))
    past = ordered([group, season], [period]).rowsBetween(Window.unboundedPreceding, -1)
    every = range(len(values))
    whole = sums.groupBy(group, season).agg(*(F.try_divide(F.sum(f"__s{k}"), F.sum(f"__n{k}")).alias(f"__w{k}") for k in every)).withColumn(season, F.col(season) + 1)
    running = sums.select(group, season, period, *(F.try_divide(F.sum(f"__s{k}").over(past), F.sum(f"__n{k}").over(past)).alias(f"__m{k}") for k in every))
    table = running.join(whole, [group, season], "left").select(group, season, period, *(F.coalesce(f"__m{k}", f"__w{k}").alias(out) for k, out in enumerate(values)))
    return df.join(table, [group, season, period], "left")


def pooled_prior_mean(df: DataFrame, group: str, season: str, period: str, value: Column | str, out: str) -> DataFrame:
    return pooled_prior_means(df, group, season, period, {out: value})

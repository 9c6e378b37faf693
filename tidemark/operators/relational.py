"""Joins, unions, dedupes and keyed updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sides(games: DataFrame, home: Mapping[str, Column | str], away: Mapping[str, Column | str]) -> DataFrame:
    """One row per side of a game, in one pass over the games: the same columns from the home and the away point of view."""
    def side(columns: Mapping[str, Column | str]) -> Column:
        return F.struct(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()))

    return games.select(F.inline(F.array(side(home), side(away))))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).filter("__row = 1").drop("__row")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of the last row of each key, by an aggregate that combines before the shuffle."""
    last = F.max(F.struct(*order, *(F.col(c).alias(f"__{c}") for c in columns))).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col(f"__last.__{c}").alias(c) for c in columns))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their ordinal rank. Spark keeps n rows a task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of all old rows with their keys; columns missing on a side are null."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def schema_union(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing in a frame is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, cast leniently; missing ones are null."""
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def full_join(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Full outer joins with the keys of either side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), "full")
    return out


def counted(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Counts of several conditions in one pass; a key stays if any condition holds for one of its rows."""
    rows = df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))
    return rows.filter(sum((F.col(n) for n in conditions), F.lit(0)) > 0)


def completed_pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: Column, prefix: str = "") -> DataFrame:
    """One column for each stated value (null where there is none), without a pass to find the values."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(column) == F.lit(v), value)).alias(f"{prefix}{v}") for v in values))


def unique_or_raise(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows; fails where a key has more than one."""
    w = Window.partitionBy(*keys)
    checked = F.when(F.count(F.lit(1)).over(w) > 1, F.raise_error(F.lit(f"repeated key {tuple(keys)}"))).otherwise(F.lit(True)).cast("boolean")
    return df.withColumn("__unique", checked).filter("__unique").drop("__unique")


def visible(df: DataFrame, known_at: str, as_of: Column) -> DataFrame:
    """Rows known strictly before a time."""
    return df.filter(F.col(known_at) < as_of)


def assert_no_leakage(df: DataFrame, known_at: str, as_of: Column) -> DataFrame:
    """The rows; fails on one that was not yet known, or whose time is unknown."""
    late = F.col(known_at).isNull() | (F.col(known_at) >= as_of)
    checked = F.when(late, F.raise_error(F.concat(F.lit("row known too late: "), F.coalesce(F.col(known_at).cast("string"), F.lit("never"))))).otherwise(F.lit(True)).cast("boolean")
    return df.withColumn("__seen", checked).filter("__seen").drop("__seen")


def full_difference(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value now and before and their difference, missing counting as 0."""
    both = full_join(keys, current.select(*keys, F.col(value).alias("now")), previous.select(*keys, F.col(value).alias("before")))
    return both.fillna(0, ["now", "before"]).withColumn("change", F.col("now") - F.col("before"))


def future_opponents(both: DataFrame, team: str, opponent: str, season: str, week: str, at: int) -> DataFrame:
    """What each side has left of its season after week ``at``: games, distinct opponents and the next week. Sides without games
    left give no row."""
    left = both.filter(F.col(week) > at)
    return left.groupBy(team, season).agg(F.count(F.lit(1)).alias("games_left"), F.count_distinct(opponent).alias("opponents_left"), F.min(week).alias("next_week"))

"""Availability, role and matchup adjustments of projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import as_column, cascade, clip, ratio

#: Share of normal availability by weeks since a report, by status.
CURVES: Mapping[str, Sequence[float]] = {"out": (0.0, 0.35, 0.65, 0.85), "doubtful": (0.25, 0.7, 0.9), "questionable": (0.85, 0.95)}


def duration_weeks(text: Column | str) -> Column:
    """Weeks out by a report's words: "2-4 weeks" (the mean), "3 weeks", "10 days" (sevenths, up), "season", "day-to-day"."""
    text = F.lower(as_column(text))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("double")

    span = r"(\d+)\s*(?:-|to)\s*(\d+)\s*weeks?"
    days = r"(\d+)\s*(?:-|to)\s*(\d+)\s*days?"
    return F.coalesce(
        (number(span, 1) + number(span, 2)) / 2,
        number(r"(\d+)\s*weeks?", 1),
        F.ceil(number(days, 2) / 7).cast("double"),
        F.ceil(number(r"(\d+)\s*days?", 1) / 7).cast("double"),
        F.when(text.rlike("season|indefinite"), 18.0),
        F.when(text.rlike("week.to.week"), 2.0),
        F.when(text.rlike("day.to.day"), 0.5),
    )


def availability(status: Column, weeks_out: Column, offset: Column) -> Column:
    """Multiplier for a period ``offset`` after a report: 0 while a stated duration lasts, else the status's curve."""
    curve = F.lit(1.0)
    for name, values in CURVES.items():
        at = F.try_element_at(F.array(*(F.lit(v) for v in values)), (offset + 1).cast("int"))
        curve = F.when(status == name, F.coalesce(at, F.lit(1.0))).otherwise(curve)
    return F.when(weeks_out.isNotNull() & (offset < F.floor(weeks_out)), 0.0).when(weeks_out.isNotNull() & (offset < weeks_out), 0.5).otherwise(curve)


def combined_multipliers(adjustments: DataFrame, keys: Sequence[str], multiplier: str, kind: str, capped_kind: str, most: float) -> DataFrame:
    """Product of a key's multipliers; the product of those of one kind counts up to ``most``."""
    capped = F.product(F.when(F.col(kind) == capped_kind, F.col(multiplier)))
    rest = F.product(F.when(F.col(kind) != capped_kind, F.col(multiplier)))
    total = F.coalesce(rest, F.lit(1.0)) * F.coalesce(F.least(capped, F.lit(most)), F.lit(1.0))
    return adjustments.groupBy(*keys).agg(total.alias(multiplier), F.count(F.lit(1)).alias("adjustments"))


def scaled(df: DataFrame, columns: Sequence[str], multiplier: Column) -> DataFrame:
    """Several columns times one multiplier (1 where there is none)."""
    return df.withColumns({c: F.col(c) * F.coalesce(multiplier, F.lit(1.0)) for c in columns})


def ruled_out(df: DataFrame, columns: Sequence[str], out: DataFrame, key: str) -> DataFrame:
    """Zero the columns of rows whose key is in a table."""
    marked = df.join(out.select(key).distinct().withColumn("__out", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("__out"), 0.0).otherwise(F.col(c)) for c in columns}).drop("__out")


def role_change(df: DataFrame, entity: str, period: str, signals: Sequence[str], recent: int = 2, before: int = 6, step: float = 0.1, least: int = 2, most: float = 0.15) -> DataFrame:
    """Means of signals over an entity's last periods against the ones before: a multiplier, capped, where at least
    ``least`` signals moved by more than ``step`` the same way."""
    back = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(period)))
    rows = df.withColumn("__back", back).filter(F.col("__back") <= recent + before)
    near, far = F.col("__back") <= recent, F.col("__back") > recent
    means = rows.groupBy(entity).agg(*(x for s in signals for x in (F.avg(F.when(near, F.col(s))).alias(f"__n_{s}"), F.avg(F.when(far, F.col(s))).alias(f"__f_{s}"))))
    moves = [ratio(F.col(f"__n_{s}") - F.col(f"__f_{s}"), f"__f_{s}") for s in signals]
    up = sum((F.coalesce((m > step).cast("int"), F.lit(0)) for m in moves), F.lit(0))
    down = sum((F.coalesce((m < -step).cast("int"), F.lit(0)) for m in moves), F.lit(0))
    mean = sum((F.coalesce(m, F.lit(0.0)) for m in moves), F.lit(0.0)) / len(signals)
    multiplier = F.when((up >= least) & (down == 0) | (down >= least) & (up == 0), 1 + clip(mean, -most, most))
    return means.select(entity, up.alias("up"), down.alias("down"), multiplier.alias("multiplier")).filter(F.col("multiplier").isNotNull())


def faded(multiplier: Column, offset: Column, horizon: int) -> Column:
    """A multiplier that returns to 1 in a straight line over a horizon."""
    return 1 + (multiplier - 1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - offset / F.lit(float(horizon))))


def matchup_weight(value: Column, mean: Column, sd: Column, slope: float = 0.15, most: float = 0.3) -> Column:
    """1 plus a share of the standardised value, bounded; 1 where there is no spread."""
    return F.when(sd > 0, 1 + F.coalesce(clip(slope * F.try_divide(value - mean, sd), -most, most), F.lit(0.0))).otherwise(1.0)


def allocated(df: DataFrame, entity: Sequence[str], total: Column, weight: Column, out: str = "allocated") -> DataFrame:
    """A total spread over an entity's rows by weight."""
    return df.withColumn(out, ratio(total * weight, F.sum(weight).over(Window.partitionBy(*entity))))


def shrunk(value: Column, n: Column, prior: Column, strength: float) -> Column:
    """(n value + k prior) / (n + k); the prior where there is no value."""
    n0 = F.when(value.isNull(), 0).otherwise(F.coalesce(n, F.lit(0)))
    return (n0 * F.coalesce(value, F.lit(0.0)) + strength * prior) / (n0 + strength)


def coverage_class(projected: Column, active: Column, injured: Column, known: Column) -> Column:
    """Why an entity has no projection, first reason first."""
    return cascade([(projected, "projected"), (~known, "unknown"), (injured, "injured"), (~active, "inactive")], "missing")


def base_availability(group: Column, age: Column, rates: Mapping[str, tuple[float, float, float]], floor: float = 0.5) -> Column:
    """Base rate less a decline for each year past an age, at least ``floor``. rates: group: (rate, age, decline)."""
    out = F.lit(None).cast("double")
    for g, (rate, cliff, decline) in rates.items():
        out = F.when(group == g, F.greatest(F.lit(floor), rate - decline * F.greatest(F.lit(0.0), F.coalesce(age, F.lit(0.0)) - cliff))).otherwise(out)
    return out


def confidence(gain: Column, p_active: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """A score from gain, availability and width of an interval, and its class."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = 0.45 * unit(gain / 5.0) + 0.35 * unit(p_active) + 0.20 * unit(1 - (high - low) / 35.0)
    return score, F.when(score >= 0.72, "High").when(score >= 0.5, "Medium").otherwise("Low")


def season_weeks(first: Column, last: Column, playoffs: int, weight: float) -> Column:
    """Weeks from first to last, those from ``playoffs`` on at a weight."""
    n = F.greatest(F.lit(0), last - first + 1)
    late = F.greatest(F.lit(0), F.least(n, last - F.greatest(first, F.lit(playoffs)) + 1))
    return (n - late) + late * F.lit(float(weight))

"""Rule-driven scoring: a weight map over stat columns folded into one expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import listed_count, listed_sum


@dataclass(frozen=True)
class Direct:
    """A stat column times its weight."""

    column: str


@dataclass(frozen=True)
class Derived:
    """An expression of the stat columns times its weight."""

    compute: Callable[[DataFrame], Column]


def between(column: str, low: float, high: float) -> Derived:
    """1 where a column lies from low to high."""
    return Derived(lambda df: F.when(F.col(column).between(low, high), 1.0).otherwise(0.0))


def at_least(column: str, threshold: float) -> Derived:
    return Derived(lambda df: F.when(F.col(column) >= threshold, 1.0).otherwise(0.0))


def sum_of(*columns: str) -> Derived:
    return Derived(lambda df: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)))


def only(condition: Callable[[DataFrame], Column], column: str) -> Derived:
    """A column on the rows of a condition."""
    return Derived(lambda df: F.when(condition(df), F.coalesce(F.col(column).cast("double"), F.lit(0.0))).otherwise(0.0))


def listed(column: str, low: float | None = None, high: float | None = None) -> Derived:
    """Sum of a delimited list of numbers, or how many of them lie from low to high."""
    if low is None:
        return Derived(lambda df: listed_sum(column))
    return Derived(lambda df: listed_count(column, low, high).cast("double"))


Rules = Mapping[str, Direct | Derived]


def unhandled(weights: Mapping[str, float], rules: Rules) -> list[str]:
    """Keys with a weight other than zero that no rule knows."""
    return sorted(k for k, w in weights.items() if w and k not in rules)


def score(df: DataFrame, weights: Mapping[str, float], rules: Rules, exclusive: tuple[frozenset[str], ...] = ()) -> Column:
    """The sum of weight x stat; nulls count as 0. Raises on unknown keys and on keys of more than one of ``exclusive``."""
    if missing := unhandled(weights, rules):
        raise ValueError(f"no rule for {missing}")
    used = {k for k, w in weights.items() if w}
    if sum(bool(used & e) for e in exclusive) > 1:
        raise ValueError("weights mix schemes that exclude each other")
    out = F.lit(0.0)
    for key in sorted(used):
        rule = rules[key]
        stat = F.col(rule.column).cast("double") if isinstance(rule, Direct) else rule.compute(df)
        out = out + F.coalesce(stat, F.lit(0.0)) * F.lit(float(weights[key]))
    return out


def with_missing_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Typed nulls for columns that a frame lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})

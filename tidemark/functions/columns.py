"""Column builders. Null policy: division by zero and NaN give null, clips pass null through."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def as_column(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where the denominator is zero or null."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def on_grid(x: Column | str, digits: int) -> Column:
    """A value on a decimal grid, by a rule without ties at halves, so that sums in any order give one result."""
    scale = float(10**digits)
    return F.floor(as_column(x) * scale + 0.4142) / scale


def clip(x: Column | str, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounds that leave null null (greatest and least alone would skip it)."""
    x = as_column(x)
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, as_column(low))
    if high is not None:
        bounded = F.least(bounded, as_column(high))
    return F.when(x.isNotNull(), bounded)


def total(x: Column | str) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(as_column(x)), F.lit(0))


def share(condition: Column) -> Column:
    """Mean of a predicate, nulls left out."""
    return F.avg(condition.cast("double"))


def lookup(key: Column | str, values: Mapping, default: Column | object = None) -> Column:
    """A fixed map as a CASE expression; ``default`` for other keys."""
    key = as_column(key)
    out = default if isinstance(default, Column) else F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def remap(key: Column | str, values: Mapping) -> Column:
    """Maps some values and keeps the others."""
    return lookup(key, values, as_column(key))


def cascade(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, as_column(value) if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def average_rank(x: Column | str, by: WindowSpec, ties: WindowSpec) -> Column:
    """Rank with ties at their mean. ``by`` is ordered by x, ``ties`` is partitioned by the same keys and x."""
    return F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function by the rational approximation 7.1.26 of Abramowitz and Stegun for erf
    (error below 1.5e-7), so that it stays inside generated code."""
    z = as_column(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = reduce(lambda acc, a: (acc + a) * t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    erf = 1 - series * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def minutes_seconds(text: Column | str) -> Column:
    """Seconds of "M:SS", null if it is not one."""
    text = as_column(text)
    return F.try_element_at(F.split(text, ":"), F.lit(1)).try_cast("int") * 60 + F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("int")


def numbers(text: Column | str, separator: str = ";") -> Column:
    """Numbers of a delimited list; empty and unreadable items are left out."""
    items = F.transform(F.split(F.coalesce(as_column(text), F.lit("")), separator), lambda x: F.trim(x).try_cast("double"))
    return F.array_compact(items)


def listed_sum(text: Column | str, separator: str = ";") -> Column:
    return F.aggregate(numbers(text, separator), F.lit(0.0), lambda a, x: a + x)


def listed_count(text: Column | str, low: float, high: float, separator: str = ";") -> Column:
    """How many numbers of a delimited list lie from low to high."""
    return F.size(F.filter(numbers(text, separator), lambda x: (x >= low) & (x <= high)))


def trimmed_mean(values: Column, trim: float = 0.2) -> Column:
    """Mean of an array without int(n * trim) values at either end; of all where nothing would be left."""
    ordered = F.array_sort(F.array_compact(values))
    n = F.size(ordered)
    cut = F.floor(n * F.lit(trim)).cast("int")
    kept = F.when(n - 2 * cut > 0, F.slice(ordered, cut + 1, F.greatest(n - 2 * cut, F.lit(1)))).otherwise(ordered)
    return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def interpolate(x: Column | str, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear function through fixed points, flat beyond them."""
    x = as_column(x)
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        out = F.when(x < x1, y0 + (x - x0) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out))


#: Suffixes of names that name_key drops, and first names that it spells out.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def name_key(name: Column | str, nicknames: Mapping[str, str] | None = None) -> Column:
    """A name for joining: accents of Latin letters off, lower case, punctuation off, generational suffix off, nickname
    of the first word spelled out."""
    marked = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿ"
    plain = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyy"
    text = F.lower(F.translate(as_column(name), marked, plain))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[-]", " "), "[^a-z0-9 ]", ""))
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), f"( ({'|'.join(SUFFIXES)}))+$", "")
    if nicknames:
        first = F.split(text, " ")[0]
        text = F.concat(remap(first, nicknames), F.substring(text, F.length(first) + 1, 10_000))
    return text


def content_id(*parts: Column | str, length: int = 12) -> Column:
    """Hexadecimal digest of values, null and empty kept apart."""
    spelled = [F.coalesce(F.concat(F.lit("="), as_column(p).cast("string")), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *spelled), 256), 1, length)


def local_to_utc(text: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Local wall time as UTC, null if it cannot be read, does not exist or exists twice."""
    local = F.try_to_timestamp(text, F.lit(pattern))
    utc = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(utc, zone)
    twice = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone) == local
    twice |= F.from_utc_timestamp(utc - F.expr("INTERVAL 1 HOUR"), zone) == local
    return F.when((back == local) & ~twice, utc)

"""Resolving names and ids between tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tidemark.session import ship


def indel_ratio(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / lengths): twice the longest common subsequence over both lengths. The rows of
    the dynamic programme are the bits of one integer."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:
        match = state & places.get(c, 0)
        state = ((state + match) | (state - match)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / (len(a) + len(b))


def similarity(a: Column, b: Column) -> Column:
    """Indel ratio of two columns, null where either is."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def prefer_first(df: DataFrame, keys: Sequence[str], preferred: str, tie: str) -> DataFrame:
    """One row for each key: one with the preferred id if there is one."""
    w = Window.partitionBy(*keys).orderBy(F.col(preferred).isNull(), tie)
    return df.withColumn("__row", F.row_number().over(w)).filter("__row = 1").drop("__row")


def layered(base: DataFrame, layer: DataFrame, link: str, target: str) -> DataFrame:
    """Fill a missing id from a layer by a link, and append the layer's rows that nothing links to."""
    filled = base.join(layer.select(link, F.col(target).alias("__new")), link, "left").withColumn(target, F.coalesce(target, "__new")).drop("__new")
    return filled.unionByName(layer.join(base.select(link), link, "left_anti"), allowMissingColumns=True)


def canonical_id(native: Column, *parts: Column) -> Column:
    """A native id, or a synthetic one from other parts."""
    return F.coalesce(native, F.concat(F.lit("synthetic_"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)))


def overridden(df: DataFrame, overrides: DataFrame, key: str, target: str) -> DataFrame:
    """Ids replaced by a table of overrides."""
    o = overrides.select(key, F.col(target).alias("__over"))
    return df.join(o, key, "left").withColumn(target, F.coalesce("__over", target)).drop("__over")


def exact_then_loose(left: DataFrame, right: DataFrame, levels: Sequence[Sequence[str]], left_id: str, right_id: str) -> DataFrame:
    """Pairs by equality of the first set of columns on which a row has exactly one partner, level after level; a row once
    matched is out of the later ones."""
    matched: DataFrame | None = None
    for n, keys in enumerate(levels):
        l = left if matched is None else left.join(matched.select(left_id), left_id, "left_anti")
        r = right if matched is None else right.join(matched.select(right_id), right_id, "left_anti")
        single = lambda df, i: df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(i).alias(i), F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")  # noqa: E731, B023
        found = single(l, left_id).join(single(r, right_id), list(keys)).select(left_id, right_id, F.lit(n).alias("level"))
        matched = found if matched is None else matched.unionByName(found)
    return matched


def fuzzy_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], left_name: str, right_name: str, floor: float) -> DataFrame:
    """Pairs within a block whose names are at least ``floor`` alike. Blocks must be of bounded size (position and initial,
    not position alone); lengths that cannot reach the floor are left out before the comparison."""
    ship(left.sparkSession)
    pairs = left.join(right, list(block))
    a, b = F.length(left_name), F.length(right_name)
    possible = F.lit(200.0) * F.least(a, b) >= floor * (a + b)
    return pairs.filter(possible).withColumn("score", similarity(F.col(left_name), F.col(right_name))).filter(F.col("score") >= floor)


def greedy_one_to_one(pairs: DataFrame, block: Sequence[str], left_id: str, right_id: str, score: str) -> DataFrame:
    """Best pairs first, each side once, block by block (ties by the ids)."""
    ship(pairs.sparkSession)
    schema = pairs.schema

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, left_id, right_id], ascending=[False, True, True])
        used_left, used_right, keep = set(), set(), []
        for k, (l, r) in enumerate(zip(rows[left_id], rows[right_id], strict=True)):
            if l not in used_left and r not in used_right:
                used_left.add(l)
                used_right.add(r)
                keep.append(k)
        return rows.iloc[keep]

    return pairs.groupBy(*block).applyInPandas(choose, schema)


def best_first(scores: Sequence[tuple], left_ids: dict, right_ids: dict) -> list[tuple]:
    """(left id, right id, score) of :func:`greedy_one_to_one` over all rows of scored pairs of names (left, right, score), where
    each name has sorted ids: at one score a left row, by id, takes the smallest id left among its names' partners."""
    levels: dict[float, list[tuple]] = {}
    for l, r, score in scores:
        levels.setdefault(score, []).append((l, r))
    used_left, used_right, at, out = set(), set(), dict.fromkeys(right_ids, 0), []
    for score in sorted(levels, reverse=True):
        partners: dict[object, list] = {}
        for l, r in levels[score]:
            for i in left_ids[l]:
                if i not in used_left:
                    partners.setdefault(i, []).append(r)
        for i in sorted(partners):
            least = None
            for name in partners[i]:
                ids = right_ids[name]
                while at[name] < len(ids) and ids[at[name]] in used_right:
                    at[name] += 1
                if at[name] < len(ids) and (least is None or ids[at[name]] < least):
                    least = ids[at[name]]
            if least is not None:
                used_left.add(i)
                used_right.add(least)
                out.append((i, least, score))
    return out


def fuzzy_one_to_one(left: DataFrame, right: DataFrame, block: Sequence[str], left_id: str, right_id: str, left_name: str, right_name: str, floor: float) -> DataFrame:
    """block, left_id, right_id, score: what :func:`greedy_one_to_one` chooses of :func:`fuzzy_pairs`, with each pair of different
    names compared once a block and rows of one name never formed into pairs. A block's rows, not its pairs, meet in a task. Rows
    without an id have no part."""
    left, right = left.dropna(subset=[left_id, left_name]), right.dropna(subset=[right_id, right_name])
    names = fuzzy_pairs(left.select(*block, left_name).distinct(), right.select(*block, right_name).distinct(), block, left_name, right_name, floor)
    rows = left.select(*block, left_id, F.col(left_name).alias("__name")).unionByName(right.select(*block, right_id, F.col(right_name).alias("__name")), allowMissingColumns=True)
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # attributes of its own, for the cogroup
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def choose(key: tuple, scored: pa.Table, own: pa.Table) -> pa.Table:
        ids: tuple[dict, dict] = {}, {}
        for l, r, name in zip(own[left_id].to_pylist(), own[right_id].to_pylist(), own["__name"].to_pylist(), strict=True):
            side, i = (0, l) if r is None else (1, r)
            ids[side].setdefault(name, set()).add(i)
        scores = list(zip(scored[left_name].to_pylist(), scored[right_name].to_pylist(), scored["score"].to_pylist(), strict=True))
        found = best_first(scores, *({name: sorted(x) for name, x in side.items()} for side in ids))
        columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((own.schema.field(left_id).type, own.schema.field(right_id).type, pa.float64()))]
        blocks = [pa.array([k.as_py()] * len(found), k.type) for k in key]
        return pa.Table.from_arrays([*blocks, *columns], names=[*block, left_id, right_id, "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*block, left_id, right_id)), "score double"])
    return names.groupBy(*block).cogroup(rows.groupBy(*block)).applyInArrow(choose, schema)


def best_match(pairs: DataFrame, left_id: str, score: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Each left row's best partner."""
    best = F.max(F.struct(F.col(score), (-F.xxhash64(tie)).alias("__tie"), *columns)).alias("__best")
    return pairs.groupBy(left_id).agg(best).select(left_id, *(F.col(f"__best.{c}").alias(c) for c in [score, *columns]))


def nearest(left: DataFrame, right: DataFrame, block: Sequence[str], left_value: str, right_value: str, left_id: str, right_id: str) -> DataFrame:
    """Of each left row's block the right row with the nearest value, the smallest id of equals; without a value on either side
    (null last, NaN before it) the smallest id of the block, and no gap.

    No pairs are formed: both sides are sorted once by value, and a row's candidates are the last right value up to its own, the
    first from it on, and the smallest id of each kind of value. Of gaps that only rounding makes equal, the nearest value's."""
    kept, a, b = list(block), F.col(left_value), F.col(right_value)
    item = F.struct(b.alias("value"), F.col(right_id).alias("id"))
    kind = F.when(b.isNull(), 4).when(F.isnan(b), 3).when(b == float("inf"), 2).when(b == float("-inf"), 1).otherwise(0)
    first = right.groupBy(*kept, kind.alias("__kind")).agg(F.min_by(item, right_id).alias("__item")).groupBy(*kept).agg(F.collect_list("__item").alias("__first"))
    values = right.filter(b.isNotNull() & ~F.isnan(b)).groupBy(*kept, right_value).agg(F.min(right_id).alias(right_id)).select(*kept, b.alias("__at"), item.alias("__item"))
    rows = left.select(*kept, a.alias("__at"), F.struct(a.alias("value"), F.col(left_id).alias("id")).alias("__left")).unionByName(values, allowMissingColumns=True)
    w = Window.partitionBy(*kept).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("__item", ignorenulls=True)
    own = F.col("__left").isNotNull()
    met = rows.withColumns({"__below": found.over(w.orderBy("__at", own)), "__above": found.over(w.orderBy(F.desc("__at"), own))}).filter(own).join(first, kept)
    gap = lambda x: F.abs(F.col("__left.value") - x["value"])
    candidates = F.filter(F.concat(F.array("__below", "__above"), F.col("__first")), lambda x: x.isNotNull())
    best = F.array_min(F.transform(candidates, lambda x: F.struct(gap(x).isNull().alias("none"), gap(x).alias("gap"), x["id"].alias("id"))))
    out = met.select(F.col("__left.id").alias(left_id), best.alias("__best")).groupBy(left_id).agg(F.min("__best").alias("__best"))
    return out.select(left_id, F.col("__best.id").alias(right_id), F.col("__best.gap").alias("gap"))


def compared(recorded: DataFrame, computed: DataFrame, key: Sequence[str], recorded_value: str, computed_value: str, tolerance: float = 0.01) -> DataFrame:
    """Every recorded value against the computed one (0 and flagged where there is none)."""
    met = recorded.join(computed, list(key), "left").withColumn("missing", F.col(computed_value).isNull())
    gap = F.abs(F.col(recorded_value) - F.coalesce(F.col(computed_value), F.lit(0.0)))
    return met.select(*key, recorded_value, F.coalesce(computed_value, F.lit(0.0)).alias(computed_value), "missing", (gap > tolerance).alias("differs"))



"""Replacement levels, value over replacement, tiers, opportunity cost, market prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import normal_cdf
from tidemark.session import ship


def converge_starters(points: Mapping[str, Sequence[float]], starters: Mapping[str, int], flex: Sequence[str], flex_slots: int, most: int = 10) -> dict[str, int]:
    """How many of each group start: dedicated slots, then flex slots to the best left over, until nothing changes.

    ``points`` are descending lists cut to the number that can start at all, so their size is bounded by the slots."""
    count = dict(starters)
    for _ in range(most):
        rest = sorted(((p, g) for g in flex for p in points.get(g, ())[starters.get(g, 0) :]), key=lambda x: (-x[0], x[1]))
        won = [g for _, g in rest[:flex_slots]]
        new = {g: starters.get(g, 0) + won.count(g) for g in {*starters, *flex}}
        if new == count:
            break
        count = new
    return count


def startable(projections: DataFrame, group: str, value: str, tie: str, starters: Mapping[str, int], flex: Sequence[str], flex_slots: int) -> dict[str, int]:
    """Starters of each group; only the few rows of a group that can start reach the driver."""
    slots = max([*starters.values(), 0]) + flex_slots
    w = Window.partitionBy(group).orderBy(F.desc(value), tie)
    top = projections.filter(F.col(value).isNotNull()).withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= slots)
    points: dict[str, list[float]] = {}
    for r in top.select(group, value, "__rank").orderBy(group, "__rank").collect():
        points.setdefault(r[0], []).append(r[1])
    return converge_starters(points, starters, flex, flex_slots)


def replacement_level(projections: DataFrame, group: str, value: str, tie: str, ranks: Mapping[str, int]) -> DataFrame:
    """The value of the group's n-th best, or of its last where it has fewer."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(F.desc(value), tie))
    rows = projections.filter(F.col(value).isNotNull()).withColumn("__rank", rank).withColumn("__n", F.count(F.lit(1)).over(w))
    wanted = F.create_map(*(x for g, n in ranks.items() for x in (F.lit(g), F.lit(max(1, n)))))
    return rows.filter(F.col("__rank") == F.least(F.col("__n"), F.try_element_at(wanted, F.col(group)))).select(group, F.col(value).alias("replacement"))


def value_over_replacement(projections: DataFrame, levels: DataFrame, group: str, value: str) -> DataFrame:
    """Value less the group's replacement; a group without one is an error."""
    joined = projections.join(levels, group, "left")
    missing = F.raise_error(F.concat(F.lit("no replacement level for "), F.col(group).cast("string"))).cast("double")
    return joined.withColumn("vor", F.when(F.col("replacement").isNull(), missing).otherwise(F.col(value) - F.col("replacement")))


def gap_tiers(df: DataFrame, group: str, value: str, tie: str, window: int = 9, factor: float = 1.4, most: int = 12) -> DataFrame:
    """A new tier where the gap to the next is over ``factor`` times the centred median of gaps, ``most`` tiers at most."""
    by = Window.partitionBy(group).orderBy(F.desc(value), tie)
    gaps = df.withColumn("rank", F.row_number().over(by)).withColumn("__gap", F.lag(value).over(by) - F.col(value))
    half = window // 2
    # the first row has no gap before it, so gaps are numbered from the second row
    local = F.percentile("__gap", F.lit(0.5)).over(by.rowsBetween(-half, half))
    opens = F.coalesce((F.col("__gap") > factor * F.col("__local")) & (F.col("__gap") > 0), F.lit(False)).cast("int")
    out = gaps.withColumn("__local", local).withColumn("__opens", opens)
    tier = 1 + F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("tier", F.least(tier, F.lit(most)).cast("int")).drop("__gap", "__local", "__opens")


def merge_small(sizes: Sequence[int], least: int) -> list[int]:
    """Group numbers of segments after segments under ``least`` joined the one before (the first: the one after)."""
    groups: list[list[int]] = []
    for i, n in enumerate(sizes):
        if groups and (n < least or sum(sizes[k] for k in groups[-1]) < least):
            groups[-1].append(i)
        else:
            groups.append([i])
    return [g for g, members in enumerate(groups) for _ in members]


def cap_segments(starts: Sequence[int], values: Sequence[float], most: int) -> list[int]:
    """Segment starts after the smallest gaps between segments closed until ``most`` are left."""
    starts = list(starts)
    while len(starts) > most:
        gaps = [(values[s - 1] - values[s], k) for k, s in enumerate(starts) if k]
        starts.pop(min(gaps)[1])
    return starts


def normalised_tiers(df: DataFrame, group: str, value: str, tie: str, least: int = 2, most: int = 12) -> DataFrame:
    """Gap tiers with small ones merged and at most ``most``. The raw tiers come from windows, however many there are; only one row for
    each tier and group reaches the sequential rule."""
    raw = gap_tiers(df, group, value, tie, most=(1 << 31) - 1)
    edges = raw.groupBy(group, "tier").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"), F.min(value).alias("bottom"))

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tier", ignore_index=True)
        rows["final"] = merge_small(rows["n"].tolist(), least)
        while rows["final"].nunique() > most:
            ends = rows.groupby("final").agg(top=("top", "max"), bottom=("bottom", "min"))
            gaps = ends["bottom"].shift(1) - ends["top"]
            at = int(gaps.idxmin())
            rows.loc[rows["final"] >= at, "final"] -= 1
        rows["final"] += 1
        return rows[[group, "tier", "final"]]

    ship(df.sparkSession)
    kind = df.schema[group].dataType.simpleString()
    final = edges.groupBy(group).applyInPandas(rule, f"`{group}` {kind}, tier int, final long")
    return raw.join(final, [group, "tier"]).drop("tier").withColumnRenamed("final", "tier")


def survival(pick: float | Column, mean: Column, sd: Column, fallback: float) -> Column:
    """Chance to be there still at a pick, 1 where nobody is expected to take it."""
    pick = pick if isinstance(pick, Column) else F.lit(float(pick))
    spread = F.when(sd > 0, sd).otherwise(F.lit(fallback))
    return F.when(mean.isNull(), 1.0).otherwise(1 - normal_cdf((pick - mean) / spread))


def expected_best(df: DataFrame, group: str, value: str, tie: str, chance: str) -> DataFrame:
    """Each group's expected value of the best one left: sum of value x chance x chance that all better ones are gone."""
    better = Window.partitionBy(group).orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.product(1 - F.col(chance)).over(better), F.lit(1.0))
    return df.withColumn("__gone", gone).groupBy(group).agg(F.sum(F.col(value) * F.col(chance) * F.col("__gone")).alias("expected_best"))


def nth_available(df: DataFrame, season: str, period: str, entity: str, value: str, drafted: int, nth: int) -> DataFrame:
    """Per season: the sum over periods of the nth best value of those outside the season's ``drafted`` best totals."""
    totals = df.groupBy(season, entity).agg(F.sum(value).alias("__total"))
    top = totals.withColumn("__rank", F.row_number().over(Window.partitionBy(season).orderBy(F.desc("__total"), entity))).filter(F.col("__rank") <= drafted)
    rest = df.join(top.select(season, entity), [season, entity], "left_anti")
    place = F.row_number().over(Window.partitionBy(season, period).orderBy(F.desc(value), entity))
    return rest.withColumn("__place", place).filter(F.col("__place") == nth).groupBy(season).agg(F.sum(value).alias("points"), F.count(F.lit(1)).alias("periods"))


def bid(value: Column, total: Column, budget: Column, aggressiveness: float = 1.0, floor: int = 1) -> Column:
    """A share of the budget by value, at least ``floor`` and at most the budget, rounded half to even."""
    wanted = F.try_divide(value, total) * budget * F.lit(aggressiveness)
    return F.bround(F.least(F.greatest(F.coalesce(wanted, F.lit(0.0)), F.lit(float(floor))), budget.cast("double"))).cast("long")


def lineup_by_sets(points: Sequence[float], eligible: Sequence[Sequence[int]], slots: int) -> tuple[float, list[int]]:
    """Best total of an assignment of players to slots, and each slot's player or -1: an exact programme over sets of
    filled slots, in O(players x 2^slots x slots)."""
    best: dict[int, tuple[float, tuple[tuple[int, int], ...]]] = {0: (0.0, ())}
    for i, value in enumerate(points):
        for filled, (total, used) in list(best.items()):
            for s in eligible[i]:
                if not filled >> s & 1:
                    key, new = filled | 1 << s, total + value
                    if key not in best or new > best[key][0] + 1e-12:
                        best[key] = new, (*used, (s, i))
    most = max(bin(k).count("1") for k in best)
    total, used = max((v for k, v in best.items() if bin(k).count("1") == most), key=lambda v: v[0])
    chosen = [-1] * slots
    for s, i in used:
        chosen[s] = i
    return total, chosen


def optimal_lineups(players: DataFrame, team: str, player: str, group: str, value: str, slots: Sequence[Sequence[str]]) -> DataFrame:
    """Each team's best legal lineup: team, slot, player, value. Before teams meet, a window keeps of each team and group
    only as many as there are slots it may fill: no other can start."""
    room = {g: sum(g in s for s in slots) for g in {g for s in slots for g in s}}
    w = Window.partitionBy(team, group).orderBy(F.desc(value), player)
    wanted = F.create_map(*(x for g, n in room.items() for x in (F.lit(g), F.lit(n))))
    pool = players.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= F.try_element_at(wanted, F.col(group)))
    types = {f.name: f.dataType.simpleString() for f in players.schema}

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([value, player], ascending=[False, True], ignore_index=True)
        fits = [[k for k, s in enumerate(slots) if g in s] for g in rows[group]]
        _, chosen = lineup_by_sets(rows[value].tolist(), fits, len(slots))
        out = [(rows[team][0], k, rows[player][i], rows[value][i]) for k, i in enumerate(chosen) if i >= 0]
        return pd.DataFrame(out, columns=[team, "slot", player, value])

    ship(players.sparkSession)
    return pool.select(team, player, group, value).groupBy(team).applyInPandas(best, f"`{team}` {types[team]}, slot int, `{player}` {types[player]}, `{value}` double")


def matching(options: Sequence[Sequence[int]], slots: int) -> list[int]:
    """A largest matching of items to slots by augmenting paths: each slot's item or -1."""
    held = [-1] * slots

    def place(i: int, seen: set[int]) -> bool:
        for s in options[i]:
            if s not in seen:
                seen.add(s)
                if held[s] < 0 or place(held[s], seen):
                    held[s] = i
                    return True
        return False

    for i in range(len(options)):
        place(i, set())
    return held


def fills_slots(groups: Sequence[str], slots: Sequence[Sequence[str]]) -> bool:
    """Whether players of these groups can all start at once and fill every slot."""
    return len(groups) >= len(slots) and -1 not in matching([[k for k, s in enumerate(slots) if g in s] for g in groups], len(slots))


def steady_sum(df: DataFrame, value: str) -> Column:
    """A sum that does not depend on the order of rows, as a double: exact for decimals and whole numbers, in ascending order for
    doubles, so that entities with equal values have equal sums."""
    if df.schema[value].dataType.typeName() not in ("double", "float"):
        return F.sum(value).cast("double")
    values = F.array_sort(F.collect_list(F.col(value).cast("double")))
    return F.when(F.count(value) > 0, F.aggregate(values, F.lit(0.0), lambda total, x: total + x))


def season_board(df: DataFrame, entity: str, group: str, season: str, week: str, value: str, at: int, last: int) -> DataFrame:
    """Each entity's value to date (weeks up to ``at``), its mean a played week, the rest of the season at that mean, and its place
    within season and group by the two together (ties by entity). Entities without a week so far are not on the board."""
    so_far = df.filter(F.col(week) <= at).groupBy(entity, group, season).agg(steady_sum(df, value).alias("to_date"), F.count(value).alias("__n"))
    board = so_far.withColumn("mean", F.when(F.col("__n") > 0, F.col("to_date") / F.col("__n"))).drop("__n")
    board = board.withColumn("rest", F.col("mean") * (last - at)).withColumn("total", F.col("to_date") + F.col("rest"))
    return board.withColumn("place", F.row_number().over(Window.partitionBy(season, group).orderBy(F.desc("total"), entity)))

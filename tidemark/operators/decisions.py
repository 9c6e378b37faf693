"""Decisions on line-ups: what a change is worth, how to bid for it, what a choice cost.

Line-ups are solved in grouped functions, a roster at a time (tens of players); everything around them is windows and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.simulation import correlation_matrix, gaussian_scores, nearest_positive_definite
from tidemark.operators.valuation import bid, fills_slots, lineup_by_sets
from tidemark.session import ship

Slots = Sequence[Sequence[str]]


def solved(rows: pd.DataFrame, group: str, value: str, slots: Slots) -> tuple[float, list[int]]:
    """Best total of a roster's rows and each slot's row place or -1. Only as many of a group as it has slots can start."""
    room = {g: sum(g in s for s in slots) for g in set(rows[group])}
    order = rows.reset_index(drop=True).sort_values(value, ascending=False, kind="stable")
    pool = [k for g, part in order.groupby(group, sort=True) for k in part.index[: room[g]]]
    pool.sort(key=lambda k: -rows[value].iloc[k])
    total, chosen = lineup_by_sets([float(rows[value].iloc[k]) for k in pool], [[s for s, e in enumerate(slots) if rows[group].iloc[k] in e] for k in pool], len(slots))
    return total, [pool[i] if i >= 0 else -1 for i in chosen]


def lineup_regret(df: DataFrame, keys: Sequence[str], group: str, actual: str, predicted: str, slots: Slots) -> DataFrame:
    """Per roster: the best line-up's actual points less those of the line-up that the forecast chose."""
    ship(df.sparkSession)
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(*keys, group, actual, predicted)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def regret(part: pd.DataFrame) -> pd.DataFrame:
        best, _ = solved(part, group, actual, slots)
        _, chosen = solved(part, group, predicted, slots)
        got = float(sum(part[actual].iloc[k] for k in chosen if k >= 0))
        return pd.DataFrame([[*(part[k].iloc[0] for k in keys), best, got, best - got]], columns=[*keys, "best", "chosen", "regret"])

    return rows.groupBy(*keys).applyInPandas(regret, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "best double", "chosen double", "regret double"]))


def candidate_gains(rosters: DataFrame, candidates: DataFrame, roster: str, player: str, group: str, value: str, slots: Slots, depth_share: float = 0.15) -> DataFrame:
    """For each roster and candidate: points that its best line-up gains, else a share of the gain over its weakest player,
    and whom it would drop. Rosters x candidates of one league, tens each."""
    ship(rosters.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rosters.schema}
    ids = rosters.select(roster).distinct()
    offered = ids.join(F.broadcast(candidates.select(player, group, value)))  # one league's waiver list
    rows = rosters.select(roster, player, group, value, F.lit(False).alias("new")).unionByName(offered.withColumn("new", F.lit(True)))

    def gains(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["new", player], ignore_index=True)
        own = part[~part["new"]]
        base, _ = solved(own, group, value, slots) if len(own) else (0.0, [])
        weakest = own[value].idxmin() if len(own) else None
        out = []
        for k in part.index[part["new"]]:
            trial = pd.concat([own, part.loc[[k]]])
            total, chosen = solved(trial, group, value, slots)
            gain = total - base if total - base > 1e-6 else 0.0
            started = {trial[player].iloc[i] for i in chosen if i >= 0}
            bench = own[~own[player].isin(started)]
            depth = max(0.0, part.at[k, value] - own.at[weakest, value]) * depth_share if not gain and weakest is not None else 0.0
            drop = bench.at[bench[value].idxmin(), player] if gain and len(bench) else own.at[weakest, player] if depth else None
            out.append((part[roster].iloc[0], part.at[k, player], base, gain, depth, drop))
        return pd.DataFrame(out, columns=[roster, player, "baseline", "lineup_gain", "depth_gain", "drop_player"])

    return rows.groupBy(roster).applyInPandas(gains, f"`{roster}` {kinds[roster]}, `{player}` {kinds[player]}, baseline double, lineup_gain double, depth_gain double, drop_player {kinds[player]}")


def bid_board(gains: DataFrame, budgets: DataFrame, roster: str, player: str, mine: object, weeks_left: int, reserve: int = 3, aggressiveness: float = 1.0, market: Column | None = None) -> DataFrame:
    """My bids from everyone's gains: a share of each budget by value, less a reserve for later; capped where a dollar over
    the richest interested rival wins outright.

    budgets: roster, budget. market: an estimate of the price as a column of ``gains`` (0 without one)."""
    by_roster = Window.partitionBy(roster)
    rows = gains.join(budgets, roster).withColumn("value", (F.col("lineup_gain") + F.col("depth_gain")) * weeks_left)
    rows = rows.withColumn("raw", F.when(F.col("value") > 0, bid(F.col("value"), F.sum("value").over(by_roster), F.col("budget"), aggressiveness)).otherwise(F.lit(0)))
    kept = F.when(F.col("raw") > 0, F.least(F.col("budget").cast("long"), F.greatest(F.lit(1).cast("long"), F.bround(F.col("raw") / (1 + 0.15 * reserve)).cast("long")))).otherwise(F.lit(0))
    rows = rows.withColumn("reserved", kept).withColumn("rival", (F.col(roster) != F.lit(mine)) & (F.col("value") > 0))
    rivals = rows.groupBy(player).agg(F.max(F.when(F.col("rival"), F.col("budget"))).alias("richest"), F.count_if("rival").alias("rivals"), F.max(F.when(F.col("rival"), F.col("reserved"))).alias("highest"))
    own = rows.filter(F.col(roster) == F.lit(mine)).withColumn("market", market if market is not None else F.lit(0)).join(rivals, player)
    lock, most = F.coalesce("richest", F.lit(0)) + 1, F.least(F.col("budget").cast("long"), F.col("raw"))
    price = F.least(F.col("market"), F.coalesce("richest", F.lit(0)))
    wanted = F.when((F.col("value") <= 0) | (most <= 0), 0).when(price + 1 > most, most).otherwise(F.least(most, F.greatest(price + 1, F.bround(most * 0.5).cast("long"))))
    final = F.when((wanted > 0) & (lock <= most), F.least(wanted, lock)).otherwise(wanted)
    kind = F.when(F.col("value") <= 0, "no upgrade").when(most <= 0, "no budget").when(price + 1 > most, "value shot").otherwise("bid")
    return own.select(player, "lineup_gain", "depth_gain", "drop_player", "value", "reserved", most.alias("max_bid"), final.cast("long").alias("recommended_bid"), lock.cast("long").alias("lock_bid"), "rivals", F.coalesce("highest", F.lit(0)).alias("highest_rival"), kind.alias("recommendation"))


def legal_swaps(incoming: Sequence[str], outgoing: Sequence[str], groups: Mapping[str, str], slots: Slots) -> list[tuple[str, str | None]]:
    """Changes, in order, that each leave a line-up legal. incoming: best first; outgoing: weakest first; groups: of every
    starter and incoming player. A player for an empty slot sits nobody; groups without a slot are left alone."""
    known = {g for s in slots for g in s}
    lineup = {p for p, g in groups.items() if g in known and p not in incoming}
    left, out = list(outgoing), []

    def legal(players: set[str]) -> bool:
        return fills_slots([groups[p] for p in players], slots)

    for new in incoming:
        if len(lineup) < len(slots) and legal(lineup | {new}):
            lineup.add(new)
            out.append((new, None))
            continue
        old = next((p for p in left if legal((lineup - {p}) | {new})), None)
        if old is not None:
            left.remove(old)
            lineup = (lineup - {old}) | {new}
            out.append((new, old))
    return out


def start_sit(df: DataFrame, matchup: str, side: str, player: str, team: str, group: str, mean: str, quantiles: str, alphas: Sequence[float], slots: Slots, rule: Callable, n: int = 2000, seed: int = 0) -> DataFrame:
    """Chance to win each matchup (side 0 against side 1) with the best line-up by means and with every one-for-one change
    at a slot that several groups may fill. Draws are shared by a matchup's line-ups, so differences are not noise."""
    ship(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def evaluate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([side, player], ignore_index=True)
        mine, other = part[part[side] == 0], part[part[side] != 0]
        _, held = solved(mine, group, mean, slots)
        _, theirs = solved(other, group, mean, slots)
        options = [(None, None, held)]
        for s, eligible in enumerate(slots):
            if len(eligible) > 1 and held[s] >= 0:
                for k in range(len(mine)):
                    if k not in held and mine[group].iloc[k] in eligible:
                        options.append((mine[player].iloc[held[s]], mine[player].iloc[k], [*held[:s], k, *held[s + 1 :]]))
        key = int(pd.util.hash_array(np.array([str(part[matchup].iloc[0])], dtype=object))[0])
        matrix = nearest_positive_definite(correlation_matrix(part[team].tolist(), part[group].tolist(), rule))
        scores = gaussian_scores(np.random.default_rng([seed, key]), matrix, part[quantiles].tolist(), alphas, n)
        against = scores[:, [len(mine) + k for k in theirs if k >= 0]].sum(1)
        out = []
        for old, new, lineup in options:
            places = [k for k in lineup if k >= 0]
            out.append((part[matchup].iloc[0], old, new, float(mine[mean].iloc[places].sum()), float((scores[:, places].sum(1) > against).mean())))
        found = pd.DataFrame(out, columns=[matchup, "sit", "start", "points", "p_win"])
        found["delta_points"], found["delta_p_win"] = found["points"] - found["points"].iloc[0], found["p_win"] - found["p_win"].iloc[0]
        return found

    return df.groupBy(matchup).applyInPandas(evaluate, f"`{matchup}` {kinds[matchup]}, sit {kinds[player]}, start {kinds[player]}, points double, p_win double, delta_points double, delta_p_win double")

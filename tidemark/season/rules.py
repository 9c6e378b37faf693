"""Scoring keys of leagues as rules over stat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions.columns import listed_count, listed_sum

UNIT = "DST"

# League scoring keys and the stat column that each multiplies.
DIRECT = {
    "pass_yd": "passing_yards", "pass_td": "passing_tds", "pass_int": "passing_interceptions", "pass_2pt": "passing_2pt_conversions", "pass_sack": "sacks_suffered",
    "rush_yd": "rushing_yards", "rush_td": "rushing_tds", "rush_2pt": "rushing_2pt_conversions",
    "rec": "receptions", "rec_yd": "receiving_yards", "rec_td": "receiving_tds", "rec_2pt": "receiving_2pt_conversions",
    "fum": "fumbles_total", "fum_lost": "fumbles_lost_total", "fum_rec_td": "fumble_recovery_tds",
    "xpm": "pat_made", "fgm_0_19": "fg_made_0_19", "fgm_20_29": "fg_made_20_29", "fgm_30_39": "fg_made_30_39", "fgm_40_49": "fg_made_40_49", "fgm_50_59": "fg_made_50_59", "fgm_60p": "fg_made_60_",
    "blk_kick": "opponent_blocked_kicks", "def_td": "def_return_tds",
}
# Keys that count on a unit's own row only, and on every other row only.
UNIT_ONLY = {
    "sack": "def_sacks", "int": "def_interceptions", "ff": "def_fumbles_forced", "fum_rec": "fumble_recovery_opp", "safe": "def_safeties",
    "def_st_td": "special_teams_tds", "def_st_ff": "special_teams_forced_fumbles", "def_st_fum_rec": "special_teams_fumble_recoveries",
}
PLAYER_ONLY = {"st_td": "special_teams_tds", "st_ff": "special_teams_forced_fumbles", "st_fum_rec": "special_teams_fumble_recoveries"}
# Points allowed, from and to.
ALLOWED = {"pts_allow_0": (0, 0), "pts_allow_1_6": (1, 6), "pts_allow_7_13": (7, 13), "pts_allow_14_20": (14, 20), "pts_allow_21_27": (21, 27), "pts_allow_28_34": (28, 34), "pts_allow_35p": (35, 10_000)}
# Yards from which a bonus is paid.
BONUS = {"bonus_rush_yd_100": ("rushing_yards", 100), "bonus_rush_yd_200": ("rushing_yards", 200), "bonus_rec_yd_100": ("receiving_yards", 100), "bonus_rec_yd_200": ("receiving_yards", 200), "bonus_pass_yd_300": ("passing_yards", 300), "bonus_pass_yd_400": ("passing_yards", 400)}
MISSES = {"xpmiss": ("pat_missed", "pat_blocked"), "fgmiss": ("fg_missed", "fg_blocked")}
#: Field goals by yards, and by distance: a league uses one of the two.
BY_YARDS, BY_DISTANCE = frozenset({"fgm_yds"}), frozenset({"fgm_0_19", "fgm_20_29", "fgm_30_39", "fgm_40_49", "fgm_50_59", "fgm_60p", "fgm_50p"})


def _kick_yards(df: DataFrame) -> Column:
    return F.coalesce(F.col("fg_made_yards").cast("double"), F.lit(0.0)) if "fg_made_yards" in df.columns else listed_sum("fg_made_list")


def _is_unit(df: DataFrame) -> Column:
    return F.col("position") == UNIT


RULES: S.Rules = {
    **{k: S.Direct(c) for k, c in DIRECT.items()},
    **{k: S.only(_is_unit, c) for k, c in UNIT_ONLY.items()},
    **{k: S.only(lambda df: F.col("position") != UNIT, c) for k, c in PLAYER_ONLY.items()},
    **{k: S.between("points_allowed", low, high) for k, (low, high) in ALLOWED.items()},
    **{k: S.at_least(c, n) for k, (c, n) in BONUS.items()},
    **{k: S.sum_of(*c) for k, c in MISSES.items()},
    "fgm_yds": S.Derived(_kick_yards),
    "fgm_50p": S.Derived(lambda df: listed_count("fg_made_list", 50, 1_000).cast("double")),
    "bonus_rec_te": S.only(lambda df: F.col("position") == "TE", "receptions"),
}


def points(stats: DataFrame, weights: dict[str, float]) -> Column:
    """A row's points under a league's weights. Raises on keys without a rule and on both field-goal schemes at once."""
    return S.score(stats, weights, RULES, (BY_YARDS, BY_DISTANCE))

"""Team and player weeks from plays, schedules, stats and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, lookup, minutes_seconds, ratio, remap, share, total
from tidemark.operators.relational import counted, keep_first, schema_union, sides
from tidemark.season.rules import UNIT
from tidemark.session import ship

TEAM_WEEK = ["team", "season", "week"]
PLAYER_WEEK = ["player_id", "season", "week"]
SKILL = ("QB", "RB", "WR", "TE")
# Team codes of franchises before they moved.
MOVED = {"STL": "LA", "SD": "LAC", "OAK": "LV"}
# Caps and bounds of game situations.
FIRST_DOWN_CAP, SCORE_CAP, NEUTRAL_MARGIN, NEUTRAL_QUARTERS = 20.0, 28.0, 7, (1.0, 2.0, 3.0)
RED_ZONE, GOAL_ZONE = 20, 5
# Whom a defence is measured against.
RECEIVERS, RUSHERS, PASSER = {"RB": "RB_receiving", "TE": "TE", "WR": "WR"}, {"QB": "QB_rushing", "RB": "RB_rushing"}, "QB_passing"
# Opponent adjustment.
SHRINKAGE, RECENCY_SPAN, RIDGE = 250.0, 8, 1.0
OUTCOMES = {"epa": "adj_epa_allowed", "success": "adj_success_allowed", "yards_gained": "adj_ypt_allowed", "touchdown": "adj_td_rate_allowed"}
REPORT_LAG = "INTERVAL 2 DAYS", "INTERVAL 12 HOURS"


def scrimmage(pbp: DataFrame) -> DataFrame:
    return pbp.filter(F.col("play_type").isin("pass", "run"))


def team_week_context(pbp: DataFrame) -> DataFrame:
    """Plays, pass rate, expected points and success of each offence's week; what other sources fill is null."""
    rows = scrimmage(pbp).groupBy(F.col("posteam").alias("team"), "season", "week").agg(
        F.count(F.lit(1)).alias("plays"), share(F.col("play_type") == "pass").alias("pass_rate"), F.avg("epa").alias("epa_per_play_off"), F.avg("success").alias("success_rate_off")
    )
    empty = {c: F.lit(None).cast("double") for c in ("neutral_pace_sec", "proe", "implied_total", "spread")}
    return rows.withColumns(empty).select(*TEAM_WEEK, "plays", "neutral_pace_sec", "pass_rate", "proe", "epa_per_play_off", "success_rate_off", "implied_total", "spread")


def team_week_defense(pbp: DataFrame) -> DataFrame:
    """What each team's offence allowed and its defence forced, in one pass: every play is dealt to both its teams. A side
    without plays of a kind has nulls for it, as outer joins of the four counts would give."""
    one = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    facts = {"scrim": F.col("play_type").isin("pass", "run"), "drop": F.coalesce(F.col("qb_dropback") == 1, F.lit(False)), "pressed": (one("sack") == 1) | (one("qb_hit") == 1), "sack_n": one("sack"), "int_n": one("interception"), "fum_n": one("fumble_lost")}
    plays = pbp.select("season", "week", "posteam", "defteam", *(c.alias(n) for n, c in facts.items())).filter(F.col("scrim") | F.col("drop"))
    shared = {n: n for n in ("season", "week", *facts)}
    rows = sides(plays, {"team": "posteam", "offence": F.lit(True)} | shared, {"team": "defteam", "offence": F.lit(False)} | shared)

    def when(offence: bool, fact: str, value: Column) -> Column:
        mine = (F.col("offence") == offence) & F.col(fact)
        return F.when(F.count_if(mine) > 0, F.sum(F.when(mine, value)))

    columns = {
        "dropbacks": when(True, "drop", F.lit(1)), "sacks_allowed": when(True, "drop", F.col("sack_n")), "pressures_allowed": when(True, "drop", F.col("pressed").cast("int")), "interceptions_thrown": when(True, "drop", F.col("int_n")),
        "plays": when(True, "scrim", F.lit(1)), "fumbles_lost": when(True, "scrim", F.col("fum_n")),
        "dropbacks_faced": when(False, "drop", F.lit(1)), "pressures_forced": when(False, "drop", F.col("pressed").cast("int")),
        "plays_faced": when(False, "scrim", F.lit(1)), "interceptions_forced": when(False, "scrim", F.col("int_n")), "fumbles_recovered": when(False, "scrim", F.col("fum_n")),
    }
    found = rows.groupBy("season", "week", "team").agg(*(c.alias(n) for n, c in columns.items())).filter(F.coalesce("dropbacks", "plays", "dropbacks_faced", "plays_faced").isNotNull())
    return found.withColumns(
        {
            "sack_rate_allowed": ratio("sacks_allowed", "dropbacks"), "pressure_rate_allowed": ratio("pressures_allowed", "dropbacks"), "interception_rate_thrown": ratio("interceptions_thrown", "dropbacks"),
            "turnover_rate": ratio(F.col("interceptions_thrown") + F.col("fumbles_lost"), "plays"), "pressure_rate_forced": ratio("pressures_forced", "dropbacks_faced"),
            "takeaway_rate": ratio(F.col("interceptions_forced") + F.col("fumbles_recovered"), "plays_faced"),
        }
    )


def decisions(pbp: DataFrame) -> DataFrame:
    """Plays that were a choice of pass or run, with capped situations and the down as indicators."""
    rows = scrimmage(pbp).filter(F.col("down").isNotNull() & (F.col("qb_kneel") == 0) & (F.col("qb_spike") == 0))
    rows = rows.withColumns({"ydstogo": clip("ydstogo", high=FIRST_DOWN_CAP), "score_differential": clip("score_differential", -SCORE_CAP, SCORE_CAP)})
    return rows.withColumns({f"down_{d}": (F.col("down") == d).cast("double") for d in (1, 2, 3, 4)})


def add_proe(context: DataFrame, pbp: DataFrame) -> DataFrame:
    """Pass rate over expectation: outcome less the chance from a logistic fit on all earlier seasons, mean by team-week.
    The first season has none. One fit a season; scoring is one pass for each."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    inputs = [*(f"down_{d}" for d in (1, 2, 3, 4)), "ydstogo", "score_differential", "half_seconds_remaining", "yardline_100"]
    rows = decisions(pbp).select("season", "week", F.col("posteam").alias("team"), F.col("pass").cast("double").alias("pass"), *(F.col(c).cast("double").alias(c) for c in inputs)).dropna(subset=inputs).persist()
    parts = []
    for (season,) in rows.select("season").distinct().orderBy("season").collect():
        prior = rows.filter(F.col("season") < season)
        n, kinds = prior.agg(F.count(F.lit(1)), F.count_distinct("pass")).first()
        if not n or kinds < 2:
            continue
        # a penalty of half the squared weights on the sum of losses, none on the intercept
        fit = LogisticRegression(featuresCol="x", labelCol="pass", probabilityCol="p", regParam=1.0 / n, standardization=False, maxIter=200)
        scored = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="x"), fit]).fit(prior).transform(rows.filter(F.col("season") == season))
        parts.append(scored.select(*TEAM_WEEK, (F.col("pass") - vector_to_array("p")[1]).alias("over")))
    if not parts:
        return context
    over = schema_union(*parts).groupBy(*TEAM_WEEK).agg(F.avg("over").alias("proe"))
    return context.drop("proe").join(over, TEAM_WEEK, "left")


def add_neutral_pace(context: DataFrame, pbp: DataFrame) -> DataFrame:
    """Seconds a play over drives that began within a score in the first three quarters."""
    first = F.struct("game_id", "play_id")
    drives = scrimmage(pbp).groupBy("season", "week", F.col("posteam").alias("team"), "drive").agg(
        *(F.min_by(c, first).alias(c) for c in ("score_differential", "drive_quarter_start", "drive_time_of_possession", "drive_play_count"))
    )
    neutral = drives.filter((F.abs("score_differential") <= NEUTRAL_MARGIN) & F.col("drive_quarter_start").isin(*NEUTRAL_QUARTERS))
    pace = ratio(total(minutes_seconds("drive_time_of_possession")), total("drive_play_count"))
    return context.drop("neutral_pace_sec").join(neutral.groupBy(*TEAM_WEEK).agg(pace.alias("neutral_pace_sec")), TEAM_WEEK, "left")


def add_schedule_context(context: DataFrame, schedule: DataFrame) -> DataFrame:
    """Spread and implied total from each team's own side."""
    shared = {"season": "season", "week": "week"}
    home = shared | {"team": remap("home_team", MOVED), "spread": "spread_line", "implied_total": "home_implied_total"}
    away = shared | {"team": remap("away_team", MOVED), "spread": -F.col("spread_line"), "implied_total": "away_implied_total"}
    return context.drop("spread", "implied_total").join(sides(schedule, home, away), TEAM_WEEK, "left")


def normalised_schedule(raw: DataFrame) -> DataFrame:
    """Implied totals: half the total, plus or less half the spread."""
    half = F.col("total_line") / 2
    return raw.withColumns({"home_implied_total": half + F.col("spread_line") / 2, "away_implied_total": half - F.col("spread_line") / 2})


def player_positions(stats: DataFrame) -> DataFrame:
    """Position of each player's season: that of its first week."""
    return stats.groupBy("player_id", "season").agg(F.min_by("position", "week").alias("position"))


def position_plays(pbp: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for each play and group that it tells of: receivers' targets, rushers' carries, passers' attempts. A pass to
    a receiver counts for the receiver's group and the passer's."""
    who = F.array(
        F.struct(F.lit("receiver").alias("role"), F.when(F.col("play_type") == "pass", F.col("receiver_player_id")).alias("player_id")),
        F.struct(F.lit("rusher").alias("role"), F.when(F.col("play_type") == "run", F.col("rusher_player_id")).alias("player_id")),
        F.struct(F.lit("passer").alias("role"), F.when(F.col("play_type") == "pass", F.col("passer_player_id")).alias("player_id")),
    )
    facts = ["season", "week", "posteam", "defteam", "epa", "success", "yards_gained", "touchdown", (F.col("posteam_type") == "home").cast("double").alias("home")]
    rows = scrimmage(pbp).select(*facts, F.inline(F.filter(who, lambda x: x["player_id"].isNotNull()))).join(player_positions(stats), ["player_id", "season"], "left")
    group = F.when(F.col("role") == "receiver", lookup("position", RECEIVERS)).when(F.col("role") == "rusher", lookup("position", RUSHERS)).otherwise(F.when(F.col("position") == "QB", F.lit(PASSER)))
    return rows.withColumn("position_group", group).dropna(subset=["position_group", "epa", "success", "yards_gained", "touchdown", "home"]).drop("role", "player_id", "position")


def defense_position_allowed(pbp: DataFrame, stats: DataFrame) -> DataFrame:
    """Plays against each defence by group; adjusted rates are null until :func:`add_opponent_adjustment`."""
    keys = ["defteam", "season", "week", "position_group"]
    rows = position_plays(pbp, stats).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_plays"))
    return rows.select(*keys, *(F.lit(None).cast("double").alias(c) for c in OUTCOMES.values()), "n_plays")


def _ridge(cells: pd.DataFrame, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Defence coefficients of outcome = mean + offence + defence + home, all but the mean penalised. ``cells`` are sums
    over plays that share both teams and the side, which is all that the normal equations need."""
    off, offences = pd.factorize(cells["posteam"], sort=True)
    dfn, defences = pd.factorize(cells["defteam"], sort=True)
    a, b = len(offences), len(defences)
    x = np.zeros((len(cells), a + b + 2))
    rows = np.arange(len(cells))
    x[rows, off] = x[rows, a + dfn] = 1.0
    x[:, -2], x[:, -1] = cells["home"], 1.0
    w = weight * cells["n"].to_numpy(float)
    penalty = np.diag([RIDGE] * (a + b + 1) + [0.0])
    y = x.T @ (weight[:, None] * cells[list(OUTCOMES)].to_numpy(float))
    solved = np.linalg.solve(x.T @ (w[:, None] * x) + penalty, y)
    return {team: solved[a + k] for k, team in enumerate(defences)}


def add_opponent_adjustment(allowed: DataFrame, pbp: DataFrame, stats: DataFrame) -> DataFrame:
    """Ridge-adjusted rates known before each week: the season's strictly earlier weeks, recent ones weighing more, shrunk
    by a defence's own plays towards the season before.

    Plays are summed to (group, season, week, offence, defence, side) before a group's task sees them: a few rows a game."""
    ship(allowed.sparkSession)
    keys = ["position_group", "season", "week", "posteam", "defteam", "home"]
    cells = position_plays(pbp, stats).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in OUTCOMES))
    decay = 1 - 2.0 / (RECENCY_SPAN + 1)

    def blend(now, then, n):
        if now is None or then is None:
            return then if now is None else now
        w = n / (n + SHRINKAGE)
        return w * now + (1 - w) * then

    def adjust(rows: pd.DataFrame) -> pd.DataFrame:
        out, before = [], {}
        for season, own in sorted(rows.groupby("season"), key=lambda g: g[0]):
            then = before.get(season - 1, {})
            for week in sorted(own["week"].unique()):
                past = own[own["week"] < week]
                now = _ridge(past, decay ** (week - past["week"].to_numpy(float))) if len(past) else {}
                seen = past.groupby("defteam")["n"].sum()
                for team in sorted({*now, *then}):
                    out.append((team, season, week, rows["position_group"].iloc[0], *blend(now.get(team), then.get(team), float(seen.get(team, 0.0)))))
            before[season] = _ridge(own, np.ones(len(own)))
        return pd.DataFrame(out, columns=["defteam", "season", "week", "position_group", *OUTCOMES.values()])

    kind = {c: allowed.schema[c].dataType.simpleString() for c in ("season", "week")}
    found = cells.groupBy("position_group").applyInPandas(adjust, f"defteam string, season {kind['season']}, week {kind['week']}, position_group string, " + ", ".join(f"{c} double" for c in OUTCOMES.values()))
    return allowed.drop(*OUTCOMES.values()).join(found, ["defteam", "season", "week", "position_group"], "left").select(*allowed.columns)


def snaps_by_player(snaps: DataFrame, players: DataFrame) -> DataFrame:
    """Snap counts under the common id, through one crosswalk row for each foreign id."""
    link = keep_first(players.filter("pfr_id is not null").select(F.col("pfr_id").alias("pfr_player_id"), "player_id"), ["pfr_player_id"], ["player_id"])
    return snaps.join(link, "pfr_player_id", "left").select(*PLAYER_WEEK, "offense_snaps", F.col("offense_pct").alias("offense_snap_pct"))


def zone_touches(pbp: DataFrame) -> DataFrame:
    """Targets and carries near the goal line and designed carries, one pass over the plays."""
    plays = scrimmage(pbp).withColumn("player_id", F.when(F.col("play_type") == "pass", F.col("receiver_player_id")).otherwise(F.col("rusher_player_id"))).filter("player_id is not null")
    run, near = F.col("play_type") == "run", F.col("yardline_100") <= RED_ZONE
    return counted(plays, PLAYER_WEEK, {"rz_targets": ~run & near, "rz_carries": run & near, "gz_carries": run & (F.col("yardline_100") <= GOAL_ZONE), "designed_rush_attempts": run & (F.col("qb_scramble") == 0)})


def player_week_usage(stats: DataFrame, snaps: DataFrame, pbp: DataFrame, players: DataFrame) -> DataFrame:
    """Opportunity and its share of the team's, for skill positions; team sums are over everyone."""
    teams = stats.groupBy(*TEAM_WEEK).agg(total("carries").alias("team_carries"))
    zones = zone_touches(pbp)
    team_zones = zones.join(stats.select(*PLAYER_WEEK, "team"), PLAYER_WEEK, "left").groupBy(*TEAM_WEEK).agg((F.sum("rz_targets") + F.sum("rz_carries")).alias("team_rz"), F.sum("gz_carries").alias("team_gz"))
    own = stats.filter(F.col("position").isin(*SKILL)).select(*PLAYER_WEEK, "team", "targets", "target_share", F.col("receiving_air_yards").alias("air_yards"), "air_yards_share", "wopr", "carries")
    rows = own.join(teams, TEAM_WEEK, "left").join(snaps_by_player(snaps, players), PLAYER_WEEK, "left").join(zones, PLAYER_WEEK, "left").join(team_zones, TEAM_WEEK, "left")
    rows = rows.fillna(0, ["rz_targets", "rz_carries", "gz_carries", "designed_rush_attempts"])
    positive = lambda top, bottom: F.when(F.col(bottom) > 0, ratio(top, bottom))
    rows = rows.withColumns(
        {
            "adot": positive("air_yards", "targets"), "carry_share": positive("carries", "team_carries"), "designed_rush_share": positive("designed_rush_attempts", "team_carries"),
            "rz_touch_share": positive(F.col("rz_targets") + F.col("rz_carries"), "team_rz"), "gz_carry_share": positive("gz_carries", "team_gz"),
            "route_participation": F.lit(None).cast("double"), "xfp": F.lit(None).cast("double"),
        }
    )
    return rows.select(
        *PLAYER_WEEK, "team", "offense_snaps", "offense_snap_pct", "targets", "target_share", "air_yards", "air_yards_share", "wopr", "adot", "carries", "carry_share", "rz_targets", "rz_carries",
        "rz_touch_share", "gz_carries", "gz_carry_share", "designed_rush_attempts", "designed_rush_share", "route_participation", "xfp",
    )


def add_xfp(usage: DataFrame, expected: DataFrame) -> DataFrame:
    keyed = expected.select("player_id", *(F.col(c).cast("double").cast("int").cast(usage.schema[c].dataType).alias(c) for c in ("season", "week")), F.col("total_fantasy_points_exp").alias("xfp"))
    return usage.drop("xfp").join(keyed, PLAYER_WEEK, "left")


def add_report_times(injuries: DataFrame, schedule: DataFrame) -> DataFrame:
    """Missing report times from the team's game day: two days before, at noon; marked as estimated."""
    shared = {"season": "season", "week": "week", "gameday": "gameday"}
    days = sides(schedule, shared | {"team": "home_team"}, shared | {"team": "away_team"})
    guess = F.try_to_timestamp("gameday", F.lit("yyyy-MM-dd")) - F.expr(REPORT_LAG[0]) + F.expr(REPORT_LAG[1])
    met = injuries.join(days, ["season", "week", "team"], "left")
    met = met.withColumn("date_modified_is_estimated", F.col("date_modified").isNull()).withColumn("date_modified", F.coalesce(F.col("date_modified").cast("timestamp"), guess))
    return met.select(*injuries.columns, "date_modified_is_estimated")


def unit_stats(team_stats: DataFrame, schedule: DataFrame, pbp: DataFrame) -> DataFrame:
    """One row for each team's week as a unit: what opponents scored, blocks, return scores, and fumbles forced and won by
    kind of play, from plays."""
    scores = sides(schedule, {"game_id": "game_id", "opponent_team": "home_team", "points_allowed": "home_score"}, {"game_id": "game_id", "opponent_team": "away_team", "points_allowed": "away_score"})
    blocks = team_stats.select("game_id", F.col("team").alias("opponent_team"), (F.coalesce("fg_blocked", F.lit(0)) + F.coalesce("pat_blocked", F.lit(0))).alias("opponent_blocked_kicks"))
    special, fumble = F.col("special_teams_play") == 1, F.col("fumble") == 1
    scored = F.when((F.col("return_touchdown") == 1) & (F.col("td_team") == F.col("defteam")) & F.col("play_type").isin("pass", "run"), F.col("defteam"))
    forced = F.when(fumble, F.col("forced_fumble_player_1_team"))
    won = F.when(fumble & (F.col("fumble_recovery_1_team") != F.col("fumbled_1_team")), F.col("fumble_recovery_1_team"))
    events = F.array(*(F.struct(team.alias("team"), F.lit(kind).alias("kind")) for team, kind in ((scored, "def_return_tds"), (F.when(~special, forced), "def_fumbles_forced"), (F.when(~special, won), "fumble_recovery_opp"), (F.when(special, forced), "special_teams_forced_fumbles"), (F.when(special, won), "special_teams_fumble_recoveries"))))
    names = ["def_return_tds", "def_fumbles_forced", "fumble_recovery_opp", "special_teams_forced_fumbles", "special_teams_fumble_recoveries"]
    counts = pbp.select("season", "week", F.inline(F.filter(events, lambda e: e["team"].isNotNull()))).groupBy(*TEAM_WEEK).agg(*(F.count_if(F.col("kind") == n).alias(n) for n in names))
    rows = team_stats.drop(*names, "points_allowed", "opponent_blocked_kicks").join(scores, ["game_id", "opponent_team"], "left").join(blocks, ["game_id", "opponent_team"], "left").join(counts, TEAM_WEEK, "left")
    return rows.fillna(0, names).withColumns({"player_id": F.col("team"), "position": F.lit(UNIT)})


def player_week_stats(stats: DataFrame, team_stats: DataFrame, schedule: DataFrame, pbp: DataFrame) -> DataFrame:
    """Players and units in one frame; what a side lacks is null."""
    return schema_union(stats, unit_stats(team_stats, schedule, pbp))


def current_season_merged(history: DataFrame, current: DataFrame, season: int) -> DataFrame:
    """History with one season replaced."""
    return schema_union(history.filter(F.col("season") != season), current)


def extended_rosters(rosters: DataFrame, schedule: DataFrame, season: int) -> DataFrame:
    """The last roster week of a season repeated for each later scheduled week."""
    own = rosters.filter(F.col("season") == season)
    latest = own.withColumn("__last", F.max("week").over(Window.partitionBy("season"))).filter(F.col("week") == F.col("__last"))
    weeks = schedule.filter(F.col("season") == season).select("season", F.col("week").alias("__week")).distinct()
    later = latest.join(weeks, "season").filter(F.col("__week") > F.col("__last")).withColumn("week", F.col("__week")).select(*rosters.columns)
    return rosters.unionByName(later)

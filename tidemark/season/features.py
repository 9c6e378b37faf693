"""Point-in-time feature tables: every column carries what its week could know.

A registry says of each feature where it comes from, its window and its lag; windows of one table share one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import lookup, ratio, remap, total
from tidemark.operators.relational import latest, sides, top_n
from tidemark.operators.timeseries import asof_join, expanding_mean, lag_shift_join, periods_in_role, pooled_prior_means, prior_season_mean, rolling_std, with_ewm
from tidemark.season.interim import MOVED, OUTCOMES, PLAYER_WEEK, SKILL, TEAM_WEEK
from tidemark.season.rules import points

ACTIVE = ("ACT", "INA")
OUT, HEALTHY = "Out", "None"
ROLE_CHANGE = 0.15
PRIME_DAYS, SUNDAY_NIGHT = ("Thursday", "Monday"), 20
# Starters of a line, by position.
LINE = {"C": 1, "G": 2, "T": 2}
# Groups of defence rows that matter to a position.
GROUPS = {"WR": ("WR",), "TE": ("TE",), "RB": ("RB_receiving", "RB_rushing"), "QB": ("QB_passing", "QB_rushing")}
ALL_GROUPS = sorted({g for groups in GROUPS.values() for g in groups})
#: Known before the week itself; all others of the team table are lagged.
SAME_WEEK = ("implied_team_total", "spread", "teammate_vacated_target_share", "teammate_vacated_carry_share", "opponent_neutral_pace_ewm_8")


class LeakageError(ValueError):
    """A feature could see its own week."""


@dataclass(frozen=True)
class Feature:
    name: str
    source: str
    positions: tuple[str, ...] = SKILL
    window: str | None = None
    lag: int = 1
    at_inference: bool = True


class Registry(dict):
    def add(self, feature: Feature) -> None:
        if feature.name in self:
            raise ValueError(f"feature {feature.name} is registered twice")
        self[feature.name] = feature

    def of(self, source: str) -> list[str]:
        return [n for n, f in self.items() if f.source == source]


def assert_lagged(features: Iterable[Feature]) -> None:
    if wrong := [f.name for f in features if f.lag < 1]:
        raise LeakageError(f"no lag: {wrong}")


def assert_at_inference(features: Iterable[Feature]) -> None:
    if wrong := [f.name for f in features if not f.at_inference]:
        raise LeakageError(f"not known at inference: {wrong}")


# Raw column, feature name, positions, windows.
USAGE_WINDOWS = (
    ("offense_snap_pct", "snap_pct", SKILL, ("ewm_3", "ewm_8", "prior_season")),
    ("target_share", "target_share", ("WR", "TE", "RB"), ("ewm_3", "ewm_8", "season_to_date")),
    ("air_yards_share", "air_yards_share", ("WR", "TE"), ("ewm_4",)),
    ("wopr", "wopr", ("WR", "TE", "RB"), ("ewm_4",)),
    ("adot", "adot", ("WR", "TE"), ("ewm_8",)),
    ("carry_share", "carry_share", ("RB", "QB"), ("ewm_3", "ewm_8")),
    ("rz_touch_share", "rz_touch_share", ("WR", "TE", "RB"), ("ewm_6",)),
    ("gz_carry_share", "gz_carry_share", ("RB",), ("ewm_6",)),
    ("xfp", "xfp_per_game", SKILL, ("ewm_4", "season_to_date")),
    ("attempts", "pass_attempts", ("QB",), ("ewm_4",)),
    ("passing_cpoe", "cpoe", ("QB",), ("ewm_4",)),
    ("sack_rate_taken", "sack_rate_taken", ("QB",), ("ewm_4",)),
    ("designed_rush_share", "designed_rush_share", ("QB",), ("ewm_6",)),
    ("rushing_yards", "rush_yards_per_game", ("QB",), ("ewm_6",)),
    ("xfp_minus_actual", "xfp_minus_actual", SKILL, ("ewm_6",)),
    ("actual_points", "points_std", SKILL, ("std_8",)),
)
TEAM_WINDOWS = (
    ("plays", "plays_per_game", 5), ("neutral_pace_sec", "neutral_pace", 8), ("proe", "proe", 5), ("pass_rate", "pass_rate", 5),
    ("epa_per_play_off", "team_epa_off", 8), ("success_rate_off", "team_success_off", 8), ("ol_continuity_raw", "ol_continuity", 5),
)
UNIT_WINDOWS = (
    ("sack_rate_allowed", "opp_sack_rate_allowed_ewm_8"), ("pressure_rate_allowed", "opp_pressure_rate_allowed_ewm_8"), ("turnover_rate", "opp_turnover_rate_ewm_8"),
    ("interception_rate_thrown", "opp_interception_rate_ewm_8"), ("pressure_rate_forced", "own_pressure_rate_forced_ewm_8"), ("takeaway_rate", "own_takeaway_rate_ewm_8"),
)
USAGE, TEAM = "player_week_usage", "team_week_context"


def with_windows(df: DataFrame, columns: Mapping[str, tuple[str, str]], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Windows (out: raw column, window) of one key and order: ewm_k, std_k and season_to_date."""
    parts = {out: (raw, *w.rpartition("_")[::2]) for out, (raw, w) in columns.items()}
    rows = with_ewm(df, {out: (raw, int(n)) for out, (raw, kind, n) in parts.items() if kind == "ewm"}, keys, order)
    other = {}
    for out, (raw, kind, n) in parts.items():
        if kind == "std":
            other[out] = rolling_std(raw, keys, order, int(n))
        elif kind == "season_to":
            other[out] = F.when(F.col(raw).isNotNull(), expanding_mean(raw, keys, order, lag=0))
        elif kind != "ewm":
            raise ValueError(f"unknown window {kind}_{n}")
    return rows.withColumns(other) if other else rows


def usage_features(usage: DataFrame, stats: DataFrame, weights: Mapping[str, float], registry: Registry | None = None) -> DataFrame:
    """Trailing usage, through each row's own week (the lag comes with the join onto a later week)."""
    scored = stats.select(*PLAYER_WEEK, "attempts", "passing_cpoe", "sacks_suffered", "rushing_yards", points(stats, dict(weights)).alias("actual_points"))
    rows = usage.join(scored, PLAYER_WEEK, "left")
    dropbacks = F.col("attempts") + F.col("sacks_suffered")
    rows = rows.withColumns({"sack_rate_taken": F.when(dropbacks > 0, ratio("sacks_suffered", dropbacks)), "xfp_minus_actual": F.col("xfp") - F.col("actual_points")})
    keys, order = ["player_id", "season"], ["week"]
    plain = {f"{name}_{w}": (raw, w, positions) for raw, name, positions, windows in USAGE_WINDOWS for w in windows}
    rows = with_windows(rows, {out: (raw, w) for out, (raw, w, _) in plain.items() if w != "prior_season"}, keys, order)
    for out, (raw, w, _) in plain.items():
        if w == "prior_season":
            rows = prior_season_mean(rows, raw, "player_id", "season", out)
    rows = rows.withColumn("snap_pct_trend", F.col("snap_pct_ewm_3") - F.col("snap_pct_ewm_8"))
    rows = periods_in_role(rows, "offense_snap_pct", keys, "week", ROLE_CHANGE, "weeks_in_current_role")
    if registry is not None:
        for out, (_, w, positions) in plain.items():
            registry.add(Feature(out, USAGE, tuple(positions), w))
        for out in ("snap_pct_trend", "weeks_in_current_role"):
            registry.add(Feature(out, USAGE))
    return rows


def line_continuity(snaps: DataFrame) -> DataFrame:
    """Share of a line's five starters (most snaps at each position) who also started the team's game before."""
    line = snaps.filter(F.col("position").isin(*LINE))
    starters = top_n(line, [*TEAM_WEEK, "position"], [F.desc("offense_snaps"), "pfr_player_id"], lookup("position", LINE))
    five = starters.groupBy(*TEAM_WEEK).agg(F.collect_set("pfr_player_id").alias("five"))
    before = F.lag("five").over(Window.partitionBy("team", "season").orderBy("week"))
    return five.select(*TEAM_WEEK, F.when(before.isNotNull(), F.size(F.array_intersect("five", before)) / F.lit(float(sum(LINE.values())))).alias("ol_continuity_raw"))


def opponents(schedule: DataFrame, moved: bool = False) -> DataFrame:
    """team, season, week, opponent, is_home, game_id, rest_days, weekday, gametime of every scheduled side."""
    name = (lambda c: remap(c, MOVED)) if moved else F.col
    shared = {c: c for c in ("game_id", "season", "week", "weekday", "gametime") if c in schedule.columns}
    rest = lambda side: F.col(f"{side}_rest") if f"{side}_rest" in schedule.columns else F.lit(None).cast("int")
    return sides(
        schedule,
        shared | {"team": name("home_team"), "opponent": name("away_team"), "is_home": F.lit(True), "rest_days": rest("home")},
        shared | {"team": name("away_team"), "opponent": name("home_team"), "is_home": F.lit(False), "rest_days": rest("away")},
    )


def vacated_shares(injuries: DataFrame, usage: DataFrame) -> DataFrame:
    """Sums, by team and week, of the last trailing shares of players ruled out: those of the weeks they were not."""
    out = injuries.filter(F.col("report_status") == OUT).select(*PLAYER_WEEK)
    shares = usage.select(*PLAYER_WEEK, "team", "target_share_ewm_3", "carry_share_ewm_3").join(out.distinct(), PLAYER_WEEK, "left_anti")
    met = asof_join(out, shares, ["player_id", "season"], "week", ["team", "target_share_ewm_3", "carry_share_ewm_3"]).dropna(subset=["team"])
    return met.groupBy(*TEAM_WEEK).agg(total("target_share_ewm_3").alias("teammate_vacated_target_share"), total("carry_share_ewm_3").alias("teammate_vacated_carry_share"))


def team_features(context: DataFrame, schedule: DataFrame, snaps: DataFrame, injuries: DataFrame, usage: DataFrame, registry: Registry | None = None) -> DataFrame:
    keys, order = ["team", "season"], ["week"]
    rows = context.join(line_continuity(snaps), TEAM_WEEK, "left")
    rows = with_ewm(rows, {f"{name}_ewm_{span}": (raw, span) for raw, name, span in TEAM_WINDOWS}, keys, order)
    # an opponent's pace through the week before: this week's game is its own too
    pace = rows.select(F.col("team").alias("opponent"), "season", "week", F.lag("neutral_pace_ewm_8").over(Window.partitionBy(*keys).orderBy(*order)).alias("opponent_neutral_pace_ewm_8"))
    rows = rows.join(opponents(schedule).select(*TEAM_WEEK, "opponent"), TEAM_WEEK, "left").join(pace, ["opponent", "season", "week"], "left").drop("opponent")
    rows = rows.withColumnRenamed("implied_total", "implied_team_total").join(vacated_shares(injuries, usage), TEAM_WEEK, "left")
    rows = rows.fillna(0.0, ["teammate_vacated_target_share", "teammate_vacated_carry_share"])
    if registry is not None:
        for _, name, span in TEAM_WINDOWS:
            registry.add(Feature(f"{name}_ewm_{span}", TEAM, window=f"ewm_{span}"))
        for name in SAME_WEEK:
            registry.add(Feature(name, TEAM))
    return rows


def row_grid(rosters: DataFrame, schedule: DataFrame) -> DataFrame:
    """Skill players on an active roster in weeks their team plays, those ruled out included."""
    active = rosters.filter(F.col("status").isin(*ACTIVE) & F.col("position").isin(*SKILL) & F.col("gsis_id").isNotNull())
    weeks = opponents(schedule).select(*TEAM_WEEK).distinct()
    return active.select(F.col("gsis_id").alias("player_id"), "season", "week", "team", "position").join(weeks, TEAM_WEEK)


def add_target(grid: DataFrame, stats: DataFrame, usage: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """League points (0 without a stat line) and whether the player had a snap."""
    scored = stats.select(*PLAYER_WEEK, points(stats, dict(weights)).alias("target"))
    played = usage.select(*PLAYER_WEEK, (F.col("offense_snaps") > 0).alias("availability_flag"))
    rows = grid.join(scored, PLAYER_WEEK, "left").join(played, PLAYER_WEEK, "left")
    return rows.withColumns({"target": F.coalesce("target", F.lit(0.0)), "availability_flag": F.coalesce("availability_flag", F.lit(False))})


def add_as_of(grid: DataFrame, schedule: DataFrame) -> DataFrame:
    """The kickoff of the week's first game."""
    return grid.join(schedule.groupBy("season", "week").agg(F.min("kickoff_utc").alias("as_of_utc")), ["season", "week"], "left")


def prime_time(weekday: Column, gametime: Column) -> Column:
    return weekday.isin(*PRIME_DAYS) | (weekday == "Sunday") & (F.substring(gametime, 1, 2).try_cast("int") >= SUNDAY_NIGHT)


def latest_reports(injuries: DataFrame) -> DataFrame:
    rest = [c for c in injuries.columns if c not in PLAYER_WEEK]
    return latest(injuries, PLAYER_WEEK, ["date_modified", *(c for c in ("report_status", "practice_status") if c in rest)], rest)


def games_since_out(grid: DataFrame, reports: DataFrame) -> DataFrame:
    """Games since the last one a player was ruled out of, over all seasons; null if there was none."""
    out = reports.filter(F.col("report_status") == OUT).select(*PLAYER_WEEK, F.lit(True).alias("__out"))
    w = Window.partitionBy("player_id").orderBy("season", "week")
    rows = grid.join(out, PLAYER_WEEK, "left").withColumn("__n", F.row_number().over(w))
    last = F.last(F.when(F.col("__out"), F.col("__n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("weeks_since_return", (F.col("__n") - last).cast("double")).drop("__n", "__out")


def situation_features(grid: DataFrame, schedule: DataFrame, injuries: DataFrame, weather: DataFrame, registry: Registry | None = None) -> DataFrame:
    game = opponents(schedule).select(*TEAM_WEEK, "game_id", "is_home", "rest_days", prime_time(F.col("weekday"), F.col("gametime")).alias("is_primetime"))
    rows = grid.join(game, TEAM_WEEK, "left").join(weather.select("game_id", "wind_mph", "precip_prob", "temp_f", "is_dome"), "game_id", "left").withColumn("week_number", F.col("week"))
    reports = latest_reports(injuries)
    rows = rows.join(reports.select(*PLAYER_WEEK, "report_status", F.col("practice_status").alias("practice_participation")), PLAYER_WEEK, "left")
    rows = games_since_out(rows.withColumn("report_status", F.coalesce("report_status", F.lit(HEALTHY))), reports)
    if registry is not None:
        for name in ("is_home", "rest_days", "is_primetime", "week_number", "wind_mph", "precip_prob", "temp_f", "is_dome", "report_status", "practice_participation", "weeks_since_return"):
            registry.add(Feature(name, "schedule"))
    return rows


def opponent_name(column: str, group: str) -> str:
    return f"def_{column}_{group.lower()}"


def opponent_features(grid: DataFrame, schedule: DataFrame, allowed: DataFrame, registry: Registry | None = None) -> DataFrame:
    """What the week's opponent allows to the groups of a player's position; other groups' columns are null."""
    values = [*OUTCOMES.values(), "n_plays"]
    cells = [F.max(F.when(F.col("position_group") == g, F.col(v).cast("double"))).alias(f"{v}__{g}") for g in ALL_GROUPS for v in values]
    wide = allowed.withColumnRenamed("defteam", "opponent").groupBy("opponent", "season", "week").agg(*cells)
    rows = grid.join(opponents(schedule).select(*TEAM_WEEK, "opponent"), TEAM_WEEK, "left").join(wide, ["opponent", "season", "week"], "left")
    columns = {}
    for g in ALL_GROUPS:
        relevant = F.col("position").isin(*(p for p, groups in GROUPS.items() if g in groups))
        for v in values:
            columns[opponent_name(v, g)] = F.when(relevant, F.col(f"{v}__{g}"))
            if registry is not None:
                registry.add(Feature(opponent_name(v, g), "defense_position_allowed", tuple(p for p, groups in GROUPS.items() if g in groups)))
    return rows.withColumns(columns).drop("opponent", *(f"{v}__{g}" for v in values for g in ALL_GROUPS))


def add_depth(grid: DataFrame, charts: DataFrame, registry: Registry | None = None) -> DataFrame:
    """A player's best place on an offensive depth chart."""
    ranks = charts.filter((F.col("formation") == "Offense") & F.col("gsis_id").isNotNull()).groupBy(F.col("gsis_id").alias("player_id"), "season", "week").agg(F.min(F.col("depth_team").try_cast("int")).alias("depth_chart_rank"))
    if registry is not None:
        registry.add(Feature("depth_chart_rank", "depth_charts"))
    return grid.join(ranks, PLAYER_WEEK, "left")


def add_age(grid: DataFrame, rosters: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Years from birth to the row's as-of time."""
    births = rosters.filter("gsis_id is not null and birth_date is not null").groupBy(F.col("gsis_id").alias("player_id")).agg(F.min(F.col("birth_date").cast("date")).alias("__born"))
    if registry is not None:
        registry.add(Feature("age", "rosters"))
    return grid.join(births, "player_id", "left").withColumn("age", F.datediff(F.to_date(F.col("as_of_utc").cast("timestamp")), "__born") / F.lit(365.25)).drop("__born")


def player_week_features(
    rosters: DataFrame, schedule: DataFrame, stats: DataFrame, usage: DataFrame, snaps: DataFrame, context: DataFrame, allowed: DataFrame, injuries: DataFrame, weather: DataFrame, charts: DataFrame,
    weights: Mapping[str, float], registry: Registry | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist,
) -> DataFrame:
    """The wide table: a row for each active player and scheduled week. Trailing columns come from the week before, by its
    number; what is known before kickoff comes from the week itself.

    ``keep`` holds the two trailing tables, which are read more than once: in memory, or as a function that writes a table
    and reads it back."""
    registry = Registry() if registry is None else registry
    grid = add_as_of(add_target(row_grid(rosters, schedule), stats, usage, weights), schedule)
    grid = situation_features(grid, schedule, injuries, weather, registry)
    grid = add_age(add_depth(opponent_features(grid, schedule, allowed, registry), charts, registry), rosters, registry)
    trailing = keep(usage_features(usage, stats, weights, registry))
    teams = keep(team_features(context, schedule, snaps, injuries, trailing, registry))
    assert_lagged(registry.values())
    grid = lag_shift_join(grid, trailing, ["player_id", "season"], "week", registry.of(USAGE))
    grid = lag_shift_join(grid, teams, ["team", "season"], "week", [c for c in registry.of(TEAM) if c not in SAME_WEEK])
    return grid.join(teams.select(*TEAM_WEEK, *SAME_WEEK), TEAM_WEEK, "left")


def unit_features(defense: DataFrame, context: DataFrame, snaps: DataFrame, schedule: DataFrame, weather: DataFrame) -> DataFrame:
    """One row for each unit and game: the opponent's offence and its own defence through the week before."""
    keys, before = ["team", "season"], Window.partitionBy("team", "season").orderBy("week")
    rates = with_ewm(defense, {out: (raw, 8) for raw, out in UNIT_WINDOWS}, keys, ["week"]).select(*TEAM_WEEK, *(out for _, out in UNIT_WINDOWS))
    rates = rates.withColumns({out: F.lag(out).over(before) for _, out in UNIT_WINDOWS})
    line = context.select(*TEAM_WEEK, F.col("implied_total").alias("opp_implied_team_total")).join(line_continuity(snaps), TEAM_WEEK, "left")
    line = with_ewm(line, {"ol": ("ol_continuity_raw", 5)}, keys, ["week"]).withColumn("opp_ol_continuity_ewm_5", F.lag("ol").over(before))
    own, opp = [o for _, o in UNIT_WINDOWS if o.startswith("own")], [o for _, o in UNIT_WINDOWS if o.startswith("opp")]
    other = ["opponent_team", "season", "week"]
    rows = opponents(schedule, moved=True).select(*TEAM_WEEK, "game_id", F.col("opponent").alias("opponent_team"), "is_home").join(rates.select(*TEAM_WEEK, *own), TEAM_WEEK, "left")
    rows = rows.join(rates.select(F.col("team").alias("opponent_team"), "season", "week", *opp), other, "left")
    rows = rows.join(line.select(F.col("team").alias("opponent_team"), "season", "week", "opp_implied_team_total", "opp_ol_continuity_ewm_5"), other, "left")
    rows = rows.join(weather.select("game_id", "wind_mph", "precip_prob", "temp_f", "is_dome"), "game_id", "left")
    return rows.select("team", "opponent_team", "season", "week", "is_home", "opp_implied_team_total", *opp, "opp_ol_continuity_ewm_5", *own, "wind_mph", "precip_prob", "temp_f", "is_dome")


# Rates with their total, number of touches, positions and prior weight in touches.
RATES = {
    "yards_per_target": ("receiving_yards", "targets", ("RB", "WR", "TE"), 60.0), "td_per_target": ("receiving_tds", "targets", ("RB", "WR", "TE"), 60.0),
    "yards_per_carry": ("rushing_yards", "carries", ("QB", "RB"), 80.0), "td_per_carry": ("rushing_tds", "carries", ("QB", "RB"), 80.0),
}


def efficiency(features: DataFrame, usage: DataFrame, stats: DataFrame, rates: Mapping[str, tuple] = RATES) -> DataFrame:
    """Rates a touch over all earlier weeks of a season, shrunk towards the position's; null for other positions."""
    needed = sorted({c for top, _, _, _ in rates.values() for c in (top,)})
    rows = features.select(*PLAYER_WEEK, "team", "position").join(usage.select(*PLAYER_WEEK, "targets", "carries"), PLAYER_WEEK, "left").join(stats.select(*PLAYER_WEEK, *needed), PLAYER_WEEK, "left")
    rows = rows.fillna(0, ["targets", "carries", *needed])
    before = Window.partitionBy("player_id", "season").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    rows = pooled_prior_means(rows, "position", "season", "week", {f"__league_{name}": ratio(top, bottom) for name, (top, bottom, _, _) in rates.items()})

    def expected(name: str, top: str, bottom: str, positions: Sequence[str], strength: float) -> Column:
        n = F.coalesce(F.sum(bottom).over(before), F.lit(0))
        value = (F.coalesce(F.sum(top).over(before), F.lit(0)) + strength * F.col(f"__league_{name}")) / (n + strength)
        return F.when(F.col("position").isin(*positions), value)

    return rows.withColumns({f"expected_{name}": expected(name, *spec) for name, spec in rates.items()}).drop(*(f"__league_{name}" for name in rates))


def hazard_features(rosters: DataFrame, schedule: DataFrame, injuries: DataFrame, snaps: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Whether a rostered player missed the game, and what was known of his health before it."""
    from tidemark.operators.relational import keep_first
    from tidemark.operators.timeseries import rolling_mean, seasons_before, weeks_since

    rows = rosters.filter(F.col("status").isin(*ACTIVE) & F.col("position").isin(*SKILL)).select(F.col("gsis_id").alias("player_id"), "season", "week", "team", "position", "status", F.col("birth_date").cast("date").alias("birth_date"))
    rows = keep_first(rows, PLAYER_WEEK, ["status", "team"]).withColumn("missed", F.col("status") == "INA")
    first = schedule.groupBy("season", "week").agg(F.min(F.col("gameday").cast("date")).alias("__day"))
    rows = rows.join(first, ["season", "week"], "left").withColumn("age", F.datediff("__day", "birth_date") / F.lit(365.25)).drop("__day", "birth_date", "status")
    rows = seasons_before(rows, F.col("missed").cast("int"), "player_id", "season", "missed_prior_two_seasons")
    rows = rows.withColumn("weeks_since_return", weeks_since(F.col("missed"), ["player_id", "season"], "week", 999))
    report = injuries.select(F.col("gsis_id").alias("player_id"), *(F.col(c).cast("int").alias(c) for c in ("season", "week")), "report_status")
    rows = rows.join(keep_first(report, PLAYER_WEEK, ["report_status"]), PLAYER_WEEK, "left").withColumn("report_status", F.coalesce("report_status", F.lit(HEALTHY)))
    bridge = crosswalk.select(F.col("pfr_id").alias("pfr_player_id"), F.col("gsis_id").alias("player_id")).dropna()
    share = keep_first(snaps.join(bridge, "pfr_player_id").select(*PLAYER_WEEK, "offense_pct"), PLAYER_WEEK, ["offense_pct"])
    rows = rows.join(share, PLAYER_WEEK, "left").withColumn("offense_pct", F.coalesce("offense_pct", F.lit(0.0)))
    return rows.withColumn("snap_pct_trend", F.coalesce(rolling_mean("offense_pct", ["player_id", "season"], ["week"], -4, -1), F.lit(0.0))).drop("offense_pct")


#: How each table's rows become known: by the week's first kickoff, by their own time, or always.
BY_KICKOFF = ("player_week_stats", "player_week_usage", "team_week_context", "defense_position_allowed", "weather", "rosters", "snap_counts")
BY_OWN_TIME, ALWAYS = ("injuries",), ("schedule",)


def known_tables(tables: Mapping[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Each table cut to the rows known strictly before a time; a table without a rule is an error."""
    first = tables["schedule"].groupBy("season", "week").agg(F.min(F.col("kickoff_utc").cast("timestamp")).alias("__known"))
    out = {}
    for name, df in tables.items():
        if name in ALWAYS:
            out[name] = df
        elif name in BY_OWN_TIME:
            out[name] = df.filter(F.col("date_modified") < as_of)
        elif name in BY_KICKOFF:
            out[name] = df.join(first, ["season", "week"], "left").filter(F.col("__known") < as_of).drop("__known")
        else:
            raise LeakageError(f"no rule says when rows of {name} are known")
    return out

"""The season layer on small hand-built tables."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.season import features as X
from tidemark.season import interim, rules

WEIGHTS = {"rec": 1.0, "rec_yd": 0.1, "pass_yd": 0.04, "pts_allow_0": 10.0, "sack": 1.0, "fgm_yds": 0.1, "bonus_rec_yd_100": 3.0}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def pbp(spark):
    rng = np.random.default_rng(1)
    rows = []
    for season in (2022, 2023):
        for week in (1, 2, 3):
            for game, (h, a) in enumerate((("A", "B"), ("C", "D")) if week % 2 else (("A", "C"), ("B", "D"))):
                for play in range(40):
                    off, dfn = (h, a) if play // 5 % 2 == 0 else (a, h)
                    run = bool(rng.random() < 0.45)
                    rows.append(
                        (f"{season}{week}{game}", play, season, week, off, dfn, "home" if off == h else "away", "run" if run else "pass", play // 5, float(1 + play % 4), 10.0, float(rng.integers(-20, 21)), 1800.0 - 40 * play, float(rng.integers(1, 99)),
                         int(not run), 0, 0, int(not run), int(rng.random() < 0.1), int(rng.random() < 0.1), 0, 0, float(rng.normal()), int(rng.random() < 0.5), float(rng.integers(-3, 20)), int(rng.random() < 0.05),
                         None if run else f"{off}_wr", f"{off}_rb" if run else None, None if run else f"{off}_qb", 0, "2:30", 5.0, 1.0)
                    )
    schema = "game_id string, play_id int, season int, week int, posteam string, defteam string, posteam_type string, play_type string, drive int, down double, ydstogo double, score_differential double, half_seconds_remaining double, yardline_100 double, pass int, qb_kneel int, qb_spike int, qb_dropback int, sack int, qb_hit int, interception int, fumble_lost int, epa double, success int, yards_gained double, touchdown int, receiver_player_id string, rusher_player_id string, passer_player_id string, qb_scramble int, drive_time_of_possession string, drive_play_count double, drive_quarter_start double"
    return frame(spark, rows, schema)


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(f"{t}_{p.lower()}", s, w, t, p, 6, 0.2, 50.0, 0.3, 0.5, 4, 5 * w, 100 if w == 3 else 40, 20, 0.0, 1, 12.0) for s in (2022, 2023) for w in (1, 2, 3) for t in "ABCD" for p in ("QB", "RB", "WR")]
    return frame(spark, rows, "player_id string, season int, week int, team string, position string, targets int, target_share double, receiving_air_yards double, air_yards_share double, wopr double, carries int, receptions int, receiving_yards int, attempts int, passing_cpoe double, sacks_suffered int, rushing_yards double")


@pytest.fixture(scope="module")
def schedule(spark):
    rows = []
    for s in (2022, 2023):
        for w in (1, 2, 3):
            for g, (h, a) in enumerate((("A", "B"), ("C", "D")) if w % 2 else (("A", "C"), ("B", "D"))):
                rows.append((f"{s}{w}{g}", s, w, h, a, 3.0, 44.0, 7, 6, "Sunday" if g else "Monday", "20:15" if g else "13:00", f"{s}-09-{7 * w:02d}", f"{s}-09-{7 * w:02d}T17:00:00Z", 20, 17))
    raw = frame(spark, rows, "game_id string, season int, week int, home_team string, away_team string, spread_line double, total_line double, home_rest int, away_rest int, weekday string, gametime string, gameday string, kickoff_utc string, home_score int, away_score int")
    return interim.normalised_schedule(raw)


@pytest.fixture(scope="module")
def players(spark):
    return frame(spark, [(f"{t}_{p}", f"x{t}{p}") for t in "ABCD" for p in ("qb", "rb", "wr")], "player_id string, pfr_id string")


@pytest.fixture(scope="module")
def snaps(spark):
    rows = [(f"x{t}{p}", s, w, t, p.upper(), 50 - 10 * (w == 2), 0.9 - 0.4 * (w == 2)) for s in (2022, 2023) for w in (1, 2, 3) for t in "ABCD" for p in ("qb", "rb", "wr")]
    rows += [(f"{t}{pos}{k if w < 3 else k + 1}", s, w, t, pos, 60, 1.0) for s in (2022, 2023) for w in (1, 2, 3) for t in "ABCD" for pos, n in (("C", 1), ("G", 2), ("T", 2)) for k in range(n)]
    return frame(spark, rows, "pfr_player_id string, season int, week int, team string, position string, offense_snaps int, offense_pct double")


def test_points_by_rules(spark):
    rows = [("a", "WR", 8, 120, 0, None, 2, None), ("u", "DST", None, None, None, 0, 3, None), ("k", "K", None, None, None, None, 0, "25;52")]
    df = frame(spark, rows, "player_id string, position string, receptions int, receiving_yards int, passing_yards int, points_allowed int, def_sacks int, fg_made_list string")
    got = {r.player_id: round(r.p, 6) for r in df.select("player_id", rules.points(df, WEIGHTS).alias("p")).collect()}
    assert got == {"a": 8 + 12 + 3, "u": 10 + 3, "k": 7.7}
    with pytest.raises(ValueError, match="exclude"):
        rules.points(df, {"fgm_yds": 1, "fgm_0_19": 1})


def test_team_week_defense_is_the_outer_join_of_its_counts(pbp):
    got = {(r.season, r.week, r.team): r for r in interim.team_week_defense(pbp).collect()}
    plays = [r.asDict() for r in pbp.collect()]
    for (s, w, t), r in got.items():
        own = [p for p in plays if (p["season"], p["week"], p["posteam"]) == (s, w, t)]
        against = [p for p in plays if (p["season"], p["week"], p["defteam"]) == (s, w, t)]
        drops = [p for p in own if p["qb_dropback"]]
        assert r.plays == len(own) and r.plays_faced == len(against) and r.dropbacks == len(drops)
        assert r.sacks_allowed == sum(p["sack"] for p in drops)
        assert r.pressure_rate_allowed == pytest.approx(sum(p["sack"] or p["qb_hit"] for p in drops) / len(drops))
    assert len(got) == 24


def test_context_with_pace_schedule_and_proe(pbp, schedule):
    context = interim.add_schedule_context(interim.add_neutral_pace(interim.add_proe(interim.team_week_context(pbp), pbp), pbp), schedule)
    rows = context.collect()
    assert len(rows) == 24
    for r in rows:
        assert (r.proe is None) == (r.season == 2022)
        assert r.neutral_pace_sec in (None, 30.0)
        assert abs(r.spread) == 3.0 and r.implied_total == 22 + r.spread / 2


def test_opponent_adjustment_knows_only_the_past(pbp, stats):
    allowed = interim.defense_position_allowed(pbp, stats)
    adjusted = interim.add_opponent_adjustment(allowed, pbp, stats)
    rows = adjusted.collect()
    assert adjusted.columns == allowed.columns and len(rows) == allowed.count()
    assert all(r.adj_epa_allowed is None for r in rows if (r.season, r.week) == (2022, 1))
    assert all(r.adj_epa_allowed is not None for r in rows if r.season == 2023)
    later = pbp.withColumn("epa", F.when((F.col("season") == 2023) & (F.col("week") == 3), 99.0).otherwise(F.col("epa")))
    again = {(r.defteam, r.season, r.week, r.position_group): r.adj_epa_allowed for r in interim.add_opponent_adjustment(allowed, later, stats).collect()}
    assert all(again[r.defteam, r.season, r.week, r.position_group] == pytest.approx(r.adj_epa_allowed) for r in rows if r.adj_epa_allowed is not None)


def test_ridge_on_sums_equals_ridge_on_plays(pbp, stats):
    plays = interim.position_plays(pbp, stats).filter("position_group = 'WR' and season = 2022").toPandas()
    cells = plays.groupby(["posteam", "defteam", "home"]).agg(n=("epa", "size"), **{c: (c, "sum") for c in interim.OUTCOMES}).reset_index()
    got = interim._ridge(cells, np.ones(len(cells)))
    teams = sorted(set(plays.posteam) | set(plays.defteam))
    x = np.zeros((len(plays), 2 * len(teams) + 1))
    for i, (o, d, h) in enumerate(zip(plays.posteam, plays.defteam, plays.home)):
        x[i, teams.index(o)] = x[i, len(teams) + teams.index(d)] = 1
        x[i, -1] = h
    y = plays[list(interim.OUTCOMES)].to_numpy(float)
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    for team, value in got.items():
        assert value == pytest.approx(want[len(teams) + teams.index(team)], abs=1e-8)


def test_features_are_those_of_the_week_before(spark, pbp, stats, schedule, players, snaps):
    usage = interim.player_week_usage(stats, snaps, pbp, players).persist()
    context = interim.add_schedule_context(interim.add_neutral_pace(interim.team_week_context(pbp), pbp), schedule).persist()
    allowed = interim.add_opponent_adjustment(interim.defense_position_allowed(pbp, stats), pbp, stats).persist()
    rosters = frame(spark, [(f"{t}_{p}", s, w, t, p.upper(), "INA" if (t, p, w) == ("A", "wr", 3) else "ACT", "1998-01-01") for s in (2022, 2023) for w in (1, 2, 3) for t in "ABCD" for p in ("qb", "rb", "wr")], "gsis_id string, season int, week int, team string, position string, status string, birth_date string")
    injuries = frame(spark, [("A_wr", 2023, 3, "A", "Out", "DNP", datetime(2023, 9, 20))], "player_id string, season int, week int, team string, report_status string, practice_status string, date_modified timestamp")
    weather = frame(spark, [("202310", 5.0, 0.1, 60.0, False)], "game_id string, wind_mph double, precip_prob double, temp_f double, is_dome boolean")
    charts = frame(spark, [(2023, 2, "A_rb", "Offense", "1")], "season int, week int, gsis_id string, formation string, depth_team string")
    registry = X.Registry()
    wide = X.player_week_features(rosters, schedule, stats, usage, snaps, context, allowed, injuries, weather, charts, {"rec": 1.0}, registry)
    rows = {(r.player_id, r.season, r.week): r for r in wide.collect()}
    assert len(rows) == 72 and set(registry) <= set(wide.columns)
    a = rows["A_wr", 2023, 2]
    assert a.target == 10 and a.snap_pct_ewm_3 == pytest.approx(0.9) and a.snap_pct_prior_season == pytest.approx((0.9 + 0.5 + 0.9) / 3)
    assert rows["A_wr", 2023, 1].snap_pct_ewm_3 is None
    assert rows["A_wr", 2023, 3].snap_pct_ewm_3 == pytest.approx((0.9 * 0.5 + 0.5) / 1.5)
    assert rows["A_qb", 2023, 3].teammate_vacated_target_share == pytest.approx(0.2) and rows["A_qb", 2023, 2].teammate_vacated_target_share == 0
    assert rows["A_wr", 2023, 3].report_status == "Out" and a.report_status == "None" and rows["A_rb", 2023, 2].depth_chart_rank == 1
    assert a.is_primetime is True and a.rest_days == 7 and a.def_n_plays_wr is not None and a.def_n_plays_te is None
    assert a.age == pytest.approx((datetime(2023, 9, 14) - datetime(1998, 1, 1)).days / 365.25)
    with pytest.raises(ValueError, match="twice"):
        registry.add(X.Feature("age", "rosters"))
    with pytest.raises(X.LeakageError):
        X.assert_lagged([X.Feature("x", "y", lag=0)])
    unit = X.unit_features(interim.team_week_defense(pbp), context, snaps, schedule, weather)
    assert unit.count() == 24 and unit.filter("week = 1 and own_takeaway_rate_ewm_8 is not null").count() == 0
    assert X.efficiency(wide, usage, stats.withColumn("receiving_tds", F.lit(0)).withColumn("rushing_tds", F.lit(0))).count() == 72


def test_line_continuity(snaps):
    got = {r.week: r.ol_continuity_raw for r in X.line_continuity(snaps).filter("team = 'A' and season = 2023").collect()}
    assert got == {1: None, 2: 1.0, 3: pytest.approx(2 / 5)}


def test_known_tables(spark, schedule):
    injuries = frame(spark, [("a", datetime(2023, 9, 6)), ("b", datetime(2023, 9, 8))], "player_id string, date_modified timestamp")
    stats = frame(spark, [("a", 2023, 1), ("a", 2023, 2)], "player_id string, season int, week int")
    known = X.known_tables({"schedule": schedule, "injuries": injuries, "player_week_stats": stats}, F.lit(datetime(2023, 9, 7, 18)))
    assert known["injuries"].count() == 1 and known["player_week_stats"].count() == 1 and known["schedule"].count() == 12
    with pytest.raises(X.LeakageError):
        X.known_tables({"schedule": schedule, "unknown": stats}, F.lit(datetime(2023, 9, 7)))

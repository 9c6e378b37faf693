"""Queries of the feature layer: windows, point-in-time joins, rollups. Each name has a query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import evaluation as E
from tidemark.operators import relational as R
from tidemark.operators import timeseries as TS
from tidemark.plans.catalog import Catalog
from tidemark.plans.frames import GAMES, PLAYS, PW, games, money, plays, player_weeks, table

KEYS, ORDER = ["player", "season"], ["week"]
_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.QUERIES, _catalog.SQL


def ewm_sql(span: int, value: str = "points") -> str:
    decay = 1 - 2 / (span + 1)
    return f"""SELECT a.player, a.season, a.week, sum(b.{value} * pow({decay!r}, a.rn - b.rn)) / sum(pow({decay!r}, a.rn - b.rn)) AS ewm
  FROM ranked a JOIN ranked b ON a.player = b.player AND a.season = b.season AND b.rn <= a.rn GROUP BY ALL"""


RANKED = PW + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY player, season ORDER BY week) AS rn FROM pw)"


@query(f"""WITH {RANKED}, e AS ({ewm_sql(4)}),
l AS (SELECT r.pos, r.points, lag(e.ewm) OVER (PARTITION BY r.player, r.season ORDER BY r.week) AS predicted FROM ranked r JOIN e USING (player, season, week))
SELECT pos, count(predicted) AS n, round(avg(abs(predicted - points)), 4) AS mae, round(sqrt(avg((predicted - points) ** 2)), 4) AS rmse, round(avg(predicted - points), 4) AS bias
FROM l GROUP BY pos""")
def lagged_ewm_baseline_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TS.lagged_ewm(player_weeks(spark, sf_dir), "points", KEYS, ORDER, 4, "predicted")
    n, *rest = E.error_metrics(F.col("points"), F.col("predicted"))
    return rows.groupBy("pos").agg(n, *rest).select("pos", "n", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")))


@query(f"WITH {RANKED} SELECT player, season, week, floor(ewm * 1000 + 0.4142) / 1000 AS ewm8 FROM ({ewm_sql(8)})")
def usage_ewm_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TS.with_ewm(player_weeks(spark, sf_dir), {"ewm8": ("points", 8)}, KEYS, ORDER)
    return rows.select("player", "season", "week", C.on_grid("ewm8", 3).alias("ewm8"))


@query(f"""WITH {RANKED}, t AS (SELECT team, season, week, sum(touches) AS v FROM pw GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY week) AS rn FROM t),
e AS (SELECT a.team, a.season, a.week, sum(b.v * pow({1 - 2 / 7!r}, a.rn - b.rn)) / sum(pow({1 - 2 / 7!r}, a.rn - b.rn)) AS ewm FROM r a JOIN r b ON a.team = b.team AND a.season = b.season AND b.rn <= a.rn GROUP BY ALL)
SELECT team, season, week, round(lag(ewm) OVER (PARTITION BY team, season ORDER BY week), 6) AS trailing FROM e""")
def team_touches_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = player_weeks(spark, sf_dir).groupBy("team", "season", "week").agg(F.sum("touches").alias("v"))
    return TS.lagged_ewm(teams, "v", ["team", "season"], ORDER, 6, "trailing").select("team", "season", "week", F.round("trailing", 6).alias("trailing"))


@query(f"WITH {PW} SELECT player, season, week, round(avg(points) OVER (PARTITION BY player, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM pw")
def expanding_mean_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).select("player", "season", "week", F.round(TS.expanding_mean("points", KEYS, ORDER), 6).alias("mean_before"))


@query(f"WITH {PW} SELECT player, season, week, round(avg(points) OVER (PARTITION BY player, season ORDER BY week), 6) AS to_date FROM pw")
def season_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).select("player", "season", "week", F.round(TS.expanding_mean("points", KEYS, ORDER, lag=0), 6).alias("to_date"))


@query(f"""WITH {PW}, s AS (SELECT pos, season, week, sum(points) AS s, count(points) AS n FROM pw GROUP BY ALL),
r AS (SELECT pos, season, week, sum(s) OVER w / sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY pos, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT pos, season + 1 AS season, avg(points) AS before FROM pw GROUP BY ALL)
SELECT pos, season, week, floor(coalesce(m, before) * 1000 + 0.4142) / 1000 AS pooled FROM r LEFT JOIN b USING (pos, season)""")
def pooled_group_mean_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TS.pooled_prior_mean(player_weeks(spark, sf_dir), "pos", "season", "week", "points", "pooled")
    return rows.select("pos", "season", "week", C.on_grid("pooled", 3).alias("pooled")).distinct()


@query(f"""WITH {PW}, s AS (SELECT pos, season, week, sum((touches > 1)::INT) AS s, count(*) AS n FROM pw GROUP BY ALL),
r AS (SELECT pos, season, week, sum(s) OVER w / sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY pos, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT pos, season + 1 AS season, avg((touches > 1)::INT) AS before FROM pw GROUP BY ALL)
SELECT pos, season, week, round(coalesce(m, before), 6) AS base_rate FROM r LEFT JOIN b USING (pos, season)""")
def availability_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TS.pooled_prior_mean(player_weeks(spark, sf_dir), "pos", "season", "week", (F.col("touches") > 1).cast("int"), "base_rate")
    return rows.select("pos", "season", "week", F.round("base_rate", 6).alias("base_rate")).distinct()


@query(f"""WITH {PW}, b AS (SELECT player, season + 1 AS season, avg(points) AS prior FROM pw GROUP BY ALL)
SELECT player, season, week, round(prior, 6) AS prior FROM pw LEFT JOIN b USING (player, season)""")
def prior_season_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TS.prior_season_mean(player_weeks(spark, sf_dir), "points", "player", "season", "prior").select("player", "season", "week", F.round("prior", 6).alias("prior"))


@query(f"""WITH {PW} SELECT player, season, week, CASE WHEN count(points) OVER w >= 2 THEN round(stddev_samp(points) OVER w, 6) END AS sd8
FROM pw WINDOW w AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def rolling_std_min2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).select("player", "season", "week", F.round(TS.rolling_std("points", KEYS, ORDER, 8), 6).alias("sd8"))


@query(f"""WITH {PW} SELECT player, season, week, round(avg(points) OVER (PARTITION BY player, season ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS trend FROM pw""")
def rolling_mean_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).select("player", "season", "week", F.round(TS.rolling_mean("points", KEYS, ORDER, -4, -1), 6).alias("trend"))


@query(f"""WITH {PW}, d AS (SELECT *, CASE WHEN abs(touches - lag(touches) OVER w) > 0.5 THEN week END AS change FROM pw WINDOW w AS (PARTITION BY player, season ORDER BY week))
SELECT player, season, week, week - coalesce(last_value(change IGNORE NULLS) OVER w, first_value(week) OVER w) AS in_role
FROM d WINDOW w AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def role_change_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TS.periods_in_role(player_weeks(spark, sf_dir), "touches", KEYS, "week", 0.5, "in_role").select("player", "season", "week", "in_role")


@query(f"""WITH {PW} SELECT g.player, g.season, g.week, f.points AS points_before, f.touches AS touches_before
FROM pw g LEFT JOIN pw f ON f.player = g.player AND f.season = g.season AND f.week + 1 = g.week""")
def lag_shift_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir)
    features = rows.select("player", "season", "week", F.col("points").alias("points_before"), F.col("touches").alias("touches_before"))
    return TS.lag_shift_join(rows.select("player", "season", "week"), features, KEYS, "week", ["points_before", "touches_before"])


EVENTS = "ev AS (SELECT user_id, ts, event_id, value, event_type FROM events)"


def _order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))


def _signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "ts", "event_id", "value")


def _midnights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of time for each event, at the middle of its day."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("left_id"), "user_id", (F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")).alias("ts"))


_LEFT = "l AS (SELECT event_id AS left_id, user_id, date_trunc('day', ts) + INTERVAL 12 HOURS AS ts FROM events)"


@query(f"""WITH {_LEFT} SELECT left_id, (SELECT max(struct_pack(ts := r.ts, event_id := r.event_id)).event_id FROM events r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS event_id FROM l""")
def asof_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = TS.asof_join(_midnights(spark, sf_dir), _signups(spark, sf_dir), ["user_id"], "ts", ["event_id"], order=["event_id"])
    return found.select("left_id", "event_id")


@query("""WITH l AS (SELECT event_id AS left_id, user_id, ts FROM events)
SELECT left_id, (SELECT max(struct_pack(ts := r.ts, event_id := r.event_id)).event_id FROM events r WHERE r.user_id = l.user_id AND r.ts < l.ts) AS event_id FROM l""")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").select(F.col("event_id").alias("left_id"), "user_id", "ts")
    return TS.asof_join(left, _signups(spark, sf_dir), ["user_id"], "ts", ["event_id"], strict=True, order=["event_id"]).select("left_id", "event_id")


@query(f"""WITH {_LEFT} SELECT left_id, (SELECT min(struct_pack(ts := r.ts, event_id := r.event_id)).event_id FROM events r WHERE r.user_id = l.user_id AND r.ts >= l.ts) AS event_id FROM l""")
def forward_asof_first_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _signups(spark, sf_dir).withColumn("tie", -F.col("event_id"))
    return TS.forward_asof(_midnights(spark, sf_dir), right, ["user_id"], "ts", ["event_id"], order=["tie"]).select("left_id", "event_id")


@query(f"""WITH {PW} SELECT player, season, round(sum(points * CASE WHEN week >= 10 THEN 2.0 ELSE 1.0 END) / sum(CASE WHEN week >= 10 THEN 2.0 ELSE 1.0 END), 6) AS weighted FROM pw GROUP BY ALL""")
def playoff_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("week") >= 10, 2.0).otherwise(1.0)
    return player_weeks(spark, sf_dir).groupBy("player", "season").agg(F.round(F.sum(F.col("points") * w) / F.sum(w), 6).alias("weighted"))


@query(f"""WITH {PW}, sh AS (SELECT player, season, week, team, touches::DOUBLE / sum(touches) OVER (PARTITION BY team, season, week) AS share FROM pw),
outs AS (SELECT o_custkey AS player, c_nationkey AS team, year(o_orderdate) AS season, month(o_orderdate) AS week FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
m AS (SELECT o.*, (SELECT max(struct_pack(week := s.week, share := s.share)).share FROM sh s WHERE s.player = o.player AND s.season = o.season AND s.week <= o.week) AS share FROM outs o)
SELECT team, season, week, round(sum(share), 6) AS vacated FROM m WHERE share IS NOT NULL GROUP BY ALL""")
def vacated_share_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir)
    shares = rows.withColumn("share", F.col("touches").cast("double") / F.sum("touches").over(Window.partitionBy("team", "season", "week")))
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    outs = orders.filter("o_orderpriority = '1-URGENT'").join(people, orders.o_custkey == people.c_custkey)
    outs = outs.select(F.col("o_custkey").alias("player"), F.col("c_nationkey").alias("team"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week")).distinct()
    met = TS.asof_join(outs, shares.select(*KEYS, "week", "share"), KEYS, "week", ["share"]).dropna(subset=["share"])
    return met.groupBy("team", "season", "week").agg(F.round(F.sum("share"), 6).alias("vacated"))


@query(f"""WITH {PLAYS}, s AS (SELECT defteam, season, week, list_sort(list(DISTINCT kind || status)) AS units FROM plays GROUP BY ALL)
SELECT defteam, season, week, CASE WHEN lag(units) OVER w IS NOT NULL THEN len(list_intersect(units, lag(units) OVER w)) / 4.0 END AS continuity FROM s WINDOW w AS (PARTITION BY defteam, season ORDER BY week)""")
def set_overlap_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = plays(spark, sf_dir).groupBy("defteam", "season", "week").agg(F.collect_set(F.concat("kind", "status")).alias("units"))
    before = F.lag("units").over(Window.partitionBy("defteam", "season").orderBy("week"))
    return units.select("defteam", "season", "week", F.when(before.isNotNull(), F.size(F.array_intersect("units", before)) / F.lit(4.0)).alias("continuity"))


@query(f"WITH {PW} SELECT pos, season, week, player, points, rank FROM (SELECT *, row_number() OVER (PARTITION BY pos, season, week ORDER BY points DESC, player) AS rank FROM pw) WHERE rank <= 3")
def ordinal_topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_n(player_weeks(spark, sf_dir), ["pos", "season", "week"], [F.desc("points"), "player"], 3).select("pos", "season", "week", "player", "points", "rank")


@query(f"""WITH {PLAYS},
a AS (SELECT defteam, season, count(*) AS sacks FROM plays WHERE kind = 'R' AND yards > 45 GROUP BY ALL),
b AS (SELECT defteam, season, count(*) AS picks FROM plays WHERE kind = 'A' AND yards > 45 GROUP BY ALL),
c AS (SELECT defteam, season, avg(yards) AS mean_yards FROM plays WHERE status = 'O' AND yards > 40 GROUP BY ALL)
SELECT defteam, season, coalesce(sacks, 0) AS sacks, coalesce(picks, 0) AS picks, round(mean_yards, 6) AS mean_yards, round(sacks::DOUBLE / nullif(picks, 0), 6) AS sack_ratio
FROM a FULL JOIN b USING (defteam, season) FULL JOIN c USING (defteam, season)""")
def team_side_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, keys = plays(spark, sf_dir), ["defteam", "season"]
    sacks = p.filter("kind = 'R' and yards > 45").groupBy(*keys).agg(F.count(F.lit(1)).alias("sacks"))
    picks = p.filter("kind = 'A' and yards > 45").groupBy(*keys).agg(F.count(F.lit(1)).alias("picks"))
    means = p.filter("status = 'O' and yards > 40").groupBy(*keys).agg(F.avg("yards").alias("mean_yards"))
    met = R.full_join(keys, sacks, picks, means)
    return met.select(*keys, F.coalesce("sacks", F.lit(0)).alias("sacks"), F.coalesce("picks", F.lit(0)).alias("picks"), F.round("mean_yards", 6).alias("mean_yards"), F.round(C.ratio("sacks", "picks"), 6).alias("sack_ratio"))


@query(f"""WITH {PLAYS} SELECT receiver, season, count(*) FILTER (kind = 'R' AND yards <= 10) AS inside_10, count(*) FILTER (kind = 'R' AND yards <= 5) AS inside_5, count(*) FILTER (kind = 'A' AND yards <= 10) AS targets_10
FROM plays GROUP BY ALL HAVING inside_10 + inside_5 + targets_10 > 0""")
def conditional_zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, yards = F.col("kind"), F.col("yards")
    return R.counted(plays(spark, sf_dir), ["receiver", "season"], {"inside_10": (kind == "R") & (yards <= 10), "inside_5": (kind == "R") & (yards <= 5), "targets_10": (kind == "A") & (yards <= 10)})


@query(f"""WITH {PLAYS}, d AS (SELECT game, min_by(season, (play, defteam, receiver, gain)) AS season, min_by(kind, (play, defteam, receiver, gain)) AS first_kind, count(*) AS n, sum(yards) AS yards FROM plays GROUP BY ALL)
SELECT season, round(sum(yards) / nullif(sum(n), 0), 6) AS pace, count(*) AS drives FROM d WHERE first_kind = 'N' GROUP BY ALL""")
def ordered_first_per_drive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct("play", "defteam", "receiver", "gain")
    drives = plays(spark, sf_dir).groupBy("game").agg(F.min_by("season", first).alias("season"), F.min_by("kind", first).alias("first_kind"), F.count(F.lit(1)).alias("n"), F.sum("yards").alias("yards"))
    return drives.filter("first_kind = 'N'").groupBy("season").agg(F.round(C.ratio(F.sum("yards"), F.sum("n")), 6).alias("pace"), F.count(F.lit(1)).alias("drives"))


@query(f"""WITH {PW}, t AS (SELECT team, season, week, sum(touches) AS team_touches FROM pw GROUP BY ALL)
SELECT player, season, week, round(touches / nullif(team_touches, 0), 6) AS touch_share FROM pw LEFT JOIN t USING (team, season, week)""")
def share_of_team_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir)
    teams = rows.groupBy("team", "season", "week").agg(F.sum("touches").alias("team_touches"))
    return rows.join(teams, ["team", "season", "week"], "left").select("player", "season", "week", F.round(C.ratio("touches", "team_touches"), 6).alias("touch_share"))


@query(f"""WITH {GAMES} SELECT game, season, week, home AS team, away AS opponent, line AS spread, true AS is_home, round(total / 2 + line / 2, 6) AS implied FROM games
UNION ALL SELECT game, season, week, away, home, -line, false, round(total / 2 - line / 2, 6) FROM games""")
def home_away_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = {"game": "game", "season": "season", "week": "week"}
    half = F.col("total") / 2
    home = shared | {"team": "home", "opponent": "away", "spread": F.col("line"), "is_home": F.lit(True), "implied": F.round(half + F.col("line") / 2, 6)}
    away = shared | {"team": "away", "opponent": "home", "spread": -F.col("line"), "is_home": F.lit(False), "implied": F.round(half - F.col("line") / 2, 6)}
    return R.sides(games(spark, sf_dir), home, away)


@query(f"""WITH {PLAYS}, a AS (SELECT defteam, season, kind, avg(yards) AS allowed FROM plays GROUP BY ALL)
SELECT defteam, season, round(max(allowed) FILTER (kind = 'A'), 6) AS allowed_A, round(max(allowed) FILTER (kind = 'N'), 6) AS allowed_N, round(max(allowed) FILTER (kind = 'R'), 6) AS allowed_R, NULL::DOUBLE AS allowed_X FROM a GROUP BY ALL""")
def opponent_group_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = plays(spark, sf_dir).groupBy("defteam", "season", "kind").agg(F.avg("yards").alias("allowed"))
    return R.completed_pivot(allowed, ["defteam", "season"], "kind", ["A", "N", "R", "X"], F.round("allowed", 6), "allowed_")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_record_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("""SELECT event_type, min_by(event_id, (ts, event_id)) AS first_event, min(ts) AS ts FROM events GROUP BY ALL""")
def first_record_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_first(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", F.col("event_id").alias("first_event"), "ts")



@query("""WITH h AS (SELECT user_id, event_id, ts, value < 20 AS missed FROM events),
b AS (SELECT *, CASE WHEN missed AND NOT coalesce(lag(missed) OVER w, false) THEN 1 ELSE 0 END AS begins FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
r AS (SELECT user_id, run, count(*) AS length FROM n WHERE missed GROUP BY ALL)
SELECT length, count(*) AS runs, round(1 / avg(length), 6) AS recovery FROM r GROUP BY length""")
def gaps_islands_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") < 20).alias("missed"))
    found = TS.runs(rows, "missed", ["user_id"], ["ts", "event_id"])
    return found.groupBy("length").agg(F.count(F.lit(1)).alias("runs"), F.round(1 / F.avg("length"), 6).alias("recovery"))


@query(f"""WITH {PW}, s AS (SELECT player, season, sum((touches > 1)::INT) AS a FROM pw GROUP BY ALL)
SELECT p.player, p.season, p.week, (coalesce(x.a, 0) + coalesce(y.a, 0))::BIGINT AS missed_two
FROM pw p LEFT JOIN s x ON x.player = p.player AND x.season + 1 = p.season LEFT JOIN s y ON y.player = p.player AND y.season + 2 = p.season""")
def two_season_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TS.seasons_before(player_weeks(spark, sf_dir), (F.col("touches") > 1).cast("int"), "player", "season", "missed_two").select("player", "season", "week", "missed_two")


@query(f"""WITH {PW} SELECT player, season, week, coalesce(week - last_value(CASE WHEN touches > 1 THEN week END IGNORE NULLS) OVER (PARTITION BY player, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 99) AS since FROM pw""")
def weeks_since_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).select("player", "season", "week", TS.weeks_since(F.col("touches") > 1, KEYS, "week").alias("since"))


@query(f"""WITH {GAMES}, f AS (SELECT season, week, min(kickoff) AS as_of FROM games GROUP BY ALL), {PW}
SELECT player, season, week, as_of FROM pw LEFT JOIN f USING (season, week)""")
def as_of_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = games(spark, sf_dir).groupBy("season", "week").agg(F.min("kickoff").alias("as_of"))
    return player_weeks(spark, sf_dir).join(first, ["season", "week"], "left").select("player", "season", "week", "as_of")


@query("""SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS over_25, round(avg(l_discount), 6) AS mean_discount, min(l_shipdate) AS first_ship,
round(quantile_cont(l_quantity, 0.25), 6) AS q25, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def context_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("over_25"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.min("l_shipdate").alias("first_ship"),
        F.round(F.percentile("l_quantity", F.lit(0.25)), 6).alias("q25"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query("""WITH s AS (SELECT l_suppkey AS team, year(l_shipdate) AS season, month(l_shipdate) AS week, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT team, max_by(v, (season, week)) AS rating FROM s WHERE season < 1997 GROUP BY ALL""")
def frozen_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("team"), F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("v"))
    return R.latest(s.filter("season < 1997"), ["team"], ["season", "week"], ["v"]).withColumnRenamed("v", "rating")


@query(f"""WITH {GAMES}, t AS (SELECT home AS team, season, week, avg(total) AS pace FROM games GROUP BY ALL),
l AS (SELECT *, lag(pace) OVER (PARTITION BY team, season ORDER BY week) AS before FROM t)
SELECT g.game, round(a.before, 6) AS own_pace, round(b.before, 6) AS opponent_pace FROM games g LEFT JOIN l a ON a.team = g.home AND a.season = g.season AND a.week = g.week LEFT JOIN l b ON b.team = g.away AND b.season = g.season AND b.week = g.week""")
def opponent_pace_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    pace = g.groupBy(F.col("home").alias("team"), "season", "week").agg(F.avg("total").alias("pace"))
    before = pace.withColumn("before", F.lag("pace").over(Window.partitionBy("team", "season").orderBy("week"))).drop("pace")
    own = before.select(F.col("team").alias("home"), "season", "week", F.round("before", 6).alias("own_pace"))
    other = before.select(F.col("team").alias("away"), "season", "week", F.round("before", 6).alias("opponent_pace"))
    return g.join(own, ["home", "season", "week"], "left").join(other, ["away", "season", "week"], "left").select("game", "own_pace", "opponent_pace")


@query("""WITH o AS (SELECT o_custkey AS id, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n, coalesce(v, 0.0) AS v, n IS NOT NULL AS active FROM customer LEFT JOIN o ON id = c_custkey""")
def target_and_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").cast("double").alias("v"))
    rows = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return rows.select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0.0)).alias("v"), F.col("n").isNotNull().alias("active"))

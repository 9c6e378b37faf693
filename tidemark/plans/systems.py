"""Queries of documents, identity, models, simulation and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import identity as I
from tidemark.operators import models as M
from tidemark.operators import relational as R
from tidemark.operators import simulation as Z
from tidemark.operators import valuation as V
from tidemark.plans.catalog import Catalog
from tidemark.plans.evaluations import forecasts
from tidemark.plans.frames import GAMES, PW, games, money, player_weeks, plays, table
from tidemark.sources import documents as D
from tidemark.streaming import stateful as S

_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.QUERIES, _catalog.SQL


@query()
def html_table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation items of every page in document order."""
    rows = D.html_rows(table(spark, sf_dir, "pages"), "page_id", row="ul", cell=("li",))
    return rows.select("page_id", "row_number", F.posexplode("cells").alias("place", "item"))


@query("""SELECT event_id, (props::JSON->>'k')::INT AS k, (props::JSON->>'missing') AS missing FROM events""")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int, missing string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


@query("""SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, count(*) AS n FROM events GROUP BY ALL""")
def list_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS keys, list(l_quantity ORDER BY l_linenumber, l_quantity, l_partkey) AS vals FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN list_position(keys, 3) > 0 THEN vals[list_position(keys, 3)] END AS at_3 FROM p""")
def parallel_array_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey")))
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    return p.select("l_orderkey", D.value_at(F.col("items.l_linenumber"), F.col("items.l_quantity"), F.lit(3)).alias("at_3"))


@query()
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds made of the parts of each brand."""
    item = F.concat(F.lit("<item><title> "), F.when(F.col("p_size") > 1, F.col("p_name")).otherwise(""), F.lit("</title><link>http://x/"), F.col("p_partkey").cast("string"), F.lit("</link></item>"))
    feeds = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("xml"))
    return D.feed_entries(feeds)


@query()
def fuzzy_name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size under two spellings of their names, matched one to one."""
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("left_id"), "p_brand", "p_size", F.col("p_name").alias("left_name"))
    right = left.select(F.col("left_id").alias("right_id"), "p_brand", "p_size", F.regexp_replace("left_name", "[aeiou](?=[a-z]$)", "").alias("right_name"))
    found = I.fuzzy_one_to_one(left, right, ["p_brand", "p_size"], "left_id", "right_id", "left_name", "right_name", 80.0)
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("""WITH l AS (SELECT c_custkey AS left_id, c_nationkey AS k, c_mktsegment AS g FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT s_suppkey AS right_id, s_nationkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS g FROM supplier),
a AS (SELECT min(left_id) AS left_id, k, g FROM l GROUP BY k, g HAVING count(*) = 1), b AS (SELECT min(right_id) AS right_id, k, g FROM r GROUP BY k, g HAVING count(*) = 1),
m0 AS (SELECT left_id, right_id, 0 AS level FROM a JOIN b USING (k, g)),
c AS (SELECT min(left_id) AS left_id, k FROM l WHERE left_id NOT IN (SELECT left_id FROM m0) GROUP BY k HAVING count(*) = 1), d AS (SELECT min(right_id) AS right_id, k FROM r WHERE right_id NOT IN (SELECT right_id FROM m0) GROUP BY k HAVING count(*) = 1)
SELECT * FROM m0 UNION ALL SELECT left_id, right_id, 1 FROM c JOIN d USING (k)""")
def exact_then_loose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("left_id"), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("g"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("g"))
    return I.exact_then_loose(left, right, [["k", "g"], ["k"]], "left_id", "right_id")


@query("""SELECT s_suppkey AS left_id, min_by(c_custkey, (abs(s_acctbal - c_acctbal), c_custkey)) AS right_id, round(min(abs(s_acctbal - c_acctbal)), 6) AS gap FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY ALL""")
def nearest_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("left_id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("a"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("right_id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"))
    return I.nearest(left, right, ["k"], "a", "b", "left_id", "right_id").withColumn("gap", F.round("gap", 6))


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS recorded FROM orders), b AS (SELECT o_orderkey AS id, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 0.5 ELSE 0 END AS computed FROM orders WHERE o_orderkey % 7 > 0)
SELECT id, recorded, coalesce(computed, 0.0) AS computed, computed IS NULL AS missing, abs(recorded - coalesce(computed, 0)) > 0.01 AS differs FROM a LEFT JOIN b USING (id)""")
def golden_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("recorded"))
    computed = o.filter("id % 7 > 0").select("id", (F.col("recorded") + F.when(F.col("id") % 10 == 0, 0.5).otherwise(0.0)).alias("computed"))
    return I.compared(o, computed, ["id"], "recorded", "computed")


@query("""WITH g AS (SELECT o_orderkey AS game, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 1 MINUTE * (o_orderkey % 60) AS kickoff FROM orders),
n AS (SELECT min(kickoff) + INTERVAL 30 DAY AS now FROM g), m AS (SELECT game, (epoch_us(kickoff) - epoch_us(now)) / 60000000.0 AS minutes FROM g, n)
SELECT game, round(minutes, 3) AS minutes, CASE WHEN minutes > 300 THEN 900 ELSE 300 END AS checkpoint FROM m WHERE minutes BETWEEN 5 AND 900""")
def due_windows_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select(k.alias("game"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"), mins=(k % 60).cast("int"))).alias("kickoff"))
    now = g.agg((F.min("kickoff") + F.expr("INTERVAL 30 DAYS")).alias("now"))
    found = S.due_windows(g.join(F.broadcast(now)), "kickoff", F.col("now"), 5, 900, 900, 300)  # one row
    return found.select("game", F.round("minutes", 3).alias("minutes"), "checkpoint")


@query("""WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0), e AS (SELECT * FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM s))
SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM e GROUP BY ALL""")
def unseen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return S.unseen(e.filter("event_type = 'signup'"), e.filter("event_id % 50 = 0"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("""WITH a AS (SELECT user_id, ts, value > 180 AS ok FROM events), n AS (SELECT max(ts) + INTERVAL 5 MINUTE AS now FROM events),
g AS (SELECT user_id, max(ts) FILTER (ok) AS done_at, max(ts) FILTER (NOT ok) AS failed_at, count(*) AS attempts FROM a GROUP BY ALL)
SELECT user_id, attempts, CASE WHEN done_at IS NOT NULL THEN 'done' WHEN floor(epoch(now))::BIGINT - floor(epoch(failed_at))::BIGINT < 36000 THEN 'waiting' ELSE 'due' END AS state FROM g, n""")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 180).alias("ok"))
    last = e.agg(F.max("ts")).first()[0]
    return S.retry_state(e, "user_id", "ts", "ok", F.lit(last) + F.expr("INTERVAL 5 MINUTES"), 36_000).select("user_id", "attempts", "state")


@query(f"""WITH {PW}, a AS (SELECT player, sum(points::DECIMAL(18,2))::DOUBLE AS v FROM pw WHERE season = 1997 GROUP BY ALL), b AS (SELECT player, sum(points::DECIMAL(18,2))::DOUBLE AS v FROM pw WHERE season = 1996 GROUP BY ALL)
SELECT player, CASE WHEN coalesce(a.v, 0) >= 300000 AND coalesce(b.v, 0) < 300000 THEN 'above' ELSE 'below' END AS alert FROM a FULL JOIN b USING (player) WHERE (coalesce(a.v, 0) >= 300000) <> (coalesce(b.v, 0) >= 300000)""")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = player_weeks(spark, sf_dir).groupBy("player", "season").agg(money("points").cast("double").alias("v"))
    return S.crossed(totals.filter("season = 1997"), totals.filter("season = 1996"), "player", "v", 300_000.0).select("player", "alert")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = S.windowed_counts(e, "ts", ["event_type"], "1 hour", "1 day")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.session_counts(e, "ts", "user_id", "2 hours", "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def ridge_strength_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of suppliers against return flags per season, recent months weighing more."""
    rows = plays(spark, sf_dir).withColumn("other", F.col("receiver") % 25)
    found = M.ridge_strengths(rows, ["season"], "defteam", "other", "yards", M.recency(F.col("week"), F.lit(12), 8.0))
    return found.select("season", "defteam", F.round("strength", 6).alias("strength"), "n")


@query()
def logistic_over_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of returned lines over what the season before leads to expect, by supplier and season."""
    rows = plays(spark, sf_dir).select("season", "defteam", (F.col("kind") == "R").cast("int").alias("y"), "yards", "discount")
    return M.over_expectation(rows, "season", ["season", "defteam"], "y", ["yards", "discount"], "over")


@query()
def boosted_points_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual model on the last value, fitted before 1999 and applied to 1999."""
    rows = forecasts(spark, sf_dir).filter("last_value is not null and mean_before is not null")
    train, test = rows.filter("season < 1999"), rows.filter("season = 1999")
    fitted = M.fit_regression(train, "points", ["mean_before", "last_value", "week"], ["pos"], trees=5, depth=3, base="mean_before")
    return fitted.predict(test).select("player", "season", "week", "prediction")


@query()
def calibrated_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of more than one order in a month, calibrated on 1998."""
    rows = forecasts(spark, sf_dir).filter("last_value is not null").withColumn("y", F.col("touches") > 1)
    fitted = M.fit_classifier(rows.filter("season < 1999"), "y", ["mean_before", "last_value", "week"], ["pos"], calibrate=F.col("season") == 1998, trees=4)
    return fitted.predict(rows.filter("season = 1999")).select("player", "season", "week", "p")


@query()
def walk_forward_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column baselines over all periods in one pass, with their error by predictor and position."""
    rows = forecasts(spark, sf_dir)
    rolled = M.rolled_column(rows, ["player", "season", "week", "pos"], "points", {"mean": "mean_before", "last": "last_value"})
    return rolled.groupBy("predictor", "pos").agg(*E.error_metrics(F.col("points"), F.col("prediction")))


@query()
def best_blend_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_weight(forecasts(spark, sf_dir).filter("mean_before is not null and last_value is not null"), "pos", "points", "mean_before", "last_value")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).groupBy("player", "pos", "team").agg(F.avg("points").alias("mean"), F.coalesce(F.stddev_samp("points"), F.lit(1.0)).alias("sd"), F.count(F.lit(1)).alias("n"))


@query()
def gaussian_copula_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best customers of each nation as a slate."""
    top = R.top_n(_means(spark, sf_dir), ["team"], [F.desc("mean"), "player"], 12)
    rows = top.select("team", "player", "pos", (F.col("player") % 2).alias("side"), F.transform(F.array(*(F.lit(z) for z in (-1.28, -0.67, 0.0, 0.67, 1.28))), lambda z: F.greatest(F.lit(0.0), F.col("mean") + z * F.col("sd"))).alias("q"))
    rule = lambda a, b, same: (0.3 if a != b else 0.1) if same else -0.05
    return Z.slate_draws(rows, "team", "player", "side", "pos", "q", [0.1, 0.25, 0.5, 0.75, 0.9], rule, n=400)


@query()
def season_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _means(spark, sf_dir).groupBy("team").agg(F.avg("mean").alias("mean"), F.avg("sd").alias("sd"))
    return Z.season_table(teams, "team", "mean", "sd", weeks=11, n=400)


@query()
def chopped_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _means(spark, sf_dir).groupBy("team").agg(F.avg("mean").alias("mean"))
    return Z.survival(teams, "mean", "team", n=2000)


@query()
def rest_of_season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _means(spark, sf_dir).withColumn("p_miss", F.lit(0.05))
    return Z.rest_of_season(rows, "player", "mean", "sd", "p_miss", weeks=6, recovery=0.47, correlation=0.35, n=200)


@query()
def bot_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted draw of one part for each brand."""
    p = table(spark, sf_dir, "part")
    w = Z.pick_weight(F.col("p_size").cast("double"), F.lit(20.0), 6.0, F.when(F.col("p_type") == "SMALL", 1.5).otherwise(1.0))
    return Z.weighted_choice(p, ["p_brand"], w, "p_partkey", seed=3).select("p_brand", "p_partkey")


@query("""SELECT g.week, g.season, min(o) FILTER (kind = 'home') AS first_home, count(*) AS n FROM (SELECT month(o_orderdate) AS week, year(o_orderdate) AS season, o_orderkey AS o, unnest(['home', 'away']) AS kind FROM orders) g GROUP BY ALL""")
def replicated_future_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games(spark, sf_dir).select("week", "season", F.col("game").alias("o"), F.explode(F.array(F.lit("home"), F.lit("away"))).alias("kind"))
    return rows.groupBy("week", "season").agg(F.min(F.when(F.col("kind") == "home", F.col("o"))).alias("first_home"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PW}, w AS (SELECT season, week, count(*) AS n FROM pw GROUP BY ALL) SELECT season, min(week) FILTER (n > 150) AS first_busy, max(week) AS last, round(avg(n), 6) AS mean_n FROM w GROUP BY ALL""")
def current_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = player_weeks(spark, sf_dir).groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("season").agg(F.min(F.when(F.col("n") > 150, F.col("week"))).alias("first_busy"), F.max("week").alias("last"), F.round(F.avg("n"), 6).alias("mean_n"))


@query(f"""WITH {PW}, a AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season DESC, week DESC) AS back FROM pw) SELECT player, points AS last_points, season, week FROM a WHERE back = 1""")
def current_form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(player_weeks(spark, sf_dir), ["player"], ["season", "week"], ["points", "season", "week"]).withColumnRenamed("points", "last_points")


#: Periods of the walk-forward query.
PERIODS = [(1994, 9), (1996, 6), (1998, 3)]


@query(f"""WITH {PW}, p(s, w) AS (VALUES {', '.join(map(str, PERIODS))}),
t AS (SELECT s, w, pos, avg(points) AS mean, regr_slope(points, week) AS slope, regr_intercept(points, week) AS start
  FROM p JOIN pw ON season < s OR season = s AND week < w GROUP BY ALL),
r AS (SELECT pw.*, unnest([struct_pack(predictor := 'mean', prediction := mean), struct_pack(predictor := 'trend', prediction := start + slope * week)]) AS x
  FROM pw JOIN t ON season = s AND week = w AND pw.pos = t.pos)
SELECT x.predictor AS predictor, season, week, pos, count(*) AS n, round(sum(abs(points - x.prediction)), 2) AS error FROM r GROUP BY ALL""")
def walk_forward_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors fitted anew for each period on the strictly earlier rows: a segment's mean and its line through the weeks."""

    def mean(train: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(train.groupBy("pos").agg(F.avg("points").alias("prediction")), "pos")

    def trend(train: DataFrame, rows: DataFrame) -> DataFrame:
        line = train.groupBy("pos").agg(F.regr_slope("points", "week").alias("slope"), F.regr_intercept("points", "week").alias("start"))
        return rows.join(line, "pos").withColumn("prediction", F.col("start") + F.col("slope") * F.col("week"))

    found = M.walk_forward(player_weeks(spark, sf_dir), "season", "week", {"mean": mean, "trend": trend}, PERIODS, ["player", "season", "week", "pos"], "points")
    error = F.round(F.sum(F.abs(F.col("points") - F.col("prediction"))), 2)
    return found.groupBy("predictor", "season", "week", "pos").agg(F.count(F.lit(1)).alias("n"), error.alias("error"))


@query(f"""WITH {GAMES}, s AS (SELECT home AS team, away AS opponent, season, week FROM games UNION ALL SELECT away, home, season, week FROM games)
SELECT team, season, count(*) AS games_left, count(DISTINCT opponent) AS opponents_left, min(week) AS next_week FROM s WHERE week > 6 GROUP BY ALL""")
def future_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = {"season": "season", "week": "week"}
    both = R.sides(games(spark, sf_dir), {"team": "home", "opponent": "away"} | common, {"team": "away", "opponent": "home"} | common)
    return R.future_opponents(both, "team", "opponent", "season", "week", at=6)


@query(f"""WITH {PW}, d AS (SELECT player, pos, season, sum(points) AS to_date, avg(points) AS mean FROM pw WHERE week <= 6 GROUP BY ALL)
SELECT player, pos, season, round(to_date, 2) AS to_date, round(mean * 6, 6) AS rest,
  row_number() OVER (PARTITION BY season, pos ORDER BY to_date + mean * 6 DESC, player) AS place FROM d""")
def season_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to date and the rest of the season at the mean so far, with places by segment."""
    weeks = player_weeks(spark, sf_dir).withColumn("points", F.col("points").cast("decimal(18,2)"))  # sums of amounts, so equal totals tie
    board = V.season_board(weeks, "player", "pos", "season", "week", "points", at=6, last=12)
    return board.select("player", "pos", "season", F.round("to_date", 2).alias("to_date"), F.round("rest", 6).alias("rest"), "place")

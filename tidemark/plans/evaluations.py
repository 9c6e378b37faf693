"""Queries of evaluation, calibration, movement and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import consensus as K
from tidemark.operators import evaluation as E
from tidemark.operators import timeseries as TS
from tidemark.plans.catalog import Catalog
from tidemark.plans.frames import PW, player_weeks, table

_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.QUERIES, _catalog.SQL

#: Forecasts: the player's mean before and the last value; both known before the week.
FORECASTS = f"""{PW}, f AS (SELECT *, avg(points) OVER (PARTITION BY player ORDER BY season * 100 + week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_before,
  lag(points) OVER (PARTITION BY player ORDER BY season * 100 + week) AS last_value FROM pw)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir).withColumn("at", F.col("season") * 100 + F.col("week"))
    w = Window.partitionBy("player").orderBy("at")
    return rows.withColumn("mean_before", TS.expanding_mean("points", ["player"], ["at"])).withColumn("last_value", F.lag("points").over(w)).drop("at")


@query(f"""WITH {FORECASTS}, g AS (SELECT season, coalesce(pos, 'ALL') AS pos, count(mean_before) AS n, avg(abs(mean_before - points)) AS mae, sqrt(avg((mean_before - points) ** 2)) AS rmse, avg(mean_before - points) AS bias
FROM f WHERE mean_before IS NOT NULL GROUP BY GROUPING SETS ((season, pos), (season))) SELECT season, pos, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(bias, 4) AS bias FROM g""")
def accuracy_by_position_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir).filter("mean_before is not null")
    found = E.by_group_and_all(rows, ["season"], "pos", E.error_metrics(F.col("points"), F.col("mean_before")))
    return found.select("season", "pos", "n", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")))


@query(f"""WITH {FORECASTS}, l AS (SELECT season, pos, 'mean' AS source, mean_before AS p, points FROM f UNION ALL SELECT season, pos, 'last', last_value, points FROM f)
SELECT season, pos, source, count(*) AS n, round(avg(abs(p - points)), 4) AS mae FROM l WHERE p IS NOT NULL GROUP BY ALL""")
def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir).select("season", "pos", "points", F.inline(F.array(F.struct(F.lit("mean").alias("source"), F.col("mean_before").alias("p")), F.struct(F.lit("last").alias("source"), F.col("last_value").alias("p")))))
    return rows.filter("p is not null").groupBy("season", "pos", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("points"))), 4).alias("mae"))


@query(f"""WITH {FORECASTS}, r AS (SELECT season, week, rank() OVER (PARTITION BY season, week ORDER BY mean_before) + (count(*) OVER (PARTITION BY season, week, mean_before) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY season, week ORDER BY points) + (count(*) OVER (PARTITION BY season, week, points) - 1) / 2.0 AS y FROM f WHERE mean_before IS NOT NULL)
SELECT season, week, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END, 6) AS spearman, count(*) AS n FROM r GROUP BY ALL""")
def weekly_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spearman(forecasts(spark, sf_dir), ["season", "week"], "mean_before", "points").withColumn("spearman", F.round("spearman", 6))


@query(f"""WITH {FORECASTS}, r AS (SELECT season, pos, row_number() OVER (PARTITION BY season, pos, week ORDER BY points DESC, player) AS a, row_number() OVER (PARTITION BY season, pos, week ORDER BY mean_before DESC, player) AS p, week FROM f WHERE mean_before IS NOT NULL)
SELECT season, pos, week, count(*) FILTER (a <= 5 AND p <= 5) / 5.0 AS precision, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 5""")
def topk_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_k_precision(forecasts(spark, sf_dir).filter("mean_before is not null"), ["season", "pos", "week"], "points", "mean_before", "player", 5)


@query(f"""WITH {FORECASTS} SELECT a.season, a.week, a.team, round(avg(((a.mean_before > b.mean_before) = (a.points > b.points))::INT), 6) AS accuracy, count(*) AS pairs
FROM f a JOIN f b ON a.season = b.season AND a.week = b.week AND a.team = b.team AND a.player < b.player AND a.mean_before <> b.mean_before AND a.points <> b.points GROUP BY ALL""")
def startsit_pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.pair_accuracy(forecasts(spark, sf_dir), ["season", "week", "team"], "player", "points", "mean_before")
    return found.withColumn("accuracy", F.round("accuracy", 6))


_PROBABILITIES = "p AS (SELECT event_id, event_type, least(1.0, greatest(0.0, value / 100)) AS p, event_id % 3 = 0 AS y FROM events)"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value").isNotNull(), p).alias("p"), (F.col("event_id") % 3 == 0).alias("y"))


@query(f"WITH {_PROBABILITIES} SELECT least(floor(p * 10), 9)::INT AS bin, round(avg(p), 6) AS mean_forecast, round(avg(y::INT), 6) AS mean_outcome, count(*) AS n FROM p GROUP BY ALL")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.calibration_bins(_probabilities(spark, sf_dir), "p", F.col("y"))
    return found.select("bin", F.round("mean_forecast", 6).alias("mean_forecast"), F.round("mean_outcome", 6).alias("mean_outcome"), "n")


@query(f"WITH {_PROBABILITIES} SELECT event_type, round(avg((p - y::INT) ** 2), 6) AS brier FROM p GROUP BY ALL")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).groupBy("event_type").agg(F.round(E.brier(F.col("p"), F.col("y")), 6).alias("brier"))


@query(f"""WITH {FORECASTS} SELECT pos, round(avg(CASE WHEN points >= mean_before THEN 0.9 * (points - mean_before) ELSE -0.1 * (points - mean_before) END), 4) AS pinball,
round(avg((points BETWEEN mean_before * 0.5 AND mean_before * 1.5)::INT), 6) AS coverage FROM f WHERE mean_before IS NOT NULL GROUP BY ALL""")
def pinball_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("mean_before")
    return forecasts(spark, sf_dir).filter("mean_before is not null").groupBy("pos").agg(F.round(E.pinball(F.col("points"), p, 0.9), 4).alias("pinball"), F.round(C.share(F.col("points").between(p * 0.5, p * 1.5)), 6).alias("coverage"))


@query(f"""WITH {FORECASTS} SELECT pos, round(quantile_cont(points - mean_before, 0.1), 4) AS q10, round(quantile_cont(points - mean_before, 0.5), 4) AS q50, round(quantile_cont(points - mean_before, 0.9), 4) AS q90 FROM f WHERE mean_before IS NOT NULL GROUP BY ALL""")
def residual_quantile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.error_quantiles(forecasts(spark, sf_dir).filter("mean_before is not null"), "pos", F.col("points") - F.col("mean_before"), [0.1, 0.5, 0.9])
    return found.select("pos", *(F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")))


@query(f"""WITH {FORECASTS}, q AS (SELECT pos, quantile_cont(points - mean_before, 0.1) AS lo, quantile_cont(points - mean_before, 0.9) AS hi FROM f WHERE season < 1998 AND mean_before IS NOT NULL GROUP BY ALL)
SELECT player, season, week, floor(greatest(mean_before + lo, 0) * 1000 + 0.4142) / 1000 AS low, floor(greatest(mean_before + hi, 0) * 1000 + 0.4142) / 1000 AS high FROM f JOIN q USING (pos) WHERE season >= 1998 AND mean_before IS NOT NULL""")
def empirical_interval_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir).filter("mean_before is not null")
    offsets = E.error_quantiles(rows.filter("season < 1998"), "pos", F.col("points") - F.col("mean_before"), [0.1, 0.9])
    met = rows.filter("season >= 1998").join(offsets, "pos")
    return met.select("player", "season", "week", C.on_grid(C.clip(F.col("mean_before") + F.col("q10"), 0.0), 3).alias("low"), C.on_grid(C.clip(F.col("mean_before") + F.col("q90"), 0.0), 3).alias("high"))


@query(f"""WITH {FORECASTS}, w AS (SELECT pos, 1 / greatest(avg(abs(mean_before - points)), 0.25) AS a, 1 / greatest(avg(abs(last_value - points)), 0.25) AS b FROM f WHERE season < 1998 AND mean_before IS NOT NULL AND last_value IS NOT NULL GROUP BY ALL)
SELECT player, season, week, floor(CASE WHEN mean_before IS NOT NULL AND last_value IS NOT NULL AND a IS NOT NULL THEN (mean_before * a + last_value * b) / (a + b) ELSE coalesce(mean_before, last_value, 0) END * 1000 + 0.4142) / 1000 AS blend,
CASE WHEN mean_before IS NOT NULL AND last_value IS NOT NULL AND a IS NOT NULL THEN 'blend' WHEN mean_before IS NOT NULL THEN 'mean' WHEN last_value IS NOT NULL THEN 'last' ELSE 'none' END AS used FROM f LEFT JOIN w USING (pos)""")
def adaptive_blend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir)
    past = rows.filter("season < 1998 and mean_before is not null and last_value is not null")
    inverse = lambda c: 1 / F.greatest(F.avg(F.abs(F.col(c) - F.col("points"))), F.lit(0.25))
    weights = past.groupBy("pos").agg(inverse("mean_before").alias("a"), inverse("last_value").alias("b"))
    value, n = K.blended([F.col("mean_before"), F.col("last_value")], [F.col("a"), F.col("b")])
    used = F.when(n >= 2, "blend").when(F.col("mean_before").isNotNull(), "mean").when(F.col("last_value").isNotNull(), "last").otherwise("none")
    return rows.join(weights, "pos", "left").select("player", "season", "week", C.on_grid(F.coalesce(value, "mean_before", "last_value", F.lit(0.0)), 3).alias("blend"), used.alias("used"))


@query("""WITH g AS (SELECT l_returnflag AS pos, l_suppkey % 4 AS source, avg(abs(l_quantity - 25)) AS mae FROM lineitem GROUP BY ALL),
m AS (SELECT pos, source, CASE WHEN source = 0 THEN mae / 20 ELSE mae END AS mae FROM g),
w AS (SELECT pos, source, (1 / greatest(mae, 0.25)) / sum(1 / greatest(mae, 0.25)) OVER (PARTITION BY pos) AS w FROM m),
t AS (SELECT *, max(w) OVER (PARTITION BY pos) AS top, row_number() OVER (PARTITION BY pos ORDER BY w DESC, source) AS place FROM w)
SELECT pos, source, round(CASE WHEN top <= 0.7 THEN w WHEN place = 1 THEN 0.7 ELSE w * 0.3 / (1 - top) END, 6) AS weight FROM t""")
def inverse_mae_weights_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.avg(F.abs(F.col("l_quantity") - 25))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("pos"), (F.col("l_suppkey") % 4).alias("source")).agg(error.alias("mae"))
    rows = rows.withColumn("mae", F.when(F.col("source") == 0, F.col("mae") / 20).otherwise(F.col("mae")))
    found = K.capped_weights(K.inverse_error_weights(rows, "pos", "mae"), "pos", "source")
    return found.select("pos", "source", F.round("weight", 6).alias("weight"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment AS pos, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, pos, ['F', 'D', 'C', 'B', 'A'][least(floor(CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0.5 END * 5), 4)::INT + 1] AS grade FROM r""")
def matchup_letter_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("pos"), "c_acctbal")
    return E.letter_grades(rows, "pos", "c_acctbal").select("c_custkey", "pos", "grade")


@query()
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of the mean before, with an interval by resampled weeks."""
    rows = forecasts(spark, sf_dir).filter("mean_before is not null").withColumn("at", F.col("season") * 100 + F.col("week"))
    return E.bootstrap_interval(rows, "at", F.abs(F.col("mean_before") - F.col("points")), F.lit(1.0), replicates=1000)


@query(f"""WITH {PW}, x AS (SELECT pos, player, points - avg(points) OVER (PARTITION BY season, week, pos) AS x FROM pw),
e AS (SELECT pos, player, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT pos, count(*)::DOUBLE AS a, sum(n)::DOUBLE AS m, sum(n * n)::DOUBLE AS n2, sum(s) AS s, sum(s * s / n) AS b, sum(q) AS q FROM e GROUP BY pos),
v AS (SELECT pos, a, (m - n2 / m) / (a - 1) AS n0, (b - s * s / m) / (a - 1) AS msb, (q - b) / (m - a) AS msw FROM g WHERE a > 1)
SELECT pos, a::BIGINT AS entities, round(least(1, greatest(0, (msb - msw) / (msb + (n0 - 1) * msw))), 6) AS icc FROM v""")
def icc_within_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.intraclass_correlation(player_weeks(spark, sf_dir), "player", "points", ["season", "week", "pos"], "pos").withColumn("icc", F.round("icc", 6))


@query("""WITH m AS (SELECT user_id, min(struct_pack(ts := ts, event_id := event_id, value := value)).value AS first_value, max(struct_pack(ts := ts, event_id := event_id, value := value)).value AS last_value, count(*) AS snapshots FROM events GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, first_value, last_value, round(last_value - first_value, 6) AS change, CASE WHEN last_value - first_value >= 20 THEN 'up' WHEN last_value - first_value <= -20 THEN 'down' ELSE 'steady' END AS signal, snapshots FROM m""")
def movement_first_last_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.movements(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 20.0).withColumn("change", F.round("change", 6))


@query(f"""WITH {FORECASTS}, h AS (SELECT *, season * 12 + week AS w FROM f WHERE last_value IS NOT NULL),
p AS (SELECT pos, w, sum(points - last_value) AS e, count(*) AS n FROM h GROUP BY ALL),
b AS (SELECT pos, w, CASE WHEN sum(n) OVER r >= 10 AND count(*) OVER r >= 2 THEN greatest(-3000.0, least(3000.0, sum(e) OVER r / sum(n) OVER r)) END AS bias FROM p WINDOW r AS (PARTITION BY pos ORDER BY w RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT player, season, week, floor(bias * 1000 + 0.4142) / 1000 AS bias, floor((last_value + coalesce(bias, 0)) * 1000 + 0.4142) / 1000 AS corrected FROM h LEFT JOIN b USING (pos, w)""")
def bias_replay_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir).filter("last_value is not null").withColumn("w", F.col("season") * 12 + F.col("week"))
    found = E.replayed_bias(rows, "pos", "w", "points", "last_value", most=3000.0)
    return found.select("player", "season", "week", C.on_grid("bias", 3).alias("bias"), C.on_grid("corrected", 3).alias("corrected"))


@query(f"""WITH {PW}, p AS (SELECT team, season * 12 + week AS w, max((touches >= 2)::INT) AS hit FROM pw GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY w DESC) AS back FROM p)
SELECT team, sum(hit)::BIGINT AS hits, count(*) AS weeks FROM r WHERE back <= 6 GROUP BY ALL HAVING sum(hit) >= 3""")
def recurring_patterns_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir).withColumn("w", F.col("season") * 12 + F.col("week"))
    return E.recent_patterns(rows, "team", "w", F.col("touches") >= 2)


@query("""WITH d AS (SELECT event_type, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, avg(value) AS v FROM events GROUP BY ALL),
t AS (SELECT event_type, regr_slope(v, day) AS slope, min_by(v, day) AS first_value, count(*) AS n FROM d GROUP BY ALL)
SELECT event_type, n, round(slope, 8) AS slope, round(first_value, 6) AS first_value, CASE WHEN slope / nullif(first_value, 0) < -0.02 THEN 'declining' WHEN slope / nullif(first_value, 0) IS NOT NULL THEN 'flat' END AS trend FROM t""")
def source_trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.to_date("ts")).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    return E.trend(days, ["event_type"], "day", "v").select("event_type", "n", F.round("slope", 8).alias("slope"), F.round("first_value", 6).alias("first_value"), "trend")


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) AS day, md5(event_type || '|' || (day(ts) % 7)::VARCHAR) AS h FROM events)
SELECT event_type, count(DISTINCT day) AS periods, count(DISTINCT h) AS contents, CASE WHEN count(DISTINCT day) < 2 THEN 'too_few' WHEN count(DISTINCT h) = 1 THEN 'static' WHEN count(DISTINCT h) >= count(DISTINCT day) THEN 'every_period' ELSE 'partial' END AS refresh FROM h GROUP BY ALL""")
def hash_change_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    content = F.md5(F.concat("event_type", F.lit("|"), (F.dayofmonth("ts") % 7).cast("string")).cast("binary"))
    return E.refresh_class(rows, "event_type", "day", content)


@query(f"""WITH {FORECASTS}, g AS (SELECT a.w / 10.0 AS w FROM range(0, 11) a(w)),
r AS (SELECT g.w, season, week, g.w * mean_before + (1 - g.w) * last_value AS p, points FROM f CROSS JOIN g WHERE mean_before IS NOT NULL AND last_value IS NOT NULL)
SELECT w, round(avg(abs(p - points)), 4) AS mae, count(*) AS n FROM r GROUP BY w""")
def blend_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.array(*(F.lit(k / 10) for k in range(11)))).alias("w")
    rows = forecasts(spark, sf_dir).filter("mean_before is not null and last_value is not null").select("points", "mean_before", "last_value", grid)
    p = F.col("w") * F.col("mean_before") + (1 - F.col("w")) * F.col("last_value")
    return rows.groupBy("w").agg(F.round(F.avg(F.abs(p - F.col("points"))), 4).alias("mae"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PW}, t AS (SELECT season, week, dense_rank() OVER (ORDER BY season DESC, week DESC) AS back, pos, touches FROM pw)
SELECT CASE WHEN back <= 4 THEN 'calibration' ELSE 'fit' END AS part, count(*) AS n, round(avg((touches > 1)::INT), 6) AS rate FROM t GROUP BY ALL""")
def calibration_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir)
    weeks = rows.select("season", "week").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("season"), F.desc("week"))))
    met = rows.join(F.broadcast(weeks), ["season", "week"])  # one row for each week there is
    return met.groupBy(F.when(F.col("back") <= 4, "calibration").otherwise("fit").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(C.share(F.col("touches") > 1), 6).alias("rate"))


@query(f"""WITH {FORECASTS}, s AS (SELECT pos, count(*) AS n, avg(abs(mean_before - points)) AS mae, avg(mean_before - points) AS bias, sqrt(avg((mean_before - points) ** 2)) AS rmse, avg((abs(mean_before - points) <= 50000)::INT) AS within, avg(abs(last_value - points)) - avg(abs(mean_before - points)) AS gain,
count(*) FILTER (abs(mean_before - points) < abs(last_value - points)) AS helped, count(*) FILTER (abs(mean_before - points) > abs(last_value - points)) AS hurt FROM f WHERE mean_before IS NOT NULL AND last_value IS NOT NULL GROUP BY ALL)
SELECT pos, n, round(mae, 4) AS mae, round(bias, 4) AS bias, round(rmse, 4) AS rmse, round(within, 6) AS within, round(gain, 4) AS gain, helped, hurt FROM s""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir).filter("mean_before is not null and last_value is not null")
    a, b = F.abs(F.col("mean_before") - F.col("points")), F.abs(F.col("last_value") - F.col("points"))
    n, mae, rmse, bias = E.error_metrics(F.col("points"), F.col("mean_before"))
    found = rows.groupBy("pos").agg(n, mae, rmse, bias, F.round(C.share(a <= 50_000), 6).alias("within"), (F.avg(b) - F.avg(a)).alias("gain"), F.count_if(a < b).alias("helped"), F.count_if(a > b).alias("hurt"))
    return found.withColumns({c: F.round(c, 4) for c in ("mae", "bias", "rmse", "gain")})

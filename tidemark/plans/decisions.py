"""Queries of scoring, consensus, valuation and adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import scoring as S
from tidemark.operators import adjustments as A
from tidemark.operators import consensus as K
from tidemark.operators import relational as R
from tidemark.operators import valuation as V
from tidemark.plans.catalog import Catalog
from tidemark.plans.frames import GAMES, PLAYS, PW, games, money, plays, player_weeks, table

_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.QUERIES, _catalog.SQL

RULES: S.Rules = {
    "yards": S.Direct("yards"),
    "big_gain": S.at_least("gain", 50_000.0),
    "return": S.only(lambda df: F.col("kind") == "R", "yards"),
    "touch": S.Derived(lambda df: F.lit(1.0)),
    "unused": S.Direct("nothing"),
}


@query(f"""WITH {PLAYS} SELECT defteam, season, round(sum(yards * 0.5 + CASE WHEN gain >= 50000 THEN 6 ELSE 0 END + CASE WHEN kind = 'R' THEN yards ELSE 0 END * -0.25 + 2), 2) AS points FROM plays GROUP BY ALL""")
def linear_scoring_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plays(spark, sf_dir)
    points = S.score(p, {"yards": 0.5, "big_gain": 6.0, "return": -0.25, "touch": 2.0, "unused": 0.0}, RULES)
    return p.groupBy("defteam", "season").agg(F.round(F.sum(points), 2).alias("points"))


@query("""SELECT o_orderkey, (CASE WHEN o_totalprice BETWEEN 0 AND 50000 THEN 5.0 WHEN o_totalprice BETWEEN 50000.01 AND 150000 THEN 2.0 ELSE 0.0 END + CASE WHEN o_totalprice >= 300000 THEN 3.0 ELSE 0.0 END)::DOUBLE AS bonus FROM orders""")
def bucket_and_threshold_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"low": S.between("o_totalprice", 0, 50_000), "mid": S.between("o_totalprice", 50_000.01, 150_000), "high": S.at_least("o_totalprice", 300_000)}
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.score(o, {"low": 5, "mid": 2, "high": 3}, rules).alias("bonus"))


@query("""WITH s AS (SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, ';' ORDER BY l_linenumber, l_partkey, l_quantity) AS listed FROM lineitem GROUP BY ALL)
SELECT l_orderkey, list_sum(list_transform(string_split(listed, ';'), lambda x: x::DOUBLE)) AS total, len(list_filter(string_split(listed, ';'), lambda x: x::DOUBLE BETWEEN 20 AND 39)) AS twenties FROM s""")
def delimited_list_parse_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(";", F.collect_list(F.col("l_quantity").cast("int").cast("string"))).alias("listed"))
    return lines.select("l_orderkey", C.listed_sum("listed").alias("total"), C.listed_count("listed", 20, 39).alias("twenties"))


_SOURCES = "src AS (SELECT l_partkey % 500 AS item, l_suppkey % 10 AS source, sum(l_quantity)::DOUBLE AS points FROM lineitem GROUP BY ALL)"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("item"), (F.col("l_suppkey") % 10).alias("source")).agg(F.sum("l_quantity").alias("points"))


@query(f"""WITH {_SOURCES}, g AS (SELECT item, list_sort(list(points)) AS v, stddev_pop(points) AS sd, count(*) AS n FROM src GROUP BY ALL),
c AS (SELECT *, floor(n * 0.2)::INT AS k FROM g)
SELECT item, round(list_avg(v[k + 1 : n - k]), 6) AS consensus, round(sd, 6) AS dispersion, n AS n_sources, n / 10.0 AS coverage FROM c""")
def trimmed_mean_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.trimmed_consensus(_sources(spark, sf_dir), ["item"], "points", 10)
    return found.select("item", F.round("consensus", 6).alias("consensus"), F.round("dispersion", 6).alias("dispersion"), "n_sources", "coverage")


@query(f"""WITH {_SOURCES}, r AS (SELECT *, item % 5 AS pos, row_number() OVER (PARTITION BY source, item % 5 ORDER BY points DESC, item) AS rank FROM src),
c AS (SELECT pos, rank, median(points) AS points FROM r GROUP BY ALL),
m AS (SELECT item, pos, avg(rank) AS mean_rank FROM r GROUP BY ALL)
SELECT item, m.pos, c.points FROM m LEFT JOIN c ON c.pos = m.pos AND c.rank = CASE WHEN mean_rank - floor(mean_rank) = 0.5 AND floor(mean_rank)::BIGINT % 2 = 0 THEN floor(mean_rank) ELSE floor(mean_rank + 0.5) END""")
def reference_curve_rank_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir).withColumn("pos", F.col("item") % 5)
    curve = K.reference_curve(src, "pos", "source", "points", "item")
    ranks = K.ranked(src, ["source", "pos"], "points", "item").groupBy("item", "pos").agg(F.avg("rank").alias("mean_rank"))
    return K.ranks_to_points(ranks, curve, "pos", "mean_rank", "points").select("item", "pos", "points")


@query(f"""WITH {_SOURCES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY points DESC, item) AS rank FROM src)
SELECT item, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, round(stddev_pop(rank), 6) AS sd_rank, max(rank) FILTER (source = 0) AS rank_0, max(rank) FILTER (source = 1) AS rank_1, max(rank) FILTER (source = 2) AS rank_2 FROM r GROUP BY ALL""")
def source_rank_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.rank_summary(K.ranked(_sources(spark, sf_dir), ["source"], "points", "item"), ["item"], "source", [0, 1, 2], "rank")
    return found.withColumns({"mean_rank": F.round("mean_rank", 6), "sd_rank": F.round("sd_rank", 6)})


@query(f"""WITH {_SOURCES}, m AS (SELECT source, median(points) AS median FROM src GROUP BY ALL),
o AS (SELECT a.source, any_value(a.median) AS median, list_sort(list(b.median)) AS others FROM m a LEFT JOIN m b ON a.source <> b.source GROUP BY ALL)
SELECT source, median, others[len(others) // 2 + 1] AS others, coalesce(median < 0.35 * others[len(others) // 2 + 1], false) AS off_scale FROM o""")
def off_scale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.off_scale_sources(_sources(spark, sf_dir), "source", "points")


_TOTALS = f"WITH {PW}, tot AS (SELECT player, any_value(pos) AS pos, sum(points::DECIMAL(18,2))::DOUBLE AS points FROM pw GROUP BY player)"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_weeks(spark, sf_dir).groupBy("player", "pos").agg(money("points").cast("double").alias("points"))


@query(_TOTALS + """, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY points DESC, player) AS rank, count(*) OVER (PARTITION BY pos) AS n FROM tot),
l AS (SELECT pos, points AS replacement FROM r WHERE rank = least(n, 24))
SELECT player, pos, points, replacement, round(points - replacement, 2) AS vor FROM tot JOIN l USING (pos)""")
def replacement_level_vor(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _totals(spark, sf_dir)
    levels = V.replacement_level(totals, "pos", "points", "player", dict.fromkeys(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), 24))
    return V.value_over_replacement(totals, levels, "pos", "points").select("player", "pos", "points", "replacement", F.round("vor", 2).alias("vor"))


@query()
def replacement_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starters by dedicated and flex slots, then value over replacement."""
    totals = _totals(spark, sf_dir)
    starters = {"AUTOMOBILE": 12, "BUILDING": 24, "FURNITURE": 24, "HOUSEHOLD": 12, "MACHINERY": 12}
    ranks = V.startable(totals, "pos", "points", "player", starters, ["BUILDING", "FURNITURE", "HOUSEHOLD"], 12)
    return V.value_over_replacement(totals, V.replacement_level(totals, "pos", "points", "player", ranks), "pos", "points")


@query(_TOTALS + """, g AS (SELECT *, row_number() OVER w AS rank, lag(points) OVER w - points AS gap FROM tot WINDOW w AS (PARTITION BY pos ORDER BY points DESC, player)),
m AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY pos ORDER BY points DESC, player ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS local FROM g),
t AS (SELECT *, coalesce((gap > 1.4 * local AND gap > 0)::INT, 0) AS opens FROM m)
SELECT player, pos, rank, least(1 + sum(opens) OVER (PARTITION BY pos ORDER BY points DESC, player ROWS UNBOUNDED PRECEDING), 12)::INT AS tier FROM t""")
def gap_tiers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gap_tiers(_totals(spark, sf_dir), "pos", "points", "player").select("player", "pos", "rank", "tier")


@query()
def tiers_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalised_tiers(_totals(spark, sf_dir), "pos", "points", "player").select("player", "pos", "rank", "tier")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_retailprice AS vor, 1 - (p_size - 1) / 50.0 AS p FROM part),
g AS (SELECT *, coalesce(product(1 - p) OVER (PARTITION BY p_brand ORDER BY vor DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS gone FROM p)
SELECT p_brand, round(sum(vor * p * gone), 6) AS expected_best FROM g GROUP BY ALL""")
def opportunity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("vor"), (1 - (F.col("p_size") - 1) / F.lit(50.0)).alias("p"))
    return V.expected_best(p, "p_brand", "vor", "p_partkey", "p").select("p_brand", F.round("expected_best", 6).alias("expected_best"))


@query()
def survival_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a part is still there at two picks."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 2, F.col("p_size").cast("double")).alias("mean"), (F.col("p_partkey") % 5).cast("double").alias("sd"))
    return p.select("p_partkey", V.survival(20, F.col("mean"), F.col("sd"), 6.0).alias("at_20"), V.survival(40, F.col("mean"), F.col("sd"), 6.0).alias("at_40"))


@query(f"""WITH {PW}, t AS (SELECT season, player, sum(points::DECIMAL(18,2)) AS total FROM pw GROUP BY ALL),
d AS (SELECT season, player, row_number() OVER (PARTITION BY season ORDER BY total DESC, player) AS rank FROM t),
a AS (SELECT pw.*, row_number() OVER (PARTITION BY pw.season, week ORDER BY points DESC, pw.player) AS place FROM pw JOIN d ON d.season = pw.season AND d.player = pw.player WHERE rank > 100)
SELECT season, round(sum(points), 2) AS points, count(*) AS periods FROM a WHERE place = 5 GROUP BY season""")
def streaming_replacement_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir).withColumn("points", F.col("points").cast("decimal(18,2)"))
    return V.nth_available(rows, "season", "week", "player", "points", 100, 5).select("season", F.round(F.col("points").cast("double"), 2).alias("points"), "periods")


@query(f"""WITH {PLAYS}, t AS (SELECT season, quantile_cont(n, 0.25) AS enough FROM (SELECT defteam, season, week, count(*) AS n FROM plays GROUP BY ALL) GROUP BY season),
w AS (SELECT defteam, season, week, sum(yards) AS v, count(*) AS n FROM plays GROUP BY ALL)
SELECT defteam, w.season, sum(v) AS strength, count(DISTINCT week) AS weeks, avg((n >= enough)::INT) >= 0.5 AS confident FROM w JOIN t ON t.season = w.season GROUP BY ALL""")
def sos_sum_distinct_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = plays(spark, sf_dir).groupBy("defteam", "season", "week").agg(F.sum("yards").alias("v"), F.count(F.lit(1)).alias("n"))
    enough = weeks.groupBy("season").agg(F.percentile("n", F.lit(0.25)).alias("enough"))
    rows = weeks.join(enough, "season")
    return rows.groupBy("defteam", "season").agg(F.sum("v").alias("strength"), F.count_distinct("week").alias("weeks"), (C.share(F.col("n") >= F.col("enough")) >= 0.5).alias("confident"))


@query(f"""WITH {PLAYS} SELECT defteam, season, """ + ", ".join(f"max(v) FILTER (week = {k}) AS w{k}" for k in range(1, 13)) + """ FROM (SELECT defteam, season, week, sum(yards) AS v FROM plays GROUP BY ALL) GROUP BY ALL""")
def schedule_grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = plays(spark, sf_dir).groupBy("defteam", "season", "week").agg(F.sum("yards").alias("v"))
    return R.completed_pivot(weeks, ["defteam", "season"], "week", list(range(1, 13)), F.col("v"), "w")


@query(f"""WITH {PLAYS}, r AS (SELECT receiver, count(*) AS n, avg(yards) AS x FROM plays WHERE kind = 'R' GROUP BY ALL), m AS (SELECT avg(yards) AS prior FROM plays WHERE kind = 'R')
SELECT receiver, n, round((n * x + 8 * prior) / (n + 8), 6) AS shrunk FROM r CROSS JOIN m""")
def shrinkage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plays(spark, sf_dir).filter("kind = 'R'")
    prior = p.agg(F.avg("yards").alias("prior"))
    rows = p.groupBy("receiver").agg(F.count(F.lit(1)).alias("n"), F.avg("yards").alias("x")).join(F.broadcast(prior))  # one row
    return rows.select("receiver", "n", F.round(A.shrunk(F.col("x"), F.col("n"), F.col("prior"), 8.0), 6).alias("shrunk"))


@query("""WITH m AS (SELECT l_orderkey AS game, l_returnflag AS kind, 1 + l_discount AS mult FROM lineitem)
SELECT game, round(coalesce(product(mult) FILTER (kind <> 'R'), 1) * coalesce(least(product(mult) FILTER (kind = 'R'), 1.1), 1), 6) AS multiplier, count(*) AS adjustments FROM m GROUP BY game""")
def multiplier_product_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("kind"), (1 + F.col("l_discount")).alias("mult"))
    return A.combined_multipliers(m, ["game"], "mult", "kind", "R", 1.1).select("game", F.round("mult", 6).alias("multiplier"), "adjustments")


@query("""WITH old AS (SELECT year(o_orderdate) AS season, month(o_orderdate) AS week, o_custkey AS player, o_totalprice AS points FROM orders WHERE o_orderkey % 3 > 0),
new AS (SELECT year(o_orderdate) AS season, month(o_orderdate) AS week, o_custkey AS player, o_totalprice AS points, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 = 0 AND month(o_orderdate) <= 2)
SELECT season, week, player, points, status FROM new UNION ALL BY NAME SELECT * FROM old WHERE (season, week) NOT IN (SELECT (season, week) FROM new)""")
def upsert_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_custkey").alias("player"), F.col("o_totalprice").alias("points"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("is_new"))
    old = rows.filter("not is_new").drop("status", "is_new")
    return R.upsert(old, rows.filter("is_new and week <= 2").drop("is_new"), ["season", "week"])


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'unit' FROM supplier")
def schema_union_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("unit").alias("kind"))
    return R.schema_union(c, s)


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-06-01'")
def snapshot_visible_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("1997-06-01").cast("timestamp_ntz")
    rows = [R.assert_no_leakage(R.visible(table(spark, sf_dir, n), c, as_of), c, as_of).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return rows[0].unionByName(rows[1])


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY ALL)
SELECT c_custkey, CASE WHEN n >= 8 THEN 'projected' WHEN c_nationkey IN (3, 4) THEN 'unknown' WHEN c_acctbal < 0 THEN 'injured' WHEN n IS NULL THEN 'inactive' ELSE 'missing' END AS coverage FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def coverage_case_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    kind = A.coverage_class(F.coalesce(F.col("n") >= 8, F.lit(False)), F.col("n").isNotNull(), F.col("c_acctbal") < 0, ~F.col("c_nationkey").isin(3, 4))
    return rows.select("c_custkey", kind.alias("coverage"))


@query("SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(replace(p_name, '-', ' '), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) || '|' || p_brand AS join_key FROM part")
def name_normalise_join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(C.name_key("p_name"), F.lit("|"), F.col("p_brand")).alias("join_key"))


@query("""WITH o AS (SELECT o_custkey AS bidder, o_totalprice AS bid FROM orders)
SELECT bidder, count(*) AS n, round(avg(bid), 6) AS mean, median(bid) AS median, quantile_disc(bid, 0.75) AS p75, max(bid) AS top, round(avg((bid < 100000)::INT), 6) AS low_rate,
round(least(1.75, greatest(0.5, (count(*) * (avg(bid) / 150000) + 5 * 1.0) / (count(*) + 5))), 6) AS multiplier FROM o GROUP BY ALL""")
def bid_profile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bidder"), F.col("o_totalprice").alias("bid"))
    p75 = F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY bid)")
    rows = o.groupBy("bidder").agg(F.count(F.lit(1)).alias("n"), F.avg("bid").alias("m"), F.median("bid").alias("median"), p75.alias("p75"), F.max("bid").alias("top"), F.round(C.share(F.col("bid") < 100_000), 6).alias("low_rate"))
    return rows.select("bidder", "n", F.round("m", 6).alias("mean"), "median", "p75", "top", "low_rate", F.round(C.clip(A.shrunk(F.col("m") / 150_000, F.col("n"), F.lit(1.0), 5.0), 0.5, 1.75), 6).alias("multiplier"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS v, sum(p_retailprice) OVER (PARTITION BY p_brand) AS total, (p_size * 4)::DOUBLE AS budget FROM part),
w AS (SELECT *, least(greatest(coalesce(v / nullif(total, 0) * budget, 0), 1), budget) AS b FROM p)
SELECT p_partkey, (CASE WHEN b - floor(b) = 0.5 AND floor(b)::BIGINT % 2 = 0 THEN floor(b) ELSE floor(b + 0.5) END)::BIGINT AS bid FROM w""")
def suggested_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("total", F.sum("p_retailprice").over(Window.partitionBy("p_brand")))
    return p.select("p_partkey", V.bid(F.col("p_retailprice"), F.col("total"), F.col("p_size") * 4).alias("bid"))


@query("""SELECT event_id, CASE WHEN v < 0 THEN NULL WHEN v <= 0 THEN 0.0 WHEN v < 25 THEN v * 0.04 WHEN v < 50 THEN 1 + (v - 25) * 0.08 WHEN v < 100 THEN 3 + (v - 50) * 0.02 ELSE 4.0 END AS price FROM (SELECT event_id, CASE WHEN value >= 0 THEN value END AS v FROM events)""")
def market_price_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") >= 0, F.col("value")))
    return e.select("event_id", C.interpolate("v", [(0, 0), (25, 1), (50, 3), (100, 4)]).alias("price"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '2-4 weeks' WHEN 1 THEN '3 weeks' WHEN 2 THEN 'about 10 days' WHEN 3 THEN 'out for season' WHEN 4 THEN 'day-to-day' ELSE 'unclear' END AS said,
CASE o_orderkey % 4 WHEN 0 THEN 'out' WHEN 1 THEN 'doubtful' WHEN 2 THEN 'questionable' ELSE 'none' END AS status, o_orderkey % 5 AS k FROM orders),
d AS (SELECT *, CASE said WHEN '2-4 weeks' THEN 3.0 WHEN '3 weeks' THEN 3.0 WHEN 'about 10 days' THEN 2.0 WHEN 'out for season' THEN 18.0 WHEN 'day-to-day' THEN 0.5 END AS weeks FROM s)
SELECT o_orderkey, weeks::DOUBLE AS weeks, (CASE WHEN k < floor(weeks) THEN 0.0 WHEN k < weeks THEN 0.5 WHEN status = 'out' THEN coalesce([0.0, 0.35, 0.65, 0.85][k + 1], 1.0) WHEN status = 'doubtful' THEN coalesce([0.25, 0.7, 0.9][k + 1], 1.0) WHEN status = 'questionable' THEN coalesce([0.85, 0.95][k + 1], 1.0) ELSE 1.0 END)::DOUBLE AS available FROM d""")
def injury_duration_and_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = C.lookup(k % 6, {0: "2-4 weeks", 1: "3 weeks", 2: "about 10 days", 3: "out for season", 4: "day-to-day"}, "unclear")
    status = C.lookup(k % 4, {0: "out", 1: "doubtful", 2: "questionable"}, "none")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", A.duration_weeks(said).alias("weeks"), status.alias("status"), (k % 5).alias("k"))
    return rows.select("o_orderkey", "weeks", A.availability(F.col("status"), F.col("weeks"), F.col("k")).alias("available"))


@query(f"""WITH {PW}, b AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season * 100 + week DESC) AS back FROM pw),
m AS (SELECT player, avg(points) FILTER (back <= 2) AS np, avg(points) FILTER (back > 2) AS fp, avg(touches) FILTER (back <= 2) AS nt, avg(touches) FILTER (back > 2) AS ft FROM b WHERE back <= 8 GROUP BY ALL),
r AS (SELECT player, (np - fp) / nullif(fp, 0) AS a, (nt - ft) / nullif(ft, 0) AS b FROM m),
c AS (SELECT player, coalesce((a > 0.1)::INT, 0) + coalesce((b > 0.1)::INT, 0) AS up, coalesce((a < -0.1)::INT, 0) + coalesce((b < -0.1)::INT, 0) AS down, (coalesce(a, 0) + coalesce(b, 0)) / 2 AS mean FROM r)
SELECT player, up, down, round(1 + least(0.15, greatest(-0.15, mean)), 6) AS multiplier FROM c WHERE (up >= 2 AND down = 0) OR (down >= 2 AND up = 0)""")
def role_change_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir).withColumn("at", F.col("season") * 100 + F.col("week"))
    return A.role_change(rows, "player", "at", ["points", "touches"]).withColumn("multiplier", F.round("multiplier", 6))


@query(f"""WITH {PW}, s AS (SELECT season, week, avg(points) AS v FROM pw GROUP BY ALL), z AS (SELECT season, avg(v) AS m, stddev_pop(v) AS sd FROM s GROUP BY ALL),
w AS (SELECT s.season, week, CASE WHEN sd > 0 THEN 1 + coalesce(least(0.3, greatest(-0.3, 0.15 * (v - m) / sd)), 0) ELSE 1 END AS w FROM s JOIN z USING (season)),
t AS (SELECT player, season, sum(points::DECIMAL(18,2))::DOUBLE AS total FROM pw GROUP BY ALL)
SELECT player, t.season, week, round(total * w / nullif(sum(w) OVER (PARTITION BY player, t.season), 0), 4) AS allocated FROM t JOIN w ON w.season = t.season""")
def allocated_season_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_weeks(spark, sf_dir)
    weeks = rows.groupBy("season", "week").agg(F.avg("points").alias("v"))
    spread = weeks.groupBy("season").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    weighted = weeks.join(spread, "season").select("season", "week", A.matchup_weight(F.col("v"), F.col("m"), F.col("sd")).alias("w"))
    totals = rows.groupBy("player", "season").agg(money("points").cast("double").alias("total"))
    met = A.allocated(totals.join(weighted, "season"), ["player", "season"], F.col("total"), F.col("w"))
    return met.select("player", "season", "week", F.round("allocated", 4).alias("allocated"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice / 400 AS gain, p_size / 50.0 AS act, p_size AS lo, p_size + p_partkey % 40 AS hi FROM part),
s AS (SELECT *, 0.45 * greatest(0, least(1, gain / 5)) + 0.35 * greatest(0, least(1, act)) + 0.2 * greatest(0, least(1, 1 - (hi - lo) / 35.0)) AS score FROM p)
SELECT p_partkey, round(score, 10) AS score, CASE WHEN score >= 0.72 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM s""")
def recommendation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    score, kind = A.confidence(F.col("p_retailprice") / 400, size / 50.0, size, size + F.col("p_partkey") % 40)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 10).alias("score"), kind.alias("confidence"))


@query(f"""WITH {GAMES} SELECT game, (greatest(0, 14 - week + 1) - greatest(0, 14 - greatest(week, 11) + 1) + greatest(0, 14 - greatest(week, 11) + 1) * 2.0)::DOUBLE AS weeks FROM games""")
def playoff_season_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).select("game", A.season_weeks(F.col("week"), F.lit(14), 11, 2.0).alias("weeks"))


@query("""SELECT c_custkey, round((CASE c_mktsegment WHEN 'AUTOMOBILE' THEN greatest(0.5, 0.92 - 0.02 * greatest(0, age - 28)) WHEN 'BUILDING' THEN greatest(0.5, 0.88 - 0.03 * greatest(0, age - 26)) END)::DOUBLE, 6) AS rate FROM (SELECT *, 20.0 + c_custkey % 30 AS age FROM customer)""")
def base_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = A.base_availability(F.col("c_mktsegment"), 20.0 + F.col("c_custkey") % 30, {"AUTOMOBILE": (0.92, 28.0, 0.02), "BUILDING": (0.88, 26.0, 0.03)})
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(rate, 6).alias("rate"))


@query()
def optimal_lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best line-up of each nation by order totals."""
    totals = player_weeks(spark, sf_dir).groupBy("player", "pos", "team").agg(money("points").cast("double").alias("points"))
    slots = [["AUTOMOBILE"], ["BUILDING"], ["BUILDING"], ["FURNITURE"], ["FURNITURE"], ["HOUSEHOLD"], ["BUILDING", "FURNITURE", "HOUSEHOLD"], ["MACHINERY"]]
    return V.optimal_lineups(totals, "team", "player", "pos", "points", slots)


@query("""SELECT o_custkey AS player, o_orderkey AS pick, substr(sha256(concat_ws(chr(31), '=' || o_custkey::VARCHAR, '=' || o_orderkey::VARCHAR, coalesce('=' || nullif(o_orderpriority, '5-LOW'), '-'))), 1, 12) AS id FROM orders""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("pick"), C.content_id("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))).alias("id"))


@query("""WITH d AS (SELECT (o_orderkey % 12) + 1 AS round, o_custkey % 10 + 1 AS slot, count(*) AS n FROM orders GROUP BY ALL)
SELECT round, slot, n, ((round - 1) * 10 + CASE WHEN round % 2 = 1 THEN slot ELSE 11 - slot END)::BIGINT AS pick FROM d""")
def snake_pick_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 12 + 1).alias("round"), (F.col("o_custkey") % 10 + 1).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("pick", (F.col("round") - 1) * 10 + F.when(F.col("round") % 2 == 1, F.col("slot")).otherwise(11 - F.col("slot")))


@query("""WITH t AS (SELECT p_brand AS brand, p_size AS size, p_partkey, p_retailprice AS v FROM part WHERE p_size > 10),
h AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size = 50)
SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.brand = t.brand)""")
def available_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_partkey", F.col("p_retailprice").alias("v"))
    return p.filter("size > 10").join(p.filter("size = 50").select("brand").distinct(), "brand", "left_anti")


@query("""WITH d AS (SELECT o_orderkey, (1 + o_orderkey % 59)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS clock, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE (1 + o_orderkey % 59)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') END AS said FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN ((1 + o_orderkey % 59) * 60 + o_orderkey % 60)::INT END AS seconds FROM d""")
def minutes_seconds_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.concat((1 + k % 59).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.minutes_seconds(F.when(k % 7 == 0, "x").otherwise(clock)).alias("seconds"))

"""Base frames over the provided tables, and the same as SQL for the oracle.

Customers play the entities, segments their groups, nations their teams; an order's year is its season and its month the
period. Line items are plays, suppliers defences, orders games between a customer's nation and one drawn from the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    """Exact sums of amounts, independent of their order."""
    return F.sum(F.col(column).cast("decimal(18,2)"))


def player_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, season, week, pos, team, points (order value), touches (orders)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), "o_totalprice")
    weeks = orders.groupBy("player", "season", "week").agg(money("o_totalprice").cast("double").alias("points"), F.count(F.lit(1)).alias("touches"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("pos"), F.col("c_nationkey").alias("team"))
    return weeks.join(people, "player")


PW = """pw AS (
  SELECT o_custkey AS player, year(o_orderdate) AS season, month(o_orderdate) AS week, any_value(c_mktsegment) AS pos, any_value(c_nationkey) AS team,
    sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS points, count(*) AS touches
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, season, week, kickoff, home, away, line (a signed spread) and total."""
    orders = table(spark, sf_dir, "orders")
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home"))
    return orders.join(homes, "o_custkey").select(
        F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_orderdate").alias("kickoff"), "home",
        F.pmod("o_orderkey", F.lit(25)).cast("int").alias("away"), (F.pmod("o_orderkey", F.lit(29)) - 14).cast("double").alias("line"), F.col("o_totalprice").alias("total"),
    )


GAMES = """games AS (
  SELECT o_orderkey AS game, year(o_orderdate) AS season, month(o_orderdate) AS week, o_orderdate AS kickoff, c_nationkey AS home,
    (o_orderkey % 25)::INT AS away, (o_orderkey % 29 - 14)::DOUBLE AS line, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, play, defteam, receiver, kind, status, yards, gain, week, season of every line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("play"), F.col("l_suppkey").alias("defteam"), F.col("l_partkey").alias("receiver"),
        F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("yards"), F.col("l_extendedprice").alias("gain"),
        F.col("l_discount").alias("discount"), F.month("l_shipdate").alias("week"), F.year("l_shipdate").alias("season"),
    )


PLAYS = """plays AS (
  SELECT l_orderkey AS game, l_linenumber AS play, l_suppkey AS defteam, l_partkey AS receiver, l_returnflag AS kind, l_linestatus AS status,
    l_quantity AS yards, l_extendedprice AS gain, l_discount AS discount, month(l_shipdate) AS week, year(l_shipdate) AS season
  FROM lineitem)"""

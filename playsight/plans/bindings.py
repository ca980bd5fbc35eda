"""How the operators' roles are bound to the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratio_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as ratio events: n revenue, d quantity, week the month of shipping."""
    week = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", week.alias("week"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("n"), F.col("l_quantity").alias("d"))


EV = "ev AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS week, l_extendedprice * (1 - l_discount) AS n, l_quantity AS d FROM lineitem)"


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day: n the value, d the number."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("n"), F.count(F.lit(1)).cast("double").alias("d"))


UD = "ud AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS n, CAST(count(*) AS DOUBLE) AS d FROM events GROUP BY ALL)"


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games with a pure margin, a market margin where there is one, and an outcome."""
    x = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        x.alias("game"), F.col("o_custkey").alias("home"),
        (F.pmod(x, F.lit(29)) - 14.0).alias("pure"), F.when(F.pmod(x, F.lit(3)) != 0, F.pmod(x, F.lit(27)) - 13.0).alias("market"),
        (F.pmod(x * 7, F.lit(41)) - 20.0).alias("actual"), F.year("o_orderdate").alias("season"), F.quarter("o_orderdate").alias("quarter"),
        (38.0 + F.pmod(x, F.lit(15))).alias("total"), (41.5 + 0.5 * F.pmod(x, F.lit(9))).alias("line"),
    )


PR = """pr AS (SELECT o_orderkey AS game, o_custkey AS home, CAST(o_orderkey % 29 AS DOUBLE) - 14 AS pure,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 27 AS DOUBLE) - 13 END AS market,
  CAST((o_orderkey * 7) % 41 AS DOUBLE) - 20 AS actual, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  38.0::DOUBLE + o_orderkey % 15 AS total, 41.5::DOUBLE + 0.5::DOUBLE * (o_orderkey % 9) AS line FROM orders)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers quoting parts: book the supplier, game the part; one quote each, the price derived from revenue a unit."""
    per = ratio_events(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("week").alias("week"))
    k = F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 17, F.lit(400))
    price = F.when(k < 200, -100.0 - k).otherwise(k - 100.0)
    return per.select(
        F.col("l_partkey").alias("game"), F.col("l_suppkey").alias("book"), F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "home").otherwise("away").alias("side"),
        price.alias("price"), (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(13)) - 6.5).alias("point"), "week",
    )


OF = """of AS (SELECT game, book, side, CASE WHEN k < 200 THEN -100.0::DOUBLE - k ELSE k - 100.0::DOUBLE END AS price, point, week FROM (
  SELECT l_partkey AS game, l_suppkey AS book, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
    (l_partkey * 31 + l_suppkey * 17) % 400 AS k, CAST((l_partkey + l_suppkey) % 13 AS DOUBLE) - 6.5 AS point, max(week) AS week
  FROM ev GROUP BY l_partkey, l_suppkey))"""

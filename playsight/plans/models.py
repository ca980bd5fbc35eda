"""Queries of the fitted models: lineitems stand for plays, orders for games and candidates.

The fits are iterative, so they have no SQL; tests hold them against dense solves in NumPy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playsight.operators import choice, context, decisions, ratings, scoring, solvers
from playsight.plans.bindings import table
from playsight.plans.traits import plays

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays(spark, sf_dir).where("kind = 'pass'").withColumn("week", F.col("week") - 12 * F.col("season"))


def passer_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _passes(spark, sf_dir).groupBy("season", "week", "passer", "team", "opponent")
    return per.agg(F.count(F.lit(1)).cast("double").alias("dropbacks"), F.sum("epa").alias("epa"), F.sum(F.expr("case when sack = 1 or hit = 1 then 1.0d else 0.0d end")).alias("hit_sacks"))


@query("M8_passer_context")
def passer_context(spark, sf_dir):
    out = context.passer_context(passer_games(spark, sf_dir), 1998, 6)[0]
    return out.select("passer", *[F.round(c, 5).alias(c) for c in ("strength", "effective_dropbacks", "hit_sack_rate", "support", "opponents")])


@query("M9_lineup_effects")
def lineup_effects(spark, sf_dir):
    mates = F.array(F.col("receiver"), F.col("team") * 100 + 50 + F.col("down") % 3)
    rows = _passes(spark, sf_dir).select((F.col("season") * 12 + F.col("week")).alias("week"), "passer", F.col("opponent").alias("defense"), F.array_distinct(mates).alias("teammates"), "epa")
    return context.lineup_effects(rows, 1997 * 12 + 6, 50.0, 100.0).select("passer", F.round("effect", 6).alias("effect"))


def scored_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games of eight teams."""
    x = F.col("o_orderkey")
    home, away = F.pmod("o_custkey", F.lit(8)), F.pmod(F.col("o_custkey") + 1 + F.pmod(x, F.lit(7)), F.lit(8))
    measure = lambda k, m, a, b: (F.pmod(x * k, F.lit(m)) / F.lit(float(a)) + b)
    return table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").cast("long").alias("week"), x.cast("string").alias("game"), home.cast("string").alias("home"), away.cast("string").alias("away"), (F.pmod(x, F.lit(9)) == 0).alias("neutral"),
        measure(7, 31, 10, 0.5).alias("home_ppd"), measure(11, 29, 10, 0.5).alias("away_ppd"), measure(13, 37, 30, -0.6).alias("home_epa"), measure(17, 41, 30, -0.7).alias("away_epa"), measure(5, 7, 1, 8.0).alias("drives"), measure(7, 31, 1, 3.0).alias("home_points"), measure(11, 29, 1, 3.0).alias("away_points"),
    )


@query("M2_joint_scoring")
def joint_scoring(spark, sf_dir):
    games = scored_games(spark, sf_dir)
    f = scoring.fits(games, games.select("season", F.lit(9).cast("long").alias("cut")).distinct())
    each = f.select("season", "cut", "base_ppd", "base_drives", "home_field", "epa_slope", F.explode(F.arrays_zip("teams", "offense", "defense", "pace")).alias("t"))
    return each.select("season", "cut", F.col("t.teams").alias("team"), *[F.round(F.col(f"t.{c}"), 6).alias(c) for c in ("offense", "defense", "pace")], *[F.round(c, 6).alias(c) for c in ("base_ppd", "base_drives", "home_field", "epa_slope")])


@query("M3_score_projections")
def score_projections(spark, sf_dir):
    games = scored_games(spark, sf_dir)
    f = scoring.fits(games, games.select("season", F.lit(9).cast("long").alias("cut")).distinct())
    out = scoring.projections(f, games.select("season", "week", "game", "home", "away", "neutral"))
    return out.select("season", "week", "game", *[F.round(c, 6).alias(c) for c in ("expected_home", "expected_away", "home_points_of_field", "margin_sd", "total_sd", "correlation")])


@query("M10_bounded_ridge")
def bounded_ridge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), (F.pmod("o_custkey", F.lit(7)) - 3.0).alias("a"), (F.pmod("o_orderkey", F.lit(11)) - 5.0).alias("b"), (F.substring("o_orderpriority", 1, 1).cast("double") - 3).alias("c"), (F.col("o_totalprice") / 1e5).alias("y"))
    weights, penalty = solvers.bounded_ridge(o, "season", ["a", "b", "c"], "y", [0.0, 0.0, float("-inf")])
    return spark.createDataFrame([(k, round(v, 6), penalty) for k, v in weights.items()], "trait string, weight double, penalty double")


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as candidates of a year; who ordered for most wins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("season")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("games"))
    rows = o.join(c, "o_custkey")
    best = rows.groupBy("season", "c_nationkey").agg(F.max("total").alias("most"))
    won = (F.col("total") == F.col("most")).cast("double")
    return rows.join(best, ["season", "c_nationkey"]).select("season", F.col("c_nationkey").cast("string").alias("race"), F.col("o_custkey").alias("who"), won.alias("won"), F.col("games").cast("double").alias("games"), (F.col("c_acctbal") / 1000).alias("account"), F.pmod("o_custkey", F.lit(5)).cast("double").alias("noise"))


@query("M16_choice_evaluation")
def choice_evaluation(spark, sf_dir):
    inf = float("inf")
    out = choice.evaluated(races(spark, sf_dir), "season", "race", "who", "won", ["games", "account", "noise"], [0.0, -inf, 0.0], [inf, inf, inf])
    return out.select("season", "race", "candidates", "winner_in_pool", "winner_hit", "top_three_hit", *[F.round(c, 6).alias(c) for c in ("winner_probability", "leader_probability", "log_loss", "brier", "uniform_log_loss")], "split")


@query("M5_unit_ratings")
def unit_ratings(spark, sf_dir):
    x = F.col("o_orderkey")
    part = lambda k, m, a: (F.pmod(x * k, F.lit(m)) - float(a)).cast("double")
    games = scored_games(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("game")), "game")
    games = games.select("season", "week", F.col("home").alias("team"), F.col("away").alias("opponent"), part(7, 31, 15).alias("rush_epa"), part(11, 29, 14).alias("pass_epa"), part(13, 17, 8).alias("st_epa"), F.when(x % 4 != 0, F.pmod(x, F.lit(9)).cast("double")).alias("pressures"),
                         F.pmod(x * 3, F.lit(40)).cast("double").alias("dropbacks"), F.when(x % 5 != 0, 2.0 + F.pmod(x, F.lit(13)) / 10.0).alias("time_to_throw"), part(5, 11, 5).alias("protection_epa"), part(3, 97, -40).alias("line_yards"), F.pmod(x * 7, F.lit(35)).cast("double").alias("carries"))
    out = ratings.unit_ratings(games, games.select("season", F.lit(9).cast("long").alias("cut")).distinct())
    return out.select("season", "cut", "team", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("M6_market_ratings")
def market_ratings(spark, sf_dir):
    games = scored_games(spark, sf_dir)
    lined = games.select(F.lit("league").alias("league"), "season", "week", "home", "away", "neutral", F.when(F.col("game").cast("long") % 6 != 0, F.pmod(F.col("game").cast("long") * 5, F.lit(29)) / 2.0 - 7.0).alias("spread"))
    cuts = games.select(F.lit("league").alias("league"), "season").distinct().withColumn("cut", F.explode(F.array(F.lit(1).cast("long"), F.lit(9).cast("long"))))
    return ratings.market_ratings(lined, cuts).select("chain", "season", "cut", "team", F.round("rating", 6).alias("rating"), "games")


@query("L1_decisions")
def priced_decisions(spark, sf_dir):
    """Parts as games, five groups of suppliers as books that quote both sides."""
    import datetime as dt

    now = dt.datetime(2024, 9, 8, 12)
    at = lambda minutes: (F.lit(now) - F.make_interval(mins=minutes)).cast("timestamp")
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 5).alias("l_suppkey")).distinct()
    k = F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 17, F.lit(60))
    market = F.element_at(F.array(F.lit("h2h"), F.lit("spreads"), F.lit("totals")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = pairs.withColumn("market", market).withColumn("side", F.explode(F.when(F.col("market") == "totals", F.array(F.lit("over"), F.lit("under"))).otherwise(F.array(F.lit("home"), F.lit("away")))))
    first = F.col("side").isin("home", "over")
    point = F.when(F.col("market") == "totals", 40.0 + F.pmod("l_partkey", F.lit(11)) / 2.0).when(F.col("market") == "spreads", F.when(first, 1.0).otherwise(-1.0) * (F.pmod("l_partkey", F.lit(27)) / 2.0 - 6.5))
    offers = rows.select(
        F.col("l_partkey").cast("string").alias("game"), "market", "side", point.alias("point"), F.when(first, -100.0 - k).otherwise(F.when(k < 20, -120.0 + k).otherwise(80.0 + k)).alias("price"), F.col("l_suppkey").cast("string").alias("book"), at((F.col("l_partkey") % 70).cast("int")).alias("updated"),
        at(F.lit(0)).alias("fetched"), F.lit("e").alias("event"), F.lit("api").alias("source"), F.lit(dt.datetime(2024, 9, 8, 17)).alias("offer_start"), ((F.col("l_partkey") + F.col("l_suppkey")) % 7 != 0).alias("verified"), F.lit(1.0).alias("match"),
    )
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("game"), F.lit(dt.datetime(2024, 9, 8, 17)).alias("start"), at(F.lit(180)).alias("as_of"), F.lit(3.0).alias("home_margin"), F.lit(4.0).alias("pure_margin"), F.lit(44.0).alias("model_total"), F.lit(13.0).alias("margin_sd"), F.lit(13.0).alias("total_sd"), F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0).alias("home_missing"), F.lit(0).alias("away_missing"), F.lit(None).cast("string").alias("input_reason"))
    out = decisions.decisions(p, offers, now)
    return out.select("game", "market", "side", "point", "price", "book", *[F.round(c, 6).alias(c) for c in ("priced_mean", "win", "push", "edge", "edge_points", "ev")], "reason", "status", "stake")

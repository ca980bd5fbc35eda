"""Offers, slates and settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.market import profit


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that fails, NULL if none does."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for name, failed in rules])


def balance(market: Column, selection: Column, margin: Column, total: Column, point: Column) -> Column:
    """Signed distance by which a selection wins: home and over count up, away and under down."""
    sign = F.when(selection.isin("home", "over"), 1.0).otherwise(-1.0)
    return F.when(market == "h2h", sign * margin).when(market == "spreads", sign * margin + point).when(market == "totals", sign * (total - point))


def settled(market: Column, won_by: Column, played: Column, moved: Column) -> Column:
    """win, loss, push, void (moved, or a tied moneyline) or no_play."""
    return (
        F.when(~played, F.lit("no_play"))
        .when(moved, F.lit("void"))
        .when((market == "h2h") & (won_by == 0), F.lit("void"))
        .when(won_by > 0, F.lit("win"))
        .when(won_by < 0, F.lit("loss"))
        .otherwise(F.lit("push"))
    )


def settled_profit(result: Column, price: Column) -> Column:
    return F.when(result == "win", profit(price)).when(result == "loss", F.lit(-1.0)).otherwise(F.lit(0.0))


def best_offer(offers: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return offers.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def fill_slate(offers: DataFrame, game: str, ev: str, tie: list[str], size: int = 5) -> DataFrame:
    """Every offer with ev > 0 is a pick; if fewer than `size` games are picked, the best others, one a game, lean.

    Columns of offers plus `kind` (pick or lean).
    """
    picks = offers.where(F.col(ev) > 0).withColumn("kind", F.lit("pick"))
    taken = picks.select(game).distinct()
    per_game = best_offer(offers.where(F.col(ev) <= 0).join(taken, game, "left_anti"), [game], [F.desc(ev), *[F.col(t) for t in tie]])
    # at most `size` rows are ranked over all games, after a distributed top-k
    top = per_game.orderBy(F.desc(ev), *tie).limit(size)
    room = taken.agg(F.greatest(F.lit(0), F.lit(size) - F.count(F.lit(1))).alias("_room"))
    ranked = top.withColumn("_rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(ev), *tie)))
    leans = ranked.crossJoin(F.broadcast(room)).where("_rn <= _room").drop("_rn", "_room").withColumn("kind", F.lit("lean"))
    return picks.unionByName(leans)


def lower_middle(values: Column) -> Column:
    """A median that was actually quoted: the lower of two middle values of an array."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int"))

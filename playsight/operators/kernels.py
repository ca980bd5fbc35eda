"""Model kernels: ratings, choice probabilities and fair values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playsight.operators.context import two_sided


def two_sided_ridge(games: DataFrame, offense: str, defense: str, value: str, weight: str, penalty: float) -> DataFrame:
    """Ratings of both sides: value = base + off[offense] - def[defense], ridge around 0, weighted; by conjugate gradients, for any number of sides."""
    out = two_sided(games, offense, defense, value, weight, penalty)
    return out.withColumn("side", F.col("side").cast(games.schema[offense].dataType))


def softmax(df: DataFrame, keys: list[str], score: str, out: str = "p") -> DataFrame:
    """Choice probabilities within keys."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def fair_values(worth: str, cash: str, guaranteed: str, discount: float) -> F.Column:
    """Worth of a contract to its club from arrays by season, by backward induction.

    owed = guaranteed + g * owed; value = max(worth - cash + g * value, -owed); g = 1 / (1 + discount).
    """
    g = 1.0 / (1.0 + discount)
    rows = F.reverse(F.arrays_zip(F.col(worth), F.col(cash), F.col(guaranteed)))
    start = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("owed"))

    def step(state, x):
        owed = x[guaranteed] + g * state["owed"]
        return F.struct(F.greatest(x[worth] - x[cash] + g * state["value"], -owed).alias("value"), owed.alias("owed"))

    return F.aggregate(rows, start, step)["value"]

"""The (numerator, denominator) contract: events, leave-one-out, with/without, decayed rates, shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import safe_div


def leave_one_out(events: DataFrame, context: list[str], least: float = 5.0) -> DataFrame:
    """Adds n_rel = n - d * (rate of the others in the context); NULL where the others' d is under `least`."""
    w = W.partitionBy(*context)
    other_n, other_d = F.sum("n").over(w) - F.col("n"), F.sum("d").over(w) - F.col("d")
    return events.withColumn("n_rel", F.when(other_d >= least, F.col("n") - F.col("d") * safe_div(other_n, other_d)))


def with_without(rows: DataFrame, keys: list[str], value: str, present: str, shrink: float = 6.0, least_present: int = 3) -> DataFrame:
    """(mean absent - mean present) * pa / (pa + shrink); needs enough games of both kinds."""
    p, a = F.count(F.when(F.col(present), 1)), F.count(F.when(~F.col(present), 1))
    both = rows.groupBy(*keys).agg(p.alias("p"), a.alias("a"), F.avg(F.when(F.col(present), F.col(value))).alias("mp"), F.avg(F.when(~F.col(present), F.col(value))).alias("ma"))
    pa = F.col("p") * F.col("a")
    effect = F.when((F.col("p") >= least_present) & (F.col("a") > 0), (F.col("ma") - F.col("mp")) * pa / (pa + shrink))
    return both.select(*keys, F.col("p").alias("n_present"), F.col("a").alias("n_absent"), effect.alias("effect"))


def with_without_totals(present: DataFrame, games: DataFrame, keys: list[str], value: str, shrink: float = 6.0, least_present: int = 3) -> DataFrame:
    """The same from the rows present alone: absences are all games less those present, so no grid of keys and games is built."""
    own = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"), F.sum(value).alias("sp"))
    whole = games.agg(F.count(F.lit(1)).alias("t"), F.sum(value).alias("st"))  # one row
    both = own.crossJoin(F.broadcast(whole)).withColumn("a", F.col("t") - F.col("p"))
    pa = F.col("p") * F.col("a")
    gap = safe_div(F.col("st") - F.col("sp"), F.col("a").cast("double")) - safe_div("sp", F.col("p").cast("double"))
    effect = F.when((F.col("p") >= least_present) & (F.col("a") > 0), gap * pa / (pa + shrink))
    return both.select(*keys, F.col("p").alias("n_present"), F.col("a").alias("n_absent"), effect.alias("effect"))


def decayed_rate(events: DataFrame, keys: list[str], week: str, half_life: float) -> DataFrame:
    """Rate with weights 0.5 ** (weeks before the last / half_life)."""
    last = events.agg(F.max(week).alias("_last"))
    rows = events.crossJoin(F.broadcast(last)).withColumn("_w", F.pow(F.lit(0.5), (F.col("_last") - F.col(week)) / half_life))
    return rows.groupBy(*keys).agg(safe_div(F.sum(F.col("n") * F.col("_w")), F.sum(F.col("d") * F.col("_w"))).alias("rate"))


def shrunk(value: Column, n: Column, mean: Column, k: Column | float) -> Column:
    """(value * n + mean * k) / (n + k)."""
    return safe_div(value * n + mean * k, n + k)


def shrinkage_constant(reliability: Column, n: Column) -> Column:
    """k = n (1 - r) / r with r at least 0.01."""
    r = F.greatest(reliability, F.lit(0.01))
    return n * (1 - r) / r


def dispatch(events: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """One pass over (keys, trait, week, n, d): each trait aggregated by its rule, a row feeding only its own.

    rate and share: sum n / sum d; quantile20: 20th percentile of n / d with at least 4 rows; latest: n of the last week.
    """
    kind = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("trait")]
    ratio = F.when(kind == "quantile20", safe_div("n", "d"))
    agg = events.groupBy(*keys, "trait").agg(
        safe_div(F.sum("n"), F.sum("d")).alias("_rate"),
        F.when(F.count(ratio) >= 4, F.percentile(ratio, 0.2)).alias("_q"),
        F.max_by(F.when(kind == "latest", F.col("n")), "week").alias("_latest"),
        F.count_distinct("week").alias("games"),
    )
    value = F.when(kind == "quantile20", F.col("_q")).when(kind == "latest", F.col("_latest")).otherwise(F.col("_rate"))
    return agg.select(*keys, "trait", "games", value.alias("value"))

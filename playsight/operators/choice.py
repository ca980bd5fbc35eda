"""Conditional logit: which candidate of a race is chosen, fitted season by season on the races before."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from playsight.operators.solvers import bounded_quadratic, cut

# Seasons that a fit needs, and what publishing asks of the validation.
LEAST_SEASONS, LEAST_VALIDATED, LARGEST_GAP, DEVELOPMENT_THROUGH = 4, 8, 0.10, 2019
ROUNDS, TOLERANCE = 100, 1e-10
#: Rows of narrow tables, one a race, up to which they are broadcast: a race may hold a large part of all candidates.
BROADCAST_RACES = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RACES else df


def _windows(spark, frames: dict[int, np.ndarray], features: list[str], scale: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(cut, mean, scale, beta): one row a season that is forecast."""
    rows = [(int(c), *(x.tolist() for x in scale[c]), b.tolist()) for c, b in frames.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField("cut", T.LongType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mean", "scale", "beta")]]))


def fit_windows(rows: DataFrame, season: str, race: str, winner: str, features: list[str], lower: list[float], upper: list[float], cuts: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """cut -> (mean, scale, coefficients) of the logit with penalty |beta|^2 / 2 and bounds, on the races of seasons before the cut that have a winner.

    Candidates are prepared once.  All cuts are fitted together: a Newton round is one aggregation over candidates (by cut and race, then by
    cut) that brings one row a cut, the gradient and the curvature, to the driver.  A race's winners
    share its weight.  Raises where a fit has fewer than LEAST_SEASONS seasons or an input isn't finite.
    """
    spark, d = rows.sparkSession, len(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    base = cut(rows.select(F.col(season).cast("long").alias("s"), F.col(race).alias("race"), F.col(winner).cast("double").alias("won"), x.alias("x")))
    if base.where(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).limit(1).count():
        raise ValueError("award inputs are finite")
    won = cut(base.groupBy("s", "race").agg(F.sum("won").alias("all")).where(F.col("all") > 0))
    races_ = won.count()
    base = cut(base.join(_small(won, races_), ["s", "race"]).select("s", "race", (F.col("won") / F.col("all")).alias("t"), *[F.col("x")[j].alias(f"x{j}") for j in range(d)]))
    every = spark.createDataFrame([(int(c),) for c in cuts], "cut long")  # as many as seasons are forecast
    rows = base.join(F.broadcast(every), F.col("s") < F.col("cut"))
    moments = rows.groupBy("cut").agg(F.count_distinct("s").alias("seasons"), *[F.avg(f"x{j}").alias(f"m{j}") for j in range(d)], *[F.stddev_pop(f"x{j}").alias(f"s{j}") for j in range(d)]).collect()
    if len(moments) < len(set(cuts)) or any(m["seasons"] < LEAST_SEASONS for m in moments):
        raise ValueError(f"at least {LEAST_SEASONS} earlier seasons with a winner are required")
    scale = {}
    for m in moments:
        sd = np.array([m[f"s{j}"] for j in range(d)])
        scale[m["cut"]] = np.array([m[f"m{j}"] for j in range(d)]), np.where(sd < 1e-8, 1.0, sd)
    low, high = np.array(lower, float), np.array(upper, float)
    beta, best = {c: np.clip(np.zeros(d), low, high) for c in scale}, {c: (np.inf, None, None) for c in scale}
    open_ = set(scale)
    for _ in range(ROUNDS):
        table = _windows(spark, {c: beta[c] for c in open_}, features, scale)
        z = [((F.col(f"x{j}") - F.col("mean")[j]) / F.col("scale")[j]).alias(f"z{j}") for j in range(d)]
        scored = rows.join(F.broadcast(table), "cut").select("cut", "s", "race", "t", "beta", *z)
        scored = scored.select("cut", "s", "race", "t", *[f"z{j}" for j in range(d)], sum((F.col(f"z{j}") * F.col("beta")[j] for j in range(d)), F.lit(0.0)).alias("v"))
        top = scored.groupBy("cut", "s", "race").agg(F.max("v").alias("top"))
        e = F.exp(F.col("v") - F.col("top"))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        races = scored.join(_small(top, races_ * len(open_)), ["cut", "s", "race"]).groupBy("cut", "s", "race", "top").agg(
            F.sum(e).alias("e"), F.sum(F.col("t") * F.col("v")).alias("tv"), *[F.sum(F.col("t") * F.col(f"z{j}")).alias(f"t{j}") for j in range(d)],
            *[F.sum(e * F.col(f"z{j}")).alias(f"a{j}") for j in range(d)], *[F.sum(e * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        )
        mean = lambda j: F.col(f"a{j}") / F.col("e")
        found = races.groupBy("cut").agg(F.sum(F.log("e") + F.col("top") - F.col("tv")).alias("loss"), *[F.sum(mean(j) - F.col(f"t{j}")).alias(f"g{j}") for j in range(d)], *[F.sum(F.col(f"h{i}_{j}") / F.col("e") - mean(i) * mean(j)).alias(f"h{i}_{j}") for i, j in pairs]).collect()
        for r in found:
            c = r["cut"]
            loss = r["loss"] + 0.5 * beta[c] @ beta[c]
            if loss > best[c][0] + 1e-12 * abs(best[c][0]):  # too far: half the way back
                beta[c] = 0.5 * (beta[c] + best[c][1])
                continue
            g = np.array([r[f"g{j}"] for j in range(d)]) + beta[c]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + np.eye(d)
            step = bounded_quadratic(h, -g, low - beta[c], high - beta[c])
            best[c] = (loss, beta[c], h)
            beta[c] = np.clip(beta[c] + step, low, high)
            if np.abs(step).max(initial=0.0) <= TOLERANCE * (1 + np.abs(beta[c]).max(initial=0.0)):
                open_.discard(c)
        if not open_:
            return {c: (*scale[c], beta[c]) for c in scale}
    raise ValueError("the choice model did not settle")


def chosen(rows: DataFrame, fits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], season: str, race: str, features: list[str]) -> DataFrame:
    """rows of the seasons that have a fit, with `probability` within their race."""
    table = _windows(rows.sparkSession, {c: f[2] for c, f in fits.items()}, features, {c: f[:2] for c, f in fits.items()})
    parts = [(F.col(f).cast("double") - F.col("mean")[j]) / F.col("scale")[j] * F.col("beta")[j] for j, f in enumerate(features)]
    scored = rows.join(F.broadcast(table), F.col(season) == F.col("cut")).withColumn("_v", sum(parts[1:], parts[0]))
    per = cut(scored.groupBy(F.col(season).alias("_s"), F.col(race).alias("_r")).agg(F.max("_v").alias("_top")))
    races = per.count()
    scored = scored.join(_small(per, races), (F.col(season) == F.col("_s")) & (F.col(race) == F.col("_r"))).withColumn("_e", F.exp(F.col("_v") - F.col("_top")))
    total = scored.groupBy("_s", "_r").agg(F.sum("_e").alias("_all"))
    return scored.join(_small(total, races), ["_s", "_r"]).select(*rows.columns, (F.col("_e") / F.col("_all")).alias("probability"))


def evaluated(rows: DataFrame, season: str, race: str, candidate: str, winner: str, features: list[str], lower: list[float], upper: list[float]) -> DataFrame:
    """A row per race of each season with LEAST_SEASONS earlier ones that have winners: the forecast by a model of those alone, and how it did.

    A race whose winner is no candidate is a full miss.
    """
    rows = cut(rows.select(*dict.fromkeys([season, race, candidate, winner, *features])))
    known = [r[0] for r in rows.groupBy(season).agg(F.max(winner).alias("w")).where("w > 0").select(season).orderBy(season).collect()]
    cuts = [r[0] for r in rows.select(season).distinct().orderBy(season).collect() if sum(k < r[0] for k in known) >= LEAST_SEASONS]
    p = cut(chosen(rows, fit_windows(rows, season, race, winner, features, lower, upper, cuts), season, race, features))
    best = F.max(F.struct("probability", -F.xxhash64(candidate), F.col(winner).cast("double").alias("won")))
    # Spark keeps the first three of each race in each task before it shuffles them
    order = W.partitionBy(season, race).orderBy(F.desc("probability"), F.desc("won"))
    first = p.select(season, race, "probability", F.col(winner).cast("double").alias("won")).withColumn("_at", F.row_number().over(order)).where("_at <= 3")
    three = first.groupBy(F.col(season).alias("_s"), F.col(race).alias("_r")).agg(F.collect_list(F.struct("probability", "won")).alias("_three"))
    per = p.groupBy(season, race).agg(F.count(F.lit(1)).alias("candidates"), F.sum(winner).alias("winners"), F.sum(F.when(F.col(winner) > 0, F.col("probability")).otherwise(0.0)).alias("winner_probability"), best.alias("_b"), F.sum(F.col("probability") * F.col("probability")).alias("_pp"))
    per = per.join(three, F.col(season).eqNullSafe(F.col("_s")) & F.col(race).eqNullSafe(F.col("_r")))
    inside = F.col("winners") > 0
    brier = F.col("_pp") - 2 * F.col("winner_probability") / F.greatest(F.col("winners"), F.lit(1)) + F.when(inside, 1.0 / F.col("winners")).otherwise(1.0)
    return per.select(
        season, race, "candidates", inside.alias("winner_in_pool"), (F.col("_b.won") > 0).alias("winner_hit"), F.exists("_three", lambda t: t["won"] > 0).alias("top_three_hit"), "winner_probability", F.col("_b.probability").alias("leader_probability"),
        (-F.log(F.greatest("winner_probability", F.lit(1e-15)))).alias("log_loss"), brier.alias("brier"), F.when(inside, F.log("candidates")).otherwise(-F.log(F.lit(1e-15))).alias("uniform_log_loss"), F.when(F.col(season) <= DEVELOPMENT_THROUGH, "development").otherwise("retrospective_validation").alias("split"),
    )


def publishable(history: DataFrame) -> DataFrame:
    """One row: status, seasons, publishable, hit rates, losses and the leader's gap, over the validation's races."""
    v = history.where("split = 'retrospective_validation'")
    per = v.agg(
        F.count(F.lit(1)).alias("seasons"), F.min("winner_in_pool").alias("pool"), F.avg("log_loss").alias("log_loss"), F.avg("uniform_log_loss").alias("uniform"), F.avg("brier").alias("brier"), F.avg(F.col("winner_hit").cast("int")).alias("winner_hit_rate"),
        F.avg(F.col("top_three_hit").cast("int")).alias("top_three_rate"), F.abs(F.avg("leader_probability") - F.avg(F.col("winner_hit").cast("int"))).alias("gap"),
    )
    good = F.coalesce((F.col("seasons") >= LEAST_VALIDATED) & F.col("pool") & (F.col("log_loss") < F.col("uniform")) & (F.col("gap") <= LARGEST_GAP), F.lit(False))
    status = F.when(F.col("seasons") == 0, "insufficient_validation").when(good, "validated").otherwise("experimental")
    return per.select(status.alias("status"), "seasons", good.alias("publishable"), "winner_hit_rate", "top_three_rate", "log_loss", "brier", "gap")

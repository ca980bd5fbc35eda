"""Statistics: reliability, rank correlation, least squares, error metrics, calibration, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import guarded_corr, safe_div
from playsight.operators.windows import average_rank


def split_half(games: DataFrame, keys: list[str], unit: str, order: list[str], least: int = 30) -> DataFrame:
    """Reliability of n / d per key group: games of a unit alternate into halves of n // 2 each.

    Pearson r between the halves over units, stepped up by 2r / (1 + r); NULL under `least` units.
    """
    w = W.partitionBy(*keys, unit).orderBy(*order)
    rows = games.withColumn("_i", F.row_number().over(w) - 1).withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(*keys, unit)))
    rows = rows.where(F.floor(F.col("_i") / 2) < F.floor(F.col("_c") / 2))
    half = lambda k: safe_div(F.sum(F.when(F.col("_i") % 2 == k, F.col("n"))), F.sum(F.when(F.col("_i") % 2 == k, F.col("d"))))
    units = rows.groupBy(*keys, unit).agg(half(0).alias("x"), half(1).alias("y")).where("x is not null and y is not null")
    r = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), guarded_corr("x", "y").alias("_r"))
    return r.select(*keys, "units", F.when(F.col("units") >= least, safe_div(2 * F.col("_r"), 1 + F.col("_r"))).alias("reliability"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation within keys over complete pairs: Pearson r of average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, average_rank(x, keys).alias("_x"), average_rank(y, keys).alias("_y"))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), guarded_corr("_x", "_y").alias("_r"))
    return out.select(*keys, "pairs", F.when(F.col("pairs") >= least, F.col("_r")).alias("rho"))


def ols(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope of y on x, and its standard error."""
    agg = df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    rest = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"))
    return agg.select(*keys, "n", "slope", F.when(F.col("n") > 2, F.sqrt(safe_div(safe_div(rest, F.col("n") - 2.0), F.col("_sxx")))).alias("se"))


def through_origin(df: DataFrame, keys: list[str], y: str, x: str, fallback: float, least: int) -> DataFrame:
    """Slope of a line through the origin; the fallback under `least` pairs."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_div(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("_s"))
    return agg.select(*keys, "n", F.when(F.col("n") >= least, F.col("_s")).otherwise(F.lit(fallback)).alias("slope"))


def error_metrics(prediction: Column, actual: Column) -> list[Column]:
    e = prediction - actual
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")]


def probability_scores(p: Column, y: Column, clip: float = 1e-12) -> list[Column]:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return [F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss")]


def calibration(df: DataFrame, p: str, y: str, cluster: str, bins: int = 10) -> DataFrame:
    """Rows per probability bin; the tolerance counts distinct clusters, not rows."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    agg = df.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(cluster).alias("clusters"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    tolerance = F.greatest(F.lit(0.02), 1.96 * F.sqrt(safe_div(F.col("predicted") * (1 - F.col("predicted")), F.col("clusters"))))
    return agg.withColumn("tolerance", tolerance).withColumn("ok", F.abs(F.col("predicted") - F.col("observed")) <= F.col("tolerance"))


def poisson_weights(clusters: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) counts (clusters x draws) from a hash of cluster, draw and seed: the same wherever a cluster lands."""
    x = clusters.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(draws, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))
    return np.searchsorted(steps, u.ravel(), "right").reshape(u.shape).astype(np.float64)


def paired_bootstrap(df: DataFrame, cluster: str, a: str, b: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Interval of mean(a - b) under resampling of whole clusters.

    Rows collapse to one sum a cluster.  Each draw weighs each cluster by a Poisson(1) count, which needs
    no gathering: partitions add up their weighted sums for all draws, and the sums are added per draw.
    """
    sums = df.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count(F.lit(1)).cast("double").alias("c")).select(F.xxhash64(cluster).alias("h"), "s", "c")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, c = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                w = poisson_weights(part["h"].to_numpy(), draws, seed)
                s += part["s"].to_numpy() @ w
                c += part["c"].to_numpy() @ w
        yield pd.DataFrame({"draw": np.arange(draws), "s": s, "c": c})

    per = sums.mapInPandas(draw, "draw int, s double, c double").groupBy("draw").agg(safe_div(F.sum("s"), F.sum("c")).alias("gap"))
    point = df.agg(F.avg(F.col(a) - F.col(b)).alias("gap"))
    low, high, worse = (F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"), F.avg((F.col("gap") > 0).cast("double")).alias("worse_share"))
    return point.crossJoin(per.agg(low, high, worse))

"""Grades and projections in columns: shrunk rates, composites, reliability curves, pooled environments, layered scores, trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playsight.functions.nulls import clip, safe_div


def curve(n: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Reliability at n from (n, r) knots: linear between them, the last beyond, Spearman-Brown below the first."""
    n0, r0 = knots[0]
    k = n / n0
    out = F.when(n < n0, safe_div(k * r0, 1 + (k - 1) * r0))
    for (a, ra), (b, rb) in zip(knots, knots[1:], strict=False):
        out = out.when(n <= b, ra + (rb - ra) * (n - a) / (b - a))
    return out.otherwise(F.lit(float(knots[-1][1])))


def shrunk_rate(v: Column, x: Column, earlier: Column, over: Column, pooled: Column, k: Column) -> Column:
    """(v * x + over + (earlier + k) * pooled) / (v + earlier + k): current rate x on v, decayed history `over` above the pooled rate on `earlier`."""
    return safe_div(v * x + over + (earlier + k) * pooled, v + earlier + k)


def composite(z: DataFrame, keys: list[str], trait: str, weights: dict[str, float], games: str, k: float, least: float = 0.6, primary: str | None = None) -> DataFrame:
    """(keys, composite, coverage, grade): sum of w z over sum of |w|, missing z as 0, times games / (games + k).

    Graded on the 20-80 scale only where the primary trait is there and the weights present cover `least`.
    """
    w = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col(trait)]
    whole = float(sum(map(abs, weights.values())))
    agg = z.where(F.col(trait).isin(*weights)).groupBy(*keys).agg(F.sum(w * F.coalesce("z", F.lit(0.0))).alias("s"), F.sum(F.when(F.col("z").isNotNull(), F.abs(w))).alias("c"), F.max(games).cast("double").alias("g"), F.max((F.col(trait) == (primary or "")) & F.col("z").isNotNull()).alias("main"))
    value = F.col("s") / whole * F.col("g") / (F.col("g") + k)
    coverage = F.coalesce(F.col("c"), F.lit(0.0)) / whole
    graded = (coverage >= least) & (F.lit(primary is None) | F.col("main"))
    return agg.select(*keys, value.alias("composite"), coverage.alias("coverage"), F.when(graded, clip(50 + 10 * value, 20.0, 80.0)).alias("grade"))


def pooled_environment(current: Column, seen: Column, prior: Column, week: Column) -> Column:
    """Early weeks lean on the prior: 64 games of it, halving every 6 weeks (fixed values)."""
    g = 64.0 * F.pow(F.lit(0.5), (week - 1) / 6.0)
    return (current * seen + prior * g) / (seen + g)


def layered(home: Column, away: Column, layers: Sequence[tuple[Column, Column]], market: Column, weight: float) -> tuple[Column, Column]:
    """(home, away) points after layers of side adjustments, floored at 0, and a blend of the margin towards the market that keeps the total."""
    for a, b in layers:
        home, away = F.greatest(F.lit(0.0), home + a), F.greatest(F.lit(0.0), away + b)
    margin = home - away
    shift = (F.coalesce(market, margin) - margin) * min(weight, 0.5) / 2
    shift = clip_between(shift, -home, away)
    return home + shift, away - shift


def clip_between(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def tree(node: dict) -> Column:
    """A decision tree as one expression: {"leaf": v} or {"on": column, "at": threshold, "missing": "left" | "right", "left": node, "right": node}."""
    if "leaf" in node:
        return F.lit(float(node["leaf"]))
    left = F.col(node["on"]) < node["at"]
    return F.when(F.coalesce(left, F.lit(node["missing"] == "left")), tree(node["left"])).otherwise(tree(node["right"]))


def ensemble(trees: Sequence[dict], base: float) -> Column:
    """Logistic of the base and the trees' sum, inside generated code."""
    total: Column = F.lit(float(base))
    for t in trees:
        total = total + tree(t)
    return 1 / (1 + F.exp(-total))

"""Seeded simulation: draws run in batches inside tasks, each batch with a generator of its own seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 1000


def _standings(wins: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Places from 0 by wins, ties by strength."""
    order = np.lexsort((-strength[None].repeat(len(wins), 0), -wins), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(wins.shape[1])[None].repeat(len(wins), 0), axis=1)
    return place


def season(spark: SparkSession, games: pd.DataFrame, draws: int = 10_000, seed: int = 20260907, shared: float = 0.5) -> DataFrame:
    """(team, draw_wins_mean, p10, p50, p90, top) over simulated seasons.

    games: home, away, p (home's probability), a bounded schedule.  Outcomes are a Gaussian copula: each
    team has a strength draw that its games share with weight `shared`.  A batch's seed is (seed, batch),
    so results don't depend on how batches are dealt to tasks.
    """
    teams = sorted({*games["home"], *games["away"]})
    at = {t: i for i, t in enumerate(teams)}
    home, away = games["home"].map(at).to_numpy(), games["away"].map(at).to_numpy()
    grid = np.linspace(-8, 8, 160_001)
    density = np.exp(-grid * grid / 2)
    cdf = np.cumsum(density) / density.sum()
    cut = np.interp(1 - np.clip(games["p"].to_numpy(), 1e-9, 1 - 1e-9), cdf, grid)
    own = np.sqrt(1 - shared)
    expected = np.zeros(len(teams))
    np.add.at(expected, home, games["p"].to_numpy())
    np.add.at(expected, away, 1 - games["p"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for b in frame["id"]:
                rng = np.random.default_rng([seed, int(b)])
                n = min(BATCH, draws - int(b) * BATCH)
                z = rng.standard_normal((n, len(teams)))
                latent = np.sqrt(shared / 2) * (z[:, home] - z[:, away]) + own * rng.standard_normal((n, len(home)))
                won = latent > cut[None]
                wins = np.zeros((n, len(teams)), np.int64)
                for g in range(len(home)):
                    wins[:, home[g]] += won[:, g]
                    wins[:, away[g]] += ~won[:, g]
                place = _standings(wins, expected)
                for t in range(len(teams)):
                    values, counts = np.unique(wins[:, t], return_counts=True)
                    tops = [int((place[wins[:, t] == v, t] == 0).sum()) for v in values]
                    yield pd.DataFrame({"team": teams[t], "wins": values, "draws": counts, "tops": tops})

    per = spark.range((draws + BATCH - 1) // BATCH).mapInPandas(run, "team long, wins long, draws long, tops long")
    counts = per.groupBy("team", "wins").agg(F.sum("draws").alias("draws"), F.sum("tops").alias("tops"))
    whole = counts.groupBy("team").agg(
        (F.sum(F.col("wins") * F.col("draws")) / F.sum("draws")).alias("mean_wins"),
        *[F.expr(f"percentile(wins, {q}, draws)").alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
        (F.sum("tops") / F.sum("draws")).alias("top_share"),
        F.sum("draws").alias("draws"),
    )
    return whole


def locked_places(spark: SparkSession, wins: dict[int, int], left: list[tuple[int, int]]) -> DataFrame:
    """(team, best, worst) place over all 2 ** n outcomes of the games left (n at most 20)."""
    if len(left) > 20:
        raise ValueError("at most 20 games can be enumerated")
    teams = sorted(wins)
    base = np.array([wins[t] for t in teams])
    at = {t: i for i, t in enumerate(teams)}
    pairs = [(at[a], at[b]) for a, b in left]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            bits = frame["id"].to_numpy()
            w = np.repeat(base[None], len(bits), 0)
            for g, (a, b) in enumerate(pairs):
                one = (bits >> g) & 1
                w[:, a] += one
                w[:, b] += 1 - one
            above = (w[:, None, :] > w[:, :, None]).sum(axis=2)
            level = (w[:, None, :] == w[:, :, None]).sum(axis=2) - 1
            yield pd.DataFrame({"team": teams, "best": (above + 1).min(axis=0), "worst": (above + 1 + level).max(axis=0)})

    per = spark.range(1 << len(left)).mapInPandas(run, "team long, best long, worst long")
    return per.groupBy("team").agg(F.min("best").alias("best"), F.max("worst").alias("worst"))

"""Ratings of units by channel, and ratings that markets imply, carried from season to season.

Games enter as weighted sums by pairing of teams, so what a task holds of a fit is bounded by the square of its teams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Penalties in games, points a pressure and a line yard, half-lives, the prior's games and what is carried.
CHANNELS = {"rush": 12.0, "pass": 8.0, "pass_block": 12.0, "run_block": 8.0, "special_teams": 16.0}
POINTS_PER_PRESSURE, POINTS_PER_LINE_YARD, LEAST_TIMED = -0.45, 0.08, 100
HALF_LIFE_WEEKS = 6.0
MARKET_HALF_LIFE, PRIOR_GAMES, CARRIED, HOME_SD = 1.29, 0.105, 0.82, 10.0


def channel_values(games: DataFrame, keys: list[str]) -> DataFrame:
    """games (team, opponent, weight, rush_epa, pass_epa, st_epa, pressures, dropbacks, time_to_throw, protection_epa, line_yards, carries) within keys -> (keys, team, opponent, weight, channel, value).

    Protection: pressures a dropback, less what the passer's time to throw explains (where at least 100 games of
    a fit have one), centred and in points; without charted pressures the EPA of sacks and hits.  Run
    blocking: line yards over the fit's yards a carry, in points; 0 without a carry.
    """
    rate = F.when(F.col("pressures").isNotNull() & (F.col("dropbacks") > 0), F.col("pressures") / F.col("dropbacks"))
    timed = F.when(F.col("time_to_throw").isNotNull(), F.col("_rate"))
    g = games.withColumn("_rate", rate)
    both = F.when(F.col("_rate").isNotNull(), F.col("time_to_throw"))
    slope = F.when(F.count(both) >= LEAST_TIMED, F.covar_pop(both, timed) / F.greatest(F.var_pop(both), F.lit(1e-12)))
    base = g.groupBy(*keys).agg(slope.alias("_slope"), F.avg(both).alias("_ttt"), F.sum(F.when(F.col("carries") > 0, F.col("line_yards"))).alias("_ly"), F.sum(F.when(F.col("carries") > 0, F.col("carries"))).alias("_ca"))
    g = g.join(base, keys).withColumn("_adj", F.col("_rate") - F.coalesce(F.col("_slope") * (F.col("time_to_throw") - F.col("_ttt")), F.lit(0.0)))
    g = g.join(g.groupBy(*keys).agg(F.avg("_adj").alias("_mean")), keys)
    block = F.coalesce((F.col("_adj") - F.col("_mean")) * F.col("dropbacks") * POINTS_PER_PRESSURE, F.col("protection_epa"))
    run = F.when(F.col("carries") > 0, (F.col("line_yards") - F.col("_ly") / F.col("_ca") * F.col("carries")) * POINTS_PER_LINE_YARD).otherwise(0.0)
    value = {"rush": F.col("rush_epa"), "pass": F.col("pass_epa"), "pass_block": block, "run_block": run, "special_teams": F.col("st_epa")}
    each = F.array(*[F.struct(F.lit(c).alias("channel"), v.cast("double").alias("value")) for c, v in value.items()])
    return g.select(*keys, "team", "opponent", "weight", F.explode(each).alias("e")).select(*keys, "team", "opponent", "weight", "e.channel", "e.value")


def _posterior(x: np.ndarray, w: np.ndarray, wy: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ (w[:, None] * x) + np.diag(precision), x.T @ wy + precision * mean)


def _channel(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """One channel of one fit: both sides, centred."""
    teams = sorted({*cells["team"], *cells["opponent"]})
    at, n, rows = {t: i for i, t in enumerate(teams)}, len(teams), np.arange(len(cells))
    x = np.zeros((len(cells), 2 * n))
    x[rows, cells["team"].map(at)], x[rows, n + cells["opponent"].map(at)] = 1.0, -1.0
    w, wv = cells["w"].to_numpy(float), cells["wv"].to_numpy(float)
    beta = _posterior(x, w, wv - w * wv.sum() / w.sum(), np.zeros(2 * n), np.full(2 * n, CHANNELS[key[2]])) if w.sum() > 0 else np.zeros(2 * n)
    return pd.DataFrame({"season": key[0], "cut": key[1], "channel": key[2], "team": teams, "unit": beta[:n] - beta[:n].mean(), "counter": beta[n:] - beta[n:].mean()})


def unit_ratings(unit_games: DataFrame, cuts: DataFrame, half_life: float = HALF_LIFE_WEEKS) -> DataFrame:
    """(season, cut, team, rush_offense, pass_offense, rush_defense, pass_defense, pass_block, run_block, special_teams) from games of weeks before each cut.

    unit_games: (season, week, ...) and the columns of channel_values but weight; all channels of all fits in one plan.
    """
    g = unit_games.join(cuts.select("season", "cut"), "season").where("week < cut")
    g = g.join(g.groupBy("season", "cut").agg(F.max("week").alias("_last")), ["season", "cut"]).withColumn("weight", F.pow(F.lit(0.5), (F.col("_last") - F.col("week")) / half_life))
    v = channel_values(g, ["season", "cut"]).where("value is not null")
    cells = v.groupBy("season", "cut", "channel", "team", "opponent").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("value")).alias("wv"))
    each = cells.groupBy("season", "cut", "channel").applyInPandas(_channel, "season long, cut long, channel string, team string, unit double, counter double")
    pick = lambda channel, value: F.max(F.when(F.col("channel") == channel, value))
    return each.groupBy("season", "cut", "team").agg(
        pick("rush", F.col("unit")).alias("rush_offense"), pick("pass", F.col("unit")).alias("pass_offense"), pick("rush", F.col("counter")).alias("rush_defense"), pick("pass", F.col("counter")).alias("pass_defense"),
        pick("pass_block", F.col("unit")).alias("pass_block"), pick("run_block", F.col("unit")).alias("run_block"), pick("special_teams", F.col("unit") + F.col("counter")).alias("special_teams"),
    )


def _market(cells: pd.DataFrame, prior: dict[str, float], teams: list[str]) -> dict[str, float]:
    """Ratings, centred, from pairings (home, away, field, w, wy) and the prior of each team (0 where it has none)."""
    at, n, rows = {t: i for i, t in enumerate(teams)}, len(teams), np.arange(len(cells))
    x = np.zeros((len(cells), n + 1))
    x[rows, cells["home"].map(at).to_numpy(int)], x[rows, cells["away"].map(at).to_numpy(int)] = 1.0, -1.0
    x[:, -1] = cells["field"]
    beta = _posterior(x, cells["w"].to_numpy(float), cells["wy"].to_numpy(float), np.array([*(prior.get(t, 0.0) for t in teams), 0.0]), np.array([*[PRIOR_GAMES] * n, HOME_SD**-2]))
    rating = beta[:-1] - beta[:-1].mean()
    return dict(zip(teams, rating.tolist(), strict=True))


def _fold(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Seasons in order: each season's final ratings, times what is carried, are the next one's prior."""
    prior: dict[str, float] = {}
    out = []
    for season, own in cells.groupby("season", sort=True):
        final = _market(own, prior, sorted({*own["home"], *own["away"]}))
        prior = {t: CARRIED * r for t, r in final.items()}
        out += [(key[0], int(season), t, r) for t, r in prior.items()]
    return pd.DataFrame(out, columns=["chain", "season", "team", "prior"])


def _current(key: tuple, cells: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
    carried = dict(zip(prior["team"], prior["prior"], strict=True))
    if not len(cells):
        return pd.DataFrame({"chain": key[0], "season": key[1], "cut": key[2], "team": list(carried), "rating": list(carried.values()), "games": 0})
    played = pd.concat([cells.groupby("home")["n"].sum(), cells.groupby("away")["n"].sum()]).groupby(level=0).sum()
    rating = _market(cells, carried, sorted({*carried, *cells["home"], *cells["away"]}))
    return pd.DataFrame({"chain": key[0], "season": key[1], "cut": key[2], "team": list(rating), "rating": list(rating.values()), "games": [int(played.get(t, 0)) for t in rating]})


def market_ratings(games: DataFrame, cuts: DataFrame, chain: str = "league") -> DataFrame:
    """(chain, season, cut, team, rating, games): what closing lines of weeks before the cut say of teams, over the last season's carried ratings.

    games: (league, season, week, home, away, neutral, spread), the home spread; cuts: (league, season, cut), where a season without games has
    its carried prior.  Only games with a line count, weighted by weeks before the last.  A chain's seasons are folded in order
    by one task, from their sums by pairing; then all cuts are fitted side by side.
    """
    g = games.where("spread is not null").withColumnRenamed(chain, "chain")
    cuts = cuts.withColumnRenamed(chain, "chain").select("chain", "season", "cut").distinct()

    def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max("week").alias("_last")) if "cut" not in keys else None
        rows = rows.join(last, keys) if last is not None else rows.withColumn("_last", F.col("cut") - 1)
        w = F.pow(F.lit(0.5), (F.col("_last") - F.col("week")) / MARKET_HALF_LIFE)
        return rows.withColumn("_w", w).groupBy(*keys, "home", "away", F.when(F.col("neutral"), 0.0).otherwise(1.0).alias("field")).agg(F.sum("_w").alias("w"), F.sum(-F.col("_w") * F.col("spread")).alias("wy"), F.count(F.lit(1)).alias("n"))

    carried = cells(g, ["chain", "season"]).groupBy("chain").applyInPandas(_fold, "chain string, season long, team string, prior double")
    # the prior of a season is what the last one before it, with lined games, leaves
    before = cuts.join(carried.select("chain", F.col("season").alias("_s")).distinct(), "chain").where("_s < season").groupBy("chain", "season", "cut").agg(F.max("_s").alias("_s"))
    prior = before.join(carried.withColumnRenamed("season", "_s"), ["chain", "_s"]).toDF("_c", "_s", "_season", "_cut", "team", "prior").select("_c", "_season", "_cut", "team", "prior")
    own = cells(g.join(cuts, ["chain", "season"]).where("week < cut"), ["chain", "season", "cut"])
    keys = ["chain", "season", "cut"]
    return own.groupBy(*keys).cogroup(prior.groupBy("_c", "_season", "_cut")).applyInPandas(_current, "chain string, season long, cut long, team string, rating double, games long")

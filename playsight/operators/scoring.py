"""Joint scoring: strengths of offenses and defenses per drive from points and from EPA, and the scores they project.

A fit of (season, cut) sees the season's games of weeks before the cut.  Games enter as sums by pairing
(offense, defense, home field), so what one task holds of a fit is bounded by the square of its teams, not
by its games; residual moments follow from the same sums, for all games of a pairing have one design.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half-life in weeks, prior deviations, home field and its deviation in points, bounds and floors.
HALF_LIFE_WEEKS = 6.0
STRENGTH_SD, PACE_SD, HOME_POINTS, HOME_SD = 0.35, 1.0, 2.0, 1.0
SLOPE_BOUNDS = (0.1, 2.0)
SHRINKAGE, PROCESS_FLOOR, SCORE_FLOOR = 0.1, 0.01, 4.0

GAME = "season week game home away neutral home_ppd away_ppd home_epa away_epa drives home_points away_points".split()
FIT = (
    "season long, cut long, teams array<string>, offense array<double>, defense array<double>, pace array<double>, base_ppd double, base_drives double, "
    "home_field double, covariance array<double>, score_covariance array<double>, epa_slope double"
)


def ridge(gram: np.ndarray, right: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posterior mean and covariance of normal equations under independent priors."""
    covariance = np.linalg.inv(gram + np.diag(1.0 / sd**2))
    return covariance @ (right + mean / sd**2), covariance


def shrunk_covariance(n: float, sums: np.ndarray, squares: np.ndarray, floor: float, shrinkage: float) -> np.ndarray:
    """The sample covariance from sums and sums of products, its off-diagonal shrunk, plus a floor."""
    covariance = (squares - np.outer(sums, sums) / n) / (n - 1)
    return (1 - shrinkage) * covariance + shrinkage * np.diag(np.diag(covariance)) + floor * np.eye(2)


def _sides(games: DataFrame) -> DataFrame:
    """Two rows a game and cut: who attacks whom, half the home field, and the two measures."""
    side = lambda o, d, sign: F.struct(F.col(o).alias("o"), F.col(d).alias("d"), F.when(F.col("neutral"), 0.0).otherwise(sign).alias("h"), F.col(f"{o}_ppd").alias("ppd"), F.col(f"{o}_epa").alias("epa"))
    return games.select("season", "cut", "recency", F.explode(F.array(side("home", "away", 0.5), side("away", "home", -0.5))).alias("s")).select("season", "cut", "recency", "s.*")


def _solved(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """One fit from its pairings: rows of kind `side` and of kind `game`."""
    side, game = cells[cells["kind"] == "side"], cells[cells["kind"] == "game"]
    teams = sorted({*game["o"], *game["d"]})
    at = {t: i for i, t in enumerate(teams)}
    n, k = len(teams), 2 * len(teams) + 1
    x = np.zeros((len(side), k))
    rows, o, d = np.arange(len(side)), side["o"].map(at).to_numpy(int), side["d"].map(at).to_numpy(int)
    x[rows, o], x[rows, n + d], x[:, -1] = 1.0, -1.0, side["h"]
    col = lambda frame, name: frame[name].to_numpy(float)
    first = side.iloc[0]
    mean, sd = np.zeros(k), np.full(k, STRENGTH_SD)
    mean[-1], sd[-1] = HOME_POINTS / first["base_drives"], HOME_SD / first["base_drives"]
    gram = x.T @ (col(side, "w")[:, None] * x)
    beta, _ = ridge(gram, x.T @ (0.5 * (col(side, "wp") + col(side, "we"))), mean, sd)
    fitted, many = x @ beta, col(side, "n")
    sums = np.array([(col(side, "p") - many * fitted).sum(), (col(side, "e") - many * fitted).sum()])
    two = lambda a, b, ab: (col(side, ab) - fitted * (col(side, a) + col(side, b)) + many * fitted**2).sum()
    squares = np.array([[two("p", "p", "pp"), two("p", "e", "pe")], [two("p", "e", "pe"), two("e", "e", "ee")]])
    inverse = np.linalg.inv(shrunk_covariance(many.sum(), sums, squares, PROCESS_FLOOR, SHRINKAGE))
    information, weight = inverse.sum(), inverse.sum(axis=1)
    beta, covariance = ridge(gram * information, x.T @ (weight[0] * col(side, "wp") + weight[1] * col(side, "we")), mean, sd)
    offense, defense = beta[:n] - beta[:n].mean(), beta[n:-1] - beta[n:-1].mean()
    center = np.eye(k)
    center[:n, :n] -= 1.0 / n
    center[n:-1, n:-1] -= 1.0 / n
    covariance = center @ covariance @ center.T

    g = np.zeros((len(game), n))
    home, away, rows = game["o"].map(at).to_numpy(int), game["d"].map(at).to_numpy(int), np.arange(len(game))
    np.add.at(g, (rows, home), 0.5)
    np.add.at(g, (rows, away), 0.5)
    weights, many = col(game, "w"), col(game, "n")
    base_drives = col(game, "pace").sum() / many.sum()
    pace, _ = ridge(g.T @ (weights[:, None] * g), g.T @ (col(game, "wpace") - weights * base_drives), np.zeros(n), np.full(n, PACE_SD))
    base_ppd = col(game, "wpoints").sum() / (2 * col(game, "wpace").sum()) + beta[:n].mean() - beta[n:-1].mean()
    base_drives += pace.mean()
    pace = pace - pace.mean()
    common, field = base_ppd * (base_drives + 0.5 * (pace[home] + pace[away])), base_drives * beta[-1] * col(game, "h")
    expect = np.stack([common + base_drives * (offense[home] - defense[away]) + field, common + base_drives * (offense[away] - defense[home]) - field])
    if many.sum() >= 2:
        a, b = col(game, "hp"), col(game, "ap")
        sums = np.array([(a - many * expect[0]).sum(), (b - many * expect[1]).sum()])
        part = lambda i, j, s, t, st: (st - expect[i] * t - expect[j] * s + many * expect[i] * expect[j]).sum()
        cross = part(0, 1, a, b, col(game, "hpap"))
        squares = np.array([[part(0, 0, a, a, col(game, "hphp")), cross], [cross, part(1, 1, b, b, col(game, "apap"))]])
        score = shrunk_covariance(many.sum(), sums, squares, SCORE_FLOOR, SHRINKAGE)
    else:
        score = np.full((2, 2), np.nan)
    return pd.DataFrame([{
        "season": key[0], "cut": key[1], "teams": teams, "offense": offense.tolist(), "defense": defense.tolist(), "pace": pace.tolist(), "base_ppd": base_ppd, "base_drives": base_drives,
        "home_field": beta[-1], "covariance": covariance.ravel().tolist(), "score_covariance": score.ravel().tolist(), "epa_slope": first["slope"],
    }])


def fits(games: DataFrame, cuts: DataFrame, half_life: float = HALF_LIFE_WEEKS) -> DataFrame:
    """One row (FIT) for each (season, cut) of cuts that has an earlier game in games (GAME, team columns as strings).

    Points a drive are centred; EPA a drive is centred and brought to points by its clipped slope on them.  The first
    pass explains their mean, the second their best weighting under the shrunk covariance of the first pass's
    residuals; both weigh games by recency.  Strengths are centred, with their covariance.  What has one row a fit is
    broadcast: shuffled by season and cut, all games of a fit would meet in one task.
    """
    last = F.max("week")
    g = games.join(F.broadcast(cuts.select("season", "cut")), "season").where("week < cut")
    g = g.join(F.broadcast(g.groupBy("season", "cut").agg(last.alias("_last"))), ["season", "cut"]).withColumn("recency", F.pow(F.lit(0.5), (F.col("_last") - F.col("week")) / half_life))
    sides = _sides(g)
    mean = lambda c: F.sum(F.col("recency") * c) / F.sum("recency")
    base = sides.groupBy("season", "cut").agg(mean(F.col("ppd")).alias("mp"), mean(F.col("epa")).alias("me"), mean(F.col("epa") * F.col("epa")).alias("ee"), mean(F.col("epa") * F.col("ppd")).alias("pe"))
    slope = F.least(F.lit(SLOPE_BOUNDS[1]), F.greatest(F.lit(SLOPE_BOUNDS[0]), (F.col("pe") - F.col("mp") * F.col("me")) / F.greatest(F.col("ee") - F.col("me") * F.col("me"), F.lit(1e-9))))
    base = base.select("season", "cut", "mp", "me", slope.alias("slope")).join(F.broadcast(g.groupBy("season", "cut").agg(F.avg("drives").alias("base_drives"))), ["season", "cut"])
    s = sides.join(F.broadcast(base), ["season", "cut"]).withColumn("p", F.col("ppd") - F.col("mp")).withColumn("e", F.col("slope") * (F.col("epa") - F.col("me")))
    total = lambda name, e: F.sum(e).cast("double").alias(name)
    w, p, e = F.col("recency"), F.col("p"), F.col("e")
    side = s.groupBy("season", "cut", "o", "d", "h", "slope", "base_drives").agg(F.count(F.lit(1)).cast("double").alias("n"), total("w", w), total("wp", w * p), total("we", w * e), total("pp", p * p), total("pe", p * e), total("ee", e * e), F.sum("p").alias("_p"), F.sum("e").alias("_e"))
    side = side.withColumnsRenamed({"_p": "p", "_e": "e"}).withColumn("kind", F.lit("side"))
    hp, ap, dr = F.col("home_points"), F.col("away_points"), F.col("drives")
    field = F.when(F.col("neutral"), 0.0).otherwise(0.5)
    game = g.groupBy("season", "cut", F.col("home").alias("o"), F.col("away").alias("d"), field.alias("h")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), total("w", w), total("pace", dr), total("wpace", w * dr), total("wpoints", w * (hp + ap)), total("hp", hp), total("ap", ap), total("hphp", hp * hp), total("apap", ap * ap), total("hpap", hp * ap),
    ).withColumn("kind", F.lit("game"))
    cells = side.unionByName(game, allowMissingColumns=True)
    return cells.groupBy("season", "cut").applyInPandas(_solved, FIT)


def projections(fitted: DataFrame, slate: DataFrame, scale: float = 1.0) -> DataFrame:
    """slate (season, week, game, home, away, neutral) with expected scores, home field, deviations of margin and total, and their correlation, by the fit cut at its week.

    Only Columns: of the strengths' covariance the five that a game touches count.  A team the fit has not seen gives no row.
    """
    fitted = F.broadcast(fitted)  # a row a fit, a square of its teams each
    m = slate.join(fitted, (slate["season"] == fitted["season"]) & (slate["week"] == fitted["cut"])).drop(fitted["season"])
    m = m.withColumn("_i", F.array_position("teams", F.col("home")).cast("int") - 1).withColumn("_j", F.array_position("teams", F.col("away")).cast("int") - 1).where("_i >= 0 and _j >= 0")
    n, b = F.size("teams"), F.col("base_drives")
    of = lambda name, i: F.get(name, F.col(i))
    common = F.col("base_ppd") * (b + 0.5 * (of("pace", "_i") + of("pace", "_j")))
    home_field = F.when(F.col("neutral"), 0.0).otherwise(b * F.col("home_field"))
    home = common + b * (of("offense", "_i") - of("defense", "_j")) + 0.5 * home_field
    away = common + b * (of("offense", "_j") - of("defense", "_i")) - 0.5 * home_field
    h = F.when(F.col("neutral"), 0.0).otherwise(0.5) * b
    rows = [[(F.col("_i"), b), (n + F.col("_j"), -b), (2 * n, h)], [(F.col("_j"), b), (n + F.col("_i"), -b), (2 * n, -h)]]

    def form(one, two) -> Column:
        parts = [x * y * F.get("covariance", (i * (2 * n + 1) + j).cast("int")) for i, x in one for j, y in two]
        return sum(parts[1:], parts[0])

    cov = {(a, c): (F.get("score_covariance", F.lit(2 * a + c)) + form(rows[a], rows[c])) * scale**2 for a in (0, 1) for c in (0, 1)}
    m = m.select(*slate.columns, home.alias("expected_home"), away.alias("expected_away"), home_field.alias("home_points_of_field"), *[v.alias(f"_c{a}{c}") for (a, c), v in cov.items()])
    margin, both = F.sqrt(F.col("_c00") - F.col("_c01") - F.col("_c10") + F.col("_c11")), F.sqrt(F.col("_c00") + F.col("_c01") + F.col("_c10") + F.col("_c11"))
    r = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), (F.col("_c00") - F.col("_c11")) / (margin * both)))
    return m.select(*slate.columns, "expected_home", "expected_away", "home_points_of_field", margin.alias("margin_sd"), both.alias("total_sd"), r.alias("correlation"))

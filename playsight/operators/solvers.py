"""Linear and bounded solves whose data stay in Spark: sums go to the driver, rows never do."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder (spark.checkpoint.dir; one of its own in local mode only)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def sparse_ridge(rows: DataFrame, targets: list[str], penalty: Callable[[Column], Column], extra: DataFrame | None = None, rounds: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """(f, x0, x1, ...): solutions of (X'WX + diag(penalty)) x = X'W y for each target, then for each column of `extra`.

    rows: (w, terms array<struct<f string, x double>>, targets...), one an observation; those with the same terms are added up first,
    for only X'WX and X'W y count, so rounds grow with the different rows of the design; penalty: of the column f;
    extra: (f, columns of further right-hand sides).  Conjugate gradients, preconditioned by the diagonal: a round is
    one product with the matrix, an aggregation to observations and back to features, and one row of
    scalars to the driver.  A feature of every row (the intercept) is aggregated before it is shuffled;
    where features are too many to broadcast, Spark's skew join splits it.
    """
    many = [c for c in (extra.columns if extra is not None else []) if c != "f"]
    n = len(targets) + len(many)
    sums = [f"_y{k}" for k in range(len(targets))]
    designs = rows.groupBy("terms").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(y)).alias(s) for s, y in zip(sums, targets, strict=True)])
    each = cut(designs.withColumn("_row", F.monotonically_increasing_id()).select("_row", "w", *sums, F.explode("terms").alias("t")).select("_row", "w", *sums, "t.f", "t.x"))
    start = each.groupBy("f").agg(F.sum(F.col("w") * F.col("x") * F.col("x")).alias("d"), *[F.sum(F.col("x") * F.col(y)).alias(f"r{k}") for k, y in enumerate(sums)])
    if extra is not None:
        start = start.join(extra, "f", "left").select("f", "d", *[f"r{k}" for k in range(len(targets))], *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"r{len(targets) + k}") for k, c in enumerate(many)])
    lam = penalty(F.col("f"))
    state = cut(start.select("f", lam.alias("lam"), (F.col("d") + lam).alias("d"), *[F.lit(0.0).alias(f"{v}{k}") for v in "xps" for k in range(n)], *[f"r{k}" for k in range(n)], *[(F.col(f"r{k}") / (F.col("d") + lam)).alias(f"u{k}") for k in range(n)]))

    def multiplied(state: DataFrame) -> DataFrame:
        """state with w = A u."""
        met = each.select("_row", "w", "f", "x").join(state.select("f", *[f"u{k}" for k in range(n)]), "f")
        seen = met.groupBy("_row", "w").agg(F.collect_list(F.struct("f", "x")).alias("t"), *[F.sum(F.col("x") * F.col(f"u{k}")).alias(f"v{k}") for k in range(n)])
        back = seen.select("w", F.explode("t").alias("t"), *[f"v{k}" for k in range(n)]).groupBy("t.f").agg(*[F.sum(F.col("w") * F.col("t.x") * F.col(f"v{k}")).alias(f"q{k}") for k in range(n)])
        joined = state.join(back, "f")
        return joined.select(*state.columns, *[(F.col(f"q{k}") + F.col("lam") * F.col(f"u{k}")).alias(f"w{k}") for k in range(n)])

    def scalars(state: DataFrame) -> tuple[list[float], list[float]]:
        row = state.agg(*[F.sum(F.col(f"r{k}") * F.col(f"u{k}")) for k in range(n)], *[F.sum(F.col(f"w{k}") * F.col(f"u{k}")) for k in range(n)]).first()
        return [row[k] or 0.0 for k in range(n)], [row[n + k] or 0.0 for k in range(n)]

    state = cut(multiplied(state))
    gamma, delta = scalars(state)
    first, beta, alpha = gamma, [0.0] * n, [g / d if d else 0.0 for g, d in zip(gamma, delta, strict=True)]
    for _ in range(rounds):
        open_ = [g > tolerance**2 * max(f, 1e-300) for g, f in zip(gamma, first, strict=True)]
        if not any(open_):
            break
        step = state
        new = {}
        for k in range(n):
            b, a = F.lit(beta[k]), F.lit(alpha[k] if open_[k] else 0.0)
            new[f"p{k}"], new[f"s{k}"] = F.col(f"u{k}") + b * F.col(f"p{k}"), F.col(f"w{k}") + b * F.col(f"s{k}")
            new[f"x{k}"], new[f"r{k}"] = F.col(f"x{k}") + a * new[f"p{k}"], F.col(f"r{k}") - a * new[f"s{k}"]
            new[f"u{k}"] = new[f"r{k}"] / F.col("d")
        step = step.select("f", "lam", "d", *[new[f"{v}{k}"].alias(f"{v}{k}") for v in "xpsru" for k in range(n)])
        state = cut(multiplied(step))
        before, (gamma, delta) = gamma, scalars(state)
        for k in range(n):
            if open_[k]:
                beta[k] = gamma[k] / before[k] if before[k] else 0.0
                below = delta[k] - beta[k] * gamma[k] / alpha[k] if alpha[k] else 0.0
                alpha[k] = gamma[k] / below if below else 0.0
            else:
                beta[k] = alpha[k] = gamma[k] = 0.0
    return state.select("f", *[f"x{k}" for k in range(n)])


def bounded_quadratic(h: np.ndarray, g: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The x within bounds that minimises x'Hx / 2 - g'x (H positive definite, a few dozen unknowns), by active sets.

    Unknowns at a bound are freed while their multiplier says so; the free ones are solved for exactly, and
    the step stops at the first bound it meets.
    """
    x = np.clip(np.zeros(len(g)), lower, upper)
    fixed = (x <= lower) | (x >= upper)
    for _ in range(50 * (len(g) + 1)):
        free = np.flatnonzero(~fixed)
        if len(free):
            wish = np.linalg.solve(h[np.ix_(free, free)], g[free] - h[np.ix_(free, np.flatnonzero(fixed))] @ x[fixed])
            move = wish - x[free]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(move < 0, (lower[free] - x[free]) / move, np.where(move > 0, (upper[free] - x[free]) / move, np.inf))
            step = min(1.0, float(np.min(room, initial=np.inf)))
            x[free] += step * move
            if step < 1.0:
                first = int(np.argmin(room))
                hit = free[first]
                x[hit] = lower[hit] if move[first] < 0 else upper[hit]
                fixed[hit] = True
                continue
        slope = h @ x - g
        wrong = np.where(fixed & (x <= lower), -slope, np.where(fixed & (x >= upper), slope, -math.inf))
        worst = int(np.argmax(wrong))
        if wrong[worst] <= 1e-12 * (1 + np.abs(g).max(initial=0.0)):
            return x
        fixed[worst] = False
    return x


#: The grid of penalties of the trait weights.
PENALTIES = np.logspace(0, 6, 61)


def bounded_ridge(rows: DataFrame, fold: str, features: list[str], target: str, lower: list[float], penalties: np.ndarray = PENALTIES) -> tuple[dict[str, float], float]:
    """Coefficients (with a free intercept) bounded below, and the penalty with the least squared error of folds left out.

    Sums of squares of each fold come from one aggregation, one row a fold; a fold is left out by taking its
    sums away, and its error follows from its own sums, so all penalties and folds need no further pass.
    With one fold the first penalty is taken.
    """
    names = ["_one", *features]
    col = lambda c: F.lit(1.0) if c == "_one" else F.col(c).cast("double")
    sums = [F.sum(col(a) * col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    found = rows.groupBy(fold).agg(*sums, *[F.sum(col(a) * F.col(target)).alias(f"b{i}") for i, a in enumerate(names)], F.sum(F.col(target) * F.col(target)).alias("yy")).orderBy(fold).collect()
    if not found:
        raise ValueError("no pair of seasons to fit on")
    k = len(names)
    gram = np.array([[[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)] for r in found])
    right = np.array([[r[f"b{i}"] for i in range(k)] for r in found])
    own = np.array([r["yy"] for r in found])
    low, high = np.array([-np.inf, *lower]), np.full(k, np.inf)

    def solved(g: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
        return bounded_quadratic(g + penalty * np.diag([0.0, *np.ones(k - 1)]), b, low, high)

    best = float(penalties[0])
    if len(found) > 1:
        errors = []
        for penalty in penalties:
            sse = 0.0
            for f in range(len(found)):
                beta = solved(gram.sum(0) - gram[f], right.sum(0) - right[f], penalty)
                sse += own[f] - 2 * beta @ right[f] + beta @ gram[f] @ beta
            errors.append(sse / gram[:, 0, 0].sum())
        best = float(penalties[int(np.argmin(errors))])
    beta = solved(gram.sum(0), right.sum(0), best)
    return dict(zip(features, beta[1:].tolist(), strict=True)), best

"""The fitted models against dense solves in NumPy on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playsight.operators import context as C
from playsight.operators import solvers as S


def _observations(seed=1, n=60):
    rng = np.random.default_rng(seed)
    return [(2020 + int(s), int(w), f"p{p}", f"t{t}", f"t{o}", float(d), float(e), float(min(d, h))) for s, w, p, t, o, d, e, h in zip(rng.integers(0, 2, n), rng.integers(1, 9, n), rng.integers(0, 5, n), rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(5, 40, n), rng.normal(2, 6, n), rng.integers(0, 9, n), strict=True)]


def test_context_equals_a_dense_solve(spark):
    rows = _observations()
    frame = spark.createDataFrame(rows, "season int, week int, passer string, team string, opponent string, dropbacks double, epa double, hit_sacks double")
    swaps = spark.createDataFrame([("swap", "p0", 1.0), ("swap", "p1", -1.0), ("new", "p0", 1.0), ("new", "nobody", -1.0)], "name string, passer string, weight double")
    got, sds, fit = C.passer_context(frame, 2021, 6, contrasts=swaps)
    d = [r for r in rows if (r[0], r[1]) < (2021, 6)]
    w = np.array([r[5] * 0.5 ** (((2021 - r[0]) * 52 + 6 - r[1]) / 52) for r in d])
    names = ["one", *sorted({f"q{r[2]}" for r in d}), *sorted({f"T{r[3]}_{r[0]}" for r in d}), *sorted({f"O{r[4]}_{r[0]}" for r in d})]
    at = {x: i for i, x in enumerate(names)}
    base = np.zeros((len(d), len(names)))
    for i, r in enumerate(d):
        base[i, [0, at[f"q{r[2]}"], at[f"T{r[3]}_{r[0]}"], at[f"O{r[4]}_{r[0]}"]]] = 1
    lam = np.array([1e-6 if x == "one" else 300.0 if x[0] == "O" else 100.0 for x in names])
    h, y = np.array([r[7] / r[5] for r in d]), np.array([r[6] / r[5] for r in d])
    full = np.column_stack([base, h - np.average(h, weights=w)])
    a1, a2 = full.T @ (w[:, None] * full) + np.diag([*lam, 1.0]), base.T @ (w[:, None] * base) + np.diag(lam)
    e, p = np.linalg.solve(a1, full.T @ (w * y)), np.linalg.solve(a2, base.T @ (w * h))
    combined = (e[:-1] + e[-1] * p) * 34
    strength = {r["passer"]: r for r in got.collect()}
    assert set(strength) == {r[2] for r in d}
    for q, r in strength.items():
        own = np.array([x[2] == q for x in d])
        assert r["strength"] == pytest.approx(combined[at[f"q{q}"]], abs=1e-6)
        assert r["effective_dropbacks"] == pytest.approx(w[own].sum()) and r["hit_sack_rate"] == pytest.approx(np.average(h[own], weights=w[own]))
        assert r["support"] == pytest.approx(np.average([combined[at[f"T{x[3]}_{x[0]}"]] for x in d if x[2] == q], weights=w[own]), abs=1e-6)
        assert r["opponents"] == pytest.approx(np.average([combined[at[f"O{x[4]}_{x[0]}"]] for x in d if x[2] == q], weights=w[own]), abs=1e-6)
    noise = max(1.0, float((w * (y - full @ e) ** 2).sum()) / max(len(d) - full.shape[1], 1))
    rate = max(0.05, float((w * (h - base @ p) ** 2).sum()) / max(len(d) - base.shape[1], 1))
    assert fit["noise"] == pytest.approx(noise, rel=1e-6) and fit["rate_noise"] == pytest.approx(rate, rel=1e-6)
    for r in sds.collect():
        c = np.zeros(len(names) + 1)
        c[at["qp0"]] = 1
        unseen = 0.01
        if r["name"] == "swap":
            c[at["qp1"]], unseen = -1, 0.0
        want = 34 * ((noise * (c @ np.linalg.solve(a1, c) + unseen)) ** 0.5 + abs(e[-1]) * (rate * (c[:-1] @ np.linalg.solve(a2, c[:-1]) + unseen)) ** 0.5)
        assert r["sd"] == pytest.approx(want, rel=1e-5)
    with pytest.raises(ValueError):
        C.passer_context(frame.limit(0), 2021, 6)
    with pytest.raises(ValueError):
        C.passer_context(frame.withColumn("hit_sacks", F.col("dropbacks") + 1), 2021, 6)


def test_lineups_equal_a_dense_solve(spark):
    rng = np.random.default_rng(2)
    plays = [(int(rng.integers(1, 5)), f"q{rng.integers(3)}", f"d{rng.integers(2)}", [f"m{k}" for k in rng.choice(4, 2, replace=False)], float(rng.normal())) for _ in range(50)]
    frame = spark.createDataFrame(plays, "week int, passer string, defense string, teammates array<string>, epa double")
    some = [p for p in plays if p[0] <= 3]
    names = sorted({f"q:{p[1]}" for p in some} | {f"d:{p[2]}" for p in some} | {f"m:{m}" for p in some for m in p[3]})
    x = np.array([[float(n in {f"q:{p[1]}", f"d:{p[2]}", *(f"m:{m}" for m in p[3])}) for n in names] for p in some])
    y = np.array([p[4] for p in some])
    beta = np.linalg.solve(x.T @ x + np.diag([3.0 if n[0] == "q" else 7.0 for n in names]), x.T @ (y - y.mean()))
    got = {r["passer"]: r["effect"] for r in C.lineup_effects(frame, 3, 3.0, 7.0).collect()}
    assert got == {n[2:]: pytest.approx(b, abs=1e-7) for n, b in zip(names, beta, strict=True) if n[0] == "q"}
    names = sorted({f"q:{p[1]}@{p[0]}" for p in plays} | {f"d:{p[2]}" for p in plays} | {f"m:{m}" for p in plays for m in p[3]})
    x = [[float(n in {f"q:{p[1]}@{p[0]}", f"d:{p[2]}", *(f"m:{m}" for m in p[3])}) for n in names] for p in plays]
    w, y = [1.0] * len(plays), [p[4] for p in plays]
    y = [v - np.mean([p[4] for p in plays]) for v in y]
    for q in {p[1] for p in plays}:
        weeks = sorted({p[0] for p in plays if p[1] == q})
        for a, b in zip(weeks[:-1], weeks[1:], strict=True):
            x.append([float(n == f"q:{q}@{b}") - float(n == f"q:{q}@{a}") for n in names])
            w.append(20.0)
            y.append(0.0)
    x, w, y = np.array(x), np.array(w), np.array(y)
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag([3.0 if n[0] == "q" else 7.0 for n in names]), x.T @ (w * y))
    got = {(r["passer"], r["week"]): r["effect"] for r in C.walking_lineup_effects(frame, 3.0, 20.0, 7.0).collect()}
    want = {(n[2:].split("@")[0], int(n.split("@")[1])): b for n, b in zip(names, beta, strict=True) if n[0] == "q"}
    assert got == {k: pytest.approx(v, abs=1e-7) for k, v in want.items()}


def test_two_sided_ratings_of_any_number_of_sides(spark):
    rng = np.random.default_rng(5)
    games = [(f"a{rng.integers(4)}", f"a{rng.integers(4)}", float(rng.normal(20, 5)), float(rng.integers(1, 4))) for _ in range(40)]
    got = {r["side"]: r for r in C.two_sided(spark.createDataFrame(games, "o string, d string, y double, w double"), "o", "d", "y", "w", 2.0).collect()}
    sides = sorted({g[0] for g in games} | {g[1] for g in games})
    x = np.array([[1.0, *(float(g[0] == s) for s in sides), *(-float(g[1] == s) for s in sides)] for g in games])
    w, y = np.array([g[3] for g in games]), np.array([g[2] for g in games])
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag([0.0, *[2.0] * 2 * len(sides)]), x.T @ (w * y))
    for k, s in enumerate(sides):
        assert (got[s]["base"], got[s]["off"], got[s]["def"]) == pytest.approx((beta[0], beta[1 + k], beta[1 + len(sides) + k]), abs=1e-6)


def test_bounded_quadratic_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.integers(1, 7))
        a = rng.normal(size=(k + 3, k))
        h, g = a.T @ a + 0.1 * np.eye(k), rng.normal(size=k) * 3
        low, high = np.where(rng.random(k) < 0.5, 0.0, -np.inf), np.where(rng.random(k) < 0.3, rng.random(k), np.inf)
        x = S.bounded_quadratic(h, g, low, high)
        slope = h @ x - g
        assert (x >= low - 1e-12).all() and (x <= high + 1e-12).all()
        inside = (x > low + 1e-9) & (x < high - 1e-9)
        assert np.abs(slope[inside]).max(initial=0) < 1e-8
        assert (slope[x <= low + 1e-9] > -1e-8).all() and (slope[x >= high - 1e-9] < 1e-8).all()


def test_bounded_ridge_leaves_out_folds_by_their_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), *map(float, v), float(v @ [1.0, -0.5, 0.2] + 2 + rng.normal())) for s in range(3) for v in rng.normal(size=(20, 3))]
    got, penalty = S.bounded_ridge(spark.createDataFrame(rows, "season int, a double, b double, c double, y double"), "season", ["a", "b", "c"], "y", [0.0, 0.0, -np.inf])
    data, low = np.array(rows), np.array([-np.inf, 0.0, 0.0, -np.inf])

    def fit(some, penalty):  # projected gradient steps to convergence, from the rows themselves
        x, y = np.column_stack([np.ones(len(some)), some[:, 1:4]]), some[:, 4]
        h, g = x.T @ x + penalty * np.diag([0.0, 1, 1, 1]), x.T @ y
        beta = np.zeros(4)
        for _ in range(3000):
            for j in range(4):
                beta[j] = max(low[j], beta[j] + (g[j] - h[j] @ beta) / h[j, j])
        return beta

    grid = S.PENALTIES[::6]
    sse = [sum(((r[4] - fit(data[data[:, 0] != s], p) @ [1.0, *r[1:4]]) ** 2) for s in range(3) for r in data[data[:, 0] == s]) for p in grid]
    coarse, best = S.bounded_ridge(spark.createDataFrame(rows, "season int, a double, b double, c double, y double"), "season", ["a", "b", "c"], "y", [0.0, 0.0, -np.inf], grid)
    assert best == grid[int(np.argmin(sse))]
    assert list(coarse.values()) == pytest.approx(fit(data, best)[1:], abs=1e-7)
    assert penalty in S.PENALTIES and got["b"] == 0.0


def _races(rng, seasons, candidates=6):
    rows = []
    for s in seasons:
        x = rng.normal(size=(candidates, 3)) + [0, 5, 0]
        v = x @ [1.5, 0.8, -1.0] + rng.gumbel(size=candidates)
        rows += [(s, "award", f"c{k}", float(k == int(np.argmax(v))), *map(float, x[k])) for k in range(candidates)]
    return rows


def test_choice_model_equals_a_plain_newton_fit(spark):
    from playsight.operators import choice

    rng = np.random.default_rng(7)
    rows = _races(rng, range(2001, 2025))
    rows[3] = (*rows[3][:3], 1.0, *rows[3][4:])  # shared
    frame = spark.createDataFrame(rows, "season long, race string, who string, won double, a double, b double, c double")
    features, low, high = ["a", "b", "c"], [0.0, 0.0, 0.0], [np.inf] * 3
    fits = choice.fit_windows(frame, "season", "race", "won", features, low, high, [2010, 2020])
    for cut, (mean, scale, beta) in fits.items():
        some = [r for r in rows if r[0] < cut]
        x = np.array([r[4:] for r in some])
        assert mean == pytest.approx(x.mean(0)) and scale == pytest.approx(x.std(0))

        def slope(b):
            g = b.copy()
            for s in {r[0] for r in some}:
                z = (np.array([r[4:] for r in some if r[0] == s]) - mean) / scale
                t = np.array([r[3] for r in some if r[0] == s])
                p = np.exp(z @ b - (z @ b).max())
                g += z.T @ (p / p.sum() - t / t.sum())
            return g

        b = np.zeros(3)
        for _ in range(20_000):  # projected gradient
            b = np.maximum(0.0, b - 0.02 * slope(b))
        assert beta == pytest.approx(b, abs=1e-6) and beta[2] == 0.0
    history = choice.evaluated(frame, "season", "race", "who", "won", features, low, high).orderBy("season").collect()
    assert [r["season"] for r in history] == list(range(2005, 2025))
    last = history[-1]
    mean, scale, beta = choice.fit_windows(frame, "season", "race", "won", features, low, high, [2024])[2024]
    own = [r for r in rows if r[0] == 2024]
    v = ((np.array([r[4:] for r in own]) - mean) / scale) @ beta
    p, t = np.exp(v) / np.exp(v).sum(), np.array([r[3] for r in own])
    assert (last["winner_probability"], last["leader_probability"], last["brier"]) == pytest.approx((p @ t, p.max(), ((p - t) ** 2).sum()))
    assert last["winner_hit"] == bool(t[p.argmax()]) and last["candidates"] == 6
    with pytest.raises(ValueError):
        choice.fit_windows(frame, "season", "race", "won", features, low, high, [2004])


def test_publishing_gate(spark):
    from playsight.operators import choice

    schema = "season long, winner_in_pool boolean, winner_hit boolean, top_three_hit boolean, leader_probability double, log_loss double, uniform_log_loss double, brier double, split string"
    good = [(2020 + k, True, k % 2 == 0, True, 0.5, 1.0, 1.8, 0.5, "retrospective_validation") for k in range(8)]
    gate = lambda rows: choice.publishable(spark.createDataFrame(rows, schema)).first()
    assert gate(good)["publishable"] and gate(good)["status"] == "validated"
    assert not gate(good[:7])["publishable"] and not gate([(*r[:4], 0.7, *r[5:]) for r in good])["publishable"] and not gate([(*r[:5], 2.0, *r[6:]) for r in good])["publishable"]
    assert not gate([(r[0], r[0] > 2020, *r[2:]) for r in good])["publishable"]
    assert gate([(*r[:8], "development") for r in good])["status"] == "insufficient_validation"


def _season(rng, weeks=6, teams=6):
    rows = []
    for season in (2020, 2021):
        for week in range(1, weeks + 1):
            order = rng.permutation(teams)
            for k in range(0, teams, 2):
                rows.append((season, week, f"{season}-{week}-{k}", f"t{order[k]}", f"t{order[k + 1]}", bool(rng.random() < 0.2), *map(float, rng.normal(2, 0.6, 2)), *map(float, rng.normal(0.1, 0.4, 2)), float(rng.integers(8, 14)), float(rng.integers(3, 40)), float(rng.integers(3, 40))))
    return rows


def _plain_fit(rows, cut):
    """The two passes on the whole design, a game at a time."""
    some = [r for r in rows if r[1] < cut]
    teams = sorted({t for r in some for t in r[3:5]})
    n, at = len(teams), {t: i for i, t in enumerate(teams)}
    x, y, e, w = np.zeros((2 * len(some), 2 * n + 1)), [], [], []
    for i, r in enumerate(some):
        for k, (o, d) in enumerate(((3, 4), (4, 3))):
            x[2 * i + k, at[r[o]]], x[2 * i + k, n + at[r[d]]] = 1, -1
            x[2 * i + k, -1] = 0 if r[5] else 0.5 - k
            y.append(r[6 + k])
            e.append(r[8 + k])
            w.append(0.5 ** ((cut - 1 - r[1]) / 6))
    y, e, w = np.array(y), np.array(e), np.array(w)
    cp, ce = y - np.average(y, weights=w), e - np.average(e, weights=w)
    pp = np.clip(np.average(ce * cp, weights=w) / np.average(ce**2, weights=w), 0.1, 2.0) * ce
    drives = np.array([r[10] for r in some])
    mean, sd = np.zeros(2 * n + 1), np.full(2 * n + 1, 0.35)
    mean[-1], sd[-1] = 2 / drives.mean(), 1 / drives.mean()

    def solve(x, y, w, mean, sd):
        c = np.linalg.inv(x.T @ (w[:, None] * x) + np.diag(sd**-2.0))
        return c @ (x.T @ (w * y) + mean / sd**2), c

    def shrunk(r, floor):
        c = np.cov(r, rowvar=False)
        return 0.9 * c + 0.1 * np.diag(np.diag(c)) + floor * np.eye(2)

    b, _ = solve(x, 0.5 * (cp + pp), w, mean, sd)
    inverse = np.linalg.inv(shrunk(np.column_stack([cp - x @ b, pp - x @ b]), 0.01))
    b, c = solve(x, np.column_stack([cp, pp]) @ inverse.sum(1) / inverse.sum(), w * inverse.sum(), mean, sd)
    off, dfn = b[:n] - b[:n].mean(), b[n:-1] - b[n:-1].mean()
    t = np.eye(2 * n + 1)
    t[:n, :n] -= 1 / n
    t[n:-1, n:-1] -= 1 / n
    c = t @ c @ t.T
    wg = w[::2]
    ppd = np.average([r[11] + r[12] for r in some], weights=wg) / (2 * np.average(drives, weights=wg)) + b[:n].mean() - b[n:-1].mean()
    pd_ = np.zeros((len(some), n))
    for i, r in enumerate(some):
        pd_[i, [at[r[3]], at[r[4]]]] = 0.5
    pace, _ = solve(pd_, drives - drives.mean(), wg, np.zeros(n), np.ones(n))
    bd, pace = drives.mean() + pace.mean(), pace - pace.mean()

    def expect(r):
        i, j, h = at[r[3]], at[r[4]], 0 if r[5] else bd * b[-1] / 2
        base = ppd * (bd + 0.5 * (pace[i] + pace[j]))
        return base + bd * (off[i] - dfn[j]) + h, base + bd * (off[j] - dfn[i]) - h

    score = shrunk(np.array([np.subtract(r[11:13], expect(r)) for r in some]), 4.0)

    def project(r):
        i, j, s = at[r[3]], at[r[4]], np.zeros((2, 2 * n + 1))
        s[0, i], s[0, n + j], s[1, j], s[1, n + i] = bd, -bd, bd, -bd
        s[:, -1] = 0 if r[5] else [0.5 * bd, -0.5 * bd]
        m = np.array([[1, -1], [1, 1]]) @ (score + s @ c @ s.T) @ np.array([[1, -1], [1, 1]]).T
        return *expect(r), m[0, 0] ** 0.5, m[1, 1] ** 0.5, m[0, 1] / (m[0, 0] * m[1, 1]) ** 0.5

    return project


def test_joint_scoring_equals_the_whole_design(spark):
    from playsight.operators import scoring

    rows = _season(np.random.default_rng(4))
    games = spark.createDataFrame(rows, "season long, week long, game string, home string, away string, neutral boolean, home_ppd double, away_ppd double, home_epa double, away_epa double, drives double, home_points double, away_points double")
    cuts = spark.createDataFrame([(s, c) for s in (2020, 2021) for c in (1, 4, 6)], "season long, cut long")
    fitted = scoring.fits(games, cuts)
    got = {r["game"]: r for r in scoring.projections(fitted, games.select("season", "week", "game", "home", "away", "neutral")).collect()}
    want = [r for r in rows if r[1] in (4, 6)]
    assert set(got) == {r[2] for r in want}
    for r in want:
        project = _plain_fit([x for x in rows if x[0] == r[0]], r[1])
        g = got[r[2]]
        assert (g["expected_home"], g["expected_away"], g["margin_sd"], g["total_sd"], g["correlation"]) == pytest.approx(project(r), rel=1e-8, abs=1e-10)
    # games of the cut's week and later change nothing
    later = games.withColumn("home_points", F.when(F.col("week") >= 4, 99.0).otherwise(F.col("home_points")))
    again = scoring.fits(later, cuts.where("cut = 4")).select("season", "offense", "base_ppd").collect()
    assert {r["season"]: r["base_ppd"] for r in again} == {r["season"]: pytest.approx(r["base_ppd"]) for r in fitted.where("cut = 4").select("season", "base_ppd").collect()}


def test_unit_ratings_equal_a_dense_solve(spark):
    from playsight.operators import ratings

    rng = np.random.default_rng(6)
    names = "rush_epa pass_epa st_epa pressures dropbacks time_to_throw protection_epa line_yards carries".split()
    rows = [(2020, int(rng.integers(1, 9)), f"t{t}", f"t{o}", *map(float, rng.normal(size=3)), None if rng.random() < 0.3 else float(rng.integers(0, 9)), float(rng.integers(0, 30)), None if rng.random() < 0.3 else float(rng.normal(2.7, 0.3)), float(rng.normal()), float(rng.normal(80, 20)), float(rng.integers(0, 30))) for t in range(6) for o in range(6) for _ in range(14) if t != o]
    frame = spark.createDataFrame(rows, "season long, week long, team string, opponent string, " + ", ".join(f"{n} double" for n in names))
    got = {r["team"]: r for r in ratings.unit_ratings(frame, spark.createDataFrame([(2020, 7)], "season long, cut long")).collect()}
    some = [dict(zip(["season", "week", "team", "opponent", *names], r, strict=True)) for r in rows if r[1] < 7]
    w = np.array([0.5 ** ((6 - r["week"]) / 6) for r in some])
    charted = [r["pressures"] is not None and r["dropbacks"] > 0 for r in some]
    timed = [i for i, r in enumerate(some) if charted[i] and r["time_to_throw"] is not None]
    rate = np.array([r["pressures"] / r["dropbacks"] if c else np.nan for r, c in zip(some, charted, strict=True)])
    ttt = np.array([some[i]["time_to_throw"] for i in timed])
    assert len(timed) >= 100
    adjusted = rate.copy()
    adjusted[timed] -= ((ttt - ttt.mean()) * (rate[timed] - rate[timed].mean())).sum() / ((ttt - ttt.mean()) ** 2).sum() * (ttt - ttt.mean())
    block = np.array([(adjusted[i] - np.nanmean(adjusted)) * r["dropbacks"] * -0.45 if charted[i] else r["protection_epa"] for i, r in enumerate(some)])
    per = sum(r["line_yards"] for r in some if r["carries"] > 0) / sum(r["carries"] for r in some if r["carries"] > 0)
    run = np.array([(r["line_yards"] - per * r["carries"]) * 0.08 if r["carries"] > 0 else 0.0 for r in some])
    x = np.array([[float(r["team"] == f"t{k}") for k in range(6)] + [-float(r["opponent"] == f"t{k}") for k in range(6)] for r in some])

    def both(y, penalty):
        b = np.linalg.solve(x.T @ (w[:, None] * x) + penalty * np.eye(12), x.T @ (w * (y - np.average(y, weights=w))))
        return b[:6] - b[:6].mean(), b[6:] - b[6:].mean()

    of = lambda c: np.array([r[c] for r in some])
    (ro, rd), (po, pd_), (b, _), (ru, _), (s1, s2) = both(of("rush_epa"), 12), both(of("pass_epa"), 8), both(block, 12), both(run, 8), both(of("st_epa"), 16)
    for k in range(6):
        r = got[f"t{k}"]
        assert [r[c] for c in ("rush_offense", "rush_defense", "pass_offense", "pass_defense", "pass_block", "run_block", "special_teams")] == pytest.approx([ro[k], rd[k], po[k], pd_[k], b[k], ru[k], s1[k] + s2[k]], abs=1e-9)


def test_market_ratings_are_carried_from_season_to_season(spark):
    from playsight.operators import ratings

    rng = np.random.default_rng(8)
    rows = [(lg, s, int(rng.integers(1, 7)), f"t{h}", f"t{a}", bool(rng.random() < 0.2), None if rng.random() < 0.1 else float(rng.normal(-2, 5))) for lg in ("x", "y") for s in (2019, 2020, 2022) for h, a in (rng.choice(5, 2, replace=False) for _ in range(25))]
    frame = spark.createDataFrame(rows, "league string, season long, week long, home string, away string, neutral boolean, spread double")
    cuts = [(lg, s, c) for lg in ("x", "y") for s, c in ((2019, 4), (2022, 1), (2022, 5), (2023, 1))]
    got = {(r["chain"], r["season"], r["cut"], r["team"]): (r["rating"], r["games"]) for r in ratings.market_ratings(frame, spark.createDataFrame(cuts, "league string, season long, cut long")).collect()}

    def fit(some, prior, teams, last):
        x = np.array([[float(g[3] == t) - float(g[4] == t) for t in teams] + [float(not g[5])] for g in some])
        w, y = np.array([0.5 ** ((last - g[2]) / 1.29) for g in some]), np.array([-g[6] for g in some])
        lam = np.array([0.105] * len(teams) + [0.01])
        b = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag(lam), x.T @ (w * y) + lam * np.array([prior.get(t, 0.0) for t in teams] + [0.0]))
        return dict(zip(teams, b[:-1] - b[:-1].mean(), strict=True))

    want = {}
    for lg, season, cut in cuts:
        prior = {}
        lined = [g for g in rows if g[0] == lg and g[6] is not None]
        for s in (2019, 2020, 2022):
            own = [g for g in lined if g[1] == s]
            if s < season:
                prior = {t: 0.82 * r for t, r in fit(own, prior, sorted({t for g in own for t in g[3:5]}), max(g[2] for g in own)).items()}
        now = [g for g in lined if g[1] == season and g[2] < cut]
        rated = fit(now, prior, sorted({*prior, *(t for g in now for t in g[3:5])}), cut - 1) if now else prior
        want |= {(lg, season, cut, t): (r, sum(t in g[3:5] for g in now)) for t, r in rated.items()}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)


def test_choice_prepares_candidates_once(spark):
    from playsight.operators import choice

    frame = spark.createDataFrame(_races(np.random.default_rng(8), range(2001, 2010)), "season long, race string, who string, won double, a double, b double, c double")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a):
        seen.add(1)
        return a

    history = choice.evaluated(frame.withColumn("a", counted("a")), "season", "race", "who", "won", ["a", "b", "c"], [0.0] * 3, [np.inf] * 3)
    assert history.count() == 5 and seen.value == 54  # nine races of six candidates


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joint_scoring_shuffles_no_games_by_fit(spark):
    from playsight.operators import scoring

    games = spark.createDataFrame(_season(np.random.default_rng(4)), "season long, week long, game string, home string, away string, neutral boolean, home_ppd double, away_ppd double, home_epa double, away_epa double, drives double, home_points double, away_points double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        fitted = scoring.fits(games, games.select("season", F.lit(4).cast("long").alias("cut")).distinct())
        assert "SortMergeJoin" not in _plan(fitted)
        assert "SortMergeJoin" not in _plan(scoring.projections(fitted, games.select("season", "week", "game", "home", "away", "neutral")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_rows_of_a_design_are_added_up_first(spark, monkeypatch):
    sizes, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    rows = spark.range(3000).selectExpr("1.0 + id % 2 as w", "cast(id % 7 as double) as y", "array(struct(concat('a', id % 3) as f, 1.0d as x), struct('one' as f, 0.5d as x)) as terms")
    got = {r["f"]: r["x0"] for r in S.sparse_ridge(rows.withColumn("w", F.col("w").cast("double")), ["y"], lambda f: F.lit(2.0)).collect()}
    assert sizes[0].count() == 6  # three designs of two terms
    i = np.arange(3000)
    x, w = np.column_stack([i % 3 == 0, i % 3 == 1, i % 3 == 2, np.full(3000, 0.5)]).astype(float), 1.0 + i % 2
    want = np.linalg.solve(x.T @ (w[:, None] * x) + 2 * np.eye(4), x.T @ (w * (i % 7)))
    assert [got[f] for f in ("a0", "a1", "a2", "one")] == pytest.approx(want, abs=1e-8)

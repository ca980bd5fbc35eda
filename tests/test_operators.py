"""Operators on small tables whose results are known."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playsight.functions import market as M
from playsight.functions.nulls import safe_div
from playsight.operators import joins as J
from playsight.operators import kernels as K
from playsight.operators import simulate
from playsight.operators import stats as S
from playsight.operators import windows as X
from playsight.sources import tables as T
from playsight.streaming import hold


def test_opponent_adjustment_sees_only_earlier_weeks(spark):
    # worked out by hand: against "hard", 4 of 10 were allowed in week 3 and 9 of 20 by week 5; the league stood at 14 of 30 and 22 of 50
    rows = [("k", "hard", 3, 4.0, 10.0), ("m", "easy", 3, 10.0, 20.0), ("k", "hard", 5, 5.0, 10.0), ("m", "easy", 5, 3.0, 10.0), ("m", "hard", 8, 6.0, 10.0), ("k", "new", 8, 1.0, 2.0)]

    def adjusted(some):
        frame = spark.createDataFrame(some, "who string, opponent string, week int, n double, d double")
        return {(r["who"], r["week"]): r["n_adj"] for r in X.opponent_adjusted(frame, "opponent").collect()}

    want = {("k", 3): 4.0, ("m", 3): 10.0, ("k", 5): 5 - 10 * (4 / 10 - 14 / 30), ("m", 5): 3 - 10 * (10 / 20 - 14 / 30), ("m", 8): 6 - 10 * (9 / 20 - 22 / 50), ("k", 8): 1.0}
    got = adjusted(rows)
    assert got == pytest.approx(want)
    # later rows, even in numbers, change nothing before them
    more = adjusted(rows + [("z", "hard", 9, 99.0, 1.0)] * 50)
    assert all(more[x] == pytest.approx(want[x]) for x in want)


def test_bootstrap_weights_are_poisson_and_draws_agree_with_a_loop(spark):
    w = S.poisson_weights(np.arange(4000, dtype=np.int64) * 7919, 50, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    rows = [(k % 40, float(k % 7), float(k % 5)) for k in range(400)]
    got = S.paired_bootstrap(spark.createDataFrame(rows, "g long, a double, b double"), "g", "a", "b", draws=200, seed=5).first()
    hashes = {r["g"]: r["h"] for r in spark.range(40).select(F.col("id").alias("g"), F.xxhash64("id").alias("h")).collect()}
    gaps = []
    for t in range(200):
        s = c = 0.0
        for g in range(40):
            n = S.poisson_weights(np.array([hashes[g]]), 200, 5)[0, t]
            s += n * sum(a - b for x, a, b in rows if x == g)
            c += n * sum(x == g for x, _, _ in rows)
        gaps.append(s / c)
    assert got["gap"] == pytest.approx(np.mean([a - b for _, a, b in rows]))
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(gaps, [0.025, 0.975])))


def test_two_sided_ridge_agrees_with_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = [(int(o), int(d), float(rng.normal()), float(rng.integers(1, 5))) for o, d in rng.integers(0, 6, (200, 2))]
    got = K.two_sided_ridge(spark.createDataFrame(rows, "o long, d long, y double, w double"), "o", "d", "y", "w", 2.5).toPandas().sort_values("side")
    x, y, w = np.zeros((200, 13)), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    for i, (o, d, _, _) in enumerate(rows):
        x[i, 0], x[i, 1 + o], x[i, 7 + d] = 1, 1, -1
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag([0.0] + [2.5] * 12), x.T @ (w * y))
    assert got["off"].to_numpy() == pytest.approx(beta[1:7]) and got["def"].to_numpy() == pytest.approx(beta[7:])


def test_safe_division(spark):
    got = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, 2.0)], "a double, b double").select(safe_div("a", "b").alias("x")).collect()
    assert [r["x"] for r in got] == [None, None, 1.5]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), min_size=1, max_size=20))
def test_fair_price_breaks_even(spark, ps):
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", M.implied(M.fair_price(F.col("p"))).alias("q"))
    assert all(math.isclose(r["p"], r["q"], abs_tol=1e-9) for r in df.collect())


def test_band_join_is_the_cross_join_filtered(spark):
    a = spark.createDataFrame([(k % 3, 7 * k % 50) for k in range(40)], "k int, t long").withColumn("a", F.monotonically_increasing_id())
    b = spark.createDataFrame([(k % 3, 11 * k % 50) for k in range(40)], "k int, s long").withColumn("b", F.monotonically_increasing_id())
    got = {(r["a"], r["b"]) for r in J.band_join(a, b, "k", "t", "s", 5).collect()}
    want = {(x["a"], y["b"]) for x in a.collect() for y in b.collect() if x["k"] == y["k"] and abs(x["t"] - y["s"]) <= 5}
    assert got == want


def test_contract_value_by_backward_induction(spark):
    # by hand, last year first.  One: 4-6 is worse than owing 0, so 0; then 5-4+0 = 1, then 7-2+1 = 6.  Two: owes 2 whatever it does, 1-8 is worse
    df = spark.createDataFrame([([7.0, 5.0, 4.0], [2.0, 4.0, 6.0], [0.0, 0.0, 0.0]), ([1.0], [8.0], [2.0])], "w array<double>, c array<double>, g array<double>")
    assert [r["v"] for r in df.select(K.fair_values("w", "c", "g", 0.0).alias("v")).collect()] == pytest.approx([6.0, -2.0])


def test_locked_places(spark):
    got = {r["team"]: (r["best"], r["worst"]) for r in simulate.locked_places(spark, {1: 3, 2: 2, 3: 0}, [(2, 3)]).collect()}
    assert got[3][0] > 1 and got[1][0] == min(b for b, _ in got.values())


def test_newer_only_keeps_what_is_there_on_ties(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, u int, v string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 6, "new"), (3, 1, "new")], "k int, u int, v string")
    assert {r["k"]: r["v"] for r in T.newer_only(old, new, ["k"], "u").collect()} == {1: "old", 2: "new", 3: "new"}


def test_strict_csv_refuses(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("season,team\n2024,AA\n2025,AA\n")
    assert T.strict_csv(spark, str(good), {"season": r"\d{4}", "team": "[A-Z]+"}, ["season", "team"]).count() == 2
    for k, text in enumerate(("season,team\n24,AA\n", "season,team\n2024,AA\n2024,AA\n")):
        bad = tmp_path / f"b{k}.csv"
        bad.write_text(text)
        with pytest.raises(ValueError):
            T.strict_csv(spark, str(bad), {"season": r"\d{4}", "team": "[A-Z]+"}, ["season", "team"])


def test_hold_last_streams_as_in_batch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = [(1, at(10), "quote", 1.5), (1, at(20), "quote", 2.5), (1, at(30), "start", None), (2, at(10), "quote", 9.0), (2, at(15), "off", None), (2, at(30), "start", None), (3, at(0), "quote", 4.0), (3, at(900), "start", None),
            (4, at(5), "quote", 1.5), (4, at(30), "quote", 7.0), (4, at(30), "start", None), (5, at(8), "quote", 2.0), (5, at(8), "quote", 3.0), (5, at(40), "start", None)]
    events = spark.createDataFrame(rows, "game long, ts timestamp, kind string, price double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = hold.hold_last(stream, "game", 600).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = hold.hold_last_batch(events, "game", 600).collect()
    assert sorted((r["game"], r["price"]) for r in spark.table("held").collect()) == sorted((r["game"], r["price"]) for r in batch) == [(1, 2.5), (4, 1.5), (5, 3.0)]


def test_prior_median_of_random_small_inputs(spark):
    """Even and odd counts, ties and single values, against a plain median."""
    rng = random.Random(11)
    rows = [(f"k{case}", day, float(rng.randrange(1, 6) * 10)) for case in range(40) for day in range(1, 6) for _ in range(rng.randrange(0, 4))]
    rows += [("two", 1, 10.0), ("two", 1, 20.0), ("two", 2, 5.0)]
    got = {(r["k"], r["day"]): r["median"] for r in X.prior_median(spark.createDataFrame(rows, "k string, day int, v double"), "k", "day", "v").collect()}
    assert set(got) == {r[:2] for r in rows}
    for (k, day), median in got.items():
        earlier = [v for kk, d, v in rows if kk == k and d < day]
        assert median == (statistics.median(earlier) if earlier else None), (k, day)
    assert got["two", 2] == 15.0


def _trait_play(**own):
    from playsight.operators.traits import PLAY

    base = dict.fromkeys(PLAY) | {"season": 2020, "week": 1, "game": 1, "team": 1, "opponent": 2, "kind": "pass", "qtr": 1, "down": 1, "togo": 10, "yardline": 50, "quarter_left": 800, "yards": 5, "epa": 1.0, "wpa": 0.1}
    base |= dict.fromkeys("success complete interception sack hit fumble fumble_lost tackle solo tfl forced defended".split(), 0)
    return base | own


def _trait_values(spark, plays, positions, presence=()):
    from playsight.operators import traits
    from playsight.plans.traits import COLUMNS

    kinds = {"kind": "string", **dict.fromkeys("epa adj_epa wpa cpoe yac xyac return_yards".split(), "double")}
    assert set(traits.PLAY) <= set(COLUMNS)
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in traits.PLAY)
    frame = spark.createDataFrame([tuple(p[c] for c in traits.PLAY) for p in plays], schema)
    here = spark.createDataFrame(list(presence), "season long, week long, game long, team long, opponent long, athlete long")
    where = spark.createDataFrame([(2020, a, g) for a, g in positions.items()], "season long, athlete long, grp string")
    return {(r["athlete"], r["trait"]): r["value"] for r in traits.evaluated(frame, where, here).collect()}


def test_shares_are_shares_and_games_without_a_target_count(spark):
    # game 1: receiver 30 has one of three targets and runs once; game 2: a run only, none of two targets
    plays = [_trait_play(passer=10, receiver=r) for r in (30, 31, 31)] + [_trait_play(kind="run", rusher=30, game=g, week=g) for g in (1, 2)] + [_trait_play(game=2, week=2, passer=10, receiver=31)] * 2
    got = _trait_values(spark, plays, {10: "QB", 30: "WR", 31: "TE"})
    assert got[30, "rec.target_share"] == pytest.approx(1 / 5) and got[31, "rec.target_share"] == pytest.approx(4 / 5)
    assert (30, "rb.breakaway") not in got  # a receiver's run is no back's
    assert got[30, "rec.value_per_target"] == 0.5  # half of the play's value


def test_defenders_count_by_game_not_by_play(spark):
    plays = [_trait_play(passer=10, defender=70, tfl=1, tackle=1, sack=s, epa=-1.0, wpa=-0.2, game=g, week=g) for g, s in ((1, 1), (1, 0), (3, 0))] + [_trait_play(passer=10, defender=71, tackle=1, hit=1, game=3, week=3)]
    presence = [(2020, g, g, 2, 1, a) for g in (1, 2, 3) for a in (70, 71)]
    got = _trait_values(spark, plays, {10: "QB", 70: "DL", 71: "LB"}, presence)
    assert got[70, "def.every_week"] == pytest.approx(2 / 3) and got[71, "def.every_week"] == 0
    assert got[70, "def.finishing"] == 1 and got[71, "def.finishing"] == 0
    assert got[71, "def.tackle_share"] == pytest.approx(1 / 4) and (70, "def.tackle_share") not in got
    # a game's own sack, and the hit of week 3 at the median sack before it
    assert got[70, "def.pass_rush"] == pytest.approx(0.2 / 3) and got[71, "def.pass_rush"] == pytest.approx(0.2 / 3)
    # three losses less one sack over three games
    assert got[70, "def.run_stop"] == pytest.approx(2 / 3, abs=0.5)
    assert (71, "qb.legs") not in got


def test_similar_names_are_all_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 14)))
    change = lambda w: "".join(c if rng.random() < 0.9 else rng.choice("abé") for c in w)
    left = [(k, rng.randrange(0, 100), word()) for k in range(60)]
    right = [(k, rng.randrange(0, 100), change(rng.choice(left)[2])) for k in range(60)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    for least in (0.7, 0.85, 1.0):
        want = {}
        for i, t, a in left:
            near = [(-round(1 - edits(a, b) / max(len(a), len(b), 1), 12), abs(t - s), j) for j, s, b in right if abs(t - s) <= 30 and 1 - edits(a, b) / max(len(a), len(b), 1) >= least - 1e-12]
            if near:
                want[i] = min(near)[2]
        got = J.similar_in_band(spark.createDataFrame(left, "i long, t long, a string"), spark.createDataFrame(right, "j long, s long, b string"), "i", "j", "t", "s", 30, [("a", "b")], least)
        assert {r["i"]: r["j"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        J.similar_in_band(spark.createDataFrame(left, "i long, t long, a string"), spark.createDataFrame(right, "j long, s long, b string"), "i", "j", "t", "s", 30, [("a", "b")], 0.6)


def test_similar_names_meet_once(spark):
    """Names with a long beginning in common, as numbered customers have, in one band."""
    name = lambda k: f"Customer#{k:09d}"
    left, right = [(k, 0, name(k)) for k in range(100)], [(k, 0, name(k)) for k in range(50, 100)]
    frames = spark.createDataFrame(left, "i long, t long, a string"), spark.createDataFrame(right, "j long, s long, b string")
    found = J.similar_in_band(*frames, "i", "j", "t", "s", 30, [("a", "b")], 0.9)
    got = {r["i"]: r["j"] for r in found.collect()}
    assert all(got[k] == k for k in range(50, 100))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "arrays_overlap" in plan and "aggregate [_id" in plan.replace("#", " ")
    want = {i: min((sum(x != y for x, y in zip(name(i), name(j), strict=True)), j) for j in range(50, 100))[1] for i in range(100)}
    assert got == want


def test_expectations_join_without_a_shuffle_of_plays(spark, sf):
    from playsight.operators import traits
    from playsight.plans.traits import plays

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        plan = traits.with_expectations(plays(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_whole_number_chances_make_no_row_a_number(spark, sf):
    from playsight.plans.queries import QUERIES

    assert "Generate" not in QUERIES["F_integer_pmf"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    rows = [(3.5, 12.0), (-40.0, 12.0), (0.0, 0.0), (None, 12.0)]
    got = [r["p"] for r in spark.createDataFrame(rows, "m double, s double").select(M.integer_pmf(F.col("m"), F.col("s"), -30, 30).alias("p")).collect()]
    assert got[2] == got[3] == [None] * 61
    for (m, s), p in zip(rows[:2], got, strict=False):
        ks = spark.createDataFrame([(k + 0.5 - m, s) for k in range(-30, 30)], "x double, s double").select(M.t_cdf7(F.col("x"), F.col("s")).alias("c")).collect()
        c = [0.0, *[r["c"] for r in ks], 1.0]
        assert p == pytest.approx([b - a for a, b in zip(c, c[1:], strict=False)], abs=1e-14)

"""Decisions against plain Python on a few offers, and every rule of the ledger by a row that breaks it."""

import datetime as dt
import math

import numpy as np
import pytest
from playsight.operators import decisions as D

NOW = dt.datetime(2024, 9, 8, 12)
START = dt.datetime(2024, 9, 8, 17)


def _cdf(x):
    t = math.atan(x / math.sqrt(7))
    c = math.cos(t)
    return 0.5 + (t + math.sin(t) * (c + 2 / 3 * c**3 + 8 / 15 * c**5)) / math.pi


def _probabilities(market, side, point, mean, weights):
    if market == "totals":
        s = D.TOTAL_SD * math.sqrt(5 / 7)
        over, under = _cdf((mean - math.floor(point) - 0.5) / s), _cdf((math.ceil(point) - 0.5 - mean) / s)
        push = max(0.0, 1 - over - under) if point == math.floor(point) else 0.0
    else:
        s, spread = D.MARGIN_SD * math.sqrt(5 / 7), 0.0 if market == "h2h" else point if side == "home" else -point
        up = lambda k: 1.0 if k >= 100 else _cdf((k + 0.5 - mean) / s)
        down = lambda k: 0.0 if k <= -100 else _cdf((k - 0.5 - mean) / s)
        mass = {k: (up(k) - down(k)) * weights[k + 100] for k in range(-100, 101)}
        over = sum(m for k, m in mass.items() if k + spread > 1e-9) / sum(mass.values())
        push = sum(m for k, m in mass.items() if abs(k + spread) <= 1e-9) / sum(mass.values())
    win = over if side in ("home", "over") else 1 - over - push
    return win, push, 1 - win - push


def _root(f, target, low, high):
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


WEIGHTS = [1.4 if abs(k) in (3, 7) else 0.9 if k == 0 else 1.0 for k in range(-100, 101)]
OFFERS = "game string, market string, side string, point double, price double, book string, updated timestamp, fetched timestamp, event string, source string, offer_start timestamp, verified boolean, match double"


def _offer(game, market, side, point, price, book, age=10, **own):
    row = {"updated": NOW - dt.timedelta(minutes=age), "fetched": NOW - dt.timedelta(minutes=5), "event": "e", "source": "api", "offer_start": START, "verified": True, "match": 1.0} | own
    return (game, market, side, point, price, book, *row.values())


def _projection(game, **own):
    row = {"start": START, "as_of": NOW - dt.timedelta(hours=3), "home_margin": 3.0, "pure_margin": 4.0, "model_total": 44.0, "margin_sd": 13.0, "total_sd": 13.0, "home_missing": 0, "away_missing": 0, "input_reason": None} | own
    return (game, *row.values())


def test_decisions(spark):
    pair = lambda g, m, p, a, b, book, **k: [_offer(g, m, "over" if m == "totals" else "home", p, a, book, **k), _offer(g, m, "under" if m == "totals" else "away", -p if m == "spreads" else p, b, book, **k)]
    rows = [
        *pair("a", "spreads", -3.0, -110.0, -110.0, "x"), *pair("a", "spreads", -2.5, 120.0, -150.0, "y"), *pair("a", "totals", 44.0, -105.0, -115.0, "x"), *pair("a", "h2h", None, -160.0, 140.0, "x"), *pair("a", "h2h", None, -120.0, 150.0, "y", verified=False),
        *pair("b", "spreads", 6.5, -110.0, -110.0, "x", age=90), *pair("c", "h2h", None, -110.0, -110.0, "x"), _offer("d", "spreads", "home", 1.0, -110.0, "x"), _offer("a", "spreads", "home", 1.25, 500.0, "z"), *pair("late", "h2h", None, -110.0, -110.0, "x"),
    ]
    projections = [_projection("a"), _projection("b"), _projection("c", home_missing=1), _projection("d"), _projection("late", start=NOW), _projection("e", margin_sd=float("nan"), as_of=NOW), _projection("old", as_of=NOW - dt.timedelta(days=8)), _projection("late2", as_of=NOW + dt.timedelta(hours=1))]
    p = spark.createDataFrame(projections, "game string, start timestamp, as_of timestamp, home_margin double, pure_margin double, model_total double, margin_sd double, total_sd double, home_missing long, away_missing long, input_reason string")
    got = {(r["game"], r["market"]): r for r in D.decisions(p, spark.createDataFrame(rows, OFFERS), NOW, WEIGHTS).collect()}
    assert {k[0] for k in got} == {"a", "b", "c", "d", "e", "old"} and len(got) == 18
    implied = lambda a: 1 / (1 + (a / 100 if a > 0 else 100 / -a))
    for market in ("spreads", "totals", "h2h"):
        offers = [r for r in rows if r[0] == "a" and r[1] == market and r[5] != "z"]
        centers = {}
        for backed in (True, False):
            means = []
            for up, down in zip(offers[::2], offers[1::2], strict=True):
                mine, theirs = implied(up[4]), implied(down[4])
                fair = (min if backed else max)(mine / (mine + theirs), mine - (mine + theirs - 1) / 2)

                def share(m, up=up):
                    win, _, loss = _probabilities(market, up[2], up[3], m, WEIGHTS)
                    return win / (win + loss)

                base = 0.0 if market == "h2h" else up[3] if market == "totals" else -up[3]
                means.append(_root(share, fair, base - 60, base + 60))
            means.sort()
            centers[backed] = (means[(len(means) - 1) // 2] + means[len(means) // 2]) / 2
        best = None
        for o in offers:
            mean = centers[o[2] in ("home", "over")]
            win, push, loss = _probabilities(market, o[2], o[3], mean, WEIGHTS)
            gain = 1 / implied(o[4]) - 1
            cell = (o[11], win * gain - loss, o[5], o, mean, win, push, win / (win + loss) - implied(o[4]))
            best = max(best, cell, key=lambda c: c[:3]) if best else cell
        r = got["a", market]
        assert (r["side"], r["price"], r["book"]) == (best[3][2], best[3][4], best[3][5])
        assert (r["priced_mean"], r["win"], r["push"], r["ev"], r["edge"]) == pytest.approx((best[4], best[5], best[6], best[1], best[7]), abs=1e-7)
        shifted = _probabilities(market, r["side"], r["point"], r["priced_mean"] + (-1 if r["side"] in ("home", "over") else 1) * r["edge_points"], WEIGHTS)
        assert shifted[0] / (shifted[0] + shifted[2]) == pytest.approx(implied(r["price"]), abs=1e-7)
        assert r["reason"] in ("positive_ev", "ranked_lean", "outside_slate") and (r["status"] == "recommended") == (r["reason"] != "outside_slate") == (r["stake"] == 1.0)
    assert got["b", "spreads"]["reason"] == "stale_price" and got["c", "h2h"]["reason"] == "missing_model_inputs" and got["d", "spreads"]["reason"] == "missing_market_line"
    assert got["e", "totals"]["reason"] == "invalid_model_distribution" and got["old", "h2h"]["reason"] == "stale_forecast" and got["b", "totals"]["reason"] == "missing_market_line"
    only = D.decisions(p, spark.createDataFrame(rows, OFFERS), NOW, WEIGHTS, spark.createDataFrame([(f"g{k}",) for k in range(5)], "game string")).where("reason = 'ranked_lean'")
    assert only.count() == 0  # five games are picked already


def test_equal_weights_need_a_few_terms_an_offer(monkeypatch):
    rng = np.random.default_rng(5)
    n = 3000
    total, up = rng.random(n) < 0.3, rng.random(n) < 0.5
    point, mean = np.where(total, 40.0, 0.0) + rng.integers(-250, 251, n) / 2.0, rng.normal(0, 40, n)
    seen, cdf = [], D._cdf
    monkeypatch.setattr(D, "_cdf", lambda x: seen.append(x.size) or cdf(x))
    got = D._chances(total, up, point, mean, None)
    assert sum(seen) <= 5 * n
    want = D._chances(total, up, point, mean, np.ones(2 * D.RANGE + 1))
    assert np.abs(np.array(got) - np.array(want)).max() < 1e-12


COLUMNS = "id string, game string, market string, side string, point double, price double, status string, outcome string, start timestamp, home_team string, away_team string, published_at timestamp, forecast_at timestamp, win double, push double, ev double, edge double, receipts map<string,struct<observed_at:timestamp,sha256:string>>, flags map<string,string>, home_points long, away_points long, profit double, graded_at timestamp, settlement_reason string, result_at timestamp"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
HOUR = dt.timedelta(hours=1)


def _row(name, **own):
    seen = {x: (NOW - 3 * HOUR, "h") for x in D.RECEIPTS}
    base = {"id": name, "game": "g", "market": "spreads", "side": "home", "point": -3.0, "price": 100.0, "status": "recommended", "outcome": "pending", "start": NOW + HOUR, "home_team": "H", "away_team": "A", "published_at": NOW, "forecast_at": NOW - 2 * HOUR, "win": 0.5, "push": 0.1, "ev": 0.1, "edge": 0.5 / 0.9 - 0.5, "receipts": seen,
            "flags": {f"{s}_{k}": v for s in ("home", "away") for k, v in (("expected_qb", "q"), ("qb_source_at", "2024-09-08 08:00:00"))}, **dict.fromkeys(D.SETTLEMENT)} | {"outcome": "pending"}
    return tuple((base | own)[c] for c in NAMES)


def test_every_rule_refuses_the_row_that_breaks_it(spark):
    past = {"start": NOW - 5 * HOUR, "published_at": NOW - 9 * HOUR, "forecast_at": NOW - 10 * HOUR, "game": "f"}
    win = {**past, "outcome": "win", "home_points": 20, "away_points": 10, "profit": 1.0, "graded_at": NOW - HOUR, "settlement_reason": "confirmed_final", "result_at": NOW - 2 * HOUR}
    missing = {x: (NOW - 3 * HOUR, "h") for x in D.RECEIPTS[1:]}
    cases = {
        "ok": ({}, None, None), "started": ({"start": NOW - HOUR}, None, "started_game"), "done": ({"outcome": "win"}, None, "new_is_pending"),
        "graded": (win, past, None), "again": ({**win, "profit": 2.0}, win, "settled_is_final"), "same": (win, win, None), "moved": ({"price": 120.0}, {}, "frozen"), "scores": ({"home_points": 3}, None, "pending_with_scores"),
        "early": ({**win, "graded_at": NOW - 20 * HOUR}, past, "settlement_time"), "other": ({**win, "result_at": NOW - 3 * HOUR}, past, "no_matching_observation"), "void": ({**win, "outcome": "void", "profit": 0.0}, past, "void_without_cause"),
        "changed": ({**win, "outcome": "void", "profit": 0.0, "game": "p", "settlement_reason": "schedule_change"}, {**past, "game": "p"}, None), "lost": ({**win, "outcome": "loss", "profit": -1.0}, past, "outcome_disagrees"),
        "wrong": ({**win, "home_points": 21}, past, "scores_not_confirmed"), "paid": ({**win, "profit": 0.9}, past, "profit_disagrees"), "none": ({**win, "status": "no_play", "profit": 0.0}, {**past, "status": "no_play"}, "outcome_of_no_decision"),
        "idle": ({**win, "status": "no_play", "outcome": "no_play", "profit": 0.0}, {**past, "status": "no_play"}, None), "receipt": ({"receipts": missing}, None, "missing_receipt"), "stale": ({"receipts": {**missing, "schedule": (NOW - 30 * HOUR, "h")}}, None, "stale_inputs"),
        "passer": ({"flags": {"home_expected_qb": "q"}}, None, "missing_passer"), "value": ({"ev": 0.2}, None, "value_disagrees"), "tie": ({**win, "market": "h2h", "point": None, "outcome": "push", "profit": 0.0, "game": "t", "home_points": 10}, {**past, "market": "h2h", "point": None, "game": "t"}, "tie_is_void"),
    }
    incoming = spark.createDataFrame([_row(n, **new) for n, (new, _, _) in cases.items()], COLUMNS)
    stored = spark.createDataFrame([_row(n, **old) for n, (_, old, _) in cases.items() if old is not None], COLUMNS)
    told = [("f", "final", True, 20, 10), ("p", "postponed", False, None, None), ("t", "final", True, 10, 10), ("g", "scheduled", False, None, None)]
    schedule = spark.createDataFrame([(g, NOW - 2 * HOUR, "H", "A", NOW - 5 * HOUR if g != "g" else NOW + HOUR, s, c, h, a) for g, s, c, h, a in told], "game string, observed_at timestamp, home_team string, away_team string, start timestamp, status string, completed boolean, home_points long, away_points long")
    got = {r["id"]: r["refusal"] for r in D.refused(incoming, stored, schedule, NOW).collect()}
    assert got == {n: why for n, (_, _, why) in cases.items()}

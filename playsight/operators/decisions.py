"""Decisions on offers: priced from the market's own devigged number, one reason each, and the rules a store of them keeps."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.market import devig, expected_value, implied, profit
from playsight.operators.ledger import balance, best_offer, first_reason, settled, settled_profit
from playsight.operators.selection import valid_offer
from playsight.operators.solvers import cut

# Pricing deviations, the model's weight against the market, slate, ages and search range.
MARGIN_SD, TOTAL_SD = 12.82, 13.28
SIDE_WEIGHT, TOTAL_WEIGHT = 0.0, 0.0
SLATE, LEAN_MARKETS = 5, ("h2h", "spreads")
OFFER_AGE, FORECAST_AGE = dt.timedelta(hours=1), dt.timedelta(days=7)
SEARCH, EDGE_SEARCH, RANGE = 60.0, 200.0, 100
MATCH = 0.95
SCHEDULE_AGE, LINEUP_AGE = dt.timedelta(hours=24), dt.timedelta(hours=48)
RECEIPTS = ("schedule", "depth_charts", "qb_overrides", "win_totals", "win_total_sources", "preseason_qbs")


def _cdf(x: np.ndarray) -> np.ndarray:
    """Student t with 7 degrees of freedom, in closed form."""
    theta = np.arctan(x / math.sqrt(7.0))
    cos = np.cos(theta)
    return 0.5 + (theta + np.sin(theta) * (cos + 2 / 3 * cos**3 + 8 / 15 * cos**5)) / math.pi


def _whole(mean: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(win, push) by whole margins of equal weight: their masses telescope, so the ends of a sum are enough.  A margin k wins where k + line > 0."""
    s = MARGIN_SD * math.sqrt(5 / 7)

    def up_to(k: np.ndarray) -> np.ndarray:
        return np.where(k < -RANGE, 0.0, np.where(k >= RANGE, 1.0, _cdf((k + 0.5 - mean) / s)))

    loses, even = np.floor(1e-9 - line), np.round(-line)
    tie = (np.abs(even + line) <= 1e-9) & (np.abs(even) <= RANGE)
    return 1.0 - up_to(loses), np.where(tie, up_to(even) - up_to(even - 1), 0.0)


def _chances(total: np.ndarray, up: np.ndarray, point: np.ndarray, mean: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(win, push) of offers, of arrays: totals by the rounded line, others by whole margins within RANGE, the tails folded in, weighted (None: equally) and made to sum to one."""
    s = TOTAL_SD * math.sqrt(5 / 7)
    over, under = _cdf((mean - np.floor(point) - 0.5) / s), _cdf((np.ceil(point) - 0.5 - mean) / s)
    tie = np.where(point == np.floor(point), np.maximum(0.0, 1.0 - over - under), 0.0)
    win, push = over, tie
    some = np.flatnonzero(~total)
    if weights is None:
        win[some], push[some] = _whole(mean[some], np.where(up, point, -point)[some])
        return np.where(up, win, 1.0 - win - push), push
    k = np.arange(-RANGE, RANGE + 1)
    steps = _cdf((k[:-1] + 0.5 - mean[some, None]) / (MARGIN_SD * math.sqrt(5 / 7)))
    mass = np.diff(np.concatenate([np.zeros((len(some), 1)), steps, np.ones((len(some), 1))], axis=1), axis=1) * weights
    mass /= mass.sum(axis=1, keepdims=True)
    edge = k + np.where(up, point, -point)[some, None]
    win[some], push[some] = (mass * (edge > 1e-9)).sum(1), (mass * (np.abs(edge) <= 1e-9)).sum(1)
    return np.where(up, win, 1.0 - win - push), push


def _arrays(market: pd.Series, side: pd.Series, point: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (market == "totals").to_numpy(), side.isin(["home", "over"]).to_numpy(), point.where(market != "h2h", 0.0).to_numpy(float)


def _root(share, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where share, increasing, is the target; NaN where it isn't between its ends."""
    with np.errstate(invalid="ignore"):
        inside = (share(low) <= target) & (share(high) >= target)
        for _ in range(36):
            mid = (low + high) / 2
            less = share(mid) < target
            low, high = np.where(less, mid, low), np.where(less, high, mid)
    return np.where(inside, (low + high) / 2, np.nan)


def _different(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of arrays, and the place of each row among them: prices and points come in steps, so a batch has few."""
    rows, place = np.unique(np.column_stack([np.asarray(c, float) for c in columns]), axis=0, return_inverse=True)
    return list(rows.T), place.ravel()


def _priced(weights: list[float] | None):
    """Vectorised functions over Arrow batches: the chances of an offer, the mean that gives it a fair share, and the shift that takes its edge."""
    w = None if weights is None else np.asarray(weights, float)

    def share(arrays, mean):
        win, push = _chances(*arrays, mean, w)
        return win / (1.0 - push)

    @F.pandas_udf("struct<win:double,push:double,loss:double>")
    def chances(market: pd.Series, side: pd.Series, point: pd.Series, mean: pd.Series) -> pd.DataFrame:
        win, push = _chances(*_arrays(market, side, point), mean.to_numpy(float), w)
        return pd.DataFrame({"win": win, "push": push, "loss": 1.0 - win - push})

    @F.pandas_udf("double")
    def fair_mean(market: pd.Series, side: pd.Series, point: pd.Series, fair: pd.Series) -> pd.Series:
        (total, up, line, target), place = _different(*_arrays(market, side, point), fair.to_numpy(float))
        a = total > 0, up > 0, line
        base = np.where(a[0], line, -line)
        return pd.Series(_root(lambda m: share(a, m), target, base - SEARCH, base + SEARCH)[place])

    @F.pandas_udf("double")
    def shift(market: pd.Series, side: pd.Series, point: pd.Series, mean: pd.Series, even: pd.Series) -> pd.Series:
        (total, up, line, m, target), place = _different(*_arrays(market, side, point), mean.to_numpy(float), even.to_numpy(float))
        a = total > 0, up > 0, line
        way, ends = np.where(a[1], -1.0, 1.0), np.full(len(m), EDGE_SEARCH)
        return pd.Series(_root(lambda delta: -share(a, m + way * delta), -target, -ends, ends)[place])

    return chances, fair_mean, shift


def market_centers(offers: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(game, market, first, second): the means at which books' devigged two-way prices are fair, median over books, for the one who backs
    the first side (home, over) and for the one who backs the other.

    A pair is two valid offers of one book with mirrored points and the same update.  The backed side takes the larger
    part of the margin: the lower of the proportional and the equal split.
    """
    o = offers.where(valid_offer(F.col("market"), F.col("side"), F.col("point"), F.col("price")))
    up = o.where("side in ('home', 'over')")
    down = o.where("side in ('away', 'under')").groupBy("game", "market", "book", "updated", F.when(F.col("market") == "spreads", -F.col("point")).otherwise(F.col("point")).alias("_p")).agg(F.max("price").alias("_price"))
    pair = up.join(down, ["game", "market", "book", "updated"]).where(F.col("point").eqNullSafe(F.col("_p")))
    mine, theirs = implied(F.col("price")), implied(F.col("_price"))
    pair = pair.select("game", "market", "side", "point", devig(mine, theirs, F.lit(True)).alias("_low"), devig(mine, theirs, F.lit(False)).alias("_high"))
    root = lambda fair: F.nanvl(_priced(weights)[1]("market", "side", "point", fair), F.lit(None))
    rows = pair.select("game", "market", root("_low").alias("first"), root("_high").alias("second"))
    return rows.groupBy("game", "market").agg(F.percentile("first", 0.5).alias("first"), F.percentile("second", 0.5).alias("second"))


def offer_reason(now: Column) -> Column:
    """Why an offer can't be taken, first failing rule; `_paired` says that its other side is quoted with it."""
    c = F.col
    return first_reason([
        ("unverified_book_availability", ~c("verified")), ("unverified_source", c("event").isNull() | (c("event") == "") | ~F.coalesce(c("source").isin("api", "feed"), F.lit(False))),
        ("kickoff_mismatch", ~c("offer_start").eqNullSafe(c("start"))), ("missing_provider", c("book").isNull() | (c("book") == "")),
        ("uncertain_game_match", ~F.coalesce(c("match").between(MATCH, 1.0), F.lit(False))), ("missing_price_timestamp", c("fetched").isNull() | c("updated").isNull()),
        ("in_play_offer", (c("fetched") >= c("start")) | (c("updated") >= c("start"))), ("stale_price", ~((c("updated") <= c("fetched")) & (c("fetched") <= now)) | (now - c("updated") > F.lit(OFFER_AGE))), ("unpaired_market", c("_paired").isNull()),
    ])


def decisions(projections: DataFrame, offers: DataFrame, now: dt.datetime, weights: list[float] | None = None, picked: DataFrame | None = None) -> DataFrame:
    """One row a game and market of projections that are pregame at `now`: the best offer with its price's value, a reason, and what is recommended.

    projections: (game, start, as_of, home_margin, pure_margin, model_total, margin_sd, total_sd, home_missing, away_missing, input_reason).
    offers: (game, market, side, point, price, book, updated, fetched, event, source, offer_start, verified, match).
    Each side is priced at the market number least favourable to it, moved toward the model by its weight; an offer
    that is blocked never hides one that isn't.  Offers of positive value are picks; the slate is filled to SLATE
    games, counting `picked` (game), with the best other sides, one a game.
    """
    at = F.lit(now)
    model = (F.col("margin_sd") > 0) & (F.col("total_sd") > 0) & ~F.isnan("margin_sd") & ~F.isnan("total_sd") & ~F.isnan("home_margin") & ~F.isnan("model_total")
    game_reason = first_reason([("stale_forecast", at - F.col("as_of") > F.lit(FORECAST_AGE)), ("invalid_model_distribution", ~F.coalesce(model, F.lit(False))), ("missing_model_inputs", ~F.coalesce((F.col("home_missing") == 0) & (F.col("away_missing") == 0), F.lit(False)))])
    games = projections.where((F.col("as_of") <= at) & (at < F.col("start"))).withColumn("_game_reason", F.coalesce(game_reason, F.col("input_reason")))
    every = games.withColumn("market", F.explode(F.array(*[F.lit(m) for m in ("h2h", "spreads", "totals")])))
    centers = market_centers(offers.join(games.select("game"), "game"), weights)
    moved = lambda c: F.when(F.col("market") == "totals", F.col(c) + TOTAL_WEIGHT * (F.col("model_total") - F.col(c))).otherwise(F.col(c) + SIDE_WEIGHT * (F.col("pure_margin") - F.col(c)))
    priced = cut(every.join(centers, ["game", "market"], "left").withColumn("_first", moved("first")).withColumn("_second", moved("second")))
    valid = offers.where(valid_offer(F.col("market"), F.col("side"), F.col("point"), F.col("price")))
    other = F.when(F.col("side") == "home", "away").when(F.col("side") == "away", "home").when(F.col("side") == "over", "under").otherwise("over")
    keys = ["game", "market", "book", "event", "offer_start", "updated", "fetched"]
    mirror = valid.select(*keys, other.alias("side"), F.when(F.col("market") == "spreads", -F.col("point")).otherwise(F.col("point")).alias("point")).distinct()
    name = {c: f"_m_{c}" for c in mirror.columns}
    same = None
    for c, m in name.items():
        test = F.col(c).eqNullSafe(F.col(m))
        same = test if same is None else same & test
    valid = valid.join(mirror.withColumnsRenamed(name), same, "left").withColumn("_paired", F.col("_m_game")).drop(*name.values())
    o = valid.join(priced.where("_first is not null and _second is not null").select("game", "market", "start", "_first", "_second", "_game_reason"), ["game", "market"])
    mean = F.when(F.col("side").isin("home", "over"), F.col("_first")).otherwise(F.col("_second"))
    o = o.withColumn("priced_mean", mean).withColumn("_q", _priced(weights)[0]("market", "side", "point", "priced_mean"))
    o = o.withColumn("ev", expected_value(F.col("_q.win"), F.col("_q.loss"), F.col("price"))).withColumn("edge", F.try_divide("_q.win", F.col("_q.win") + F.col("_q.loss")) - implied(F.col("price")))
    sound = F.coalesce((F.col("_q.win") > 0) & (F.col("_q.win") < 1) & (F.col("_q.loss") > 0) & ~F.isnan("ev"), F.lit(False))
    o = o.withColumn("_block", F.when(~sound, "invalid_probability").otherwise(F.coalesce("_game_reason", offer_reason(at)))).withColumn("ev", F.when(sound, F.col("ev")).otherwise(float("-inf")))
    o = o.where(~F.coalesce(F.col("_game_reason") == "invalid_model_distribution", F.lit(False)))
    best = best_offer(o, ["game", "market"], [F.col("_block").isNull().desc(), F.desc("ev"), F.desc("book"), "side", "price", "point"])
    best = best.withColumn("edge_points", F.nanvl(_priced(weights)[2]("market", "side", "point", "priced_mean", implied(F.col("price"))), F.lit(None)))
    best = best.select("game", "market", "side", "point", "price", "book", "priced_mean", F.col("_q.win").alias("win"), F.col("_q.push").alias("push"), "edge", "edge_points", "ev", F.coalesce("_block", F.when(F.col("edge_points").isNull(), "invalid_probability"), F.lit("outside_slate")).alias("_reason"))
    empty = F.coalesce("_game_reason", F.when(F.col("_first").isNull() | F.col("_second").isNull(), "missing_market_line").otherwise("no_valid_price"))
    rows = priced.join(best, ["game", "market"], "left").withColumn("reason", F.coalesce("_reason", empty)).select("game", "market", "start", "side", "point", "price", "book", "priced_mean", "win", "push", "edge", "edge_points", "ev", "reason")
    return _recommended(cut(rows), picked)


def _recommended(rows: DataFrame, picked: DataFrame | None) -> DataFrame:
    value = (F.col("reason") == "outside_slate") & (F.col("ev") > 0)
    taken = rows.where(value).select("game").distinct()
    if picked is not None:
        taken = taken.unionByName(picked.select("game")).distinct()
    rest = rows.where((F.col("reason") == "outside_slate") & ~value & F.col("market").isin(*LEAN_MARKETS)).join(taken, "game", "left_anti")
    top = best_offer(rest, ["game"], [F.desc("ev"), "market"]).orderBy(F.desc("ev"), "game").limit(SLATE)  # a slate's few rows
    room = taken.agg(F.greatest(F.lit(0), F.lit(SLATE) - F.count(F.lit(1))).alias("_room"))
    leans = top.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("ev"), "game"))).crossJoin(F.broadcast(room)).where("_n <= _room").select("game", "market", F.lit(True).alias("_lean"))
    out = rows.join(leans, ["game", "market"], "left")
    reason = F.when(value, "positive_ev").when(F.col("_lean"), "ranked_lean").otherwise(F.col("reason"))
    status = F.when(reason.isin("positive_ev", "ranked_lean"), "recommended").otherwise("no_play")
    return out.select(*[c for c in rows.columns if c != "reason"], reason.alias("reason"), status.alias("status"), F.when(status == "recommended", 1.0).otherwise(0.0).alias("stake"))


#: What may change in a published row: its settlement.
SETTLEMENT = ("outcome", "home_points", "away_points", "profit", "graded_at", "settlement_reason", "result_at")


def refused(incoming: DataFrame, stored: DataFrame, schedule: DataFrame, now: dt.datetime) -> DataFrame:
    """incoming with `refusal`: the first rule of the ledger that a row breaks, NULL where it may be written.

    incoming and stored: one row an id (id, game, market, side, point, price, status, outcome, start, home_team, away_team, published_at,
    forecast_at, win, push, ev, edge, receipts map<string,struct<observed_at,sha256>>, flags map<string,string>, and SETTLEMENT);
    schedule: the confirmed observation of each game (game, observed_at, home_team, away_team, start, status, completed, home_points, away_points).
    A store writes what is not refused; nothing is ever deleted.
    """
    at, c = F.lit(now), F.col
    fixed = [x for x in incoming.columns if x not in SETTLEMENT and x != "published_at"]
    old = stored.select("id", F.lit(True).alias("_old"), F.col("outcome").alias("_outcome"), F.col("status").alias("_status"), F.col("start").alias("_start"), F.to_json(F.struct(*fixed)).alias("_fixed"), F.to_json(F.struct(*[x for x in incoming.columns if x != "published_at"])).alias("_all"))
    told = schedule.select("game", *[F.col(x).alias(f"_r_{x}") for x in ("observed_at", "home_team", "away_team", "start", "status", "completed", "home_points", "away_points")])
    rows = incoming.join(old, "id", "left").join(told, "game", "left")
    new = c("_old").isNull()
    yes = lambda x: F.coalesce(x, F.lit(False))
    done = c("outcome") != "pending"
    margin, total = c("home_points") - c("away_points"), c("home_points") + c("away_points")
    won_by = balance(c("market"), c("side"), margin.cast("double"), total.cast("double"), c("point"))
    result = settled(c("market"), won_by, F.lit(True), F.lit(False))
    moved = (c("settlement_reason") == "schedule_change") & ((c("_r_start") != c("start")) | c("_r_status").isin("canceled", "cancelled", "postponed"))
    tied = (c("settlement_reason") == "moneyline_tie") & (c("market") == "h2h") & c("_r_completed") & (c("_r_home_points") == c("_r_away_points")) & (c("_r_start") == c("start")) & (c("graded_at") >= c("start"))
    matching = (c("_r_observed_at") == c("result_at")) & (c("_r_observed_at") <= c("graded_at")) & (c("_r_home_team") == c("home_team")) & (c("_r_away_team") == c("away_team"))
    final = c("_r_completed") & (c("_r_start") == c("start")) & (c("_r_home_points") == c("home_points")) & (c("_r_away_points") == c("away_points")) & (c("settlement_reason") == "confirmed_final") & (c("graded_at") >= c("start"))
    graded = c("outcome").isin("win", "loss", "push")
    owed = F.when(c("outcome").isin("void", "no_play"), 0.0).otherwise(settled_profit(c("outcome"), c("price")))
    pick = ~done & (c("status") == "recommended")
    seen = lambda x: F.try_element_at(c("receipts"), F.lit(x))
    receipts = [yes((seen(x)["observed_at"] <= c("forecast_at")) & seen(x)["sha256"].isNotNull()) for x in RECEIPTS]
    held = receipts[0]
    for x in receipts[1:]:
        held = held & x
    fresh = (c("published_at") - seen("schedule")["observed_at"] <= F.lit(SCHEDULE_AGE)) & (c("published_at") - seen("depth_charts")["observed_at"] <= F.lit(LINEUP_AGE))
    flag = lambda x: F.try_element_at(c("flags"), F.lit(x))
    passer = F.lit(True)
    for side in ("home", "away"):
        when = flag(f"{side}_qb_source_at").try_cast("timestamp")
        passer = passer & yes((flag(f"{side}_expected_qb") != "") & (when <= c("forecast_at")) & (c("published_at") - when <= F.lit(LINEUP_AGE)))
    gain = profit(c("price"))
    sums = yes((F.abs(c("ev") - (c("win") * gain - (1 - c("win") - c("push")))) < 1e-10) & (F.abs(c("edge") - (c("win") / (1 - c("push")) - 1 / (1 + gain))) < 1e-10))
    everything, unmoved = F.to_json(F.struct(*[x for x in incoming.columns if x != "published_at"])), F.to_json(F.struct(*fixed))
    rules = [
        ("started_game", new & (yes(c("start") <= at) | yes(c("_r_completed")))), ("new_is_pending", new & done),
        ("settled_is_final", ~new & (c("_outcome") != "pending") & ~everything.eqNullSafe(c("_all"))), ("frozen", ~new & ((c("_status") == "recommended") | (c("_start") <= at)) & ~unmoved.eqNullSafe(c("_fixed"))),
        ("pending_with_scores", ~done & (c("home_points").isNotNull() | c("away_points").isNotNull())), ("settlement_time", done & ~yes((c("graded_at") >= c("published_at")) & (c("graded_at") <= at))),
        ("no_matching_observation", done & ~yes(matching)), ("void_without_cause", (c("outcome") == "void") & ~yes(moved | tied)), ("before_kickoff", (c("outcome") == "no_play") & (c("status") == "no_play") & ~yes(c("graded_at") >= c("start"))),
        ("outcome_of_no_decision", done & ~(c("outcome") == "void") & ~((c("outcome") == "no_play") & (c("status") == "no_play")) & ~(graded & (c("status") == "recommended"))), ("scores_not_confirmed", graded & ~yes(final)),
        ("tie_is_void", graded & (c("market") == "h2h") & yes(won_by == 0)), ("outcome_disagrees", graded & ~yes(c("outcome") == result)), ("profit_disagrees", done & ~yes(F.abs(c("profit") - owed) < 1e-10)),
        ("missing_receipt", pick & ~held), ("stale_inputs", pick & ~yes(fresh)), ("missing_passer", pick & ~passer), ("value_disagrees", pick & ~sums),
    ]
    return rows.select(*incoming.columns, first_reason(rules).alias("refusal"))

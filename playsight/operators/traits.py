"""The trait registry: each trait is a declared ratio over an athlete's games, opponents and seasons.

Plays (columns PLAY, NULL where a play has none) become role rows: who of the offense is credited with a play, and
with which share.  One aggregation makes a row per athlete and game of them; priors (league, team, receiver)
and what others of the same game did are joined to these rows, never to plays.  Defenders have a row for each
game they were present in, counts or none.  An event is (season, week, game, team, opponent, athlete, trait, n, d);
only athletes of a trait's groups have any.  Adjusted traits are taken against what the opponent allowed
before in the season, and `values` aggregates each trait by its rule, season by season.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import safe_div
from playsight.operators.ratio import dispatch, leave_one_out
from playsight.operators.windows import prior_median

PLAY = (
    "season week game team opponent kind qtr down togo yardline yards epa adj_epa wpa success cpoe complete interception sack hit "
    "fumble fumble_lost fumbler quarter_left passer receiver rusher defender kicker yac xyac made distance tackle solo tfl forced defended "
    "return_yards return_touchdown return_fumble"
).split()
KEYS = ["season", "week", "game", "team", "opponent", "athlete"]

# Fixed values of the definitions: downs, yards, seconds, floors and weights.
LATE_DOWN = "down in (3, 4)"
SHORT = f"((togo <= 2 and {LATE_DOWN}) or yardline <= 3)"
TWO_MINUTE = "(qtr in (2, 4) and quarter_left <= 120)"
CARRY = "role = 'rusher' and yards is not null"
EXPLOSIVE, BREAKAWAY, FLOOR_DROPBACKS, OTHER_DROPBACKS, OTHER_TARGETS = 20, 10, 10, 30.0, 10.0
#: Weight of a defensive role, in order of priority: an athlete has one role a play.
DEFENSE_WEIGHTS = {"sack = 1": 0.96, "interception = 1": 1.48, "forced = 1": 1.08, "defended = 1": 1.90, "tfl = 1": 0.58, "hit = 1": 1.34, "tackle = 1 and epa < 0": 0.55}
RETURN_EPA = {"return_yards": -0.0643, "return_touchdown": -0.851, "return_fumble": 5.218}
WITH_WITHOUT_GAMES, LEAST_PRESENT = 6.0, 3
LINE_YARDS = "case when yards < 0 then 1.2 * yards when yards <= 4 then yards when yards <= 10 then 4 + 0.5 * (yards - 4) else 7 end"


@dataclass(frozen=True)
class Trait:
    """n and d: SQL over role rows (summed where `where` holds), or over the columns of a row per game where `source` names one."""

    name: str
    groups: tuple[str, ...]
    n: str
    d: str = "1"
    where: str = "true"
    source: str = "rows"
    rule: str = "rate"
    adjusted: bool = False
    #: leave-one-out against the others of the same values here
    relative: tuple[str, ...] = ()
    #: the others: of the trait's groups, or all
    among_group: bool = True


_QB, _RB, _RECEIVERS, _FRONT, _DEFENSE = ("QB",), ("RB",), ("WR", "TE"), ("DL", "LB"), ("DL", "LB", "DB")
_EXPLOSIVE = f"case when complete = 1 and yards >= {EXPLOSIVE} then 1 else 0 end"
REGISTRY: tuple[Trait, ...] = (
    Trait("epa.credit", ("QB", "RB", "WR", "TE", "DL", "LB", "DB"), "credit", source="credits"),
    Trait("qb.drive_engine", _QB, "success - expected", where=f"role in ('passer', 'rusher') and ({LATE_DOWN} or {TWO_MINUTE})", adjusted=True),
    Trait("qb.explosive", _QB, _EXPLOSIVE, where="role = 'passer'", adjusted=True),
    Trait("qb.accuracy", _QB, "cpoe", where="role = 'passer' and cpoe is not null", adjusted=True),
    Trait("qb.ball_security", _QB, "qb_cost", "dropbacks", "dropbacks > 0", "games", adjusted=True),
    Trait("qb.floor", _QB, "dropback_value / dropbacks", "1", f"dropbacks >= {FLOOR_DROPBACKS}", "games", rule="quantile20"),
    Trait("qb.legs", _QB, "success - expected", where="role = 'rusher'", adjusted=True),
    Trait("qb.pressure_handling", _QB, "dropbacks * sack_base - sacks", "dropbacks", "dropbacks > 0", "games", adjusted=True),
    Trait("qb.receiver_independence", _QB, "over", "targets", "targets > 0", "throws"),
    Trait("rb.yards_over_expected", _RB, "yards - expected_yards", where=CARRY, adjusted=True),
    Trait("rb.stuff_avoidance", _RB, "case when yards <= 0 then -1 else 0 end", where=CARRY, relative=("game", "team")),
    Trait("rb.breakaway", _RB, f"case when yards >= {BREAKAWAY} then 1 else 0 end", where=CARRY, adjusted=True),
    Trait("rb.short_yardage", _RB, "success - expected", where=f"{CARRY} and {SHORT}", adjusted=True),
    Trait("rb.receiving", _RB, "value", where="role = 'receiver'"),
    Trait("rb.ball_security", _RB, "fumble_cost", "touches", "touches > 0", "games", adjusted=True),
    Trait("rb.line_independence", _RB, "value", where=CARRY, relative=("game", "team")),
    Trait("rec.target_share", _RECEIVERS, "own_targets", "team_targets", "team_targets > 0 and appeared > 0", "games"),
    Trait("rec.value_per_target", _RECEIVERS, "value", where="role = 'receiver'"),
    Trait("rec.explosive", _RECEIVERS, _EXPLOSIVE, where="role = 'receiver'", adjusted=True),
    Trait("rec.late_down", _RECEIVERS, "success - expected", where=f"role = 'receiver' and {LATE_DOWN}", adjusted=True),
    Trait("rec.yac_over_expected", _RECEIVERS, "yac - xyac", where="role = 'receiver' and complete = 1 and yac is not null and xyac is not null", adjusted=True),
    Trait("rec.qb_independence", _RECEIVERS, "value", where="role = 'receiver'", relative=("game", "passer"), among_group=False),
    Trait("def.havoc", _DEFENSE, "tfl + forced + defended + interceptions", source="defenders", adjusted=True),
    Trait("def.pass_rush", _FRONT, "sack_wpa + case when hits > 0 then hits * sack_price else 0 end", source="defenders"),
    Trait("def.finishing", _FRONT, "sacks", "sacks + hits", "sacks + hits > 0", "defenders"),
    Trait("def.run_stop", _FRONT, "greatest(tfl - sacks, 0)", source="defenders", adjusted=True),
    Trait("def.stops", _DEFENSE, "stops", source="defenders", adjusted=True),
    Trait("def.every_week", _DEFENSE, "case when greatest(tfl, sacks, defended, interceptions, forced) > 0 then 1 else 0 end", source="defenders", rule="share"),
    Trait("def.tackle_share", ("LB",), "tackles", "team_tackles", "team_tackles > 0", "defenders"),
    Trait("def.coverage", ("LB",), "defended + interceptions", source="defenders", adjusted=True),
    Trait("def.ball_production", ("DB",), "interceptions + defended", source="defenders", adjusted=True),
    Trait("def.run_support", ("DB",), "solo", source="defenders", adjusted=True),
    Trait("def.impact", _DEFENSE, "impact", source="impact", rule="latest"),
    Trait("def.pass_impact", ("DB",), "pass_impact", source="impact", rule="latest"),
    Trait("ol.protection", ("OL",), "dropbacks * pressure_base - pressures", "dropbacks", "dropbacks > 0", "units", adjusted=True),
    Trait("ol.stuff_rate", ("OL",), "-stuffs", "carries", "carries > 0", "units", adjusted=True),
    Trait("ol.short_yardage", ("OL",), "short_over", "shorts", "shorts > 0", "units", adjusted=True),
    Trait("ol.line_yards", ("OL",), "line_yards", "carries", "carries > 0", "units", adjusted=True),
    Trait("k.field_goal", ("K",), "made_over", "kicks", "kicks > 0", "kickers"),
    Trait("p.punt_average", ("P",), "gross - gross_punts * gross_base", "gross_punts", "gross_punts > 0", "kickers"),
    Trait("p.punt_epa", ("P",), "punt_value - punts * value_base", "punts", "punts > 0", "kickers"),
)


def distance_bucket(togo: str = "togo") -> str:
    return f"case when {togo} <= 2 then '1-2' when {togo} <= 6 then '3-6' when {togo} <= 10 then '7-10' else '11+' end"


def prior_season_means(plays: DataFrame, bucket: list[Column], values: dict[str, str]) -> DataFrame:
    """Mean of each value per bucket over strictly earlier seasons; keyed by season and the bucket columns."""
    names = [f"_b{k}" for k in range(len(bucket))]
    sums = plays.select("season", *[c.alias(n) for c, n in zip(bucket, names, strict=True)], *[F.expr(v).cast("double").alias(f"v_{k}") for k, v in values.items()])
    per = sums.groupBy("season", *names).agg(*[F.sum(f"v_{k}").alias(f"s_{k}") for k in values], *[F.count(f"v_{k}").alias(f"c_{k}") for k in values])
    earlier = W.partitionBy(*names).orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    return per.select("season", *names, *[safe_div(F.sum(f"s_{k}").over(earlier), F.sum(f"c_{k}").over(earlier).cast("double")).alias(k) for k in values])


def with_expectations(plays: DataFrame) -> DataFrame:
    """plays with `expected`, `expected_yards` and `expected_made`: means of earlier seasons by bucket, else by kind.

    The tables have a row a season and bucket, whatever the number of plays, and are broadcast: plays are wide, and a bucket holds many.
    """
    scrimmage = plays.where("kind in ('pass', 'run')")
    table = prior_season_means(scrimmage, [F.col("kind"), F.col("down"), F.expr(distance_bucket())], {"b_success": "success", "b_yards": "yards"}).toDF("season", "kind", "down", "_k1", "b_success", "b_yards")
    whole = prior_season_means(scrimmage, [F.col("kind")], {"a_success": "success", "a_yards": "yards"}).toDF("season", "kind", "a_success", "a_yards")
    made = prior_season_means(plays.where("kind = 'field_goal'"), [F.expr("5 * floor(distance / 5)")], {"expected_made": "made"}).toDF("season", "_m", "expected_made")
    out = plays.withColumn("_k1", F.expr(distance_bucket())).withColumn("_m", F.expr("5 * floor(distance / 5)"))
    out = out.join(F.broadcast(table), ["season", "kind", "down", "_k1"], "left").join(F.broadcast(whole), ["season", "kind"], "left").join(F.broadcast(made), ["season", "_m"], "left")
    return out.withColumn("expected", F.coalesce("b_success", "a_success")).withColumn("expected_yards", F.coalesce("b_yards", "a_yards")).drop("_k1", "_m", "b_success", "a_success", "b_yards", "a_yards")


def role_rows(plays: DataFrame) -> DataFrame:
    """plays, a row for each credited athlete: role, athlete, share and value (share of the adjusted, else raw, EPA).

    Passer and receiver share a pass, the passer has it alone without a receiver or when intercepted; a run is its
    runner's; a lost fumble its fumbler's alone.  Every fumble also gives a row `fumbled` that shares in nothing.
    """
    who = lambda role, column, share: F.when(F.col(column).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(column).alias("athlete"), share.cast("double").alias("share")))
    tagged = F.col("receiver").isNotNull() & (F.col("interception") != 1)
    lost = (F.col("fumble_lost") == 1) & F.col("fumbler").isNotNull()
    passing = F.array(who("passer", "passer", F.when(tagged, 0.5).otherwise(1.0)), F.when(tagged, who("receiver", "receiver", F.lit(0.5))))
    shared = F.when(lost, F.array(who("fumbler", "fumbler", F.lit(1.0)))).when(F.col("kind") == "run", F.array(who("rusher", "rusher", F.lit(1.0)))).otherwise(passing)
    every = F.array_compact(F.concat(shared, F.array(F.when(F.col("fumble") == 1, who("fumbled", "fumbler", F.lit(0.0))))))
    rows = plays.where("kind in ('pass', 'run')").withColumn("x", F.explode(every))
    return rows.select("*", "x.role", "x.athlete", "x.share").drop("x").withColumn("value", F.col("share") * F.coalesce("adj_epa", "epa"))


def _sum(where: str, value: str = "1") -> Column:
    return F.coalesce(F.sum(F.expr(f"case when {where} then cast({value} as double) end")), F.lit(0.0))


def _before(per_game: DataFrame, keys: list[str], columns: list[str], suffix: str) -> DataFrame:
    """Sums of columns over strictly earlier weeks of the season, for each week that keys have a game in."""
    weekly = per_game.groupBy("season", *keys, "week").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = W.partitionBy("season", *keys).orderBy("week").rowsBetween(W.unboundedPreceding, -1)
    return weekly.select("season", *keys, "week", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}{suffix}") for c in columns])


def offense_games(rows: DataFrame) -> DataFrame:
    """A row per athlete and game of role rows: what the traits of source `games` need, with the sack rate to compare with."""
    per = rows.groupBy(*KEYS).agg(
        _sum("role = 'passer'").alias("dropbacks"), _sum("role = 'passer'", "sack").alias("sacks"), _sum("role = 'passer'", "value").alias("dropback_value"),
        (_sum("role = 'passer' and interception = 1", "wpa") + _sum("role = 'fumbled'", "wpa")).alias("qb_cost"), _sum("role = 'fumbled'", "wpa").alias("fumble_cost"),
        _sum(f"({CARRY}) or role = 'receiver'").alias("touches"), _sum("role = 'receiver'").alias("own_targets"), _sum("role <> 'fumbled'").alias("appeared"),
    )
    per = per.withColumn("team_targets", F.sum("own_targets").over(W.partitionBy("season", "game", "team")))
    counts, passing = ["dropbacks", "sacks"], per.where("dropbacks > 0")
    team, own, league = (_before(passing, keys, counts, f"_{name}") for keys, name in ((["team"], "team"), (["team", "athlete"], "own"), ([], "league")))
    per = per.join(league, ["season", "week"], "left").join(team, ["season", "team", "week"], "left").join(own, ["season", "team", "athlete", "week"], "left")
    others = F.coalesce("dropbacks_team", F.lit(0.0)) - F.coalesce("dropbacks_own", F.lit(0.0))
    base = F.when(others >= OTHER_DROPBACKS, (F.col("sacks_team") - F.coalesce("sacks_own", F.lit(0.0))) / others).otherwise(safe_div("sacks_league", "dropbacks_league"))
    return per.withColumn("sack_base", base)


def throws(rows: DataFrame) -> DataFrame:
    """A row per passer and game: value over each receiver's earlier rate with other passers, where that has enough targets."""
    pairs = rows.where("role = 'receiver' and sack = 0 and passer is not null").groupBy(*KEYS[:-1], "passer", "athlete").agg(F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("t"))
    receiver = _before(pairs, ["athlete"], ["v", "t"], "_all")
    pair = _before(pairs, ["athlete", "passer"], ["v", "t"], "_pair")
    both = pairs.join(receiver, ["season", "athlete", "week"]).join(pair, ["season", "athlete", "passer", "week"])
    rest = F.col("t_all") - F.col("t_pair")
    over = F.when(rest >= OTHER_TARGETS, F.col("v") - F.col("t") * (F.col("v_all") - F.col("v_pair")) / rest)
    both = both.withColumn("over", over).withColumn("targets", F.when(F.col("over").isNotNull(), F.col("t")))
    return both.groupBy(*KEYS[:-1], F.col("passer").alias("athlete")).agg(F.sum("over").alias("over"), F.sum("targets").alias("targets"))


def credits(rows: DataFrame, plays: DataFrame) -> DataFrame:
    """A row per credited athlete and game: the offense's values, and minus the play's for a defender by the weight of the first role that holds."""
    offense = rows.where("role <> 'fumbled'").select(*KEYS, F.col("value").alias("credit"))
    weight = reduce(lambda w, x: w.when(F.expr(x[0]), x[1]), list(DEFENSE_WEIGHTS.items())[1:], F.when(F.expr(next(iter(DEFENSE_WEIGHTS))), next(iter(DEFENSE_WEIGHTS.values()))))
    defense = plays.where("kind in ('pass', 'run') and defender is not null").withColumn("w", weight).where("w is not null")
    defense = defense.select("season", "week", "game", F.col("opponent").alias("team"), F.col("team").alias("opponent"), F.col("defender").alias("athlete"), (-F.coalesce("adj_epa", "epa") * F.col("w")).alias("credit"))
    return offense.unionByName(defense).groupBy(*KEYS).agg(F.sum("credit").alias("credit"))


def defender_games(plays: DataFrame, presence: DataFrame) -> DataFrame:
    """A row per defender and game present (KEYS of presence): counts, zero where there are none, and the price of a hit.

    The price is the median win probability that sacks of earlier weeks of the season swung.
    """
    flags = {"tfl": "tfl", "forced": "forced", "defended": "defended", "interceptions": "interception", "sacks": "sack", "hits": "hit", "solo": "solo", "tackles": "tackle"}
    rows = plays.where("defender is not null").withColumnsRenamed({"team": "_offense", "opponent": "team"}).withColumn("athlete", F.col("defender"))
    stops = _sum("kind in ('pass', 'run') and epa < 0 and (tackle = 1 or tfl = 1 or sack = 1)").alias("stops")
    box = rows.groupBy("season", "game", "team", "athlete").agg(*[_sum("true", c).alias(k) for k, c in flags.items()], _sum("sack = 1", "abs(wpa)").alias("sack_wpa"), stops)
    team = box.groupBy("season", "game", "team").agg(F.sum("tackles").alias("team_tackles"))
    sacks = plays.where("sack = 1").select("season", "week", F.abs("wpa").alias("wpa"))
    price = prior_median(sacks, "season", "week", "wpa", presence.select("season", "week")).withColumnRenamed("median", "sack_price")
    counts = [*flags, "sack_wpa", "stops"]
    out = presence.select(*KEYS).join(box, ["season", "game", "team", "athlete"], "left").fillna(0.0, counts)
    return out.join(team, ["season", "game", "team"], "left").join(price, ["season", "week"], "left")


def impact(plays: DataFrame, presence: DataFrame) -> DataFrame:
    """A row per defender and week: with/without of the EPA a play his team allowed through that week, all and passing.

    (mean absent - mean present) * p a / (p a + 6) with p >= 3 games present and a > 0 missed, over all completed
    games of the teams he was present for.
    """
    unit = plays.where("kind in ('pass', 'run')").groupBy("season", "week", "game", F.col("opponent").alias("team"), F.col("team").alias("opponent")).agg(F.avg("epa").alias("v"), F.avg(F.expr("case when kind = 'pass' then epa end")).alias("pv"))
    mine = presence.select("season", "team", "athlete").distinct()
    there = presence.select("season", "game", "team", "athlete", F.lit(True).alias("here"))
    grid = mine.join(unit, ["season", "team"]).join(there, ["season", "game", "team", "athlete"], "left")
    sums = [(f"{kind}{k}", F.sum(F.expr(f"case when here is {'not null' if k == 'p' else 'null'} and {c} is not null then {v} end"))) for kind, c in (("", "v"), ("q", "pv")) for k in ("p", "a") for v in (c,)]
    counts = [(f"{kind}n{k}", F.count(F.expr(f"case when here is {'not null' if k == 'p' else 'null'} and {c} is not null then 1 end"))) for kind, c in (("", "v"), ("q", "pv")) for k in ("p", "a")]
    weekly = grid.groupBy("season", "athlete", "week").agg(F.max("team").alias("team"), F.max("opponent").alias("opponent"), *[e.alias(n) for n, e in sums + counts])
    run = W.partitionBy("season", "athlete").orderBy("week").rowsBetween(W.unboundedPreceding, 0)

    def shrunk(kind: str) -> Column:
        p, a = (F.sum(f"{kind}n{k}").over(run).cast("double") for k in ("p", "a"))
        gap = F.sum(f"{kind}a").over(run) / F.nullif(a, F.lit(0.0)) - F.sum(f"{kind}p").over(run) / F.nullif(p, F.lit(0.0))
        return F.when((p >= LEAST_PRESENT) & (a > 0), gap * (p * a) / (p * a + WITH_WITHOUT_GAMES))

    return weekly.select("season", "week", F.lit(None).cast("long").alias("game"), "team", "opponent", "athlete", shrunk("").alias("impact"), shrunk("q").alias("pass_impact"))


def unit_games(rows: DataFrame) -> DataFrame:
    """A row per team and game of role rows, as the athlete of its line, with the league's earlier pressure rate."""
    per = rows.groupBy(*KEYS[:-1]).agg(
        _sum("role = 'passer'").alias("dropbacks"), _sum("role = 'passer' and (sack = 1 or hit = 1)").alias("pressures"), _sum(CARRY).alias("carries"), _sum(f"{CARRY} and yards <= 0").alias("stuffs"),
        _sum(f"{CARRY} and {SHORT} and expected is not null").alias("shorts"), _sum(f"{CARRY} and {SHORT}", "success - expected").alias("short_over"), _sum(CARRY, LINE_YARDS).alias("line_yards"),
    )
    per = per.join(_before(per.where("dropbacks > 0"), [], ["dropbacks", "pressures"], "_league"), ["season", "week"], "left")
    return per.withColumn("pressure_base", safe_div("pressures_league", "dropbacks_league")).withColumn("athlete", F.col("team"))


def kicker_games(plays: DataFrame) -> DataFrame:
    """A row per kicker and game: field goals over expectation, punts beside the league's earlier averages.

    A punt's value leaves out what its return added: yards, a touchdown, a lost fumble.
    """
    rows = plays.where("kind in ('field_goal', 'punt') and kicker is not null").withColumn("athlete", F.col("kicker"))
    returned = " + ".join(f"coalesce({c}, 0) * {w}" for c, w in RETURN_EPA.items())
    kick, gross, valued = "kind = 'field_goal' and made is not null and expected_made is not null", "kind = 'punt' and distance is not null", "kind = 'punt' and epa is not null"
    per = rows.groupBy(*KEYS).agg(_sum(kick).alias("kicks"), _sum(kick, "made - expected_made").alias("made_over"), _sum(gross).alias("gross_punts"), _sum(gross, "distance").alias("gross"), _sum(valued).alias("punts"), _sum(valued, f"epa - ({returned})").alias("punt_value"))
    per = per.join(_before(per, [], ["gross", "gross_punts", "punt_value", "punts"], "_league"), ["season", "week"], "left")
    return per.withColumn("gross_base", safe_div("gross_league", "gross_punts_league")).withColumn("value_base", safe_div("punt_value_league", "punts_league"))


def _of_groups(events: DataFrame, positions: DataFrame, traits: list[Trait]) -> DataFrame:
    """events of athletes in the groups of their trait; units are their own group."""
    groups = F.create_map(*[x for t in traits for x in (F.lit(t.name), F.array(*[F.lit(g) for g in t.groups]))])[F.col("trait")]
    return events.join(positions.select("season", "athlete", "grp"), ["season", "athlete"]).where(F.array_contains(groups, F.col("grp"))).drop("grp")


def trait_events(plays: DataFrame, positions: DataFrame, presence: DataFrame, traits: tuple[Trait, ...] = REGISTRY) -> DataFrame:
    """(season, week, game, team, opponent, athlete, trait, n, d) of the chosen traits, before opponent adjustment.

    plays: PLAY; positions: (season, athlete, grp), one row each; presence: KEYS of defenders' games.
    """
    plays = with_expectations(plays)
    rows = role_rows(plays)
    sources = {"games": lambda: offense_games(rows), "throws": lambda: throws(rows), "credits": lambda: credits(rows, plays), "defenders": lambda: defender_games(plays, presence), "impact": lambda: impact(plays, presence), "units": lambda: unit_games(rows), "kickers": lambda: kicker_games(plays)}
    parts: list[DataFrame] = []

    def long(per: DataFrame, some: list[Trait], context: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(t.name).alias("trait"), F.col(f"n{k}").alias("n"), F.col(f"d{k}").alias("d")) for k, t in enumerate(some)])
        return per.select(*KEYS, *context, F.explode(each).alias("e")).select(*KEYS, *context, "e.trait", "e.n", "e.d").where("n is not null and d is not null")

    for relative in sorted({t.relative for t in traits if t.source == "rows"}):
        some = [t for t in traits if t.source == "rows" and t.relative == relative]
        context = [c for c in relative if c not in KEYS]
        sums = [F.sum(F.expr(f"case when {t.where} then cast({x} as double) end")).alias(f"{letter}{k}") for k, t in enumerate(some) for letter, x in (("n", t.n), ("d", f"case when ({t.n}) is not null then {t.d} end"))]
        out = long(rows.groupBy(*KEYS, *context).agg(*sums), some, context)
        if not relative:
            parts.append(_of_groups(out, positions, some))
            continue
        for among in sorted({t.among_group for t in some}):
            part = out.where(F.col("trait").isin([t.name for t in some if t.among_group == among]))
            part = _of_groups(part, positions, some) if among else part
            part = leave_one_out(part, ["trait", "season", *relative]).where("n_rel is not null").withColumn("n", F.col("n_rel"))
            part = part.groupBy(*KEYS, "trait").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
            parts.append(part if among else _of_groups(part, positions, some))
    for source in sorted({t.source for t in traits if t.source != "rows"}):
        some = [t for t in traits if t.source == source]
        per = sources[source]()
        per = per.select(*KEYS, *[F.expr(f"case when {t.where} then cast({x} as double) end").alias(f"{letter}{k}") for k, t in enumerate(some) for letter, x in (("n", t.n), ("d", t.d))])
        out = long(per, some, [])
        parts.append(out if source == "units" else _of_groups(out, positions, some))
    return reduce(DataFrame.unionByName, parts)


def adjusted_events(events: DataFrame, traits: tuple[Trait, ...] = REGISTRY) -> DataFrame:
    """events with n of adjusted traits less d * (allowed by the opponent before - league before), all traits in one plan."""
    weekly = events.where(F.col("trait").isin([t.name for t in traits if t.adjusted])).groupBy("season", "trait", "opponent", "week").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    rate = lambda w: F.when(F.sum("d").over(w) > 0, safe_div(F.sum("n").over(w), F.sum("d").over(w)))
    earlier = lambda *keys: W.partitionBy("season", "trait", *keys).orderBy("week").rowsBetween(W.unboundedPreceding, -1)
    allowed = weekly.select("season", "trait", "opponent", "week", rate(earlier("opponent")).alias("allowed"))
    league = weekly.groupBy("season", "trait", "week").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).select("season", "trait", "week", rate(earlier()).alias("league"))
    joined = events.join(allowed, ["season", "trait", "opponent", "week"], "left").join(league, ["season", "trait", "week"], "left")
    return joined.withColumn("n", F.coalesce(F.col("n") - F.col("d") * (F.col("allowed") - F.col("league")), F.col("n"))).select(*events.columns)


def values(events: DataFrame, traits: tuple[Trait, ...] = REGISTRY) -> DataFrame:
    """(season, athlete, trait, games, value): each trait by its rule."""
    return dispatch(events, ["season", "athlete"], {t.name: t.rule for t in traits})


def evaluated(plays: DataFrame, positions: DataFrame, presence: DataFrame, traits: tuple[Trait, ...] = REGISTRY) -> DataFrame:
    """(season, athlete, trait, games, value) of the chosen traits from plays."""
    return values(adjusted_events(trait_events(plays, positions, presence, traits), traits), traits)

"""Passers apart from their casts and opponents: ridge effects over sparse designs, by conjugate gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playsight.functions.nulls import safe_div
from playsight.operators.solvers import cut, sparse_ridge

# The league's dropbacks a game, half-life in weeks, penalties and floors of the noise.
DROPBACKS_A_GAME = 34.0
HALF_LIFE_WEEKS = 52.0
INTERCEPT_PENALTY, OPPONENT_PENALTY, PRESSURE_PENALTY = 1e-6, 300.0, 1.0
EXECUTION_FLOOR, PRESSURE_FLOOR = 1.0, 0.05


def _term(name: str, x=1.0) -> Column:
    return F.struct(F.lit(name).alias("f") if name in ("one", "pressure") else F.col(name).alias("f"), (F.lit(x) if isinstance(x, float) else x).cast("double").alias("x"))


def _before(observations: DataFrame, season: int, week: int) -> DataFrame:
    """Observations before the week, weighted, with their feature names; raises where one is impossible."""
    d = observations.where((F.col("season") < season) | ((F.col("season") == season) & (F.col("week") < week)))
    bad = d.where("not coalesce(dropbacks > 0 and hit_sacks >= 0 and hit_sacks <= dropbacks and not isnan(epa) and abs(epa) < double('infinity'), false)")
    if bad.limit(1).count():
        raise ValueError("context observations need dropbacks, a finite EPA, and no more hits and sacks than dropbacks")
    age = (season - F.col("season")) * 52 + week - F.col("week")
    return d.select(
        "passer", (F.col("dropbacks") * F.pow(F.lit(0.5), age / HALF_LIFE_WEEKS)).alias("w"), (F.col("epa") / F.col("dropbacks")).alias("y"), (F.col("hit_sacks") / F.col("dropbacks")).alias("h"),
        F.concat(F.lit("q:"), F.col("passer").cast("string")).alias("q"), F.concat_ws("_", F.lit("t:"), F.col("team").cast("string"), "season").alias("t"), F.concat_ws("_", F.lit("o:"), F.col("opponent").cast("string"), "season").alias("o"),
    )


def _effects(rows: DataFrame, solution: DataFrame, column: str, roles: list[str], out: str) -> DataFrame:
    """rows with the sum of the effects of their roles and each of them: a join a role on a table with one row a name."""
    for role in roles:
        rows = rows.join(solution.select(F.col("f").alias(role), F.col(column).alias(f"{out}_{role}")), role)
    return rows


def passer_context(observations: DataFrame, season: int, week: int, passer_penalty: float = 100.0, team_penalty: float = 100.0, contrasts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, dict[str, float]]:
    """Strengths of passers net of team-seasons and opponent-seasons, from weeks before (season, week) only.

    observations: (season, week, passer, team, opponent, dropbacks, epa, hit_sacks).  One fit explains EPA a
    dropback by passer, team, opponent and the rate of hits and sacks, another that rate by the same sides;
    a passer's own part of the rate, at the price the first fit gives it, returns to his strength.

    Gives (passer, strength, effective_dropbacks, hit_sack_rate, support, opponents) in points a game; for
    contrasts (name, passer, weight) also (name, sd), the conditional uncertainty of the swap, from one further
    right-hand side each (a few: they are columns of the solve); and the scalars of the fits.
    """
    if not (passer_penalty > 0 and team_penalty > 0):
        raise ValueError("penalties are positive")
    rows = cut(_before(observations, season, week))
    mean = rows.agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not mean["n"]:
        raise ValueError("context needs observations before the forecast week")
    kind = lambda f: F.when(f == "one", INTERCEPT_PENALTY).when(f == "pressure", PRESSURE_PENALTY).when(f.startswith("q:"), passer_penalty).when(f.startswith("t:"), team_penalty).otherwise(OPPONENT_PENALTY)
    sides = [_term("one"), _term("q"), _term("t"), _term("o")]
    full = rows.select("w", "y", F.array(*sides, _term("pressure", F.col("h") - mean["m"])).alias("terms"))
    extra, names, unseen = None, [], {}
    if contrasts is not None:
        given = contrasts.groupBy("name", F.concat(F.lit("q:"), F.col("passer").cast("string")).alias("f")).agg(F.sum("weight").alias("v"))
        known = given.join(rows.select(F.col("q").alias("f")).distinct().withColumn("known", F.lit(True)), "f", "left")
        missing = known.groupBy("name").agg(F.sum(F.when(F.col("known").isNull(), F.col("v") * F.col("v") / passer_penalty).otherwise(0.0)).alias("u")).orderBy("name").collect()
        names, unseen = [r["name"] for r in missing], {r["name"]: r["u"] for r in missing}
        extra = given.groupBy("f").agg(*[F.sum(F.when(F.col("name") == x, F.col("v")).otherwise(0.0)).alias(f"c{k}") for k, x in enumerate(names)])
    execution = cut(sparse_ridge(full, ["y"], kind, extra))
    pressure = cut(sparse_ridge(rows.select("w", F.col("h").alias("y"), F.array(*sides).alias("terms")), ["y"], kind, extra))
    value = {r["f"]: r["x0"] for r in execution.where("f in ('one', 'pressure')").collect()}
    rate = pressure.where("f = 'one'").first()["x0"]
    price = value["pressure"]
    met = _effects(_effects(rows, execution, "x0", ["q", "t", "o"], "e"), pressure, "x0", ["q", "t", "o"], "p")
    left = F.col("y") - value["one"] - F.col("e_q") - F.col("e_t") - F.col("e_o") - price * (F.col("h") - mean["m"])
    left_rate = F.col("h") - rate - F.col("p_q") - F.col("p_t") - F.col("p_o")
    sums = met.agg(F.sum(F.col("w") * left * left).alias("e"), F.sum(F.col("w") * left_rate * left_rate).alias("p")).first()
    size = execution.count()
    noise = max(EXECUTION_FLOOR, sums["e"] / max(mean["n"] - size, 1))
    noise_rate = max(PRESSURE_FLOOR, sums["p"] / max(mean["n"] - size + 1, 1))
    points = lambda role: (F.col(f"e_{role}") + price * F.col(f"p_{role}")) * DROPBACKS_A_GAME
    weighted = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    out = met.groupBy("passer").agg(F.max(points("q")).alias("strength"), F.sum("w").alias("effective_dropbacks"), weighted(F.col("h")).alias("hit_sack_rate"), weighted(points("t")).alias("support"), weighted(points("o")).alias("opponents"))
    sds = None
    if contrasts is not None:
        square = lambda k, s: s.join(extra, "f").agg(*[F.sum(F.col(f"c{i}") * F.col(f"x{i + 1}")) for i in range(k)]).first()
        one, two = square(len(names), execution), square(len(names), pressure)
        sd = [(x, DROPBACKS_A_GAME * ((noise * max((one[i] or 0.0) + unseen[x], 0.0)) ** 0.5 + abs(price) * (noise_rate * max((two[i] or 0.0) + unseen[x], 0.0)) ** 0.5)) for i, x in enumerate(names)]
        sds = out.sparkSession.createDataFrame(sd, "name string, sd double")
    return out, sds, {"pressure_price": price, "noise": noise, "rate_noise": noise_rate, "features": float(size)}


def lineup_effects(plays: DataFrame, through_week: int, passer_penalty: float, other_penalty: float) -> DataFrame:
    """(passer, effect): ridge of a play's EPA (less the mean) on passer, defense and teammates, of plays (week, passer, defense, teammates, epa) through a week.

    A man who passes in one play and lines up elsewhere in another has two effects.
    """
    rows = plays.where(F.col("week") <= through_week)
    mean = rows.agg(F.avg("epa").alias("m")).first()["m"]
    tag = lambda kind, c: F.struct(F.concat(F.lit(kind), c.cast("string")).alias("f"), F.lit(1.0).alias("x"))
    terms = F.concat(F.array(tag("q:", F.col("passer")), tag("d:", F.col("defense"))), F.transform("teammates", lambda m: tag("m:", m)))
    if mean is None:
        return plays.select("passer", F.lit(0.0).alias("effect")).limit(0)
    found = sparse_ridge(rows.select(F.lit(1.0).alias("w"), (F.col("epa") - mean).alias("y"), terms.alias("terms")), ["y"], lambda f: F.when(f.startswith("q:"), passer_penalty).otherwise(other_penalty))
    return found.where("f like 'q:%'").select(F.substring("f", 3, 1 << 20).alias("passer"), F.col("x0").alias("effect"))


def walking_lineup_effects(plays: DataFrame, passer_penalty: float, walk_penalty: float, other_penalty: float) -> DataFrame:
    """(passer, week, effect): the same with an effect of each passer and week that walks: steps from his last week with a play are penalised."""
    rows = plays.groupBy("passer", "week").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    last = F.lag("week").over(W.partitionBy("passer").orderBy("week"))
    at = lambda week: F.concat_ws("@", F.concat(F.lit("q:"), F.col("passer").cast("string")), week.cast("string"))
    steps = rows.withColumn("last", last).where("last is not null")
    walk = steps.select(F.lit(float(walk_penalty)).alias("w"), F.lit(0.0).alias("y"), F.array(F.struct(at(F.col("week")).alias("f"), F.lit(1.0).alias("x")), F.struct(at(F.col("last")).alias("f"), F.lit(-1.0).alias("x"))).alias("terms"))
    mean = plays.agg(F.avg("epa").alias("m")).first()["m"]
    if mean is None:
        return plays.select("passer", "week", F.lit(0.0).alias("effect")).limit(0)
    tag = lambda kind, c: F.struct(F.concat(F.lit(kind), c.cast("string")).alias("f"), F.lit(1.0).alias("x"))
    terms = F.concat(F.array(F.struct(at(F.col("week")).alias("f"), F.lit(1.0).alias("x")), tag("d:", F.col("defense"))), F.transform("teammates", lambda m: tag("m:", m)))
    every = plays.select(F.lit(1.0).alias("w"), (F.col("epa") - mean).alias("y"), terms.alias("terms")).unionByName(walk)
    found = sparse_ridge(every, ["y"], lambda f: F.when(f.startswith("q:"), passer_penalty).otherwise(other_penalty))
    parts = F.split(F.substring("f", 3, 1 << 20), "@")
    return found.where("f like 'q:%'").select(parts[0].alias("passer"), parts[1].cast("int").alias("week"), F.col("x0").alias("effect"))


def two_sided(games: DataFrame, offense: str, defense: str, value: str, weight: str, penalty: float) -> DataFrame:
    """(side, off, def, base): value = base + off[offense] - def[defense], ridge around 0; any number of sides."""
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    term = lambda f, x: F.struct(f.alias("f"), F.lit(x).alias("x"))
    per = games.groupBy(offense, defense).agg(F.sum(weight).alias("w"), safe_div(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("y"))
    rows = per.where("w > 0").select("w", "y", F.array(term(F.lit("one"), 1.0), term(tag("o:", offense), 1.0), term(tag("d:", defense), -1.0)).alias("terms"))
    found = cut(sparse_ridge(rows, ["y"], lambda f: F.when(f == "one", 0.0).otherwise(float(penalty))))
    base = found.where("f = 'one'").select(F.col("x0").alias("base"))  # one row
    part = lambda kind, out: found.where(F.col("f").startswith(kind)).select(F.substring("f", 3, 1 << 20).alias("side"), F.col("x0").alias(out))
    both = part("o:", "off").join(part("d:", "def"), "side", "full").fillna(0.0, ["off", "def"])
    return both.crossJoin(F.broadcast(base))

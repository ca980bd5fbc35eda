"""Credit for plays: who shares in one, and what the share is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import safe_div


def offensive_shares(plays: DataFrame, play: str = "ord") -> DataFrame:
    """(play, athlete, role, share): passer and receiver half each, the passer alone for a sack, an interception or no receiver, a lost fumble its fumbler's, a run its runner's."""
    one = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.col(role).alias("athlete"), F.lit(1.0).alias("share")))
    half = F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("athlete"), F.lit(0.5).alias("share")) for role in ("passer", "receiver")])
    alone = F.col("receiver").isNull() | (F.col("sack") == 1) | (F.col("interception") == 1)
    fumbler = F.when(F.col("kind") == "run", one("rusher")).when(F.col("sack") == 1, one("passer")).when(F.col("receiver").isNotNull(), one("receiver")).otherwise(one("passer"))
    shares = F.when((F.col("fumble") == 1) & F.col("kind").isin("pass", "run"), fumbler).when(F.col("kind") == "run", one("rusher")).when(F.col("kind") == "pass", F.when(alone, one("passer")).otherwise(half))
    return plays.select(play, F.explode(shares).alias("s")).select(play, "s.athlete", "s.role", "s.share").where("athlete is not null")


def defensive_shares(plays: DataFrame, tags: dict[str, tuple[list[str], float]], play: str = "ord", only_lost: tuple[str, ...] = ()) -> DataFrame:
    """(play, athlete, role, share): tags in order of priority, role -> (its id columns, its weight).

    Each athlete has one role a play, the first of the order; roles in `only_lost` count only where the
    offense lost value.  A share is the role's weight over the number of different athletes on the play.
    """
    names = list(tags)
    each = [
        F.when(F.col(c).isNotNull() & ((F.col("epa") < 0) if role in only_lost else F.lit(True)), F.struct(F.col(c).alias("athlete"), F.lit(k).alias("k")))
        for k, (role, (columns, _)) in enumerate(tags.items())
        for c in columns
    ]
    rows = plays.select(play, F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy(play, F.col("x.athlete").alias("athlete")).agg(F.min("x.k").alias("k"))
    share = F.element_at(F.array(*[F.lit(float(w)) for _, w in tags.values()]), F.col("k") + 1) / F.count(F.lit(1)).over(W.partitionBy(play))
    return rows.select(play, "athlete", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1).alias("role"), share.alias("share"))


def valued(shares: DataFrame, plays: DataFrame, side: int, raw: str = "epa", adjusted: str = "adj_epa", wpa: str = "wpa", play: str = "ord") -> DataFrame:
    """(play, athlete, share, value, wpa): side * (adjusted, else raw value) * share; win probability isn't shared out."""
    value: Column = side * F.coalesce(adjusted, raw) * F.col("share")
    return shares.join(plays.select(play, raw, adjusted, wpa), play).select(play, "athlete", "share", value.alias("value"), (side * F.col(wpa)).alias("wpa"))


def box(rows: DataFrame, keys: list[str], play: str, tags: list[str]) -> DataFrame:
    """For each tag its plays (any) and its sum shared among the athletes who have it on the play."""
    n = {t: F.sum(t).over(W.partitionBy(play)) for t in tags}
    shared = rows.select(*keys, play, *tags, *[safe_div(F.col(t).cast("double"), n[t].cast("double")).alias(f"_{t}") for t in tags])
    return shared.groupBy(*keys).agg(*[F.sum(F.when(F.col(t) > 0, F.col(f"_{t}"))).alias(f"{t}_shared") for t in tags], *[F.count_if(F.col(t) > 0).alias(f"{t}_any") for t in tags])

"""Feature builders over play rows (columns of traits.PLAY, and drive, ord, margin, scored, qb_epa)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import is_true, safe_div, total


def competitive(qtr: str = "qtr", margin: str = "margin") -> Column:
    """A play that still decides something; the limits by quarter are fixed values."""
    q = F.least(F.col(qtr), F.lit(4))
    limit = F.when(q == 1, 28).when(q == 2, 21).when(q == 3, 16).otherwise(14)
    return F.col(margin).isNull() | (F.abs(margin) <= limit)


def scrimmage(kinds: tuple[str, ...] = ("pass", "run")) -> Column:
    """A play from scrimmage that counts: of one of the kinds, with a value and a side."""
    return is_true(F.col("kind").isin(*kinds) & F.col("epa").isNotNull() & F.col("team").isNotNull())


def late_down() -> Column:
    return is_true(F.col("down") >= 3)


def short_yardage(togo: int = 2) -> Column:
    return is_true((F.col("togo") <= togo) & (F.col("down") >= 3))


def two_minute() -> Column:
    return is_true((F.col("half_left") <= 120) & F.col("qtr").isin(2, 4))


def line_yards(yards: str = "yards") -> Column:
    """Yards that a line is credited with; fixed break points."""
    y = F.col(yards)
    return F.when(y < 0, 1.2 * y).when(y <= 4, y * 1.0).when(y <= 10, 4 + 0.5 * (y - 4)).otherwise(7.0)


def play_key(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def kept_drives(plays: DataFrame) -> DataFrame:
    """(game, drive, keep): whether the first scrimmage play of a drive is competitive; NULL without one."""
    first = F.min_by(F.when(scrimmage(), competitive()), F.when(scrimmage(), F.col("ord")))
    return plays.groupBy("game", "drive").agg(first.alias("keep"))


def team_games(plays: DataFrame) -> DataFrame:
    """A row a game and team: EPA, plays and drives from scrimmage, all and competitive, and competitive points."""
    rows = plays.join(kept_drives(plays), ["game", "drive"]).withColumn("keep", is_true(F.col("keep"))).withColumn("live", scrimmage())
    return rows.groupBy("game", "week", "team", "opponent").agg(
        total(F.when(F.col("live"), F.col("epa"))).alias("epa"), F.count_if("live").alias("plays"), F.count_distinct(F.when(F.col("live"), F.col("drive"))).alias("drives"),
        F.count_distinct(F.when(F.col("live") & F.col("keep"), F.col("drive"))).alias("competitive_drives"), total(F.when(F.col("keep"), F.col("scored").cast("double"))).alias("competitive_points"),
    )


def passer_games(plays: DataFrame) -> DataFrame:
    """A row a game, team and passer: dropbacks, EPA, and whether they threw the team's first."""
    drop = plays.where("kind = 'pass' and passer is not null")
    first = drop.groupBy("game", "team").agg(F.min_by("passer", "ord").alias("first"))
    own = drop.groupBy("game", "team", "passer").agg(F.count(F.lit(1)).alias("dropbacks"), F.sum("epa").alias("epa"))
    return own.join(first, ["game", "team"]).withColumn("started", F.col("passer") == F.col("first")).drop("first")


def passer_context(plays: DataFrame) -> DataFrame:
    """The same with scrambles counted for who ran, the passer's own value where there is one, and pressures."""
    who = F.when(F.col("scramble") == 1, F.coalesce("rusher", "passer")).otherwise(F.col("passer"))
    rows = plays.withColumn("athlete", who).where("athlete is not null and (kind = 'pass' or scramble = 1)")
    return rows.groupBy("game", "team", "athlete").agg(F.count(F.lit(1)).alias("dropbacks"), F.sum(F.coalesce("qb_epa", "epa")).alias("epa"), F.count_if((F.col("sack") == 1) | (F.col("hit") == 1)).alias("pressures"))


def unit_channels(plays: DataFrame, keys: list[str]) -> DataFrame:
    """Channel sums a team and game: rush, pass, protection and special value, line yards, carries, dropbacks, pressures."""
    run, drop = F.col("kind") == "run", F.col("kind") == "pass"
    pressed = drop & ((F.col("sack") == 1) | (F.col("hit") == 1))
    when = lambda c, v: total(F.when(c, v))
    return plays.groupBy(*keys).agg(
        when(run, F.col("epa")).alias("rush_epa"), when(drop, F.col("epa")).alias("pass_epa"), when(pressed, F.col("epa")).alias("protection_epa"), when(F.col("special") == 1, F.col("epa")).alias("special_epa"),
        when(run, line_yards()).alias("line_yards"), F.count_if(run).alias("carries"), F.count_if(drop).alias("dropbacks"), F.count_if(pressed).alias("pressures"),
    )


def two_sided(features: DataFrame, game: str, side: str, values: list[str]) -> DataFrame:
    """One row a game with both sides' values, the lesser side first: an aggregation in place of two joins."""
    pick = lambda best: [best(F.struct(side, *values))[v] for v in [side, *values]]
    cols = [c.alias(f"home_{v}") for c, v in zip(pick(F.min), [side, *values], strict=True)] + [c.alias(f"away_{v}") for c, v in zip(pick(F.max), [side, *values], strict=True)]
    return features.groupBy(game).agg(*cols, F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")


def opponents(rows: DataFrame, game: str, side: str) -> DataFrame:
    """Each (game, side) with the other side of the same game."""
    both = rows.select(game, side).distinct().groupBy(game).agg(F.min(side).alias("_a"), F.max(side).alias("_b")).where("_a <> _b")
    return both.select(game, F.explode(F.array(F.struct(F.col("_a").alias(side), F.col("_b").alias("opponent")), F.struct(F.col("_b").alias(side), F.col("_a").alias("opponent")))).alias("x")).select(game, "x.*")


def aligned(parts: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Full outer alignment of many single-row-a-key tables: name -> (table, value).  One union and one aggregation, whatever their number."""
    names = list(parts)
    rows = None
    for k, (df, value) in parts.items():
        one = df.select(key, *[(F.col(value).cast("double") if n == k else F.lit(None).cast("double")).alias(n) for n in names])
        rows = one if rows is None else rows.unionAll(one)
    return rows.groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def through_week(rows: DataFrame, keys: list[str], week: str, value: str) -> DataFrame:
    """Sums of a value through each week and after it; NULL where no value is known on that side."""
    per = rows.groupBy(*keys, week).agg(F.sum(value).alias("_v"))
    w = W.partitionBy(*keys).orderBy(week)
    return per.select(*keys, week, F.sum("_v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("through"), F.sum("_v").over(w.rowsBetween(1, W.unboundedFollowing)).alias("after"))


def participation_share(rows: DataFrame, team: str, athlete: str, week: str, half_life: float = 6.0) -> DataFrame:
    """An athlete's share of the team's rows, each weighed by 0.5 ** (weeks before the team's last / half_life)."""
    last = rows.groupBy(team).agg(F.max(week).alias("_last"))
    per = rows.groupBy(team, athlete, week).agg(F.count(F.lit(1)).alias("_c")).join(last, team)
    own = per.groupBy(team, athlete).agg(F.sum(F.col("_c") * F.pow(F.lit(0.5), (F.col("_last") - F.col(week)) / half_life)).alias("_w"))
    every = own.groupBy(team).agg(F.sum("_w").alias("_all"))
    return own.join(every, team).select(team, athlete, safe_div("_w", "_all").alias("share"))


def moved(rows: DataFrame, athlete: str, season: str, order: str, team: str) -> DataFrame:
    """Athletes whose first team of a season isn't their last of the season before: (athlete, season, was, now)."""
    ends = rows.groupBy(athlete, season).agg(F.min_by(team, order).alias("now"), F.max_by(team, order).alias("_end"))
    w = W.partitionBy(athlete).orderBy(season)
    pairs = ends.select(athlete, season, "now", F.lag("_end").over(w).alias("was"), F.lag(season).over(w).alias("_s"))
    return pairs.where((F.col("_s") == F.col(season) - 1) & (F.col("was") != F.col("now"))).select(athlete, season, "was", "now")

"""Selections: pages, nearest elements, final and next weeks, latest versions, cohorts, legs and closing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page `number` (from 1, clamped to what there is) of df in a total order, as a range of the sorted rows."""
    pages = max(1, -(-df.count() // size))
    at = min(max(1, number), pages)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)


def nearest(values: Column, wanted: Column) -> Column:
    """The element of an array nearest to a value; the lower of two as near."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - wanted).alias("d"), v.alias("v"))))["v"]


def final_week(df: DataFrame, season: str, week: str) -> DataFrame:
    """Rows of each season's last week."""
    last = df.groupBy(season).agg(F.max(week).alias("_last"))
    return df.join(last, season).where(F.col(week) == F.col("_last")).drop("_last")


def next_week(schedule: DataFrame, season: str, week: str, kickoff: str, played: str, now: str) -> DataFrame:
    """Per season the week of the first kickoff from `now` on that isn't played; the last week where there is none."""
    open_ = F.when(~F.col(played) & (F.col(kickoff) >= F.lit(now).cast("timestamp_ntz")), F.col(kickoff))
    return schedule.groupBy(season).agg(F.coalesce(F.min_by(F.when(open_.isNotNull(), F.col(week)), F.struct(open_.isNull(), open_, F.col(week))), F.max(week)).alias("week"))


def latest_before(versions: DataFrame, cutoff: str, wanted: DataFrame, season: str) -> DataFrame:
    """Each wanted season with the version of the latest cutoff strictly before it: an as-of by one sort."""
    rows = versions.select(F.col(cutoff).alias("_t"), F.lit(1).alias("_o"), F.col("version").alias("_v")).unionByName(wanted.select(F.col(season).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(versions.schema["version"].dataType).alias("_v")))
    # versions and seasons are a few rows each
    w = W.partitionBy(F.lit(0)).orderBy("_t", "_o", "_v").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("version", F.last("_v", ignorenulls=True).over(w)).where("_o = 0").select(F.col("_t").alias(season), "version")


def cohorts(forecasts: DataFrame, game: str, at: str, tie: str, p: str, y: str, bins: int = 10) -> DataFrame:
    """First and last forecast of each game, binned: (cohort, bin, games, predicted, observed)."""
    key = F.struct(at, tie)
    ends = forecasts.groupBy(game).agg(F.min_by(F.struct(p, y), key).alias("first"), F.max_by(F.struct(p, y), key).alias("last"))
    rows = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cohort"), F.col(f"{c}.{p}").alias("p"), F.col(f"{c}.{y}").alias("y")) for c in ("first", "last")])).alias("x")).select("x.*")
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy("cohort", b.alias("bin")).agg(F.count(F.lit(1)).alias("games"), F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))


def valid_offer(market: Column, side: Column, point: Column, price: Column) -> Column:
    """Domain, price and half-point rules of an offer; fixed values."""
    sides = F.when(market == "totals", side.isin("over", "under")).otherwise(side.isin("home", "away"))
    half = F.when(market == "h2h", point.isNull()).otherwise(point.isNotNull() & (point * 2 == F.floor(point * 2)) & (F.abs(point) <= 100))
    return F.coalesce(market.isin("h2h", "spreads", "totals") & sides & half & (F.abs(price) >= 100) & (F.abs(price) <= 100_000), F.lit(False))


def lower_median(value: Column) -> Column:
    """The lower middle of a group's values: one that is really there."""
    s = F.sort_array(F.collect_list(value))
    return F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))


def teaser_legs(offers: DataFrame, game: str, at: str, point: str, shift: float = 6.0, lines: tuple[float, ...] = (1.5, 2.0, 2.5)) -> DataFrame:
    """Games whose underdog line (lower middle over books) is one of `lines` at first sight: (game, at, line, teased)."""
    per = offers.where(F.col(point) > 0).groupBy(game, at).agg(lower_median(F.col(point)).alias("line"))
    first = per.groupBy(game).agg(F.min(F.struct(at, "line")).alias("f")).select(game, f"f.{at}", "f.line")
    return first.where(F.col("line").isin(*lines)).withColumn("teased", F.col("line") + shift)


def closing_line(offers: DataFrame, game: str, book: str, at: str, point: str, preferred: int) -> DataFrame:
    """(game, point, book, consensus): the preferred book's last offer, else the latest of any; and the median of all."""
    best = F.max_by(F.struct(point, book), F.struct(F.col(book) == preferred, at, book, point))
    return offers.groupBy(game).agg(best.alias("b"), F.median(point).alias("consensus")).select(game, f"b.{point}", f"b.{book}", "consensus")


def at_cutoff(schedule: DataFrame, kickoff: str, cutoff: Column, scores: list[str], hours: int = 24) -> DataFrame:
    """The schedule as known at the cutoff: scores are NULL until some hours after kickoff."""
    known = F.col(kickoff) + F.expr(f"INTERVAL {hours} HOURS") <= cutoff
    return schedule.select(*[F.when(known, F.col(c)).alias(c) if c in scores else F.col(c) for c in schedule.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What appending `new` writes when keys that are there stay as they are; of repeated new keys the first."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return first.join(old.select(*keys).distinct(), keys, "left_anti")


def bisect(f, target: Column, low: Column, high: Column, steps: int = 60) -> Column:
    """The root of an increasing f (Column to Column) at `target` within [low, high], without leaving the JVM."""
    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(f(mid) < target, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda s: (s["lo"] + s["hi"]) / 2)

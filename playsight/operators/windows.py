"""Window operators: prior cumulative rates, average-rank percentiles, grids, decayed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import safe_div

Keys = list[str]


def before(keys: Keys, order: str):
    """All earlier rows of a key; the row itself is left out."""
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def weekly(events: DataFrame, keys: Keys, week: str = "week", num: str = "n", den: str = "d") -> DataFrame:
    """One row a key and week: prior-only windows need it, or rows of one week would see each other."""
    return events.groupBy(*keys, week).agg(F.sum(num).alias(num), F.sum(den).alias(den))


def prior_totals(events: DataFrame, keys: Keys, week: str = "week", num: str = "n", den: str = "d") -> DataFrame:
    """Totals of strictly earlier weeks, for weeks that have a row."""
    w = before(keys, week)
    rows = weekly(events, keys, week, num, den)
    return rows.select(*keys, week, F.sum(num).over(w).alias("prior_n"), F.sum(den).over(w).alias("prior_d"))


def prior_rate(events: DataFrame, keys: Keys, out: str, week: str = "week") -> DataFrame:
    """Cumulative rate of strictly earlier weeks; NULL without prior evidence."""
    return prior_totals(events, keys, week).select(*keys, week, F.when(F.col("prior_d") > 0, safe_div("prior_n", "prior_d")).alias(out))


def opponent_adjusted(events: DataFrame, opponent: str, week: str = "week") -> DataFrame:
    """Adds n_adj = n - d * (allowed by the opponent before - league before); n where either is missing.

    The opponent's totals are windowed over (opponent, week) sums; the league's over one row a week.
    """
    allowed = prior_rate(events, [opponent], "allowed", week)
    by_week = weekly(events, [], week)
    # a row a week: small whatever the number of events
    w = W.partitionBy(F.lit(0)).orderBy(week).rowsBetween(W.unboundedPreceding, -1)
    league = by_week.select(week, F.when(F.sum("d").over(w) > 0, safe_div(F.sum("n").over(w), F.sum("d").over(w))).alias("league"))
    joined = events.join(allowed, [opponent, week], "left").join(league, [week], "left")
    return joined.withColumn("n_adj", F.coalesce(F.col("n") - F.col("d") * (F.col("allowed") - F.col("league")), F.col("n")))


def average_rank(value: str | Column, keys: Keys) -> Column:
    """Rank that ties share evenly, from 1."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(W.partitionBy(*keys).orderBy(v)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, v)) - 1) / 2.0


def percentile_within(value: str, keys: Keys) -> Column:
    """100 * (average rank - 1) / (n - 1); 100 for a single row."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return F.when(n == 1, F.lit(100.0)).otherwise(100.0 * (average_rank(value, keys) - 1) / F.nullif(n - 1, F.lit(0)))


def z_score(value: str, keys: Keys, most: float = 3.0) -> Column:
    """Standard score within keys, clipped; 0 where the spread is missing or 0."""
    w = W.partitionBy(*keys)
    sd = F.stddev_samp(value).over(w)
    z = F.when(sd > 0, safe_div(F.col(value) - F.avg(value).over(w), sd))
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(z, F.lit(0.0))))


def share_of_group(value: str, keys: Keys) -> Column:
    return safe_div(F.col(value), F.sum(value).over(W.partitionBy(*keys)))


def latest(df: DataFrame, keys: Keys, order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, which must be total."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def grid_cumulative(events: DataFrame, keys: Keys, weeks: DataFrame, week: str = "week", num: str = "n", den: str = "d") -> DataFrame:
    """Running totals on every week of the grid, carried through weeks without a row, from a key's first week on."""
    sums = weekly(events, keys, week, num, den)
    first = sums.groupBy(*keys).agg(F.min(week).alias("_first"))
    grid = first.crossJoin(F.broadcast(weeks.select(week).distinct())).where(F.col(week) >= F.col("_first")).drop("_first")
    w = W.partitionBy(*keys).orderBy(week).rowsBetween(W.unboundedPreceding, 0)
    full = grid.join(sums, [*keys, week], "left")
    return full.select(*keys, week, F.coalesce(F.sum(num).over(w), F.lit(0.0)).alias("cum_n"), F.coalesce(F.sum(den).over(w), F.lit(0.0)).alias("cum_d"))


def decayed_state(df: DataFrame, key: str, clock: str, gained: str, plays: str, span: float, half_life: float, order: list[str]) -> DataFrame:
    """State after each row when the old state fades by 0.5 ** (plays / span + time / half_life) and the row is added.

    In closed form: with z = running plays / span + (clock - first clock) / half_life, the state is
    0.5 ** z * sum(gained * 2 ** z), a running sum over the key's rows.
    """
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    z = F.sum(plays).over(w) / span + (F.col(clock) - F.min(clock).over(W.partitionBy(key))) / half_life
    rows = df.withColumn("_z", z)
    return rows.withColumn("state", F.pow(F.lit(0.5), F.col("_z")) * F.sum(F.col(gained) * F.pow(F.lit(2.0), F.col("_z"))).over(w)).drop("_z")


def centred_mean(value: str, keys: Keys, order: str, reach: int) -> Column:
    """Mean over `reach` rows on each side, fewer at the ends."""
    return F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach))


def z_scored(df: DataFrame, keys: Keys, value: str, out: str, most: float = 3.0) -> DataFrame:
    """df with `out`, the clipped standard score within keys: one small aggregate joined back, so that no group meets in a task."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    z = F.when(F.col("_sd") > 0, safe_div(F.col(value) - F.col("_m"), F.col("_sd")))
    return _met(df, stats, keys).withColumn(out, F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(z, F.lit(0.0))))).drop("_m", "_sd")


def group_shared(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """df with `share` of the group's sum and the group's `mean`."""
    stats = df.groupBy(*keys).agg(F.sum(value).alias("_s"), F.avg(value).alias("mean"))
    return _met(df, stats, keys).withColumn("share", safe_div(value, "_s")).drop("_s")


def _met(df: DataFrame, stats: DataFrame, keys: Keys) -> DataFrame:
    """df with the row of `stats` of its keys; NULL keys meet too."""
    other = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    return df.join(other, on, "left").drop(*[f"_k_{k}" for k in keys])


def percentiled(df: DataFrame, keys: Keys, value: str, out: str) -> DataFrame:
    """df with `out` = 100 * (average rank - 1) / (n - 1) within keys; 100 for a single row.

    Values are counted first, and the window runs over different values only; rows take theirs by a join.
    """
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    below = F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_c").over(W.partitionBy(*keys))
    rank = below + (F.col("_c") + 1) / 2.0
    table = per.select(*keys, value, F.when(n == 1, F.lit(100.0)).otherwise(100.0 * (rank - 1) / F.nullif(n - 1, F.lit(0))).alias(out))
    return _met(df, table, [*keys, value])


def prior_median(df: DataFrame, key: str, day: str, value: str, asked: DataFrame | None = None) -> DataFrame:
    """(key, day, median): the median of all values of strictly earlier days, for each day that has a row, or that is `asked` (key, day).

    A day's value counts as many earlier ones as there are: with the rank of each (key, value) known
    once, the median of a prefix of days is found from counts per day and slice of ranks, in two
    steps: the slice that holds the middle, then the values inside it.
    """
    counts = df.groupBy(key, day, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(key).agg(F.count_distinct(value).alias("_u"))
    place = F.dense_rank().over(W.partitionBy(key).orderBy(value)) - 1
    width = F.greatest(F.lit(1), F.ceil(F.sqrt("_u"))).cast("int")
    ranked = counts.join(sizes, key).withColumn("_slice", F.floor(place / width).cast("int")).select(key, day, value, "_n", "_slice")
    days = (df.select(key, day) if asked is None else df.select(key, day).unionByName(asked.select(key, day))).distinct()
    # rows in each slice before each day
    grid = days.join(ranked.select(key, "_slice").distinct(), key).join(ranked.groupBy(key, day, "_slice").agg(F.sum("_n").alias("_n")), [key, day, "_slice"], "left")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key, "_slice").orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grid = grid.select(key, day, "_slice", before.alias("_b"))
    run = W.partitionBy(key, day).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_b").over(W.partitionBy(key, day))
    upto = grid.select(key, day, "_slice", "_b", F.sum("_b").over(run).alias("_upto"), total.alias("_total"))
    wanted = upto.where("_total > 0").select(key, day, "_slice", "_b", "_upto", "_total", F.explode(F.array_distinct(F.array(F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)))).alias("_mid"))
    wanted = wanted.where("_mid < _upto and _mid >= _upto - _b").withColumn("_at", F.col("_mid") - (F.col("_upto") - F.col("_b")))
    inside = wanted.join(ranked.select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col("_slice").alias("_s"), value, "_n"), (F.col(key) == F.col("_k")) & (F.col("_slice") == F.col("_s")) & (F.col("_d") < F.col(day)))
    # the two middles may lie at one offset of two slices: k tells them apart
    per = inside.groupBy(key, day, "_mid", "_at", value).agg(F.sum("_n").alias("_n"))
    passed = F.sum("_n").over(W.partitionBy(key, day, "_mid").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    found = per.withColumn("_passed", passed).where("_at < _passed and _at >= _passed - _n").groupBy(key, day).agg(F.avg(value).alias("median"))
    return (days if asked is None else asked.select(key, day).distinct()).join(found, [key, day], "left")

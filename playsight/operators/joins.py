"""Join operators beyond plain equi-joins: asserted keys, as-of, band, mirrored pairs, coalescing full outer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playsight.operators.solvers import cut

#: Different trigrams (16 bytes each) up to which their counts are broadcast: the commonest stand in nearly every name.
BROADCAST_GRAMS = 1_000_000


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where a join may assume them unique."""
    return df.groupBy(*keys).count().where("count > 1")


def asof_latest(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, carry: list[str], left_id: str, tie: str, strict: bool = True) -> DataFrame:
    """For each left row the carried columns of the latest right row before it (or at the same time, if not strict).

    Both sides meet in one sort by (key, time): left rows are unioned in, and the last right value
    before each is carried forward by a window, so the cost doesn't grow with the number of matches.
    """
    from pyspark.sql import Window as W

    rank = F.lit(0 if strict else 2)  # at equal times a strict left row comes before the right rows
    right_rows = right.select(F.col(key).alias("_k"), F.col(seen).alias("_t"), F.lit(1).alias("_o"), F.col(tie).alias("_tie"), F.struct(*carry).alias("_v"), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"))
    left_rows = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), rank.cast("int").alias("_o"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right_rows.schema["_v"].dataType).alias("_v"), F.col(left_id).alias("_id"))
    w = W.partitionBy("_k").orderBy("_t", "_o", "_tie").rowsBetween(W.unboundedPreceding, 0)
    both = right_rows.unionByName(left_rows).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_o <> 1")
    return both.select(F.col("_id").alias(left_id), F.col("_k").alias(key), F.col("_t").alias(at), *[F.col(f"_last.{c}").alias(c) for c in carry])


def band_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str, width: int) -> DataFrame:
    """Pairs of one key whose whole-number times are within `width`.

    Times are cut into buckets of the band's width, and a left row looks into three of them, so the
    join stays an equi-join.
    """
    b = lambda c: F.floor(F.col(c) / width)
    spread = left.withColumn("_b", F.explode(F.array(b(at) - 1, b(at), b(at) + 1)))
    return spread.join(right.withColumn("_b", b(start)), [key, "_b"]).where(F.abs(F.col(at) - F.col(start)) <= width).drop("_b")


def coalesced(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Full outer over sources in order of priority: the first value that isn't NULL, and its source's place."""
    tagged = None
    for k, source in enumerate(sources):
        part = source.select(*keys, F.lit(k).alias("source"), F.col(value).alias(value))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = F.min(F.when(F.col(value).isNotNull(), F.struct("source", value)))
    return tagged.groupBy(*keys).agg(first.alias("_f")).select(*keys, F.col(f"_f.{value}").alias(value), F.col("_f.source").alias("source"))


def mirrored(offers: DataFrame, keys: list[str], side: str, point: str, price: str) -> DataFrame:
    """Each offer with the other side's price at the mirrored point of the same book."""
    other = offers.select(*keys, F.col(side).alias("_side"), (-F.col(point)).alias("_point"), F.col(price).alias("other_price"))
    cond: Column = F.col(f"a.{side}") != F.col("b._side")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & (F.col(f"a.{point}") == F.col("b._point"))
    return offers.alias("a").join(other.alias("b"), cond).select("a.*", "b.other_price")


def unique_mapping(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Only the sources that map to exactly one target."""
    return rows.groupBy(source).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")


def _grams(name: Column) -> Column:
    """The different trigrams of a padded name, hashed: names that share one share its hash."""
    padded = F.concat(F.lit("  "), name, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(name) + 2), lambda i: F.xxhash64(F.substr(padded, i, F.lit(3)))))


def similar_in_band(left: DataFrame, right: DataFrame, left_id: str, right_id: str, at: str, start: str, width: int, names: list[tuple[str, str]], least: float) -> DataFrame:
    """(left_id, right_id, score, lag): for each left row the right row within `width` of its time whose names are most alike, by the mean of 1 - edits / length, at least `least`.

    Names are pairs of a left and a right column; ties go to the smaller |lag|, then the smaller right id.  Exact: a pair that
    counts has a first name of similarity 1 - k (1 - least) at least (k names), so at most that share of the longer
    name's letters differ, and each edit spoils three trigrams.  A name need only be looked up by so many of its
    rarest trigrams, plus one; frequent ones are hardly ever used.  A pair that meets by several is kept at the
    first, and only where no name has more edits than a pair that counts may have.  Names are compared with letters as they are; a null name is empty.
    """
    share = len(names) * (1.0 - least)
    if share >= 1 / 3:
        raise ValueError("names must be alike by more than two thirds for trigrams to find them all")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    bucket = lambda c: F.floor(F.col(c) / width)
    rows = {"l": left.select(F.col(left_id).alias("_id"), F.col(at).alias("_at"), *[text(a).alias(f"_n{k}") for k, (a, _) in enumerate(names)]), "r": right.select(F.col(right_id).alias("_id"), F.col(start).alias("_at"), *[text(b).alias(f"_n{k}") for k, (_, b) in enumerate(names)])}
    counts = rows["l"].select("_n0").unionByName(rows["r"].select("_n0")).select(F.explode(_grams(F.col("_n0"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    counts = cut(counts)
    known = F.broadcast(counts) if counts.count() <= BROADCAST_GRAMS else counts

    def keyed(side: str) -> DataFrame:
        per = rows[side].select("_n0").distinct()
        # the longer name of a pair has length / (1 - share) letters at most
        need = F.floor(F.char_length("_n0") / (1.0 - share) * share + 1e-9) * 3 + 1
        found = per.select("_n0", need.alias("need"), F.explode(_grams(F.col("_n0"))).alias("g")).join(known, "g").groupBy("_n0", "need").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("gs"))
        return found.select("_n0", F.slice("gs", F.lit(1), F.col("need").cast("int"))["g"].alias("gs"))

    met_by = lambda side, b: rows[side].join(keyed(side), "_n0").withColumn("_b", b).select("*", F.posexplode("gs").alias("_k", "g"))
    a = met_by("l", bucket("_at"))
    b = met_by("r", F.explode(F.array(bucket("_at") - 1, bucket("_at"), bucket("_at") + 1)))
    b = b.select("g", "_b", F.col("gs").alias("_rgs"), *[F.col(c).alias(f"_r{c}") for c in rows["r"].columns])
    met = a.join(b, ["g", "_b"]).where(F.abs(F.col("_at") - F.col("_r_at")) <= width).where(~F.arrays_overlap(F.slice("gs", F.lit(1), F.col("_k")), "_rgs"))
    for k in reversed(range(len(names))):
        most = F.floor(F.greatest(F.char_length(f"_n{k}"), F.char_length(f"_r_n{k}")) * share + 1e-9).cast("int")
        met = met.where(F.call_function("levenshtein", F.col(f"_n{k}"), F.col(f"_r_n{k}"), most) >= 0)
    alike = [F.when(F.greatest(F.char_length(f"_n{k}"), F.char_length(f"_r_n{k}")) == 0, 1.0).otherwise(1.0 - F.levenshtein(f"_n{k}", f"_r_n{k}") / F.greatest(F.char_length(f"_n{k}"), F.char_length(f"_r_n{k}"))) for k in range(len(names))]
    scored = met.select("_id", "_r_id", (sum(alike[1:], alike[0]) / float(len(names))).alias("score"), (F.col("_at") - F.col("_r_at")).alias("lag")).where(F.col("score") >= least - 1e-12)
    best = scored.groupBy("_id").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), F.abs("lag").alias("d"), F.col("_r_id").alias("r"), "score", "lag")).alias("x"))
    return best.select(F.col("_id").alias(left_id), F.col("x.r").alias(right_id), F.col("x.score").alias("score"), F.col("x.lag").alias("lag"))

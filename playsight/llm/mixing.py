"""Mixing sources to target weights by entropy balancing.

Each document i of source s gets the rate r_i that stays closest to 1 in relative entropy over
documents, subject to sum(size_i * r_i) = target_s and r_i <= CAP.  The dual has one multiplier a source
and r_i = min(CAP, exp(lambda_s * size_i / mean size)): Newton steps on it need the sums of the
gradient and the curvature over a source's documents, which are distributed sums over (source, size)
counts, in decimals, so that no order of summing changes them.  Steps are held inside the bracket that
earlier ones have found.  Rates are rounded into whole copies in runs of a source's documents (dealt by
hash), from the largest down, each error handed on to the next document: a run misses its share by
about the size of its smallest document, and reruns agree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.llm.common import BROADCAST_ROWS, cut, if_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Documents that are rounded together, about.
RUN = 2000


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), a row a source.  Adds `target`.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all words;
    no target is above cap * source_size, and what is cut is shared out by weight among the others.
    The level where the caps stop is found over the sorted caps, on the table of sources.
    """
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("top", cap * F.col("source_size"))
    everything = W.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(everything)
    # if all sources before this one are at their cap, the level of the rest
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("top"))
    first = F.struct((F.col("top") / F.col("w")).alias("ratio"), F.col("source").isNull(), "source", "level")
    stop = F.min(F.when(F.col("fits"), first)).over(everything)["level"]
    return rows.select("source", "source_size", F.least(F.col("top"), F.col("w") * F.coalesce(stop, F.lit(float("inf")))).alias("target"))


def newton_rates(counts: DataFrame, goal: DataFrame, cap: float = CAP, tolerance: float = 1e-9, most: int = 60) -> DataFrame:
    """counts: (source, size, n), goal: (source, source_size, target).  Adds `lam`, `mean` and `documents`: a document's rate is min(cap, exp(lam * size / mean)).

    Each Newton step (on the logarithm of the words taken, which is nearly straight) sums gradient and
    curvature over all (source, size) counts.  Lambda lies between 0 and where the smallest document
    alone has the wanted rate; a step that leaves what is left of that bracket is replaced by its middle.
    A target of nothing gives lam = -inf, one of cap times the source +inf.
    """
    some = counts.where("size > 0").groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("documents"), F.min("size").alias("least"))
    state = goal.join(some, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = state.withColumn("documents", F.coalesce("documents", F.lit(0).cast("long"))).withColumn("mean", F.col("source_size") / F.greatest("documents", F.lit(1)))
    edge = F.when(F.coalesce(F.col("target"), F.lit(0.0)) <= 0, F.lit(float("-inf"))).when(F.col("target") >= cap * F.col("source_size"), F.lit(float("inf")))
    ratio = F.log(F.col("target") / F.col("source_size"))
    end = F.when(ratio > 0, F.lit(math.log(cap))).otherwise(ratio) * F.col("mean") / F.col("least")
    state = state.withColumn("lam", F.coalesce(edge, ratio)).withColumn("low", F.least(F.lit(0.0), end)).withColumn("high", F.greatest(F.lit(0.0), end)).withColumn("done", edge.isNotNull())
    state = cut(state.select("source", "source_size", "target", "mean", "documents", "lam", "low", "high", "done"))
    small = (lambda df: F.broadcast(df)) if state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)  # a row a source
    each = counts.where("size > 0")
    for _ in range(most):
        if state.where("not done").isEmpty():
            break
        known = small(state.where("not done").select(F.col("source").alias("_s"), "lam", "mean"))
        rows = each.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("z", F.col("lam") * F.col("size") / F.col("mean"))
        words = F.col("n") * F.col("size") * F.least(F.lit(cap), F.exp("z"))
        bend = F.when(F.col("z") < math.log(cap), words * F.col("size") / F.col("mean")).otherwise(0.0)
        exact = lambda c, name: F.sum(c.cast("decimal(38,9)")).cast("double").alias(name)
        sums = rows.groupBy("_s").agg(exact(words, "words"), exact(bend, "bend"))
        step = state.join(small(sums), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("words") - F.col("target")
        step = step.withColumn("low", F.when(gap < 0, F.greatest("low", "lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.least("high", "lam")).otherwise(F.col("high")))
        newton = F.col("lam") - F.log(F.col("words") / F.col("target")) * F.try_divide("words", "bend")
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        ended = F.col("done") | (F.abs(gap) <= tolerance * F.col("target")) | (F.col("high") - F.col("low") <= 1e-13 * (1 + F.abs(F.col("lam"))))
        state = cut(step.select("source", "source_size", "target", "mean", "documents", F.when(ended, F.col("lam")).otherwise(moved).alias("lam"), "low", "high", ended.alias("done")))
    return state.drop("low", "high", "done")


def _rate(cap: float) -> Column:
    """A document's rate by `lam`, `size` and `mean`; exact at both ends."""
    bent = F.least(F.lit(cap), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
    return F.when(F.col("size") == 0, 0.0).when(F.col("lam") == float("-inf"), 0.0).when(F.col("lam") == float("inf"), cap).otherwise(bent)


def _units(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(doc_id, source, th, size, n, source_size, target, whole, more): rows that repeat id, source and text are one unit of n rows, of which `more` are taken once more than `whole` times."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    units = cut(sized.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("n")))
    counts = cut(units.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goal = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    rates = if_small(newton_rates(counts, goal, cap).withColumnRenamed("source", "_source"))
    rated = units.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", _rate(cap)).withColumn("most", F.lit(math.floor(cap)))
    # runs of about RUN documents of one source, each dealt out on its own
    width = F.greatest(F.lit(1), F.ceil(F.col("documents") / RUN))
    rated = rated.withColumn("tie", F.xxhash64("th", "doc_id")).withColumn("run", F.pmod("tie", width))
    rated = rated.withColumn("no_source", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    return rated.groupBy("no_source", "_source", "run").applyInPandas(_rounded, "doc_id long, source string, th long, size long, n long, source_size long, target double, whole long, more long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, th) for every row of docs (doc_id, source, text; others are ignored).

    Null and empty texts have size 0 and take nothing.  A null source is a source of its own, the
    last.  Ties in size are broken by hash of the text and id; rows that repeat id, source and text are
    interchangeable.  A text of any length is one document.  An empty table gives an empty result.
    """
    each = _units(docs, weights, share, cap).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("whole") + (F.col("k") <= F.col("more")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "th")


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies, from the largest document down: each rounding error is handed on to the next, which may take any number of copies up to the cap."""
    rows = rows.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable")
    owed, wholes, mores = 0.0, [], []
    for size, n, rate, most in zip(*(rows[c].tolist() for c in ("size", "n", "rate", "most")), strict=True):
        times = min(most * n, max(0, math.floor(owed / size + rate * n + 0.5))) if size else 0
        owed += (rate * n - times) * size
        wholes.append(times // n)
        mores.append(times % n)
    rows["whole"], rows["more"] = wholes, mores
    return rows[["doc_id", "source", "th", "size", "n", "source_size", "target", "whole", "more"]]


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, source, text and any other columns) with each row repeated as often as the mix takes it; not at all: dropped.

    Null and empty texts are dropped.  Rows that repeat id, source and text are taken as often as all of
    them together, as copies of one of them.
    """
    units = _units(docs, *(options.get(k, v) for k, v in (("weights", WEIGHTS), ("share", SHARE), ("cap", CAP))))
    taken = units.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("th").alias("h"), "n", (F.col("whole") * F.col("n") + F.col("more")).alias("times"))
    taken = if_small(cut(taken.where("times > 0")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    same = (F.col("th") == F.col("h")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("of"))
    met = rows.join(taken, same).select("row", "id", "of", "h", "n", "times")
    once = met.where("n = 1").unionAll(met.where("n > 1").dropDuplicates(["id", "of", "h"]))
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")

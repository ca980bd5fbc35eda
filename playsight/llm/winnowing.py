"""Benchmark decontamination by winnowing, in DataFrame functions only.

K-word grams of each text are hashed; of each window of consecutive grams the least hash is a
fingerprint.  Two texts that share SPAN = K + WINDOW - 1 or more consecutive words share a whole
window and so a fingerprint.  Fingerprints of documents and benchmark are joined (the benchmark's
are broadcast only within a counted bound); the hits of the documents found are then extended
along their diagonal, which gives the exact shared spans.  Items of fewer than SPAN words match
as a whole, by a gram of their own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.llm.common import cut, if_small

#: Words that an item's window has.
SPAN = 13
#: Words of a gram; a window then has SPAN - K + 1 grams.
K = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """df with `w` (words): replaces it by `fp`, the distinct least hashes of each window of grams."""
    # explode(array(x)) keeps the optimizer from repeating x inside the lambda of the next step
    named = df.withColumn("g", F.explode(F.array(grams(F.col("w"), k)))).drop("w")
    g = F.col("g")
    least = F.transform(F.sequence(F.lit(1), F.size(g) - window + 1), lambda j: F.array_min(F.slice(g, j, window)))
    return named.withColumn("fp", F.when(F.size(g) > window, F.array_distinct(least)).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(F.array().cast("array<bigint>"))).drop("g")


def hit_spans(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(every document with its word count, every shared span).

    docs: (doc_id, text), benchmark: (item_id, text).  The first table is (doc_id, th, n_words), th a
    hash of the text; the second (doc_id, th, item_id, first, last): word positions, both included.
    Rows that repeat an id and its text are one document; other texts under the same id are others.
    """
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = cut(benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null"))
    window = span - k + 1
    prints = cut(_fingerprints(items.where(F.size("w") >= span), k, window).select(F.explode("fp").alias("fp")).distinct())
    lengths = [r[0] for r in items.where(F.size("w") < span).select(F.size("w").alias("n")).distinct().collect()]  # fewer than span numbers

    with_words = docs.select("doc_id", "th", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    marked = _fingerprints(with_words.withColumn("n_words", F.size("w")), k, window)
    tried = marked.select("doc_id", "th", "n_words", F.explode_outer("fp").alias("fp"))
    joined = tried.join(if_small(prints.withColumn("is_hit", F.lit(1))), "fp", "left")
    counted = cut(joined.groupBy("doc_id", "th").agg(F.max("n_words").cast("long").alias("n_words"), F.max("is_hit").alias("is_hit")))

    found = cut(counted.where("is_hit = 1 and doc_id is not null").select("doc_id").distinct())
    near = docs.join(if_small(found), "doc_id", "left_semi").select("doc_id", "th", words_of(F.col("text")).alias("w"))
    spans = [_extended(near, items.where(F.size("w") >= span), k, window)]
    if lengths:
        whole = docs.select("doc_id", "th", F.explode(F.array(words_of(F.col("text")))).alias("w"))
        spans += [_extended(whole, items.where(F.size("w") == n), n, 1) for n in sorted(lengths)]
    return counted.select("doc_id", "th", "n_words"), reduce(DataFrame.unionAll, spans)


def _extended(docs: DataFrame, items: DataFrame, k: int, run: int) -> DataFrame:
    """Maximal diagonals of at least `run` successive equal k-grams, as spans of words."""
    one = docs.withColumn("g", F.explode(F.array(grams(F.col("w"), k)))).select("doc_id", "th", F.posexplode("g").alias("pos", "gram"))
    two = items.select("item_id", F.posexplode(grams(F.col("w"), k)).alias("at", "gram"))
    hits = one.join(if_small(cut(two)), "gram").select("doc_id", "th", "item_id", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    line = W.partitionBy("doc_id", "th", "item_id", "diagonal").orderBy("pos")
    runs = hits.distinct().withColumn("island", F.col("pos") - F.row_number().over(line))
    ends = runs.groupBy("doc_id", "th", "item_id", "diagonal", "island").agg(F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"), F.count("*").alias("c"))
    return ends.where(F.col("c") >= run).select("doc_id", "th", "item_id", "first", "last")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, th) per document.

    Null and empty texts have no words and are clean, as is everything when the benchmark is empty.
    A null doc_id gets its word count but is not searched.  Null item ids are skipped; equal items
    under several ids count once each.
    """
    counted, spans = hit_spans(docs, benchmark, span, k)
    spans = cut(spans)
    before = W.partitionBy("doc_id", "th").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    fresh = spans.select("doc_id", "th", "first", "last").distinct().withColumn("done", F.coalesce(F.max("last").over(before), F.lit(-1)))
    n_hit = fresh.groupBy("doc_id", "th").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.col("done")))).cast("long").alias("n_hit"))
    which = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    out = counted.join(n_hit, ["doc_id", "th"], "left").join(which, ["doc_id", "th"], "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("any"),
        "th",
    ).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("any") & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "th")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

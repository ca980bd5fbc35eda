"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash of the document's key.  All rows start in one
bucket; only buckets over the byte limit split on one more bit, until each is within the limit (or
holds one row).  Byte sums per cell of the directory are distributed sums, and rolled up over all
depths of a level at once; further levels look only at cells that are still too large.  Rows that
no bit of their key tells apart (one key with more bytes than the limit) are dealt into slots along
a running sum of their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playsight.llm.common import cut, if_small, running_total

LIMIT = 4 << 20
BITS = 60
#: Bits that a level adds after the first, whose bits follow from the total size.
LEVEL = 8


def _prefix(depth) -> F.Column:
    return F.expr(f"shiftrightunsigned(h, cast({BITS} - {depth} as int))")


def extendible_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, slot, shard, shard_bytes) for every row.

    A row is as large as its UTF-8 text; null and empty texts have 0 bytes.  Rows that share a key
    share a shard unless they alone exceed the limit; a null key is a key.  A single row above the
    limit has a shard of its own.  An empty table gives an empty result.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    sized = cut(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hashed.alias("h")))
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, total // limit + 1).bit_length() + 3)
    decided, start, open_rows = [], 0, sized
    while True:
        end = min(BITS, start + LEVEL) if start else depth
        cells = cut(open_rows.groupBy(_prefix(end).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c")))
        rolled = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, cast({end} - depth as int))"))
        whole = rolled.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("c").alias("rows"))
        leaves = rolled.join(whole, ["depth", "prefix"]).where(f"shard_bytes <= {limit} or rows = 1").groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        directory = if_small(cut(cells.select("cell").join(leaves, "cell", "left")), 200_000)
        placed = open_rows.withColumn("cell", _prefix(end)).join(directory, "cell").drop("cell")
        decided.append(placed.where("leaf is not null").select("doc_id", "n_bytes", F.col("leaf.depth").alias("depth"), F.col("leaf.prefix").alias("prefix"), F.lit(0).cast("long").alias("slot"), "leaf.shard_bytes"))
        open_rows = cut(placed.where("leaf is null").drop("leaf"))
        start = end
        if open_rows.isEmpty() or end == BITS:
            break
    if not open_rows.isEmpty():
        half = limit // 2
        small = running_total(open_rows.where(f"n_bytes <= {half}"), ["h", "n_bytes", "doc_id"], "n_bytes", "before", group="h").withColumn("slot", F.expr(f"2 * (before div {half})"))
        large = running_total(open_rows.where(f"n_bytes > {half}").withColumn("one", F.lit(1).cast("long")), ["h", "n_bytes", "doc_id"], "one", "before", group="h").withColumn("slot", F.col("before") * 2 + 1)
        rest = cut(small.select("doc_id", "n_bytes", "h", "slot").unionAll(large.select("doc_id", "n_bytes", "h", "slot")))
        sums = rest.groupBy("h", "slot").agg(F.sum("n_bytes").alias("shard_bytes"))
        rest = rest.join(sums, ["h", "slot"])
        decided.append(rest.select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "slot", "shard_bytes"))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionAll(more)
    shard = F.concat_ws("-", F.col("depth").cast("string"), F.col("prefix").cast("string"), F.col("slot").cast("string"))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("long").alias("depth"), "prefix", "slot", shard.alias("shard"), "shard_bytes")


ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
e AS (SELECT doc_id, n_bytes, h, depth, h >> ({BITS} - depth) AS prefix FROM s, (SELECT unnest(range(0, {BITS} + 1)) AS depth)),
t AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM e GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT} OR count(*) = 1),
m AS (SELECT doc_id, n_bytes, depth, prefix, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM e JOIN t USING (depth, prefix))
SELECT doc_id, n_bytes, depth, prefix, CAST(0 AS BIGINT) AS slot, depth || '-' || prefix || '-0' AS shard, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM m WHERE k = 1
"""

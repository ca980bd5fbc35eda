"""Shared Spark plumbing of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of two or three fixed-width columns may be broadcast.
#: Counted before each use; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Links (16 bytes each) up to which one task may contract what is left of them.
TOGETHER = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir; in local mode (tests) sets one where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, so that a lost executor costs a re-read only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Like cut, but as a compressed table (below `folder`, if given): for what is large and needed to the end."""
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch_folder(df.sparkSession, "written")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a (cheap, already cut) narrow table for broadcast if its row count is within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_total(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one (exclusive), ordered by `order`.

    With `group`, which must then lead `order`, sums restart with each group.  Rows are dealt
    by range of the whole order (ties in the hot prefix are spread as far as the order tells rows
    apart), summed inside each range, and shifted by the totals of the ranges before: only one
    number a range and group crosses tasks, never the rows.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    keys = ["_part", *([group] if group else [])]
    from pyspark.sql import Window as W

    totals = dealt.groupBy(*keys).agg(F.sum(value).alias("_total"))
    # at most (number of ranges + number of groups) rows
    before = W.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = cut(totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [local[k].eqNullSafe(totals[k]) for k in keys]
    both = local.join(if_small(totals), match[0] if len(match) == 1 else match[0] & match[1])
    return both.select(*[local[c] for c in df.columns], (F.col("_before") + F.col("_local")).alias(out))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: the same components with one link a node."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            while (p := parent.setdefault(a, a)) != a:
                parent[a] = a = parent[p]
            while (p := parent.setdefault(b, b)) != b:
                parent[b] = b = parent[p]
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes, roots = [], []
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        if r != x:
            nodes.append(x)
            roots.append(r)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (columns a, b; other columns ignored).

    Links are contracted inside each partition.  While more than TOGETHER are left they are dealt to
    larger and smaller neighbours (large-star, small-star), each round cut, until nothing changes; as
    soon as no more than that are left, one task contracts them.  Nodes without links don't appear.
    Nothing is gathered on the driver but two sums a round.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = cut(edges.mapInArrow(_contract, "u long, v long"))
    before = None
    while (count := edges.count()) > TOGETHER:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u")
        edges = cut(
            linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    if 0 < count <= TOGETHER:
        edges = edges.coalesce(1).mapInArrow(_contract, "u long, v long")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def long_list(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """A list<int64> column of 64-bit hashes from flat values and n+1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))

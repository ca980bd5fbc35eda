"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its NEAREST closest pivots (reference vectors from a bounded sample), in
order.  Inverted lists hold, for each label and pivot, the vectors that have it among theirs; two
vectors of a list with at least SHARED pivots in common are compared, in the list of the first pivot
they share only, by cosine in double precision.  A list beyond LIST rows is dealt into blocks, and
each pair of blocks is a task of its own.  Links are counted where they are found and come out
contracted to one link a vector, so no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playsight.llm.common import components, cut, if_small

COSINE = 0.93
NEAREST = 6
SHARED = 2
#: Pivots: one for so many different vectors, between the two bounds.
PER_PIVOT, FEWEST, MOST = 64, 32, 4096
#: Rows of a list that one task compares at once.
LIST = 2048
#: Rows of them whose products are held at once.
TILE = 256


def _nearest(pivots: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(values), -1) if len(values) else np.zeros((0, pivots.shape[1]))
            norm = np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True) if len(x) else np.ones((0, 1))
            close = (x / norm) @ pivots.T
            k = min(nearest, len(pivots))
            top = np.argpartition(-close, k - 1, axis=1)[:, :k] if len(x) else np.zeros((0, k), np.int64)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, batch.column(3), lists], names=["cid", "label", "embedding", "copies", "near"])

    return run


def _compared(cosine: float, shared: int):
    """One partition of rows (list key, block pair, side, cid, copies, near, embedding), sorted by list and pair."""

    def links(rows: list[tuple]) -> tuple[list, list, list]:
        pivot, pair = rows[0][1], rows[0][3]
        x = np.array([r[7] for r in rows], np.float64)
        big = np.abs(x).max(axis=1, keepdims=True)
        x = x / big
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = np.array([r[6] for r in rows], np.int64)
        ids, codes = np.unique(near, return_inverse=True)
        has = np.zeros((len(rows), len(ids)), np.float32)
        has[np.arange(len(rows))[:, None], codes.reshape(near.shape)] = 1
        early = np.ascontiguousarray(has[:, ids < pivot])
        block = np.array([r[2] for r in rows])
        linked = np.zeros((len(rows), len(rows)), bool)
        for t in range(0, len(rows), TILE):
            part = slice(t, t + TILE)
            near_by = (has[part] @ has.T >= shared) & (early[part] @ early.T == 0)
            if pair[0] != pair[1]:
                near_by &= block[part, None] != block[None]
            linked[part] = near_by & (x[part] @ x.T >= cosine)
        np.fill_diagonal(linked, False)
        copies = np.array([r[5] for r in rows], np.float64)
        count = np.concatenate([linked[t : t + TILE] @ copies for t in range(0, len(rows), TILE)])
        root = np.arange(len(rows))
        while True:
            least = np.concatenate([np.where(linked[t : t + TILE], root[None], len(rows)).min(axis=1) for t in range(0, len(rows), TILE)])
            low = np.minimum(root, least)
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(count)
        cid = np.array([r[4] for r in rows], np.int64)
        return cid[some].tolist(), count[some].astype(np.int64).tolist(), cid[root[some]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        held: list[tuple] = []
        last = None

        def close() -> None:
            if len(held) > 1:
                for column, more in zip(out, links(held), strict=True):
                    column.extend(more)
            held.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)] + [batch.column(7).to_numpy(zero_copy_only=False)]
            for row in zip(*columns, strict=True):
                row = (row[0], row[1], row[2], (row[3] // 65536, row[3] % 65536), *row[4:])
                key = (row[0], row[1], row[3])
                if key != last:
                    close()
                    last = key
                held.append(row)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["a", "n", "b"])
                out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["a", "n", "b"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, limit: int = LIST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal length are compared.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, as do rows with a null id.
    Equal vectors are one entry of the index, and all linked.
    """
    # floats travel as floats, and are compared as doubles
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    valid = valid.withColumn("label", F.concat_ws(":", F.size("embedding").cast("string"), "label"))
    classed = cut(valid.withColumn("h", F.xxhash64("embedding")))
    classes = cut(classed.select("label", "h", "vec_id").distinct().groupBy("label", "h").agg(F.min("vec_id").alias("cid"), F.count("*").cast("int").alias("copies")))
    lead = classed.join(if_small(classes), ["label", "h"]).where("vec_id = cid").dropDuplicates(["vec_id"]).select("cid", "label", "embedding", "copies")
    lead = cut(lead)
    counted = []
    for (dim,) in lead.select(F.size("embedding")).distinct().collect():
        own = lead.where(F.size("embedding") == dim)
        n = own.count()
        wanted = min(MOST, max(FEWEST, n // PER_PIVOT))
        picked = own.orderBy(F.xxhash64("cid"), "cid").select("embedding").limit(wanted).collect()
        pivots = np.array([r[0] for r in picked], np.float64)
        pivots = pivots / np.abs(pivots).max(axis=1, keepdims=True)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        schema = f"cid long, label string, embedding {kind}, copies int, near array<int>"
        described = own.mapInArrow(_nearest(pivots, nearest), schema)
        listed = cut(described.select("cid", "label", "copies", "near", "embedding", F.explode("near").alias("pivot")))
        sizes = cut(listed.groupBy("label", "pivot").agg(F.count("*").alias("m")).where(F.col("m") > limit))
        placed = listed.join(if_small(sizes), ["label", "pivot"], "left").withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / limit).cast("int"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumn("pair", F.least("block", "other") * 65536 + F.greatest("block", "other"))
        rows = placed.select("label", "pivot", "block", "pair", "cid", "copies", "near", "embedding")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = rows.repartition(parts, "label", "pivot", "pair").sortWithinPartitions("label", "pivot", "pair")
        counted.append(cut(found.mapInArrow(_compared(cosine, shared), "a long, n long, b long")))
    ids = vectors.select("vec_id")
    if not counted:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = counted[0]
    for more in counted[1:]:
        links = links.unionAll(more)
    totals = links.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comps = components(links)
    member = classed.select("vec_id", "label", "h").join(classes, ["label", "h"])
    member = member.join(totals, "cid", "left").join(comps, F.col("cid") == F.col("node"), "left")
    member = member.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "cid").alias("c")).groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = ids.join(member, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

"""Blocks of texts that ask a sharded table for what they hold.

A block is a few MB of texts, packed.  It asks for each of its different codes (64-bit integers) once:
one packed list a shard of the table.  The lists meet their shard in sorted order, so a task holds one
shard of the table and streams the lists; the answers go back to the bucket of the block.  So neither
texts nor their words one by one cross the shuffle, and a code that every block holds is one entry of a
list in each: no key is hot.  Retried tasks give the same blocks, for the blocks are a written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playsight.llm.common import discard, scratch_folder

#: Bytes of text that a block holds, about.
BLOCK = 4 << 20
#: Codes are dealt to shards by their remainder by this prime first.
_PRIME = 1_000_003
#: Most buckets that Spark gives a table.
_BUCKETS = 100_000

ASKS = "array<struct<shard:int,codes:binary>>"


def shards_of(spark: SparkSession) -> int:
    """As many shards and buckets as shuffle partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), _BUCKETS))


def squeezed(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers: differences, a byte plane at a time, compressed."""
    planes = np.diff(values, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def loosened(packed: bytes) -> np.ndarray:
    """What squeezed() packed."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def asks_of(codes: np.ndarray, shards: int) -> list[dict]:
    """Lists by shard of sorted different int64 codes."""
    shard = codes % _PRIME % shards
    by = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[by], np.arange(shards + 1))
    return [{"shard": int(k), "codes": squeezed(codes[by[bounds[k] : bounds[k + 1]]])} for k in np.flatnonzero(np.diff(bounds))]


def shard(code: str, shards: int) -> F.Column:
    """The shard of a code, as asks_of() deals it."""
    return F.pmod(F.pmod(code, F.lit(_PRIME)), F.lit(shards)).cast("int")


@contextmanager
def bucketed(blocks: DataFrame) -> Iterator[tuple[DataFrame, str]]:
    """Writes blocks, numbered, bucketed by `block`, into the shared folder; gives them and a folder for more, and removes both at the end."""
    spark = blocks.sparkSession
    folder, name = scratch_folder(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    numbered = blocks.withColumn("block", F.monotonically_increasing_id())
    numbered.write.option("path", f"{folder}/blocks").option("compression", "zstd").bucketBy(shards_of(spark), "block").saveAsTable(name)
    try:
        yield spark.table(name), folder
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, folder)


def _answered(types: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, block, codes, code, values...) sorted by shard and block: a shard of the table, then the lists that ask it."""
        at, known, index, columns = None, [], np.zeros(0, np.int64), []
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            shards, blocks, asked = (batch.column(i).to_pylist() for i in range(3))
            table = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            values = [pc.fill_null(batch.column(3 + i), 0).to_numpy(zero_copy_only=False) for i in range(1 + len(types))]
            out: list[tuple[int, int, bytes]] = []
            i = 0
            while i < len(shards):
                if shards[i] != at:
                    at, known, index = shards[i], [], None
                if table[i]:
                    j = i
                    while j < len(shards) and table[j] and shards[j] == at:
                        j += 1
                    known.append([v[i:j] for v in values])
                    i = j
                    continue
                if index is None:
                    index = np.concatenate([k[0].astype(np.int64) for k in known]) if known else np.zeros(0, np.int64)
                    order = np.argsort(index)
                    # one more value, all zero, for codes that the table lacks
                    columns = [np.append(np.concatenate([k[1 + c] for k in known]).astype(t)[order], np.zeros(1, t)) if known else np.zeros(1, t) for c, t in enumerate(types)]
                    index, known = index[order], []
                codes = loosened(asked[i])
                place = np.searchsorted(index, codes)
                found = place < len(index)
                found[found] = index[place[found]] == codes[found]
                place[~found] = len(index)
                planes = [np.ascontiguousarray(c[place].view(np.uint8).reshape(len(place), -1).T).tobytes() for c in columns]
                out.append((blocks[i], shards[i], pack.compress(b"".join(planes))))
                i += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "packed"])

    return run


def answers(blocks: DataFrame, table: DataFrame, values: dict[str, str]) -> DataFrame:
    """(block, shard, packed): for each list of blocks (block, asks), the values of its codes in `table`; zeros for those it lacks.

    table: (code, one column for each of `values`), each code once.  values: column -> NumPy type ("<i8", "<f8", or "<f4" to send less).
    """
    n = shards_of(blocks.sparkSession)
    spark_type = {"<i8": "long", "<f8": "double", "<f4": "double"}
    empty = lambda kind: F.lit(None).cast(kind)
    rows = table.select(shard("code", n).alias("shard"), empty("long").alias("block"), empty("binary").alias("codes"), "code", *[F.col(v).cast(spark_type[t]).alias(v) for v, t in values.items()])
    lists = blocks.select("block", F.explode("asks").alias("x")).select("x.shard", "block", "x.codes", empty("long").alias("code"), *[empty(spark_type[t]).alias(v) for v, t in values.items()])
    met = rows.unionAll(lists).repartition(n, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    return met.mapInArrow(_answered(list(values.values())), "block long, shard int, packed binary")


def told(asks: list[dict], answered: dict[int, bytes], types: list[str]) -> list[np.ndarray]:
    """The codes of a block in ascending order, then the values of each column for them."""
    unpack = zstandard.ZstdDecompressor()
    codes = [loosened(x["codes"]) for x in asks]
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for x, own in zip(asks, codes, strict=True):
        raw, at = np.frombuffer(unpack.decompress(answered[x["shard"]]), np.uint8), 0
        for c, t in enumerate(types):
            wide = np.dtype(t).itemsize
            parts[c].append(np.ascontiguousarray(raw[at : at + wide * len(own)].reshape(wide, -1).T).view(t).ravel())
            at += wide * len(own)
    joined = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    by = np.argsort(joined)
    return [joined[by], *[np.concatenate(p)[by] if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]]


def answered_blocks(blocks: DataFrame, answered: DataFrame, run, schema: str) -> DataFrame:
    """run(block's row as a dict, shard -> packed answer) -> a record batch, for each block."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        said = dict(zip(right.column("shard").to_pylist(), right.column("packed").to_pylist(), strict=True))
        return pa.Table.from_batches([run(row, said) for row in left.to_pylist()])

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(one, schema)

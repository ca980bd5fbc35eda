"""Document quality by an interpolated modified Kneser-Ney n-gram model.

The model is over bytes of a text's UTF-8 form, of order ORDER, one per language, and is trained on
trusted text: labelled good, and not set aside for calibration.  A byte n-gram sees about a word; so
that it also sees words repeated, a mark is put behind each word that equals the word before it
or the one before that.  An n-gram is a 64-bit integer of up to seven bytes, so lower orders follow by
shifts.  Counts, continuation counts, discounts and
back-off weights are Spark aggregations; the probabilities that documents need are found by joining
their distinct n-grams with the sharded counts, order by order.

A document is rejected if its perplexity is above the QUANTILE of its language among the trusted
documents set aside; both are taken less the scatter that a text of that length has.

Texts are packed into blocks (a few MB of text of one language, compressed), written bucketed by
block.  A block asks for each of its distinct n-grams once: one packed list a shard of the model, as
many shards as shuffle partitions.  The lists meet their shard of the model in sorted order, so a task
holds one shard and streams the lists; lists of log-probabilities go back to the bucket of the block.
So neither texts nor the text's n-grams one by one cross the shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playsight.llm.common import cut, discard, if_small, scratch_folder, written
from playsight.llm.textkit import CHUNK_BYTES, Words, chunks

ORDER = 5
#: Rejected above this quantile of the trusted documents set aside, per language.
QUANTILE = 0.99
#: And above this multiple of it, so that the tail of good text stays.
MARGIN = 1.05
#: A mean over n symbols scatters by about this over the root of n (in natural logs); short texts are given that much.
SCATTER = 3.0
#: Bytes of text that a block holds, about.
BLOCK = 4 << 20
#: Symbols that may follow a context: 256 bytes and the end of text.
SYMBOLS = 257
#: 0xFF never occurs in UTF-8 and marks the end; 0x00 pads the start.
_END = 0xFF
#: Marks behind a word that equals the last word, or the one before it.
_AGAIN = (1, 2)
#: N-grams are dealt to shards by their remainder by this prime first, so that no shard stands for a byte.
_PRIME = 1_000_003
#: Most buckets that Spark gives a table.
_BUCKETS = 100_000


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with marks behind repeated words."""
    words = Words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    mark = np.zeros(len(words.hash), np.uint8)
    for back in (2, 1):
        same = (words.hash[back:] == words.hash[:-back]) & (row[back:] == row[:-back])
        mark[back:][same] = _AGAIN[back - 1]
    at = words.end[mark > 0]
    added = np.bincount(row[mark > 0], minlength=len(offsets) - 1)
    return np.insert(data, at, mark[mark > 0]), offsets + np.concatenate([[0], np.cumsum(added)])


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order-gram that ends at each byte, and at the end, of each text; and the row of each."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    wide = sizes + order  # order - 1 zeros, the text, the end mark
    begin = np.cumsum(wide) - wide
    flat = np.zeros(int(wide.sum()), np.uint8)
    rows = np.repeat(np.arange(n), sizes)
    flat[np.arange(len(data)) - offsets[rows] + begin[rows] + order - 1] = data
    flat[begin + wide - 1] = _END
    code = np.zeros(max(0, len(flat) - order + 1), np.int64)
    for k in range(order):
        code = (code << 8) | flat[k : len(flat) - order + 1 + k]
    ends = np.repeat(np.arange(n), sizes + 1)
    at = np.arange(len(ends)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1) + begin[ends]
    return code[at], ends


def _counted(data: np.ndarray, sizes: np.ndarray, learned: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct order-grams of texts in a row, and how often each occurs in those learned from; a run of texts at a time."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        found, rows = _codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
        more, inverse = np.unique(found, return_inverse=True)
        times = np.bincount(inverse, learned[a:b][rows], len(more)).astype(np.int64)
        codes, inverse = np.unique(np.concatenate([codes, more]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, times]), len(codes)).astype(np.int64)
        a = b
    return codes, counts


def _squeezed(values: np.ndarray) -> bytes:
    """Sorted non-negative 64-bit integers: differences, a byte plane at a time, compressed."""
    planes = np.diff(values, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _loosened(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _blocks(order: int, shards: int):
    """Packs rows (doc_id, text, lang, role) into blocks by language, with their n-grams by shard."""
    ask = pa.struct([("shard", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])

    def emit(lang, ids: list, roles: list, texts: list[bytes]) -> pa.RecordBatch:
        data = b"".join(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        codes, counts = _counted(np.frombuffer(data, np.uint8), sizes, np.array(roles) == 1, order)
        packed = zstandard.ZstdCompressor(level=6).compress(data)
        shard = codes % _PRIME % shards
        by = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[by], np.arange(shards + 1))
        asks = []
        for k in np.flatnonzero(np.diff(bounds)):
            own = by[bounds[k] : bounds[k + 1]]
            times = counts[own].astype("<i8").tobytes() if counts[own].any() else b""
            asks.append({"shard": int(k), "codes": _squeezed(codes[own]), "counts": times})
        one = lambda kind, x: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(pa.string(), lang), one(pa.list_(pa.int64()), ids), one(pa.list_(pa.int32()), roles), one(pa.list_(pa.int64()), sizes), one(pa.binary(), packed), one(pa.list_(ask), asks)],
            names=["lang", "ids", "roles", "sizes", "packed", "asks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str | None, list] = {}
        for batch in batches:
            ids, langs, roles = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for a, b, data, offsets in chunks(batch.column(1)):
                data, offsets = _marked(data, offsets)
                raw, offsets = data.tobytes(), offsets.tolist()
                for i in range(a, b):
                    text = raw[offsets[i - a] : offsets[i - a + 1]]
                    block = open_blocks.setdefault(langs[i], [[], [], [], 0])
                    block[0].append(ids[i])
                    block[1].append(roles[i])
                    block[2].append(text)
                    block[3] += len(text)
                    if block[3] >= BLOCK:
                        yield emit(langs[i], *block[:3])
                        del open_blocks[langs[i]]
        for lang, block in open_blocks.items():
            yield emit(lang, *block[:3])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (lang, codes, counts) of whole shards: each different n-gram of a language once, with its count."""
    have: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
    wait: dict[str | None, list] = {}
    waiting: Counter = Counter()

    def settle(lang) -> None:
        parts = ([have[lang]] if lang in have else []) + wait.pop(lang)
        waiting[lang] = 0
        codes, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, inverse, np.concatenate([y for _, y in parts]))
        have[lang] = codes, counts

    for batch in batches:
        for lang, packed, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            codes = _loosened(packed)
            counts = np.frombuffer(times, "<i8") if times else np.zeros(len(codes), np.int64)
            wait.setdefault(lang, []).append((codes, counts))
            # as much waits as is held: each n-gram is sorted again a few times only
            waiting[lang] += len(codes)
            if waiting[lang] > max(1 << 18, len(have[lang][0]) if lang in have else 0):
                settle(lang)
    for lang in list(wait):
        settle(lang)
    for lang, (codes, counts) in have.items():
        for a in range(0, len(codes), 100_000):
            n = len(codes[a : a + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(codes[a : a + n]), pa.array(counts[a : a + n])], names=["lang", "code", "n"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, shard, block, codes, code, log_p) sorted by key, shard and block: a shard of the model, then the lists that ask it."""
    at, known, index, values = None, [], None, None
    for batch in batches:
        keys, shards, blocks, asked = (batch.column(i).to_pylist() for i in range(4))
        codes, log_p = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
        model = batch.column(3).is_null().to_numpy(zero_copy_only=False)
        out: list[tuple[int, int, bytes]] = []
        i = 0
        while i < len(keys):
            if (keys[i], shards[i]) != at:
                at, known, index = (keys[i], shards[i]), [], None
            if model[i]:
                j = i
                while j < len(keys) and model[j] and (keys[j], shards[j]) == at:
                    j += 1
                known.append((codes[i:j].astype(np.int64), log_p[i:j]))
                i = j
                continue
            if index is None:
                index, values = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(index)
                index, values = index[order], values[order].astype("<f4")
            out.append((blocks[i], shards[i], values[np.searchsorted(index, _loosened(asked[i]))].tobytes()))
            i += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "log_p"])


def _perplexities(order: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block (repeated blocks are equal) and the log-probabilities of its n-grams."""
        if not len(left):
            return pd.DataFrame({"doc_id": [], "role": [], "lang": [], "n_symbols": [], "log_p": []})
        answer = dict(zip(right["shard"], right["log_p"], strict=True))
        asks = left["asks"].iloc[0]
        codes = np.concatenate([_loosened(x["codes"]) for x in asks])
        values = np.concatenate([np.frombuffer(answer[x["shard"]], "<f4") for x in asks]).astype(np.float64)
        by = np.argsort(codes)
        codes, values = codes[by], values[by]
        out = []
        for row in left.itertuples():
            sizes = np.asarray(row.sizes, np.int64)
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.packed), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            total = np.zeros(len(sizes))
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
                found, rows = _codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
                total[a:b] = np.bincount(rows, values[np.searchsorted(codes, found)], b - a)
                a = b
            out.append(pd.DataFrame({"doc_id": np.asarray(row.ids, object), "role": np.asarray(row.roles, np.int32), "lang": row.lang, "n_symbols": sizes + 1, "log_p": total}))
        return pd.concat(out)

    return run


def _suffix(column: str, n: int) -> F.Column:
    """The last n bytes of an n-gram."""
    return F.col(column).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _context(column: str) -> F.Column:
    return F.shiftright(F.col(column), 8)


def _levels(counts: DataFrame, order: int, folder: str | None) -> list[tuple[int, DataFrame, DataFrame, DataFrame]]:
    """For each order from the highest down: (n, n-grams with their count, contexts, discounts), by language.

    Below the highest order the count of an n-gram is the number of different bytes before it.
    """
    levels = []
    grams = counts
    for n in range(order, 0, -1):
        grams = written(grams, folder)
        kinds = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2)] + [F.sum((F.col("c") >= 3).cast("long")).alias("n3")]
        contexts = grams.groupBy("lang", _context("code").alias("context")).agg(F.sum("c").alias("total"), *kinds)
        of = grams.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)])
        y = F.coalesce(F.try_divide("t1", F.col("t1") + 2 * F.col("t2")), F.lit(0.5))
        d = [F.coalesce(k - (k + 1) * y * F.try_divide(f"t{k + 1}", f"t{k}"), F.lit(0.5)) for k in (1, 2, 3)]
        discounts = of.select("lang", *[F.greatest(F.lit(0.05), F.least(x, F.lit(k - 0.05))).alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)])
        levels.append((n, grams, contexts, discounts))
        if n > 1:
            grams = grams.groupBy("lang", _suffix("code", n - 1).alias("code")).agg(F.count("*").alias("c"))
    return levels


def log_probabilities(wanted: DataFrame, counts: DataFrame, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """wanted: (lang, code), distinct; counts: (lang, code, c) of the trusted text.  Adds log_p (natural log).

    Joins the sharded counts and contexts of each order; a language without trusted text gets the
    uniform distribution.  Tables of the orders are written below `folder`.
    """
    levels = _levels(counts, order, folder)
    found = wanted.withColumn("p", F.lit(1.0 / SYMBOLS))
    keyed = wanted
    # distinct keys of each order, lowest first, each built on the probability of the order below
    for n, grams, contexts, discounts in reversed(levels):
        keyed = wanted.select("lang", _suffix("code", n).alias("key")).distinct()
        same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
        g = grams.select(F.col("lang").alias("_gl"), F.col("code").alias("_g"), "c")
        c = contexts.withColumnRenamed("lang", "_cl")
        d = discounts.withColumnRenamed("lang", "_dl")
        row = keyed.join(g, (F.col("key") == F.col("_g")) & same("lang", "_gl"), "left")
        row = row.join(c, (F.shiftright("key", 8) == F.col("context")) & same("lang", "_cl"), "left")
        row = row.join(if_small(d), same("lang", "_dl"), "left")
        if n == 1:
            lower = F.lit(1.0 / SYMBOLS)
        else:
            below = found.select(F.col("lang").alias("_bl"), F.col("key").alias("_b"), F.col("p").alias("lower"))
            row = row.join(below, (_suffix("key", n - 1) == F.col("_b")) & same("lang", "_bl"))
            lower = F.col("lower")
        kept = F.when(F.col("c").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))))
        freed = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
        p = F.when(F.col("total").isNull(), lower).otherwise((kept + freed * lower) / F.col("total"))
        found = written(row.select("lang", "key", p.alias("p")), folder)
    return found.select("lang", F.col("key").alias("code"), F.log("p").alias("log_p"))


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, name: Column | None = None) -> DataFrame:
    """(doc_id, lang, role, n_symbols, log_p, perplexity) for every row of docs (doc_id, text, lang).

    `name`, a long made from columns of docs, stands in place of the doc_id in the result, if given.

    trusted: (doc_id), distinct and cut.  role: 1 trusted and trained on, 2 trusted and set aside for
    calibration (one in five, by hash), 0 otherwise.  n_symbols: bytes, marks and the end.  Null texts
    count as empty: one end mark.  A long text is one text; its n-grams are counted a run at a time.
    """
    role = F.when(F.col("_t").isNull(), 0).when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, 2).otherwise(1)
    id_ = F.col("doc_id").cast("long")
    marked = docs.select(id_.alias("doc_id"), "text", "lang", (id_ if name is None else name).alias("_name")).join(if_small(trusted.select("doc_id", F.lit(1).alias("_t"))), "doc_id", "left")
    rows = marked.select("_name", F.coalesce("text", F.lit("")).alias("text"), "lang", role.cast("int").alias("role"))
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = rows.mapInArrow(_blocks(order, n), "lang string, ids array<long>, roles array<int>, sizes array<long>, packed binary, asks array<struct<shard:int,codes:binary,counts:binary>>")
    folder = scratch_folder(spark, "kneser-ney")
    blocks_name = f"blocks_{uuid.uuid4().hex}"
    keyed = blocks.withColumn("block", F.xxhash64(F.get("ids", F.lit(0)), F.size("ids"), "packed", "lang"))
    keyed.write.option("path", f"{folder}/blocks").option("compression", "zstd").bucketBy(min(n, _BUCKETS), "block").saveAsTable(blocks_name)
    try:
        return _scored(spark, blocks_name, folder, n, order)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {blocks_name}")
        discard(spark, folder)


def _scored(spark: SparkSession, name: str, folder: str, n: int, order: int) -> DataFrame:
    """The texts of the blocks in a bucketed table, with their log-probabilities; cut."""
    blocks = spark.table(name)
    asks = blocks.select("block", "lang", F.explode("asks").alias("x")).select("block", "lang", "x.shard", "x.codes", "x.counts")
    asked = written(asks.repartition(n, "lang", "shard").select("lang", "codes", "counts").mapInArrow(_merged, "lang string, code long, n long"), folder)
    known = log_probabilities(asked.select("lang", "code"), asked.where("n > 0").select("lang", "code", F.col("n").alias("c")), order, folder)
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key")
    shard = F.pmod(F.pmod("code", F.lit(_PRIME)), F.lit(n)).cast("int").alias("shard")
    nothing = lambda kind: F.lit(None).cast(kind)
    model = known.select(key, shard, nothing("long").alias("block"), nothing("binary").alias("codes"), "code", "log_p")
    lists = asks.select(key, "shard", "block", "codes", nothing("long").alias("code"), nothing("double").alias("log_p"))
    met = model.unionAll(lists).repartition(n, "key", "shard").sortWithinPartitions("key", "shard", F.col("block").asc_nulls_first())
    answers = met.mapInArrow(_answered, "block long, shard int, log_p binary")
    scored = blocks.select("block", "lang", "roles", "ids", "sizes", "packed", "asks").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_perplexities(order), "doc_id long, role int, lang string, n_symbols long, log_p double")
    return cut(scored.withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_symbols"))))


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, name: Column | None = None) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, keep) for every row of docs (doc_id, text, lang).

    labels: (doc_id, quality); quality 1 marks trusted text.  The threshold is `margin` times the
    quantile of the perplexities, less the scatter of a text of that length, of the language's trusted
    documents that were set aside; a language (null is one) without any has no threshold, and its
    documents are kept.  Empty texts are kept.  Rows that repeat an id are judged one by one; `name`
    may tell them apart in the result.
    """
    trusted = cut(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    scored = perplexities(docs, trusted, order, name)
    score = F.log("perplexity") - SCATTER / F.sqrt("n_symbols")
    # on a grid of 0.0001, so that the table the quantile is read off is bounded
    bins = scored.where("role = 2 and n_symbols > 1").groupBy("lang").agg(F.percentile(F.round(score, 4), quantile).alias("q"))
    limits = bins.select(F.col("lang").alias("_l"), (F.col("q") + F.log(F.lit(margin))).alias("limit"))
    both = scored.join(if_small(cut(limits)), F.col("lang").eqNullSafe(F.col("_l")), "left")
    keep = F.col("limit").isNull() | (F.col("n_symbols") <= 1) | (score <= F.col("limit"))
    threshold = F.exp(F.col("limit") + SCATTER / F.sqrt("n_symbols"))
    return both.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), keep.alias("keep"))

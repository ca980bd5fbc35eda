"""Phrases whose words occur together more than apart, counted in counting quotient filters.

Only words as frequent as a phrase must be have an id; a rarer word is in no such phrase, so nothing is lost.
Blocks of texts get the ids of their words from the sharded table of words, count their n-grams in
filters, one a shard, and the filters of a shard are merged in order (quotient_filter).  A phrase that
every block holds is one entry of a filter in each: no key is hot in the merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.llm import quotient_filter as qf
from playsight.llm.blocks import BLOCK, answered_blocks, answers, asks_of, bucketed, shards_of, told
from playsight.llm.common import cut, if_small, written
from playsight.llm.textkit import LOWER, Words, chunks, mix

#: Occurrences that a phrase has at least; phrases reported for each language.
LEAST, TOP = 10, 2000
#: A phrase is part of a longer one that has this share (of 100) of its occurrences.
SHARE = 50
#: Parts that a table is repeated in for joins on a word, which a third of all phrases may share.
SALTS = 16
#: What ends a piece: `[.,;:!?\x0A-\x0D]`; what else is between words: space and tab.
_ENDS = np.zeros(256, np.int64)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = 1
_BETWEEN = _ENDS.astype(bool)
_BETWEEN[[0x20, 0x09]] = True


def _language(lang: str) -> np.uint64:
    raw = lang.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.zeros(256, bool)).hash[0] if raw else np.uint64(1)


def _codes(hashes: np.ndarray, lang: str) -> np.ndarray:
    """One code for a word of a language."""
    return mix(hashes ^ mix(np.array([_language(lang)]))[0]).view(np.int64)


def _blocks(shards: int):
    """Packs rows (text, lang) into blocks by language: the words of each with their counts, and the texts as numbers of words."""
    word = pa.struct([("word", pa.string()), ("n", pa.int64())])
    ask = pa.struct([("shard", pa.int32()), ("codes", pa.binary())])

    def emit(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        raw = b"".join(texts)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        found = Words(data, offsets, _BETWEEN)
        codes, first, which, times = np.unique(_codes(found.hash, lang), return_index=True, return_inverse=True, return_counts=True)
        spans = zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)
        words = pa.StructArray.from_arrays([pa.array([raw[a:b] for a, b in spans], pa.binary()).cast(pa.string()), pa.array(times.astype(np.int64))], fields=list(word))
        ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
        row = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
        fresh = np.ones(len(which), bool)  # begins a piece
        if len(which):
            fresh[1:] = (ends[found.start[1:]] > ends[found.end[:-1]]) | (row[1:] != row[:-1])
        planes = np.ascontiguousarray(which.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(planes + np.packbits(fresh).tobytes())
        one = lambda kind, x: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(pa.string(), lang), one(pa.int64(), len(which)), one(pa.binary(), packed), one(pa.list_(ask), asks_of(codes, shards)), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)],
            names=["lang", "n_words", "packed", "asks", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, list] = {}
        total = 0
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, offsets in chunks(batch.column(0)):
                raw, at = LOWER[data].tobytes(), offsets.tolist()
                for i in range(a, b):
                    block = open_blocks.setdefault(langs[i], [[], 0])
                    block[0].append(raw[at[i - a] : at[i - a + 1]])
                    block[1] += len(block[0][-1])
                    total += len(block[0][-1])
                    if block[1] >= BLOCK or total >= 4 * BLOCK:
                        most = max(open_blocks, key=lambda k: open_blocks[k][1])
                        total -= open_blocks[most][1]
                        yield emit(most, open_blocks.pop(most)[0])
        for lang, block in open_blocks.items():
            yield emit(lang, block[0])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, id) -> (code, id)."""
    nothing = np.zeros(256, bool)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in set(langs):
            own = batch.filter(pa.array([x == lang for x in langs]))
            for a, b, data, offsets in chunks(own.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_codes(Words(data, offsets, nothing).hash, lang)), own.column(2).slice(a, b - a)], names=["code", "id"])


def _filtered(bits: int, shards: int):
    half = qf.half_bits(bits)

    def run(row: dict, said: dict[int, bytes]) -> pa.RecordBatch:
        """The filters of a block's n-grams of two and three frequent words, one a shard."""
        _, ids = told(row["asks"], said, ["<i8"])
        n = row["n_words"]
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
        word = ids[np.ascontiguousarray(raw[: 4 * n].reshape(4, -1).T).view("<u4").ravel()] if n else np.zeros(0, np.int64)
        fresh = np.unpackbits(raw[4 * n :], count=n).astype(bool)
        two = np.flatnonzero((word[:-1] > 0) & (word[1:] > 0) & ~fresh[1:])
        three = two[:-1][two[1:] == two[:-1] + 1]
        hi, lo = qf.pack(np.concatenate([word[two], word[three]]), np.concatenate([word[two + 1], word[three + 1]]), np.concatenate([np.zeros(len(two), np.int64), word[three + 2]]), bits)
        hi, lo, counts = qf.summed(*qf.permute(hi, lo, half), np.ones(len(hi), np.int64), half)
        at = qf.shard_bounds(hi, half, shards)
        some = np.flatnonzero(np.diff(at))
        stored = [qf.store(hi[at[k] : at[k + 1]], lo[at[k] : at[k + 1]], counts[at[k] : at[k + 1]], half, shards) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(stored, pa.binary())], names=["shard", "filter"])

    return run


def _merged(bits: int, least: int):
    half = qf.half_bits(bits)

    def rows(merge: qf.Merge) -> Iterator[pa.RecordBatch]:
        hi, lo, counts = merge.total()
        keep = counts >= least
        ids = qf.unpack(*qf.restore(hi[keep], lo[keep], half), bits)
        for a in range(0, len(ids[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (*ids, counts[keep])], names=["w1", "w2", "w3", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, filter) sorted by shard: its n-grams (w3 is 0 where there are two words) that are frequent."""
        at, merge = None, qf.Merge(half)
        for batch in batches:
            for shard, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != at:
                    yield from rows(merge)
                    at, merge = shard, qf.Merge(half)
                merge.add(stored.as_py())
        yield from rows(merge)

    return run


def _salted(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined with table (each key once) on keys, which one key may hold a large part of: dealt in SALTS parts by `by`.

    Never by broadcast: Spark sizes the table as its compressed file, and its SALTS copies no larger.
    """
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).alias("_salt")
    spread = table.withColumn("_salt", F.explode(F.lit(list(range(SALTS))).cast("array<long>")))
    return rows.withColumn("_salt", salt).join(spread.hint("merge"), [*keys, "_salt"]).drop("_salt")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language, of rows (text, lang).

    A-Z count as a-z; texts are split into pieces at `[.,;:!?]` and line ends, and those into words at spaces
    and tabs.  A phrase is two or three words of a piece that occur a >= least times (overlaps included).  Cut after
    its first k words it has parts of l and r occurrences and the score floor(1000000 a a / (l r)); the cut
    with the lowest score counts, of those the smallest k.  A phrase inside a longer one, itself dropped or not, that has
    `share` in 100 of its occurrences is dropped.  n: all words of the language.  Order: score and a downwards,
    then the phrase by its UTF-8 bytes.

    A null lang is `und`; null and empty texts have no words; a text is handled whole, however long; rows that repeat
    count each; an empty table gives no row.  Other columns are ignored.  Two words that share a 64-bit hash
    would be taken for one.  Counts have 14 digits at most.
    """
    spark = docs.sparkSession
    n = shards_of(spark)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    schema = "lang string, n_words long, packed binary, asks array<struct<shard:int,codes:binary>>, words array<struct<word:string,n:long>>"
    with bucketed(rows.mapInArrow(_blocks(n), schema)) as (blocks, folder):
        each = blocks.select("lang", F.explode("words").alias("w")).select("lang", "w.word", "w.n")
        counted = each.groupBy("word", "lang").agg(F.sum("n").alias("c")).where(F.col("c") >= least)
        # dense ids: the place in the partition, then the partition
        dealt = counted.withColumn("_at", F.monotonically_increasing_id())
        frequent = written(dealt, folder)
        parts = F.shiftright("_at", 33)
        width = (frequent.agg(F.max(parts)).first()[0] or 0) + 1
        number = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) * width + parts + 1
        frequent = frequent.select("lang", "word", "c", number.alias("id"))
        bits = max(1, int(frequent.agg(F.max("id")).first()[0] or 0).bit_length())
        known = answers(blocks, frequent.select("lang", "word", "id").mapInArrow(_named, "code long, id long"), {"id": "<i8"})
        filters = answered_blocks(blocks.select("block", "n_words", "packed", "asks"), known, _filtered(bits, n), "shard int, filter binary")
        grams = written(filters.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_merged(bits, least), "w1 long, w2 long, w3 long, a long"), folder)

        def cut_at(k: int, left: str, right: str):
            # whole numbers of up to 35 digits; the quotient is 1000000 at most
            wide = lambda c: f"cast({c} as decimal(14,0))"
            score = F.expr(f"(cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide(left)} * {wide(right)})")
            return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

        by = ["w1", "w2", "w3"]
        word = lambda k: frequent.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"s{k}"), F.col("c").alias(f"c{k}"), *(["lang"] if k == 1 else []))
        bigrams, trigrams = grams.where("w3 = 0").drop("w3"), grams.where("w3 > 0")
        inside = trigrams.select("w1", "w2", "a").unionAll(trigrams.select("w2", "w3", "a")).toDF("w1", "w2", "longer").groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
        pairs = bigrams.join(inside.hint("merge"), ["w1", "w2"], "left").where(f"longer is null or 100 * longer < {int(share)} * a").drop("longer")
        pairs = _salted(_salted(pairs, word(1), ["w1"], ["w1", "w2"]), word(2), ["w2"], ["w1", "w2"])
        pairs = pairs.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", cut_at(1, "c1", "c2").alias("x"))
        triples = trigrams
        triples = _salted(triples, bigrams.select("w1", "w2", F.col("a").alias("first")), ["w1", "w2"], by)
        triples = _salted(triples, bigrams.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("last")), ["w2", "w3"], by)
        for k in (1, 2, 3):
            triples = _salted(triples, word(k), [f"w{k}"], by)
        triples = triples.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", F.array_min(F.array(cut_at(1, "c1", "last"), cut_at(2, "first", "c3"))).alias("x"))
        found = pairs.unionAll(triples).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        # Spark keeps the first rows of each language in each task before it shuffles them
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        totals = cut(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")))
        out = best.join(if_small(totals), "lang")
        return cut(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: {'w1': w[i], 'w2': CAST(NULL AS VARCHAR), 'w3': CAST(NULL AS VARCHAR)})) AS g FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'w1': w[i], 'w2': w[i + 1], 'w3': CAST(NULL AS VARCHAR)})) FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'w1': w[i], 'w2': w[i + 1], 'w3': w[i + 2]})) FROM pieces
), f AS (SELECT lang, g.w1, g.w2, g.w3, count(*) AS a FROM grams GROUP BY ALL),
one AS (SELECT lang, w1 AS w, a FROM f WHERE w2 IS NULL),
two AS (SELECT lang, w1, w2, a FROM f WHERE w2 IS NOT NULL AND w3 IS NULL),
three AS (SELECT lang, w1, w2, w3, a FROM f WHERE w3 IS NOT NULL AND a >= 10),
parts AS (SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three),
longest AS (SELECT lang, w1, w2, max(a) AS longer FROM parts GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.a, 1 AS k, x.a AS l, y.a AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN one y ON y.lang = t.lang AND y.w = t.w2
  LEFT JOIN longest g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2
  WHERE t.a >= 10 AND (g.longer IS NULL OR 100 * g.longer < 50 * t.a)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 1, x.a, y.a
  FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 2, x.a, y.a
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w = t.w3
), scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score
FROM ranked r JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM one GROUP BY lang) n ON n.lang = r.lang WHERE r.rank <= 2000
"""

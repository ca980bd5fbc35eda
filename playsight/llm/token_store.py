"""Token ids in a content-addressed store.

Documents are encoded with the tokenizers library; an end id follows each.  A rolling hash over
the id stream of a document cuts it into chunks at content-defined places, so equal passages give
equal chunks.  Unique chunks are stored once under the SHA-256 of their bytes; a recipe names the
chunks of each document in order, and has their joint hash as its root.  A Merkle manifest is a tree
over those roots: a node for each run of tokens, nodes over FAN nodes each, up to one.  Reading
computes the roots anew from the recipes' chunks, compares all nodes of the tree, joins recipes with
chunks and checks every chunk against its name.

Layout under one folder (Parquet, written and read by Spark alone):
  chunks/     hash binary (of the ids as little-endian unsigned 32-bit), ids binary: a byte with the width (2 or 4), then zstd
  recipes/    doc_id, start, n_tokens, root, chunks array<binary>; sorted by start
  manifest/   level, node, first and last doc_id, documents, n_tokens, root over those below
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playsight.llm.common import cut, discard, if_small, running_total
from playsight.llm.textkit import _BASE, _BASE_INV, _BYTE_CODE, _power_tables, chunks, mix

END_ID = 2
#: Ids of a chunk: at least, on average about (in a long stream), at most.
LEAST, MEAN, MOST = 64, 512, 4096
#: Ids that the rolling hash sees.
ROLL = 16
#: Bytes of text whose pieces are looked up together: each different one once.
TOGETHER = 1 << 20
#: Entries of the per-worker memory of encoded pieces; it is emptied when full.
MEMORY = 1_000_000
#: Tokens of a run of documents that have one node of the manifest (log2); nodes under a higher node.
LEAF, FAN = 14, 1024

_UNUSUAL = "[\u001c-\u001f\u0085   -     　]|<\\|"
#: 1: ASCII white space, 2: ASCII letter, 3: other ASCII, 0: the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[:0x80] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 2


class Encoder:
    """encode_batch of whole texts, with pieces encoded once.

    A byte-level BPE splits text by a pattern whose pieces hold white space at their start only, so
    no piece crosses from a word to the white space behind it, nor from an ASCII letter to an ASCII
    digit or sign behind it.  Texts are cut there; each different piece is encoded by the library once
    and then looked up.  New pieces that start with white space, but hold more, are encoded in one string,
    whose ids are dealt back by the bytes they stand for; should a token cross a join, they are encoded one
    by one.  Texts with other white space than ASCII's, or with a special token's mark, are encoded whole.
    The result is that of encoding each whole text, but that pieces are known by a 64-bit hash: two
    different pieces in one worker's memory share one with a probability of about 2**-64 a pair.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # a byte-level token has one character a byte
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.memory = MEMORY
        self._forget()

    def _forget(self) -> None:
        # codes of the known pieces, sorted, and the number of each: arrays, as a dictionary of a million is ten times as large
        self.codes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.at = np.zeros(1 << 20, np.uint16 if len(self.width) <= 1 << 16 else np.uint32), np.zeros(1 << 18, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, codes: np.ndarray, raw: list[bytes]) -> None:
        """Encodes pieces and files them under their codes."""
        # white space alone (the end of a text) would run into the white space of the next piece
        joined = [_KIND[x[0]] == 1 != _KIND[x[-1]] for x in raw]
        spaced = [i for i, x in enumerate(joined) if x]
        others = [i for i, x in enumerate(joined) if not x]
        alone = self._encode([raw[i].decode() for i in others])
        ids = [np.zeros(0, np.uint32)]
        lengths = []
        for x in range(0, len(spaced), 20_000):
            part = spaced[x : x + 20_000]
            got = self._encode([b"".join(raw[i] for i in part).decode()])[0]
            ends = np.cumsum([len(raw[i]) for i in part])
            stands = np.cumsum(self.width[got])
            after = np.searchsorted(stands, ends) + 1
            if after[-1] != len(got) or (stands[after - 1] != ends).any():  # a token crosses a join: one by one
                apart = self._encode([raw[i].decode() for i in part])
                after, got = np.cumsum([len(x) for x in apart]), np.concatenate(apart)
            lengths.append(np.diff(after, prepend=0))
            ids.append(got)
        ids += alone
        lengths.append(np.array([len(x) for x in alone], np.int64))
        self._file(codes[spaced + others], np.concatenate(ids), np.concatenate(lengths))

    def _file(self, codes: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        """Files the ids of pieces in a row, so many a piece, under their codes."""
        n, used = len(self.codes), int(self.at[len(self.codes)])
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(length) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used : used + len(flat)] = flat
        self.at[n + 1 : n + 1 + len(length)] = used + np.cumsum(length)
        order = np.argsort(codes)
        place = np.searchsorted(self.codes, codes[order])
        self.codes, self.number = np.insert(self.codes, place, codes[order]), np.insert(self.number, place, (n + order).astype(np.int32))

    def _has(self, codes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.codes[place] == codes

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Where pieces start (but for those at the start of a text)."""
        kind = _KIND[data]
        start = np.zeros(len(data), bool)
        # white space after anything else; an ASCII sign or digit after an ASCII letter
        start[1:] = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 3) & (kind[:-1] == 2))
        return start

    def _lookup(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a run of texts, and their n+1 bounds."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = self._starts(data)
        inner = offsets[:-1]
        start[inner[inner < len(data)]] = True
        start = np.flatnonzero(start)
        end = np.append(start[1:], len(data))
        up, down = _power_tables(len(data) + 1, _BASE, _BASE_INV)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
        code = mix((total[end] - total[start]) * down[start])
        order = np.argsort(code)
        ranked = code[order]
        new = np.empty(len(code), bool)
        new[0], new[1:] = True, ranked[1:] != ranked[:-1]
        first = order[new]
        unique = ranked[new]
        inverse = np.empty(len(code), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.codes) + len(unique) > self.memory:
            self._forget()
        missing = np.flatnonzero(~self._has(unique)) if len(self.codes) else np.arange(len(unique))
        if len(missing):
            raw = data.tobytes()
            at = first[missing]
            self._learn(unique[missing], [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        which = self.number[np.searchsorted(self.codes, unique)].astype(np.int64)[inverse]
        begin = self.at[which]
        length = self.at[which + 1] - begin
        after = np.cumsum(length)
        take = np.arange(after[-1]) + np.repeat(begin - after + length, length)
        return self.flat[take].astype(np.uint32), np.concatenate([[0], after])[np.searchsorted(start, offsets)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, flat ids, bounds) of runs of rows; null counts as empty."""
        if column.null_count:
            column = column.fill_null("")
        marked = pc.match_substring_regex(column, _UNUSUAL)
        unusual = marked.to_numpy(zero_copy_only=False)
        plain = pc.if_else(marked, pa.scalar("", column.type), column) if unusual.any() else column
        for a, b, data, offsets in chunks(plain, TOGETHER):
            ids, bounds = self._lookup(data, offsets)
            odd = np.flatnonzero(unusual[a:b])
            if len(odd):
                parts = [ids[bounds[i] : bounds[i + 1]] for i in range(b - a)]
                for i, x in zip(odd, self._encode([column[a + int(i)].as_py() for i in odd]), strict=True):
                    parts[i] = x
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                ids = np.concatenate(parts) if parts else ids
            yield a, b, ids, bounds


_encoders: dict[str, Encoder] = {}


def _cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: where the hash of the last ROLL ids hits, within LEAST and MOST."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    code = mix(ids.astype(np.uint64) + np.uint64(0x9E37))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code * _power_tables(n + 1)[0][:n], out=total[1:])
    rolled = mix((total[ROLL:] - total[:-ROLL]) * _power_tables(n + 1)[1][: n + 1 - ROLL])
    hits = (np.flatnonzero((rolled & np.uint64(MEAN - 1)) == 0) + ROLL).tolist()
    ends, last = [], 0
    for h in [*hits, n]:
        while h - last > MOST:
            last += MOST
            ends.append(last)
        if h - last >= LEAST or h == n:
            if h > last:
                ends.append(h)
            last = h
    return ends


def _packed(ids: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Ids in two bytes each where all fit, else in four."""
    width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return bytes([width]) + pack.compress(ids.astype(f"<u{width}").tobytes())


def _unpacked(stored: bytes, unpack: zstandard.ZstdDecompressor) -> bytes:
    """The ids as little-endian unsigned 32-bit."""
    return np.frombuffer(unpack.decompress(stored[1:]), f"<u{stored[0]}").astype("<u4").tobytes()


def _chunked(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = Encoder(path)
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, ids, bounds in encoder.encode(batch.column(1)):
                n_tokens, hashes, payload, at = [], [], [], [0]
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    n_tokens.append(len(own))
                    last = 0
                    for e in _cut_points(own):
                        raw = own[last:e].tobytes()
                        hashes.append(hashlib.sha256(raw).digest())
                        payload.append(_packed(own[last:e], pack))
                        last = e
                    at.append(len(hashes))
                parts = pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(payload, pa.binary())], names=["hash", "ids"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts)],
                    names=["doc_id", "n_tokens", "parts"],
                )

    return run


def _root(names: F.Column) -> F.Column:
    """The root of a recipe: the joint hash of its chunks' names."""
    return F.sha2(F.array_join(F.transform(names, lambda x: F.hex(x)), "").cast("binary"), 256)


def _tree(leaves: DataFrame) -> DataFrame:
    """leaves: (doc_id, start, n_tokens, root).  All nodes over them, as (level, node, first_doc, last_doc, documents, n_tokens, root).

    A node has at most 2**LEAF documents, or FAN nodes, below it.
    """
    level, step = leaves.select("doc_id", F.col("doc_id").alias("last"), F.lit(1).cast("long").alias("documents"), "n_tokens", F.col("start").alias("at"), "root"), 1 << LEAF
    levels: list[DataFrame] = []
    while not levels or level.limit(2).count() > 1:
        roots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: x["root"]), "")
        over = level.groupBy(F.floor(F.col("at") / step).alias("at")).agg(F.min("doc_id").alias("doc_id"), F.max("last").alias("last"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(roots.cast("binary"), 256).alias("root"))
        level, step = cut(over), FAN
        levels.append(level.select(F.lit(len(levels) + 1).alias("level"), F.col("at").alias("node"), F.col("doc_id").alias("first_doc"), F.col("last").alias("last_doc"), "documents", "n_tokens", "root"))
    return reduce(DataFrame.unionAll, levels)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text; other columns are ignored) into a store at `folder`.

    Null and empty texts are a lone end id.  Rows that repeat an id are kept, one recipe each, in
    order of their content.  A null id comes first.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunked(tokenizer, end_id), "doc_id long, n_tokens long, parts array<struct<hash:binary,ids:binary>>")
    staged = f"{folder}/_encoded"
    encoded.withColumn("row", F.monotonically_increasing_id()).write.parquet(staged, compression="none")
    encoded = spark.read.parquet(staged)
    recipes = encoded.select("doc_id", "n_tokens", F.col("parts.hash").alias("chunks")).withColumn("root", _root(F.col("chunks")))
    placed = running_total(recipes, ["doc_id", "root"], "n_tokens", "start")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartitionByRange(n, "start", "doc_id").sortWithinPartitions("start", "doc_id")
    ordered.select("doc_id", "start", "n_tokens", "root", "chunks").write.parquet(f"{folder}/recipes")
    # each different chunk once: names alone are compared, and only further copies, if they are few, sent to the chunks
    named = encoded.select("row", F.posexplode("parts.hash").alias("pos", "hash"))
    first = named.groupBy("hash").agg(F.min(F.struct("row", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(named.join(first, "hash").where(F.struct("row", "pos") != F.col("first")).select("row", "pos"))
    parts = encoded.select("row", F.posexplode("parts").alias("pos", "p")).join(if_small(copies), ["row", "pos"], "left_anti")
    parts.select("p.hash", "p.ids").write.parquet(f"{folder}/chunks", compression="none")
    discard(spark, staged)
    _tree(spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "n_tokens", "root")).write.parquet(f"{folder}/manifest")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks the chunks of each document against their names and gives length and CRC-32 of the joined ids."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        lengths, crcs = [], []
        for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
            size = crc = 0
            for p in parts:
                raw = _unpacked(p["ids"], unpack)
                if hashlib.sha256(raw).digest() != p["hash"]:
                    raise ValueError("a stored chunk does not match its name")
                crc = zlib.crc32(raw, crc)
                size += len(raw) // 4
            lengths.append(size)
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "read", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, parts): each recipe with its chunks (hash, ids) in order, from the files alone."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    chunk = spark.read.parquet(f"{folder}/chunks")
    named = recipes.select("doc_id", "start", "n_tokens", F.posexplode("chunks").alias("pos", "hash"))
    joined = named.join(chunk, "hash", "left")
    return joined.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "ids"))).alias("parts"))


def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, read, ids_crc32): every document put together from its chunks, each copy anew."""
    return read_documents(spark, folder).mapInArrow(_rebuilt, "doc_id long, start long, n_tokens long, read long, ids_crc32 long")


def _applied(matrix: tuple[int, ...], vector: int) -> int:
    """A 32 by 32 matrix over GF(2), given by columns, times a vector."""
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


@lru_cache(maxsize=16_384)
def _zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes do to a CRC-32."""
    if n == 1:
        bit = (0xEDB88320, *(1 << k for k in range(31)))
        for _ in range(3):
            bit = tuple(_applied(bit, c) for c in bit)
        return bit
    half = _zeros(n // 2)
    twice = tuple(_applied(half, c) for c in half)
    return tuple(_applied(_zeros(1), c) for c in twice) if n % 2 else twice


def joined_crc(one: int, two: int, n_two: int) -> int:
    """CRC-32 of two strings of bytes in a row from theirs and the length of the second."""
    return _applied(_zeros(n_two), one) ^ two if n_two else one


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each chunk, checks it against its name, and gives its number of ids and CRC-32."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, crcs = [], []
        for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = _unpacked(packed, unpack)
            if hashlib.sha256(raw).digest() != name:
                raise ValueError("a stored chunk does not match its name")
            sizes.append(len(raw) // 4)
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["hash", "size", "crc"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, crcs = [], []
        for parts in batch.column(2).to_pylist():
            size = crc = 0
            for x in parts:
                if x["size"] is None:
                    raise ValueError("a recipe names a chunk that is not stored")
                crc = joined_crc(crc, x["crc"], 4 * x["size"])
                size += x["size"]
            lengths.append(size)
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, read back from the store.

    The recipes are checked against the manifest first: a ValueError if any root or node differs.  Each
    stored chunk is read and checked once; a document's CRC-32 follows from those of its chunks, so no
    chunk crosses the shuffle.  rebuild() gives the same by putting the ids together.
    """
    if wrong := verify_manifest(spark, folder).limit(1).collect():
        raise ValueError(f"the recipes do not give the manifest: level {wrong[0]['level']}, node {wrong[0]['node']}")
    read = spark.read.parquet(f"{folder}/chunks").mapInArrow(_read_chunks, "hash binary, size long, crc long")
    named = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("pos", "hash"))
    parts = named.join(read, "hash", "left").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "crc"))).alias("parts"))
    return parts.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(level, node) of the manifest's nodes that do not follow from the recipes' chunks (none in a sound store)."""
    again = _tree(spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "n_tokens", _root(F.col("chunks")).alias("root")))
    same = F.struct("first_doc", "last_doc", "documents", "n_tokens", "root")
    there = spark.read.parquet(f"{folder}/manifest").select("level", "node", same.alias("there"))
    return there.join(again.select("level", "node", same.alias("again")), ["level", "node"], "full").where(~F.col("there").eqNullSafe(F.col("again"))).select("level", "node")


def default_tokenizer() -> str:
    """Path of the public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


__all__ = ["default_tokenizer", "digests", "read_documents", "verify_manifest", "write_store"]

"""Which tokens of one tokenizer lie over which of another.

Each text is encoded by a byte-level BPE (A, of a space and the text) and a sentencepiece model (B, which adds
the space itself).  Tokens are rows of an incidence matrix over the text's bytes in CSR form; the row
products A * B^T give the pairs that overlap, with their bytes in common.  Where tokens of both end, a group
ends; the products of the incidence matrices over groups give the pairs that share a group.

Corpus-wide counts of id pairs: blocks of texts name each of their pairs once, with its count; Spark adds
them up, and the blocks ask the sharded table of pairs.  No pair is hot, for a block names it once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playsight.llm.blocks import BLOCK, answered_blocks, answers, asks_of, bucketed, shards_of, told
from playsight.llm.common import cut, if_small, written
from playsight.llm.incidence import Csr
from playsight.llm.textkit import chunks
from playsight.llm.token_store import Encoder, default_tokenizer

#: Bytes of text encoded together; entries of each per-worker memory of encoded pieces.
TOGETHER = 1 << 20
MEMORY = 400_000


def default_pieces() -> str:
    """Path of the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Bytes:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        after = np.cumsum(size)
        return self.flat[np.arange(int(after[-1]) if len(after) else 0) + np.repeat(self.at[ids] - after + size, size)]


def _alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteTokens(Encoder):
    """Encoder of the byte-level BPE to which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.memory = MEMORY
        self.tokenizer.encode_special_tokens = True
        stands, known = _alphabet(), self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * len(self.width)
        for token, i in known.items():
            tokens[i] = bytes(stands[c] for c in token) if all(c in stands for c in token) else token.encode()
        self.bytes = _Bytes(tokens)


class PieceTokens(Encoder):
    """Encoder of a sentencepiece BPE in which no piece has a mark behind another character, so none reaches into the space behind a word.

    Texts are cut before each run of spaces; each different part is encoded by the library once and then looked up.
    The texts begin with a space, which the library adds itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece has a mark behind another character")
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = _Bytes(tokens)
        self.width, self.memory = self.bytes.size, MEMORY
        self._forget()

    def _starts(self, data: np.ndarray) -> np.ndarray:
        start = np.zeros(len(data), bool)
        start[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        return start

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]

    def _learn(self, codes: np.ndarray, raw: list[bytes]) -> None:
        # the library gives nothing for nothing: a space alone is the mark alone
        alone = np.array([self.model.piece_to_id("▁")], np.uint32)
        ids = [alone if x == b" " else y for x, y in zip(raw, self._encode([x[1:].decode() for x in raw]), strict=True)]
        self._file(codes, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for a, b, data, offsets in chunks(column, TOGETHER):
            yield a, b, *self._lookup(data, offsets)


_encoders: dict[tuple[str, str], tuple[ByteTokens, PieceTokens]] = {}


def _pair(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = ByteTokens(path_a), PieceTokens(path_b)
    return _encoders[path_a, path_b]


def _whole(encoder: Encoder, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of a column and their bounds by row."""
    ids, bounds = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for _, _, x, y in encoder.encode(column):
        bounds.append(y[1:] + bounds[-1][-1])
        ids.append(x)
    return np.concatenate(ids), np.concatenate(bounds)


class Aligned:
    """The tokens of a run of texts and how they lie over each other.

    Rows whose tokens do not stand for exactly their bytes have none.  Of each side: ids, ends (over the bytes of
    all rows that have tokens), bounds (of rows) and group; and the links (index of A, index of B).
    """

    def __init__(self, encoders: tuple[ByteTokens, PieceTokens], texts: pa.Array):
        self.n = len(texts)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.string()), pc.fill_null(texts, ""), pa.scalar(" "))
        # the separator stands between an empty string and the text; empty texts have no tokens
        spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 1), "", spaced)
        if isinstance(spaced, pa.ChunkedArray):
            spaced = spaced.combine_chunks()
        (_, _, data, offsets), *more = list(chunks(spaced, 1 << 62)) or [(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        assert not more
        sides = [_whole(x, spaced) for x in encoders]
        good = np.ones(self.n, bool)
        for encoder, (ids, bounds) in zip(encoders, sides, strict=True):
            sizes = np.concatenate([[0], np.cumsum(encoder.bytes.size[ids])])[bounds]
            same = np.diff(sizes) == np.diff(offsets)
            if not same.all() or not np.array_equal(encoder.bytes.joined(ids), data):
                raw, told_ = data.tobytes(), encoder.bytes.joined(ids).tobytes()
                for i in np.flatnonzero(same):
                    same[i] = raw[offsets[i] : offsets[i + 1]] == told_[sizes[i] : sizes[i + 1]]
            good &= same
        self.ids, self.ends, self.bounds = [], [], []
        for encoder, (ids, bounds) in zip(encoders, sides, strict=True):
            if not good.all():
                ids = ids[np.repeat(good, np.diff(bounds))]
                bounds = np.concatenate([[0], np.cumsum(np.where(good, np.diff(bounds), 0))])
            self.ids.append(ids.astype(np.int64))
            self.ends.append(np.cumsum(encoder.bytes.size[self.ids[-1]]))
            self.bounds.append(bounds)
        self.size = int(self.ends[0][-1]) if len(self.ends[0]) else 0
        self.shared = np.intersect1d(*self.ends, assume_unique=True)
        self.group = [np.searchsorted(self.shared, x) for x in self.ends]
        self.incidence = [Csr.of_spans(x, self.size) for x in self.ends]
        self.groups = [Csr.of_members(x, len(self.shared)) for x in self.group]

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of A and B that overlap, and in how many bytes."""
        return self.incidence[0].times(self.incidence[1].transposed())

    def together(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of A and B that share a group."""
        return self.groups[0].times(self.groups[1].transposed())

    def row_of(self, side: int) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.bounds[side]))

    def groups_of_rows(self) -> np.ndarray:
        """How many groups each row has."""
        last = np.concatenate([[0], self.ends[0]])[self.bounds[0]]
        return np.diff(np.searchsorted(self.shared, last, "right"))

    def sharing(self) -> np.ndarray:
        """How many pairs of each row share a group: a product with ones, without naming the pairs."""
        pairs = self.groups[0].column_sums() * self.groups[1].column_sums()
        total = np.concatenate([[0], np.cumsum(pairs)])
        at = np.concatenate([[0], np.cumsum(self.groups_of_rows())])
        return np.diff(total[at])

    def spelled_groups(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for each row."""
        a, b = self.group
        many = len(a) + len(b)
        place = [np.arange(len(a)) + np.searchsorted(b, a, "left"), np.arange(len(b)) + np.searchsorted(a, b, "right")]
        ids, after = np.zeros(many, np.int64), np.zeros(many, np.uint8)
        for side, closing in ((0, b"|"), (1, b";")):
            ids[place[side]] = self.ids[side]
            last = np.ones(len(self.group[side]), bool)
            last[:-1] = self.group[side][1:] != self.group[side][:-1]
            after[place[side]] = np.where(last, closing[0], ord(","))
        digits = np.ones(many, np.int64)
        top = int(ids.max(initial=0))
        power = 10
        while power <= top:
            digits += ids >= power
            power *= 10
        end = np.cumsum(digits + 1)
        out = np.zeros(int(end[-1]) if many else 0, np.uint8)
        out[end - 1] = after
        left = ids.copy()
        for k in range(int(digits.max(initial=0))):
            some = np.flatnonzero(digits > k) if k else slice(None)
            out[end[some] - 2 - k] = 48 + left[some] % 10
            left[some] //= 10
        at = np.concatenate([[0], end])[self.bounds[0] + self.bounds[1]].tolist()
        raw = out.tobytes()
        return [raw[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]


def _blocks(path_a: str, path_b: str, shards: int):
    """Rows (doc_id, text) -> blocks: what each document has by itself, its counts of id pairs, and the pairs."""
    ask = pa.struct([("shard", pa.int32()), ("codes", pa.binary())])
    pair = pa.struct([("code", pa.int64()), ("n", pa.int64())])
    own = pa.struct([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_shared")], ("groups_sha256", pa.string())])

    def emit(rows: list[dict], docs: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        named, which = np.unique(np.concatenate(codes), return_inverse=True)
        cells, times = np.unique(np.concatenate(docs) * np.int64(max(1, len(named))) + which, return_counts=True)
        bounds = np.searchsorted(cells, np.arange(len(rows) + 1) * np.int64(max(1, len(named))))
        held = [(cells % max(1, len(named))), times]
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in held))
        pairs = pa.StructArray.from_arrays([pa.array(named), pa.array(np.bincount(which, minlength=len(named)).astype(np.int64))], fields=list(pair))
        one = lambda kind, x: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(pa.list_(own), rows), one(pa.list_(pa.int64()), bounds.tolist()), one(pa.binary(), packed), one(pa.list_(ask), asks_of(named, shards)), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)],
            names=["docs", "bounds", "packed", "asks", "pairs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _pair(path_a, path_b)
        rows, docs, codes, size = [], [], [], 0
        for batch in batches:
            for a, b, data, _ in chunks(batch.column(1), TOGETHER):
                found = Aligned(encoders, batch.column(1).slice(a, b - a))
                row, n_links = found.row_of(0), np.zeros(b - a, np.int64)
                for x, y, _ in found.overlaps():
                    n_links += np.bincount(row[x], minlength=b - a)
                    docs.append(row[x] + len(rows))
                    codes.append((found.ids[0][x] << 32) | found.ids[1][y])
                texts = found.spelled_groups()
                numbers = zip(np.diff(found.bounds[0]).tolist(), np.diff(found.bounds[1]).tolist(), found.groups_of_rows().tolist(), n_links.tolist(), found.sharing().tolist(), strict=True)
                for doc_id, (n_a, n_b, groups, links, shared), text in zip(batch.column(0).slice(a, b - a).to_pylist(), numbers, texts, strict=True):
                    digest = hashlib.sha256(text).hexdigest() if n_a else ""
                    rows.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "n_shared": shared, "groups_sha256": digest})
                size += len(data)
                if size >= BLOCK:
                    yield emit(rows, docs, codes)
                    rows, docs, codes, size = [], [], [], 0
        if rows:
            yield emit(rows, [np.zeros(0, np.int64), *docs], [np.zeros(0, np.int64), *codes])

    return run


def _summed(row: dict, said: dict[int, bytes]) -> pa.RecordBatch:
    """Adds to each document of a block what its links count in the corpus."""
    _, count = told(row["asks"], said, ["<i8"])
    bounds = np.array(row["bounds"], np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
    which, times = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in np.split(planes, 2))
    # a count is negative where another pair of its B id has more
    totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (times * (count[which] > 0), times * np.abs(count[which]))]
    docs = pa.array(row["docs"], pa.struct([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_shared")], ("groups_sha256", pa.string())]))
    flat = [docs.field(k) for k in range(7)]
    return pa.RecordBatch.from_arrays([*flat[:5], *[pa.array(x.astype(np.int64)) for x in totals], *flat[5:]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256"])


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, n_shared long, groups_sha256 string"


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_shared, groups_sha256) for every row of docs (doc_id, text).

    n_links: pairs of tokens that overlap; n_best: those whose id pair is, corpus-wide, the most frequent of its B id
    (ties included); count_sum: the corpus-wide counts of their id pairs, added up; n_shared: pairs that share a group;
    groups_sha256: of `a1,a2|b1;a3|b2,b3`, the ids of each group in order.

    Null and empty texts, and texts that the tokens do not spell exactly, have no tokens: zeros, and '' for the
    hash.  Texts are encoded whole, however long.  Rows that repeat an id or a text have a result each and count each;
    a null id is kept; an empty table gives no row.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n = shards_of(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,n_shared:long,groups_sha256:string>>, bounds array<long>, packed binary, asks array<struct<shard:int,codes:binary>>, pairs array<struct<code:long,n:long>>"
    with bucketed(rows.mapInArrow(_blocks(path_a or default_tokenizer(), path_b or default_pieces(), n), schema)) as (blocks, folder):
        counts = written(blocks.select(F.explode("pairs").alias("p")).groupBy("p.code").agg(F.sum("p.n").alias("n")), folder)
        of_b = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
        # one row an id of B: bounded by its vocabulary
        highest = cut(counts.groupBy(of_b).agg(F.max("n").alias("most")))
        signed = counts.withColumn("b", of_b).join(if_small(highest), "b").select("code", F.when(F.col("n") == F.col("most"), F.col("n")).otherwise(-F.col("n")).alias("n"))
        met = answers(blocks, signed, {"n": "<i8"})
        return cut(answered_blocks(blocks.select("block", "docs", "bounds", "packed", "asks"), met, _summed, _SCHEMA))


def _linked(path_a: str, path_b: str, shared: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in chunks(batch.column(1), TOGETHER):
                found = Aligned(_pair(path_a, path_b), batch.column(1).slice(a, b - a))
                ids, row = batch.column(0).slice(a, b - a), found.row_of(0)
                for x, y, value in found.together() if shared else found.overlaps():
                    at = [x - found.bounds[0][row[x]], y - found.bounds[1][row[x]], found.ids[0][x], found.ids[1][y], value]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[x])), *[pa.array(z.astype(np.int64)) for z in at]], names=["doc_id", "a", "b", "a_id", "b_id", "n"])

    return run


def links(docs: DataFrame, shared: bool = False, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, a, b, a_id, b_id, n): token pairs of each text by position and id, with the bytes (n) they have in common.

    With `shared`, the pairs that share a group instead (n is 1); a run of rows of the product at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_linked(path_a or default_tokenizer(), path_b or default_pieces(), shared), "doc_id long, a long, b long, a_id long, b_id long, n long")

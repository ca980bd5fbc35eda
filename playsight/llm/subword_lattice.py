"""The probability of a text over all its segmentations into the pieces of an existing vocabulary.

Pieces are byte strings; a word with its boundary mark is a lattice whose nodes are the places between its
bytes and whose arcs are the pieces that lie there (every byte has an arc of its own, so all words have
a path).  A forward recursion in log space adds up all paths.  No piece reaches over a boundary mark, so the
probability of a text is the product of those of its words and of the end.

The vocabulary is taken as it is; its scores, read as ranks where they are no log-probabilities, are
the start and the prior of the pieces' probabilities, which are then fitted to the training text by
expectation-maximisation: expected uses of each piece over all segmentations, by a forward and a backward
recursion.  Only these, one number a piece, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playsight.llm.blocks import BLOCK, answered_blocks, answers, asks_of, bucketed, shards_of, told
from playsight.llm.common import cut, written
from playsight.llm.textkit import _BYTE_CODE, LOWER, Words, _power_tables, chunks, mix

#: Rounds of expectation-maximisation.
ROUNDS = 4
#: Uses that the vocabulary's own scores stand for beside those in the training text.
PRIOR = 200.0
#: Bytes of words that go through the recursions together.
TOGETHER = 1 << 20
#: Parts that the pieces are dealt in where tasks' uses are added up: a row a task, slot and part.
PARTS = 64
#: Slots of languages that have probabilities of their own.
SLOTS = 61
_FILTER = 20


def default_vocabulary() -> str:
    """Path of the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece model as bytes, a space for the boundary mark, and their prior probabilities; the end comes last.

    Pieces that hold a mark behind another character, control and unknown pieces are left out; a byte piece
    stands for its byte.  Log-probabilities are used as they are; ranks (scores of whole numbers) by Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
    ranked = (scores == np.round(scores)).all()
    for i, score in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:] and (model.is_byte(i) or score > -1e8):
            p = 1.0 / len(scores) ** 2 if model.is_byte(i) else 1.0 / (2.0 - score) if ranked else float(np.exp(score))
            found[piece] = found.get(piece, 0.0) + p
    for b in range(256):
        found.setdefault(bytes([b]), 1.0 / len(scores) ** 2)
    weights = np.array([*found.values(), sum(found.values()) / 100])
    return list(found), weights / weights.sum()


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


class Lattice:
    """Forward and backward recursions over many words at once."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = log_p
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.filter = np.zeros(1 << _FILTER, bool)
        by: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by.setdefault(len(piece), []).append(i)
        for size, which in sorted(by.items()):
            code = self._windows(np.frombuffer(b"".join(pieces[i] for i in which), np.uint8), np.arange(len(which)) * size, size)
            order = np.argsort(code)
            self.tables.append((size, code[order], np.array(which, np.int32)[order]))
            self.filter[code & np.uint64((1 << _FILTER) - 1)] = True

    @staticmethod
    def _total(data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * _power_tables(len(data) + 1)[0][: len(data)], out=total[1:])
        return total

    @classmethod
    def _windows(cls, data: np.ndarray, at: np.ndarray, size: int, total: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of `size` bytes at the places `at`."""
        total = cls._total(data) if total is None else total
        return mix((total[at + size] - total[at]) * _power_tables(len(data) + 1)[1][at] + np.uint64(size))

    def arcs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all arcs of words in a row; ends: where each word ends."""
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(data))
        total, place = self._total(data), np.arange(len(data))
        start, end, piece = [], [], []
        for size, codes, which in self.tables:
            place = place[left[place] >= size]
            if not len(place):
                break
            code = self._windows(data, place, size, total)
            maybe = np.flatnonzero(self.filter[code & np.uint64((1 << _FILTER) - 1)])
            at = np.searchsorted(codes, code[maybe])
            at[at == len(codes)] = 0
            hit = codes[at] == code[maybe]
            start.append(place[maybe[hit]])
            end.append(start[-1] + size)
            piece.append(which[at[hit]])
        return np.concatenate(start), np.concatenate(end), np.concatenate(piece)

    @staticmethod
    def _swept(nodes: np.ndarray, source: np.ndarray, target: np.ndarray, step: np.ndarray, cost: np.ndarray) -> None:
        """Fills nodes[target] with the log of the summed exp of nodes[source] + cost, in the order of `step`."""
        order = np.lexsort((target, step))
        source, target, step, cost = source[order], target[order], step[order], cost[order]
        rounds = _runs(step)
        for a, b in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
            value = nodes[source[a:b]] + cost[a:b]
            first = _runs(target[a:b])
            top = np.maximum.reduceat(value, first[:-1])
            summed = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(first))), first[:-1])
            nodes[target[a:b][first[:-1]]] = top + np.log(summed)

    def forward(self, data: np.ndarray, ends: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each word (non-empty, in a row); with counts, also the expected uses of each piece."""
        sizes = np.diff(ends, prepend=0)
        start, end, piece = self.arcs(data, ends)
        word = np.repeat(np.arange(len(ends)), sizes)[start]
        begin = ends - sizes
        # nodes: one more than bytes in each word
        source, target = start + word, end + word
        cost = self.log_p[piece]
        alpha = np.full(len(data) + len(ends), -np.inf)
        alpha[begin + np.arange(len(ends))] = 0.0
        self._swept(alpha, source, target, end - begin[word], cost)
        last = ends + np.arange(len(ends))
        if counts is None:
            return alpha[last], None
        beta = np.full(len(alpha), -np.inf)
        beta[last] = 0.0
        self._swept(beta, target, source, ends[word] - start, cost)
        used = np.exp(alpha[source] + cost + beta[target] - alpha[last][word]) * counts[word]
        return alpha[last], np.bincount(piece, used, len(self.log_p))


def _marked(words: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, ends) of runs of words, each with a space before it."""
    for a, b, data, offsets in chunks(words, TOGETHER):
        flat = np.insert(data, offsets[:-1], 0x20)
        yield a, b, flat, offsets[1:] + np.arange(1, len(offsets))


def _expected(pieces: list[bytes], log_p: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (word, c, slot): the expected uses of the pieces in each slot."""
        lattices = {s: Lattice(pieces, x) for s, x in log_p.items()}
        uses = {s: np.zeros(len(x)) for s, x in log_p.items()}
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            for slot in np.unique(slots).tolist():
                own = batch.filter(pa.array(slots == slot))
                counts = own.column(1).to_numpy(zero_copy_only=False)
                for a, b, data, ends in _marked(own.column(0)):
                    uses[slot] += lattices[slot].forward(data, ends, counts[a:b])[1]
        rows = [(slot, k, part.astype("<f8").tobytes()) for slot, x in uses.items() for k, part in enumerate(np.array_split(x, PARTS)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["slot", "part", "uses"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """One slot and part: the tasks' uses of its pieces, added up."""
    total = sum(np.frombuffer(x, "<f8") for x in table.column("uses").to_pylist())
    return table.slice(0, 1).set_column(2, "uses", pa.array([total.tobytes()], pa.binary()))


def fit(words: DataFrame, pieces: list[bytes], prior: dict[int, np.ndarray], texts: dict[int, int], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Natural log-probabilities of the pieces and the end by slot, fitted to words (word, c, slot) of so many texts a slot.

    At most one number a piece and slot comes to the driver, each round: bounded by the vocabulary, not by the text.
    """
    p = prior
    for _ in range(rounds):
        found = words.where("c > 0").select("word", "c", "slot").mapInArrow(_expected(pieces, {s: np.log(x) for s, x in p.items()}), "slot int, part int, uses binary")
        got = found.groupBy("slot", "part").applyInArrow(_added, "slot int, part int, uses binary").collect()
        uses = {s: PRIOR * x for s, x in prior.items()}
        for row in got:
            at = sum(len(x) for x in np.array_split(prior[row["slot"]], PARTS)[: row["part"]])
            more = np.frombuffer(row["uses"], "<f8")
            uses[row["slot"]][at : at + len(more)] += more
        for s, x in uses.items():
            x[-1] += texts.get(s, 0)
        p = {s: x / x.sum() for s, x in uses.items()}
    return {s: np.log(x) for s, x in p.items()}


def _blocks(shards: int):
    """Packs rows (doc_id, text, slot, learn) into blocks by slot; a block's words, its documents' counts of them, and its asks."""
    word = pa.struct([("word", pa.string()), ("n", pa.int64())])
    ask = pa.struct([("shard", pa.int32()), ("codes", pa.binary())])

    def emit(slot: int, ids: list, learn: list, texts: list[bytes]) -> pa.RecordBatch:
        raw = b"".join(texts)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        found = Words(data, offsets)
        row = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
        codes, first, which = np.unique(_coded(found.hash, slot), return_index=True, return_inverse=True)
        counts = np.bincount(which, np.array(learn, bool)[row], len(codes)).astype(np.int64)
        spans = zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)
        words = pa.StructArray.from_arrays([pa.array([raw[a:b] for a, b in spans], pa.binary()).cast(pa.string()), pa.array(counts)], fields=list(word))
        cells, times = np.unique(row * np.int64(max(1, len(codes))) + which, return_counts=True)
        bounds = np.searchsorted(cells, np.arange(len(texts) + 1) * np.int64(max(1, len(codes))))
        held = [(cells % max(1, len(codes))), times]
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in held))
        one = lambda kind, x: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(pa.int32(), slot), one(pa.list_(pa.int64()), ids), one(pa.list_(pa.bool_()), learn), one(pa.list_(pa.int64()), bounds.tolist()), one(pa.binary(), packed),
             one(pa.list_(ask), asks_of(codes, shards)), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)],
            names=["slot", "ids", "learn", "bounds", "packed", "asks", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list] = {}
        total = 0
        for batch in batches:
            ids, slots, learn = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for a, b, data, offsets in chunks(batch.column(1)):
                raw, at = LOWER[data].tobytes(), offsets.tolist()
                for i in range(a, b):
                    block = open_blocks.setdefault(slots[i], [[], [], [], 0])
                    text = raw[at[i - a] : at[i - a + 1]]
                    for x, y in zip(block, (ids[i], learn[i], text), strict=False):
                        x.append(y)
                    block[3] += len(text)
                    total += len(text)
                    if block[3] >= BLOCK or total >= 4 * BLOCK:
                        most = max(open_blocks, key=lambda k: open_blocks[k][3])
                        total -= open_blocks[most][3]
                        yield emit(most, *open_blocks.pop(most)[:3])
        for slot, block in open_blocks.items():
            yield emit(slot, *block[:3])

    return run


def _coded(hashes: np.ndarray, slot: int) -> np.ndarray:
    """One code for a word of a slot."""
    return mix(hashes + np.uint64((slot + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def _valued(pieces: list[bytes], fitted: dict[int, np.ndarray], otherwise: np.ndarray, of: dict[int, tuple[float, float, float, float]] | None):
    """Rows (slot, word, own, c) -> code, c, and the log-probability by the lattice; with whole-word arcs, if their masses are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            for slot in np.unique(slots).tolist():
                own = batch.filter(pa.array(slots == slot))
                if slot not in lattices:
                    lattices[slot] = Lattice(pieces, fitted.get(slot, otherwise))
                for a, b, data, ends in _marked(own.column(1)):
                    log_p = lattices[slot].forward(data, ends)[0]
                    if of is not None:
                        n, kinds, discount, texts = of.get(slot, (0.0, 0.0, 0.5, 0.0))
                        times = own.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.float64)
                        # whole-word arcs beside the pieces: Pitman-Yor, with what the discounts free (and one more) going to the pieces
                        log_p = np.logaddexp(np.log(np.maximum(times - discount, 1e-300)), np.log(discount * kinds + 1.0) + log_p) - np.log(n + texts + 2.0)
                    flat, bounds = np.delete(data, np.concatenate([[0], ends[:-1]])), ends - np.arange(1, b - a + 1)
                    words = Words(flat, np.concatenate([[0], bounds]))
                    codes = _coded(words.hash, slot)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), own.column(3).slice(a, b - a), pa.array(log_p)], names=["code", "c", "log_p"])

    return run


_KINDS = {"c": "<i8", "log_p": "<f4"}


def _scored(total: int, distinct: int, ends: float, end_p: dict[int, float], otherwise: float):
    def run(row: dict, said: dict[int, bytes]) -> pa.RecordBatch:
        _, c, log_p = told(row["asks"], said, list(_KINDS.values()))
        bounds = np.array(row["bounds"], np.int64)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
        which, times = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in np.split(planes, 2))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        added = lambda x: np.bincount(doc, x, len(bounds) - 1)
        bottom = np.log10(total + distinct + 1.0)
        words, known = added(times), added(times * (c[which] > 0)) + (ends > 0)
        base = added(times * (np.log10(c[which] + 1.0) - bottom)) + np.log10(ends + 1.0) - bottom
        score = (added(times * log_p[which].astype(np.float64)) + end_p.get(row["slot"], otherwise)) / np.log(10.0)
        return pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array([not x for x in row["learn"]], pa.bool_()), pa.array((words + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def text_scores(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, whole_words: bool = True) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text, lang).

    A-Z count as a-z; tokens are the words and an end.  Learned from are the rows whose crc32(doc_id) mod 7 is
    not 2 (a null doc_id counts as '').  base_score: add-one unigram of words.  score: log10 of the probability of
    the text over all segmentations.  With `whole_words`, the lattice has an arc more over each whole word of
    the training text, which takes that word's share of the training words, less a discount; what the discounts
    free goes to the paths of pieces, whose probabilities are then fitted to the different words, each once,
    as it is new words that they spell.  Without, all words are spelled by pieces, fitted to all words.

    Languages have probabilities of their own, dealt by hash to SLOTS slots; what a language lacks is
    supplied by all of them.  Null texts count as empty (the end alone); very long words and texts are
    handled whole; rows that repeat an id or a text have a result each; an empty table gives none.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.crc32(F.coalesce("lang", F.lit("und")).cast("binary")), F.lit(SLOTS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), slot.alias("slot"), (key % 7 != 2).alias("learn"))
    n = shards_of(spark)
    schema = "slot int, ids array<long>, learn array<boolean>, bounds array<long>, packed binary, asks array<struct<shard:int,codes:binary>>, words array<struct<word:string,n:long>>"
    with bucketed(rows.mapInArrow(_blocks(n), schema)) as (blocks, folder):
        # a block names each of its words once, so words need no adding up before the shuffle
        each = blocks.select("slot", F.explode("words").alias("w")).select("slot", "w.word", "w.n").repartition(n, "word")
        by = each.groupBy("word", "slot").agg(F.sum("n").alias("own")).groupBy("word").agg(F.sum("own").alias("c"), F.collect_list(F.struct("slot", "own")).alias("x"))
        words = written(by.select("word", "c", F.explode("x").alias("x")).select("x.slot", "word", "x.own", "c"), folder)
        learned = F.explode(F.filter("learn", lambda x: x))
        texts = {r["slot"]: r["n"] for r in blocks.select("slot", learned).groupBy("slot").agg(F.count("*").alias("n")).collect()}  # SLOTS rows at most
        sums = [F.sum("own").alias("n"), F.sum((F.col("own") > 0).cast("long")).alias("kinds"), *[F.sum((F.col("own") == k).cast("long")).alias(f"t{k}") for k in (1, 2)]]
        of = {r["slot"]: r for r in words.groupBy("slot").agg(*sums).collect()}
        distinct = words.where("c > 0").select("word").distinct().count() if of else 0
        ends = sum(texts.values())
        total, distinct = sum(r["n"] for r in of.values()) + ends, distinct + (ends > 0)
        pieces, prior = vocabulary(path or default_vocabulary())
        weight = (lambda x: F.when(x > 0, 1).otherwise(0)) if whole_words else (lambda x: x)
        common = fit(words.groupBy("word").agg(weight(F.max("c")).cast("long").alias("c"), F.lit(0).alias("slot")), pieces, {0: prior}, {} if whole_words else {0: ends}, rounds)[0]
        fitted = fit(words.select("word", weight(F.col("own")).cast("long").alias("c"), "slot"), pieces, {s: np.exp(common) for s in of}, {} if whole_words else texts, max(1, rounds - 1))
        mass = {s: (float(r["n"]), float(r["kinds"]), min(0.95, max(0.05, r["t1"] / (r["t1"] + 2.0 * r["t2"]) if r["t1"] + r["t2"] else 0.5)), float(texts.get(s, 0))) for s, r in of.items()}
        if whole_words:
            ending = {s: float(np.log((texts.get(s, 0) + 1.0) / ((of[s]["n"] if s in of else 0) + texts.get(s, 0) + 2.0))) for s in {*of, *texts}}
        else:
            ending = {s: float(x[-1]) for s, x in fitted.items()}
        table = words.select("slot", "word", "own", "c").mapInArrow(_valued(pieces, fitted, common, mass if whole_words else None), "code long, c long, log_p double")
        met = answers(blocks, table, _KINDS)
        scored = _scored(total, distinct, float(ends), ending, float(np.log(0.5)) if whole_words else float(common[-1]))
        out = answered_blocks(blocks.select("block", "slot", "ids", "learn", "bounds", "packed", "asks"), met, scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return cut(out.withColumn("train_tokens", F.lit(total).cast("long")))

"""Repeated passages by a sparse suffix array.

Suffixes (at word starts) are kept only where a minimiser is: the least K-word hash of some window
of WINDOW such hashes.  Any passage of PASSAGE words has one among its first WINDOW words, and from
there at least HEAD = PASSAGE - WINDOW + 1 of its words follow.  Suffixes are grouped by their first
HEAD words; those alone in a group are dropped, the rest are sorted by the words before and
behind, and each is compared with its neighbours, extending the match to the left and right.  Where
a match reaches PASSAGE words, its words are marked; the matches of successive anchors join up.

A group of more than REACH + 1 suffixes may hide a match from its neighbours; there the passages
around each suffix (one for each of the at most WINDOW places that the head can have in it) are hashed
as well, and those that occur twice are marked.  A group of more than HOT suffixes never meets in one
task: its passages are counted by a pre-aggregated groupBy.  Either way every match is found.  Words
are white-space separated, A-Z lower-cased, and compared as hashes: 64 bits for heads, 32 bits a word
for extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playsight.llm.common import cut, if_small, long_list, written
from playsight.llm.textkit import Words, chunks, mix, spans_hash, window_starts

PASSAGE = 50
K = 4
WINDOW = 16
#: Suffixes of a group, or copies of a passage, that may meet in one task.
HOT = 20_000
#: Neighbours on each side that a suffix is compared with.
REACH = 4
_MORE = np.uint64(0x9FB21C651E98DF25)


def _anchors(passage: int, k: int, window: int):
    head = passage - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                n = np.diff(words.bounds)
                start, rows = window_starts(words.bounds, k + window - 1)
                if len(start):
                    gram = spans_hash(words.hash, np.arange(max(0, len(words.hash) - k + 1)), k)
                    low = start + np.lib.stride_tricks.sliding_window_view(gram, window)[start].argmin(axis=1)
                    low, first = np.unique(low, return_index=True)
                    rows = rows[first]
                    fits = low + head <= words.bounds[1:][rows]
                    low, rows = low[fits], rows[fits]
                else:
                    low, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
                keys = spans_hash(words.hash, low, head) if len(low) else np.zeros(0, np.uint64)
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                at = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((low - words.bounds[:-1][rows]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), long_list(keys, bounds), at], names=["doc_id", "th", "n_words", "keys", "at"])

    return run


def _around(whole: pa.RecordBatch, passage: int, window: int) -> Iterator[tuple]:
    """(taken, spots, pos, left, right, before, behind) of runs of the spots of rows (doc_id, text, th, spots)."""
    head, side = passage - window + 1, window - 1
    spots = whole.column(3)
    for a, b, data, offsets in chunks(whole.column(1)):
        words = Words(data, offsets)
        code = (mix(words.hash) >> np.uint64(32)).astype(np.uint32)
        own = spots.slice(a, b - a)
        count = np.diff(np.asarray(own.offsets))
        rows = np.repeat(np.arange(b - a), count)
        flat = own.flatten()
        at = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
        here = at + words.bounds[:-1][rows]
        left = np.minimum(side, at)
        right = np.minimum(side, words.bounds[1:][rows] - here - head)
        k = np.arange(side)
        padded = np.concatenate([code, np.zeros(1, np.uint32)])
        before = padded[np.where(k < left[:, None], here[:, None] - 1 - k, len(code))]
        behind = padded[np.where(k < right[:, None], here[:, None] + head + k, len(code))]
        yield pa.array(rows + a), flat, at, left, right, before, behind


def _contexts(passage: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for taken, spots, at, left, right, before, behind in _around(whole, passage, window):
                fixed = lambda m: pa.array([x.tobytes() for x in np.ascontiguousarray(m.astype(">u4"))], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [spots.field("key"), whole.column(0).take(taken), whole.column(2).take(taken), pa.array(at.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), fixed(before), fixed(behind)],
                    names=["key", "doc_id", "th", "pos", "nl", "nr", "before", "behind"],
                )

    return run


def _passage_codes(key: np.ndarray, nl: np.ndarray, nr: np.ndarray, before: np.ndarray, behind: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words before the head: (number, suffixes that have such a passage, hashes of their passages)."""
    side = before.shape[1]
    both = []
    for words in (before, behind):
        codes = [np.zeros(len(key), np.uint64)]
        for k in range(side):
            codes.append(mix(codes[-1] * _MORE + words[:, k].astype(np.uint64) + np.uint64(1)))
        both.append(codes)
    own = mix(key.astype(np.int64).view(np.uint64))
    for n in range(side + 1):
        fits = np.flatnonzero((nl >= n) & (nr >= side - n))
        yield n, fits, mix((own[fits] + both[0][n][fits]) * _MORE + both[1][side - n][fits] + np.uint64(n))


def _passages(passage: int, window: int):
    """Rows (doc_id, th, pos, left, code): each passage around each spot by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for taken, spots, at, left, right, before, behind in _around(whole, passage, window):
                ids, ths = whole.column(0).take(taken), whole.column(2).take(taken)
                for n, fits, codes in _passage_codes(spots.field("key").to_numpy(zero_copy_only=False), left, right, before, behind):
                    if len(fits):
                        f = pa.array(fits)
                        yield pa.RecordBatch.from_arrays([ids.take(f), ths.take(f), pa.array(at[fits].astype(np.int32)), pa.array(np.full(len(fits), n, np.int32)), pa.array(codes.view(np.int64))], names=["doc_id", "th", "pos", "left", "code"])

    return run


def _same(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of a and b, at most `most`."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, most)


def _matched(passage: int, window: int, reach: int):
    head, side = passage - window + 1, window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: rows[name].to_numpy()
        flat = lambda name: np.frombuffer(b"".join(rows[name].to_pylist()), ">u4").reshape(rows.num_rows, side).astype(np.uint32)
        # a row that is there twice gives its suffixes twice: one of each goes on
        order = np.lexsort([column("pos"), column("th"), column("doc_id"), column("key")])
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for name in ("key", "doc_id", "th", "pos"):
            fresh[1:] |= column(name)[order[1:]] != column(name)[order[:-1]]
        rows = rows.take(pa.array(order[fresh])).combine_chunks()
        key, nl, nr, pos = column("key"), column("nl"), column("nr"), column("pos")
        before, behind = flat("before"), flat("behind")
        best_left, best_right = np.full(rows.num_rows, -1), np.full(rows.num_rows, -1)
        # sorted by the words before, then behind; and the other way round
        for first, second in ((before, behind), (behind, before)):
            order = np.lexsort([*[second[:, c] for c in range(side - 1, -1, -1)], *[first[:, c] for c in range(side - 1, -1, -1)], key])
            for step in range(1, reach + 1):
                x, y = order[:-step], order[step:]
                near = key[x] == key[y]
                x, y = x[near], y[near]
                left = _same(before[x], before[y], np.minimum(nl[x], nl[y]))
                right = _same(behind[x], behind[y], np.minimum(nr[x], nr[y]))
                long = left + head + right >= passage
                for z in (x[long], y[long]):
                    np.maximum.at(best_left, z, left[long])
                    np.maximum.at(best_right, z, right[long])
        # in a group with more than the neighbours, whatever they missed
        _, inverse, size = np.unique(key, return_inverse=True, return_counts=True)
        large = np.flatnonzero(size[inverse] > reach + 1)
        for n, fits, codes in _passage_codes(key[large], nl[large], nr[large], before[large], behind[large]):
            order = np.argsort(codes)
            same = codes[order[1:]] == codes[order[:-1]]
            z = large[fits[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]]
            best_left[z] = np.maximum(best_left[z], n)
            best_right[z] = np.maximum(best_right[z], side - n)
        found = np.flatnonzero(best_left >= 0)
        for at in range(0, len(found), 50_000):
            f = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].take(pa.array(f)).combine_chunks(), rows["th"].take(pa.array(f)).combine_chunks(), pa.array((pos[f] - best_left[f]).astype(np.int64)), pa.array((pos[f] + head + best_right[f]).astype(np.int64))],
                names=["doc_id", "th", "first", "stop"],
            )

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the matches of each document into spans."""
    for batch in batches:
        found = batch.column(3).fill_null([])
        spans, n = found.flatten(), len(found)
        row = np.repeat(np.arange(n), np.diff(np.asarray(found.offsets)))
        first, stop = (spans.field(k).to_numpy(zero_copy_only=False) for k in ("first", "stop"))
        order = np.lexsort((first, row))
        row, first, stop = row[order], first[order], stop[order]
        # the furthest stop so far; a row's own are above those of the rows before it
        shift = row * (int(stop.max(initial=0)) + 1)
        far = np.maximum.accumulate(stop + shift) if len(stop) else stop
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (first[1:] + shift[1:] > far[:-1])
        at = np.flatnonzero(opens)
        low, high = first[at], (far - shift)[np.append(at[1:], len(row)) - 1] if len(at) else first[at]
        bounds = np.searchsorted(row[at], np.arange(n + 1))
        total = np.concatenate([[0], np.cumsum(high - low)])
        each = [f"{x}-{y}" for x, y in zip(low.tolist(), high.tolist(), strict=True)]
        names = [",".join(each[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(total[bounds])), pa.array(np.diff(bounds)), pa.array(names, pa.string())], names=["doc_id", "th", "n_words", "n_repeated", "n_spans", "spans"])


def _hot_spans(texts: DataFrame, passage: int, window: int, hot: int) -> DataFrame:
    """(doc_id, th, first, stop) of the passages around the spots of texts that occur twice; no group meets in one task."""
    each = written(texts.mapInArrow(_passages(passage, window), "doc_id long, th long, pos int, left int, code long"))
    # a row that is there twice is one place
    place = F.xxhash64("doc_id", "th", "pos")
    again = cut(each.groupBy("code").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("code", "n"))
    # the many copies of the few common passages stay where they are
    common = if_small(again.where(F.col("n") > hot).select("code"))
    rare = each.join(common, "code", "left_anti").join(again.where(F.col("n") <= hot).select("code"), "code")
    found = each.join(common, "code").select("doc_id", "th", "pos", "left").unionAll(rare.select("doc_id", "th", "pos", "left"))
    # all passages of one suffix hold its head
    found = found.groupBy("doc_id", "th", "pos").agg(F.max("left").alias("most"), F.min("left").alias("least"))
    return found.select("doc_id", "th", (F.col("pos") - F.col("most")).cast("long").alias("first"), (F.col("pos") - F.col("least") + passage).cast("long").alias("stop"))


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, k: int = K, window: int = WINDOW, hot: int = HOT, reach: int = REACH) -> DataFrame:
    """(doc_id, th, n_words, n_repeated, n_spans, spans) per id and text of docs (doc_id, text); th is a hash of the text.

    `spans` lists first-stop in words, the stop exclusive, of the passages of `passage` words or more
    that occur elsewhere in the corpus, in the same document or another.  Null and empty texts have no
    words.  Rows that repeat an id and its text are one document; an id with several texts has a row
    for each.  Rows with a null id are left out of the search.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = cut(docs.mapInArrow(_anchors(passage, k, window), "doc_id long, th long, n_words long, keys array<long>, at array<int>"))
    each = anchors.where("doc_id is not null").select("doc_id", "th", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("doc_id", "th", F.col("x.keys").alias("key"), F.col("x.at").alias("pos"))
    counts = each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    kept = each.join(counts, "key").select("doc_id", "th", F.struct("pos", "key", (F.col("m") > hot).alias("hot")).alias("spot"))
    spots = cut(kept.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("spot")).alias("spots")))

    def held(which) -> DataFrame:
        some = spots.select("doc_id", "th", F.filter("spots", which).alias("spots")).where(F.size("spots") > 0)
        # of the texts only those go on to the join that have such a spot
        texts = docs.join(if_small(some.select("doc_id", "th")), ["doc_id", "th"], "left_semi")
        return texts.join(some, ["doc_id", "th"]).select("doc_id", "text", "th", "spots")

    suffixes = held(lambda x: ~x["hot"]).mapInArrow(_contexts(passage, window), "key long, doc_id long, th long, pos int, nl int, nr int, before binary, behind binary")
    found = suffixes.repartition(parts, "key").mapInArrow(_matched(passage, window, reach), "doc_id long, th long, first long, stop long")
    if spots.where(F.exists("spots", lambda x: x["hot"])).limit(1).count():
        found = found.unionAll(_hot_spans(held(lambda x: x["hot"]), passage, window, hot))
    # a span that several suffixes give joins up with itself
    spans = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "stop")).alias("found"))
    sizes = anchors.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"))
    joined = sizes.join(spans, ["doc_id", "th"], "left").select("doc_id", "th", "n_words", "found")
    return joined.mapInArrow(_union, "doc_id long, th long, n_words long, n_repeated long, n_spans long, spans string")

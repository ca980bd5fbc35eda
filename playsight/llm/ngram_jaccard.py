"""Exact n-gram Jaccard self-join by vertical partitioning of the n-gram order.

Every n-gram is a 64-bit hash, and the hash order is the global order.  A linked pair
(100 * |x & y| >= 75 * |x | y|) leaves at most floor(n / 4) n-grams of either side unmatched.

1. Documents of equal sets form a class, named by a hash of its set (`cid`); one text of it goes on.
   Copies are never expanded into pairs.
2. The first fragment of the order holds each class's floor(n / 4) + 1 smallest n-grams and a
   slack of floor(0.08 n) + 4 more.  N-grams that at most COLD classes have there give pairs and
   partial overlaps, summed per pair; a bound from those sums drops most.  An n-gram that more than
   COLD classes of one map task have is known to be hot there; further rows of it don't meet.
3. N-grams that more classes have are hot: passages, or large groups of near copies.  If a link
   isn't found by a cold n-gram, both sides have at least floor(0.06 n) + 5 (or half) hot ones:
   the classes with so many are joined once more, by a prefix in order of true frequency among
   them, where what is still hot is linked to one pivot: the class with the smallest share of
   n-grams of its own.
4. Candidates are verified: the sets of both sides are cut into fragments of the order, partial
   overlaps are counted a fragment at a time and summed per pair.  Pairs that earlier links
   already connect aren't verified again.
5. Lists of hot n-grams that still hold several components: their classes are dealt into blocks by
   pivot.  Each pair of blocks that some list names is a task, which counts the overlaps of its classes
   of different components, a fragment of the order at a time, and gives links that span what it finds.

A link is lost or made up only by a 64-bit hash collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.llm.common import components, cut, if_small, long_list
from playsight.llm.textkit import chunks, mix, sets_of_shingles

#: Classes that may share an n-gram before it counts as hot.
COLD = 16
#: Fragments that verification cuts the order into.
FRAGMENTS = 4
#: Classes of a block (fewer, where they are large); and n-grams that a task compares at once.
BLOCK, COLUMNS = 1024, 4096
#: Rows (16 bytes each) of heads that a task deals out together.
RUN = 1 << 19
#: Rows of lists that a task looks at together, pairs that it adds up at once, and rows of a batch that it gives on.
LOOK, PAIRS, SEND = 1 << 17, 1 << 19, 50_000


def _named(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set of hashes: of its size and two sums."""
    n = np.diff(bounds)
    run_sum = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(values, out=run_sum[0, 1:])
    np.cumsum(mix(values), out=run_sum[1, 1:])
    sums = run_sum[:, bounds[1:]] - run_sum[:, bounds[:-1]]
    return mix(mix(sums[0] + n.astype(np.uint64)) + sums[1]).view(np.int64)


def _profiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                values, bounds = sets_of_shingles(data, offsets, k)
                n = np.diff(bounds)
                q = np.minimum(n, n // 4 + 1 + (0.08 * n).astype(np.int64) + 4)
                ends = np.cumsum(q)
                take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - q, q) + np.repeat(bounds[:-1], q)
                index = values[take].view(np.int64) ^ np.int64(-(2**63))  # signed order follows the unsigned order
                top = np.where(q > 0, index[np.maximum(ends - 1, 0)] if len(index) else 0, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(_named(values, bounds)), pa.array(top), long_list(index, np.concatenate([[0], ends]))],
                    names=["doc_id", "n", "cid", "top", "head"],
                )

    return run


def _segments(k: int, fragments: int):
    shift = np.uint64(64 - (fragments - 1).bit_length()) if fragments > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                values, bounds = sets_of_shingles(data, offsets, k)
                rows = np.repeat(np.arange(b - a), np.diff(bounds))
                part = (values >> shift).astype(np.int64) if shift is not None else np.zeros(len(values), np.int64)
                at = np.searchsorted(rows * fragments + part, np.arange((b - a) * fragments + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(_named(values, bounds), fragments)), pa.array(np.tile(np.arange(fragments, dtype=np.int32), b - a)), long_list(values, at)],
                    names=["cid", "frag", "seg"],
                )

    return run


def _dealt(cold: int):
    """Rows (head, cid) into rows (h, cid, slot); slot 0: to the list of h; else h is hot here, and the row spread by its slot."""

    def out(h: np.ndarray, cid: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((cid, h))
        h, cid = h[order], cid[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        # a row that is there twice counts once
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])])
        place = np.cumsum(fresh) - np.cumsum(fresh)[np.arange(len(h)) - place]
        slot = np.where(place > cold, 1 + (cid & 0xFFFF), 0).astype(np.int32)
        h, cid, slot = h[fresh], cid[fresh], slot[fresh]
        for x in range(0, len(h), SEND):
            yield pa.RecordBatch.from_arrays([pa.array(c[x : x + SEND]) for c in (h, cid, slot)], names=["h", "cid", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            heads, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            cid = np.repeat(ids, np.diff(np.asarray(heads.offsets)))
            held.append((heads.flatten().to_numpy(zero_copy_only=False), cid))
            size += len(cid)
            if size >= RUN:
                yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _lists(cold: int):
    """Rows (h, cid, slot) of one partition, sorted by h: pairs of cold n-grams with their count, and the rows of hot ones."""

    def rows(a: np.ndarray, b: np.ndarray | None, shared: np.ndarray | None, h: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(a), SEND):
            part = slice(x, x + SEND)
            n = len(a[part])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c[part]) for c in (a, b, shared, h)], names=["a", "b", "shared", "h"])

    def settle(h: np.ndarray, cid: np.ndarray, slot: np.ndarray, known_hot: int | None) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((cid, h))
        h, cid, slot = h[order], cid[order], slot[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])])
        h, cid, slot = h[new], cid[new], slot[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        is_hot = (size > cold) | (np.maximum.reduceat(slot, first) > 0) | (h[first] == known_hot if known_hot is not None else False)
        # pairs are added up a part of the lists at a time: there are up to cold / 2 for a row
        of = np.where(is_hot, 0, size * (size - 1) // 2)
        part = (np.cumsum(of) - of) // PAIRS
        for k in np.unique(part[of > 0]).tolist():
            left, right = [], []
            for m in range(2, cold + 1):
                at = first[(size == m) & ~is_hot & (part == k)]
                if len(at):
                    i, j = np.triu_indices(m, 1)
                    left.append(cid[at[:, None] + i].ravel())
                    right.append(cid[at[:, None] + j].ravel())
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield from rows(a[new], b[new], np.diff(np.append(new, len(a))), None)
        hot = np.repeat(is_hot, size)
        yield from rows(cid[hot], None, None, h[hot])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known_hot = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            size += batch.num_rows
            if size < LOOK:
                continue
            h, cid, slot = (np.concatenate(x) for x in zip(*held, strict=True))
            # the last list goes on in the next run, unless it is known to be hot
            at = int(np.searchsorted(h, h[-1]))
            if at == 0 or len(h) - at > LOOK // 2:
                yield from settle(h, cid, slot, known_hot)
                known_hot, held, size = int(h[-1]), [], 0
            else:
                yield from settle(h[:at], cid[:at], slot[:at], known_hot)
                held, size = [(h[at:], cid[at:], slot[at:])], len(h) - at
        if size:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)), known_hot)

    return run


def _by_lists(heads: DataFrame, cold: int) -> DataFrame:
    """heads: (head, cid).  Rows of one n-gram meet in one task as plain rows; no pairs of a hot one are made."""
    n = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.select("head", "cid").mapInArrow(_dealt(cold), "h long, cid long, slot int").repartition(n, "h", "slot").sortWithinPartitions("h")
    return dealt.mapInArrow(_lists(cold), "a long, b long, shared long, h long")


class Verifier:
    """Counts overlaps of candidate pairs, fragment by fragment, over the full sets."""

    def __init__(self, docs: DataFrame, leads: DataFrame, k: int, fragments: int):
        """leads: (cid, lead): a doc_id that has a text of the class."""
        self.docs, self.leads, self.k, self.fragments = docs, leads, k, fragments

    def texts(self, ids: DataFrame) -> DataFrame:
        """A few texts: of the documents that lead the classes ids (cid, cut); under such a doc_id there may be more."""
        some = cut(self.leads.join(if_small(ids), "cid", "left_semi").select(F.col("lead").alias("doc_id")).distinct())
        return self.docs.join(if_small(some), "doc_id", "left_semi")

    def links(self, pairs: DataFrame) -> DataFrame:
        """pairs: (a, b, na, nb), cut.  Those with 100 * overlap >= 75 * union, as (a, b)."""
        ids = cut(pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "cid"))
        sets = self.texts(ids).mapInArrow(_segments(self.k, self.fragments), "cid long, frag int, seg array<long>")
        left = pairs.join(sets.select(F.col("cid").alias("a"), "frag", F.col("seg").alias("sa")), "a")
        both = left.join(sets.select(F.col("cid").alias("b"), "frag", F.col("seg").alias("sb")), ["b", "frag"])
        partial = both.select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("sa", "sb")).alias("part"))
        # a text that is there twice gives its fragments twice: each counts once
        total = partial.groupBy("a", "b", "na", "nb").agg(F.aggregate(F.collect_set(F.struct("frag", "part")), F.lit(0), lambda x, y: x + y["part"]).alias("inter"))
        return cut(total.where("100 * inter >= 75 * (na + nb - inter)").select("a", "b", "inter"))


def jaccard_components(docs: DataFrame, k: int = 5, cold: int = COLD, fragments: int = FRAGMENTS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links.  Null, empty and blank texts have no shingle
    and are linked with nothing (component_id is their own id).  Rows that repeat an id and its text are
    one document and get equal rows; an id with several texts has a row for each, each linked on its own.
    Rows with a null id are kept, unlinked, with a null component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = cut(docs.mapInArrow(_profiles(k), "doc_id long, n long, cid long, top long, head array<long>"))
    some = profiles.where("n > 0 and doc_id is not null")
    leads = cut(some.groupBy("cid", "n", "top").agg(F.min("doc_id").alias("lead"), F.count("*").alias("rows")))
    copied = leads.where("rows > 1").select("cid", "lead")
    lead = some.join(if_small(copied), "cid", "left").where("lead is null or lead = doc_id")
    first = cut(_by_lists(lead.select("head", "cid"), cold))

    hot = first.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("hot"))
    shared = first.where("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    with_hot = cut(leads.join(hot, "cid", "left").select("cid", "n", "top", F.coalesce("hot", F.lit(0)).alias("hot")))
    one = with_hot.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("top").alias("ta"), F.col("hot").alias("ha"))
    two = with_hot.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("top").alias("tb"), F.col("hot").alias("hb"))
    q = lambda n: F.least(F.col(n), F.floor(F.col(n) / 4) + 1 + F.floor(F.lit(0.08) * F.col(n)) + 4)
    most = F.col("shared") + F.least("ha", "hb") + F.when(F.col("ta") <= F.col("tb"), F.col("na") - q("na")).otherwise(F.col("nb") - q("nb"))
    near = shared.join(one, "a").join(two, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na").where(7 * most >= 3 * (F.col("na") + F.col("nb")))
    near = cut(near.select("a", "b", "na", "nb", "shared"))

    # each class with its likeliest partner first, and what hot n-grams suggest; then only what those links leave apart
    verifier = Verifier(docs, leads, k, fragments)
    best = near.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("shared", -F.col("a"))).alias("x")).select("x.a", "b", "x.na", "x.nb")
    suggested, left, sets = _hot_pairs(with_hot, verifier, k, cold)
    links = verifier.links(cut(best.unionAll(suggested).distinct()))
    comps = cut(components(links))
    more = verifier.links(cut(_apart(near, comps))).select("a", "b").unionAll(_across(left, sets, comps, block))
    comps = cut(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)))

    # only classes that have copies or links have another component than their own document
    named = leads.join(comps, F.col("cid") == F.col("node"), "left").where("rows > 1 or component is not null")
    low = named.where("component is not null").groupBy("component").agg(F.min("lead").alias("low"))
    named = cut(named.join(if_small(cut(low)), "component", "left").select("cid", F.coalesce("low", "lead").alias("component_id")))
    out = profiles.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("cid")).alias("cid")).join(if_small(named), "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose sides aren't in one component yet."""
    a, b = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(if_small(a), "a", "left").join(if_small(b), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    return joined.select("a", "b", "na", "nb")


def _explode_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(1)):
                values, bounds = sets_of_shingles(data, offsets, k)
                ids = np.repeat(_named(values, bounds), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ids)], names=["h", "cid"])

    return run


def _hot_pairs(with_hot: DataFrame, verifier: Verifier, k: int, cold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For classes that consist of hot n-grams to a good part: candidate pairs, (h, cid, n, a) of lists that are still long with their pivot, all n-grams."""
    wide = cut(with_hot.where("hot > 0 and hot >= least(floor(0.06 * n) + 5, ceil(n / 2))").select("cid", "n"))
    texts = verifier.texts(wide.select("cid"))
    rows = cut(texts.mapInArrow(_explode_sets(k), "h long, cid long").join(if_small(wide.select("cid")), "cid", "left_semi").distinct())
    frequency = rows.groupBy("h").agg(F.count("*").alias("df"))
    own = W.partitionBy("cid")
    ranked = rows.join(frequency, "h").withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("own", F.sum((F.col("df") == 1).cast("int")).over(own)).withColumn("n", F.max("rank").over(own.orderBy("df", "h").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    head = cut(ranked.where("rank <= floor(n / 4) + 1").groupBy("cid", "n", "own").agg(F.collect_list("h").alias("head")))
    # by true frequency few lists are long: a higher bound leaves less to compare in blocks
    lists = cut(_by_lists(head, 2 * cold))
    sized = if_small(head.select("cid", "n", "own"))
    left = lists.where("b is null").select("h", F.col("a").alias("cid")).join(sized, "cid")
    pivot = left.groupBy("h").agg(F.min(F.struct(F.col("own") / F.col("n"), "cid"))["cid"].alias("a"))
    left = cut(left.join(if_small(cut(pivot)), "h").select("h", "cid", "n", "a"))
    star = left.where("a <> cid").select("a", F.col("cid").alias("b"))
    a, b = head.select(F.col("cid").alias("a"), F.col("n").alias("na")), head.select(F.col("cid").alias("b"), F.col("n").alias("nb"))
    pairs = lists.where("b is not null").select("a", "b").unionAll(star).distinct().join(if_small(a), "a").join(if_small(b), "b")
    return pairs.where("4 * na >= 3 * nb and 4 * nb >= 3 * na").select("a", "b", "na", "nb"), left, rows


def _spanning(parts: list[tuple], comps: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """parts: (cid, set) of one pair of blocks.  Links between rows of different components and sides that span all there are."""
    n = np.array([len(x) for _, x in parts])
    codes, inverse, times = np.unique(np.concatenate([x for _, x in parts]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(parts)), n)
    # n-grams of one row alone match nothing
    column = np.cumsum(times > 1) - 1
    some = times[inverse] > 1
    rows, at = rows[some], column[inverse[some]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = np.empty(len(parts), np.int64)
    place[one], place[two] = np.arange(len(one)), np.arange(len(two))
    inter = np.zeros((len(one), len(two)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        r, c = rows[a:b], at[a:b] - low
        x, y = np.zeros((len(one), COLUMNS), np.float32), np.zeros((len(two), COLUMNS), np.float32)
        mine = side[r] == 0
        x[place[r[mine]], c[mine]] = 1
        y[place[r[~mine]], c[~mine]] = 1
        inter += x @ y.T
    linked = (175 * inter >= 75 * (n[one][:, None] + n[two][None])) & (comps[one][:, None] != comps[two][None])
    root = {int(c): int(c) for c in comps}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        i, j = int(one[i]), int(two[j])
        a, b = find(int(comps[i])), find(int(comps[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((parts[i][0], parts[j][0]))
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (left, right, side, cid, comp, set) sorted by left and right, both blocks; links (a, b)."""
    held: list[tuple] = []
    last = None

    def close() -> list[tuple[int, int]]:
        side = np.array([r[0] for r in held])
        if not held or side.min() == side.max():
            return []
        return _spanning([(r[1], r[3]) for r in held], np.array([r[2] for r in held], np.int64), side)

    for batch in batches:
        out: list[tuple[int, int]] = []
        left, right, side, cid, comp = (batch.column(i).to_pylist() for i in range(5))
        sets = batch.column(5)
        for i in range(batch.num_rows):
            if (left[i], right[i]) != last:
                out += close()
                held, last = [], (left[i], right[i])
            held.append((side[i], cid[i], comp[i], sets[i].values.to_numpy(zero_copy_only=False).copy()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    if out := close():
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _across(left: DataFrame, sets: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """Links across components in lists (h, cid, n, a) that hold several; a is the list's pivot.

    A class lives in a block of the pivot of its longest list, so that classes alike share one.  Lists
    only name pairs of blocks; each set goes once to each pair of its block, whatever lists it is in.
    """
    marked = left.join(if_small(comps), left["cid"] == comps["node"], "left").select("h", "cid", "a", "n", F.coalesce("component", "cid").alias("comp"))
    sums = marked.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("comps"))
    mixed = cut(marked.join(if_small(cut(sums.where("comps > 1"))), "h").select("h", "cid", "comp", (F.col("comp") != F.col("main")).alias("minor"), "a", "m", "n"))
    homes = mixed.groupBy("cid", "comp", "n").agg(F.max_by("a", F.struct("m", "h")).alias("home"), F.max("minor").alias("minor"))
    size = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / (block * COLUMNS))).cast("int").alias("width"))
    homes = homes.join(if_small(cut(size)), "home")
    homes = cut(homes.withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("cid"), "width"))).select("cid", "comp", "minor", "block"))
    placed = mixed.select("h", "cid", "minor").join(if_small(homes.select("cid", "block")), "cid")
    one = placed.where("minor").select("h", F.col("block").alias("left")).distinct()
    pairs = cut(one.join(placed.select("h", F.col("block").alias("right")).distinct(), "h").select("left", "right").distinct())
    sides = [pairs.join(homes.where("minor"), F.col("left") == F.col("block")).withColumn("side", F.lit(0)), pairs.join(homes, F.col("right") == F.col("block")).withColumn("side", F.lit(1))]
    whole = sets.join(if_small(homes.select("cid")), "cid", "left_semi").groupBy("cid").agg(F.collect_list("h").alias("set"))
    rows = sides[0].unionAll(sides[1]).select("left", "right", "side", "cid", "comp").join(whole, "cid")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("left", "right", "side", "cid", "comp", "set").repartition(n, "left", "right").sortWithinPartitions("left", "right")
    return met.mapInArrow(_met, "a long, b long")

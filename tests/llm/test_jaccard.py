"""The n-gram Jaccard join against brute force: repeated rows, ids with several texts, large groups of near copies."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from playsight.llm import ngram_jaccard
from playsight.llm.ngram_jaccard import jaccard_components

rng = random.Random(21)


def _shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _want(rows):
    """(doc_id, size, component) of every row; links between sets by an inverted index, checked one by one."""
    docs = {(d, s) for d, t in rows if d is not None for s in [_shingles(t)] if s}
    root = {x: x for x in docs}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    index = defaultdict(list)
    for x in docs:
        for g in x[1]:
            index[g].append(x)
    for x in docs:
        for y, n in Counter(y for g in x[1] for y in index[g]).items():
            if 100 * n >= 75 * (len(x[1]) + len(y[1]) - n):
                root[find(x)] = find(y)
    low = {}
    for x in docs:
        low[find(x)] = min(low.get(find(x), x[0]), x[0])
    return Counter((d, len(s), low[find((d, s))] if d is not None and s else d) for d, t in rows for s in [_shingles(t)])


def _check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_components(frame, **options).collect())
    assert got == _want(rows)


def _words(n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def _edited(words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_repeated_rows_make_no_links(spark):
    base = _words(60)
    half = " ".join([*base[:38], *_words(22)])  # Jaccard of about 0.4
    assert 0.3 < len(_shingles(" ".join(base)) & _shingles(half)) / len(_shingles(" ".join(base)) | _shingles(half)) < 0.5
    rows = [(1, " ".join(base))] * 5 + [(2, half), (3, half)] + [(4, _edited(base, 1))]
    _check(spark, rows)


def test_an_id_with_several_texts(spark):
    one, two = _words(50), _words(50)
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, _edited(one, 1)), (3, _edited(two, 1)), (0, " ".join(two)), (5, None), (5, ""), (6, "a b"), (7, "A  B"), (None, " ".join(one)), (None, None)]
    _check(spark, rows)


@pytest.mark.parametrize(("cold", "block"), [(2, 8), (16, 1024)])
def test_a_large_group_of_near_copies(spark, cold, block):
    base = _words(90)
    rows = [(k, _edited(base, rng.choice([0, 1, 1, 2, 3, 3, 4]))) for k in range(500)]
    rows += [(1000 + k, " ".join([*_words(30), *base[:40], *_words(30)])) for k in range(100)]  # a passage that many share
    rows += [(2000 + k, _edited(base[:70], rng.choice([0, 1, 2]))) for k in range(100)]
    two = _words(90)
    rows += [(3000 + k, _edited([*base[:45], *two[45:]], 1)) for k in range(60)] + rows[:30]
    _check(spark, rows, cold=cold, block=block)


def test_many_copies_of_a_few_near_texts(spark):
    base = _words(40)
    texts = [" ".join(base), _edited(base, 1), _edited(base, 1)]
    _check(spark, [(k, texts[k % 3]) for k in range(3000)] + [(3000 + k, " ".join(_words(20))) for k in range(50)])


def test_lists_of_many_pairs_need_little_memory():
    cold, rows = 16, 40_000 * 16
    h = np.repeat(np.arange(rows // cold), cold)
    cid = (h // 50) * 1000 + np.tile(np.arange(cold), rows // cold)  # 50 lists hold the same classes
    batches = [pa.RecordBatch.from_arrays([pa.array(h[x : x + 10_000]), pa.array(cid[x : x + 10_000]), pa.array(np.zeros(len(h[x : x + 10_000]), np.int32))], names=["h", "cid", "slot"]) for x in range(0, rows, 10_000)]
    tracemalloc.start()
    found = Counter()
    for batch in ngram_jaccard._lists(cold)(iter(batches)):
        for a, b, shared in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found[a, b] += shared
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 800 * 120 and set(found.values()) == {50}
    assert most < 100e6

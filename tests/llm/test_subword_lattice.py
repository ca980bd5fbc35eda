"""The lattice model against enumeration, and its base score against a plain count."""

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playsight.llm import subword_lattice as lattice
from playsight.llm.common import table

PIECES = [b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"aba", bytes([0xC3, 0xA9]), *[bytes([k]) for k in range(256) if k not in (0x20, 0x61, 0x62)]]


def _paths(word, weight):
    """All segmentations of a word with their weights, one by one."""
    if not word:
        yield (), 1.0
    for i, p in enumerate(PIECES):
        if word.startswith(p):
            for rest, w in _paths(word[len(p) :], weight):
                yield (i, *rest), weight[i] * w


def test_forward_adds_up_all_segmentations():
    rng = np.random.default_rng(3)
    weight = rng.random(len(PIECES) + 1)
    weight /= weight.sum()
    words, counts = ["abab", "b", "abaabab", "é", "aébxab", "b" * 40], np.array([3.0, 1.0, 2.0, 5.0, 1.0, 4.0])
    model = lattice.Lattice(PIECES, np.log(weight))
    ((a, b, data, ends),) = lattice._marked(pa.array(words))
    log_p, uses = model.forward(data, ends, counts)
    want_uses = np.zeros(len(weight))
    for word, n, got in zip(words, counts, log_p, strict=True):
        paths = list(_paths(b" " + word.encode(), weight))
        total = sum(w for _, w in paths)
        assert got == pytest.approx(math.log(total), rel=1e-12)
        for path, w in paths:
            for i in path:
                want_uses[i] += n * w / total
    assert np.allclose(uses, want_uses, rtol=1e-9)
    assert np.allclose(model.forward(data, ends)[0], log_p)


def test_a_very_long_word_has_a_finite_probability():
    pieces, prior = lattice.vocabulary(lattice.default_vocabulary())
    model = lattice.Lattice(pieces, np.log(prior))
    ((_, _, data, ends),) = lattice._marked(pa.array(["xy" * 20_000]))
    assert np.isfinite(model.forward(data, ends)[0]).all()


def test_pieces_are_a_distribution():
    pieces, prior = lattice.vocabulary(lattice.default_vocabulary())
    assert prior.sum() == pytest.approx(1.0) and (prior > 0).all() and len(prior) == len(pieces) + 1
    assert len(set(pieces)) == len(pieces) and all(bytes([b]) in set(pieces) for b in range(256))


def _plain(rows):
    """doc_id, n_tokens, n_known, base_score by the contract, one token at a time."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for d, t in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = Counter(x for d, ts in tokens if not held(d) for x in ts)
    n, v = sum(count.values()), len(count)
    return sorted(((-1 if d is None else d), held(d), len(ts), sum(count[x] > 0 for x in ts), n, round(sum(math.log10((count[x] + 1) / (n + 1 * (v + 1))) for x in ts), 6)) for d, ts in tokens)


def _got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


def test_base_score_is_the_plain_count(spark, sf):
    docs = table(spark, sf, "documents")
    got = lattice.text_scores(docs, rounds=2).cache()
    assert _got(got) == _plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    sums = lambda df, held: df.where(f"held_out = {held}").agg(F.sum("score"), F.sum("base_score")).first()
    alone = lattice.text_scores(docs, rounds=2, whole_words=False).cache()
    assert sums(got, "true")[0] > sums(alone, "true")[0] and sums(got, "false")[0] > sums(got, "false")[1]
    assert got.where("not score < 0 or isnan(score)").count() == 0


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "Aa ÄA aa ▁x " + "q" * 5000, "en"), (4, "twice", "en"), (4, "twice", "en"), (None, "no id", "xx"), (7, "<s> </s> \U0001f600 \x00", None), (15, "aa held", "zz")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, c int, word int")
    got = lattice.text_scores(docs, rounds=1)
    assert _got(got) == _plain([r[:2] for r in rows])
    assert got.where("not score < 0").count() == 0
    assert lattice.text_scores(docs.limit(0)).count() == 0
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)  # nothing to learn from
    assert _got(lattice.text_scores(held)) == _plain([(r["doc_id"], r["text"]) for r in held.collect()])


def test_whole_text_is_the_product_of_its_words(spark):
    """A recursion over the whole marked text by plain Python gives the lattice score."""
    docs = spark.createDataFrame([(k, t, "en") for k, t in zip((0, 2, 3), ["the cat sat", "a cat", "the the dog barks loudly"], strict=True)], "doc_id long, text string, lang string")
    pieces, prior = lattice.vocabulary(lattice.default_vocabulary())
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("c")).withColumn("slot", F.lit(0))
    common = lattice.fit(words, pieces, {0: prior}, {0: 3}, 2)[0]
    fitted = dict(zip([*pieces, None], lattice.fit(words, pieces, {0: np.exp(common)}, {0: 3}, 1)[0], strict=True))

    @lru_cache(maxsize=None)
    def alpha(text):
        if not text:
            return 1.0
        return sum(math.exp(fitted[p]) * alpha(text[: -len(p)]) for k in range(len(text)) if (p := text[k:]) in fitted)

    got = {r["doc_id"]: r["score"] for r in lattice.text_scores(docs, rounds=2, whole_words=False).where("not held_out").collect()}
    assert len(got) == 3
    for r in docs.collect():
        want = math.log10(alpha(b" " + r["text"].encode())) + fitted[None] / math.log(10)
        assert got[r["doc_id"]] == pytest.approx(want, rel=1e-5)

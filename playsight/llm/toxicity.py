"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words, their leading 4, 5 and 6 characters, and every two successive
characters of scripts that are written without spaces.  All are hashed into a fixed space of 2 ** BITS
places.  Every place that tells the labelled training rows apart (its chi-squared, counted over all of
those rows, reaches CHI) is an input, however many there are, as present or absent.  A factorization machine
gives each a weight and a vector; the products of the vectors of two present terms add what only the pair says.
It is fitted by Spark ML on at most 2 * SAMPLE labelled rows, and every text is scored inside the scan
that reads it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playsight.llm.common import cut, if_small
from playsight.llm.textkit import _BYTE_CODE, LOWER, NON_ALNUM, Words, _power_tables, chunks, mix

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 4000
#: Places that terms are hashed to (log2).
BITS = 22
#: What a place must reach to be an input (one in twenty does by chance), and in how many training rows it must be.
CHI, LEAST_ROWS = 3.84, 5
FACTORS = 4
PREFIXES = (4, 5, 6)
#: Three-byte characters of scripts without spaces: Thai and Lao, Burmese, Khmer, and kana, ideographs and hangul; first and last as lead byte and next byte.
UNSPACED = ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xED9F))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all terms and the row of each."""
    words = Words(data, offsets, NON_ALNUM)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[LOWER[data]] * up[: len(data)], out=total[1:])
    found, at = [words.hash], [rows]
    # where characters start, and which of them a word starts and ends at
    char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first, last = np.searchsorted(char, words.start), np.searchsorted(char, words.end)
    for n in PREFIXES:
        long = last - first > n
        start, end = words.start[long], char[first[long] + n]
        found.append(mix((total[end] - total[start]) * down[start]) ^ np.uint64(n))
        at.append(rows[long])
    pair = (data[:-1].astype(np.int64) << 8) | data[1:] if len(data) > 1 else np.zeros(0, np.int64)
    wide = np.zeros(len(data), bool)
    for low, high in UNSPACED:
        wide[: len(pair)] |= (pair >= low) & (pair <= high)
    if wide.any():
        start = np.flatnonzero(wide[:-5] & wide[3:-2]) if len(data) > 5 else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + 6 <= offsets[row + 1]
        start, row = start[inside], row[inside]
        found.append(mix((total[start + 6] - total[start]) * down[start]) ^ np.uint64(2))
        at.append(row)
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, number of toxic texts, number of others) of one batch of (doc_id, text, toxic)."""
    for batch in batches:
        toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, data, offsets in chunks(batch.column(1)):
            terms, rows = _terms(data, offsets)
            both = np.unique(terms * (b - a) + rows)
            term, inverse = np.unique(both // (b - a), return_inverse=True)
            bad = np.bincount(inverse, toxic[a:b][both % (b - a)], len(term)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(term))
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(bad), pa.array(every - bad)], names=["term", "bad", "good"])


class _Inputs:
    """Which of the chosen places each text has: (row, number of the place), each pair once."""

    def __init__(self, terms: np.ndarray):
        self.number = np.full(1 << BITS, -1, np.int32)
        self.number[np.sort(terms)] = np.arange(len(terms))
        self.many = max(1, len(terms))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, rows = _terms(data, offsets)
        at = self.number[found]
        pairs = np.unique(rows[at >= 0].astype(np.int64) * self.many + at[at >= 0])
        return pairs // self.many, pairs % self.many


def _present(terms: np.ndarray):
    """(doc_id, label, present): the places of the terms that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _Inputs(terms)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                rows, at = inputs(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)), pa.array(at).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).cast(pa.float64()), lists], names=["doc_id", "label", "present"])

    return run


def _scored(terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _Inputs(terms)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                rows, at = inputs(data, offsets)
                z = bias + np.bincount(rows, linear[at], b - a)
                for f in range(factors.shape[1]):  # terms are present or absent, so the square of an input is itself
                    z += (np.bincount(rows, factors[at, f], b - a) ** 2 - np.bincount(rows, factors[at, f] ** 2, b - a)) / 2
                z = np.clip(z, -40, 40)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    labels: (doc_id, toxic); rows with a null id or label, and those held out, are never learned
    from.  Null and empty texts get the score of a text without any of the terms.  Without labels of
    both kinds every score is the share of the kind there is (0 without any).  `features` may name a
    number of inputs to keep; by default there is no such number.  Texts are read whole, rows that repeat an id are scored
    one by one, and where labels of one id differ the toxic one counts.  An empty table gives no row.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms, bias, linear, factors = np.zeros(0, np.int64), -40.0, np.zeros(1), np.zeros((1, 1))
    if n and bad in (0, n):
        bias = 40.0 if bad else -40.0
    elif n:
        every = docs.join(if_small(cut(known)), "doc_id").select("doc_id", "text", "toxic")
        terms = _chosen_terms(every, bad, n - bad, features)
        order = F.xxhash64("doc_id", F.lit("sample"))
        picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
        picked = if_small(cut(picked[0].unionAll(picked[1])))
        rows = docs.join(picked, "doc_id").select("doc_id", "text", "toxic").mapInArrow(_present(terms), "doc_id long, label double, present array<string>")
        counter = CountVectorizerModel.from_vocabulary([str(k) for k in range(max(1, len(terms)))], inputCol="present", outputCol="features").setBinary(True)
        vectors = cut(counter.transform(rows).select("doc_id", "label", "features").coalesce(4))
        share = vectors.agg(F.avg("label")).first()[0]
        if share is not None and 0 < share < 1:
            machine = FMClassifier(factorSize=FACTORS, maxIter=80, stepSize=0.1, regParam=0.001, initStd=0.05, seed=7, solver="adamW").fit(vectors)
            linear, factors = machine.linear.toArray(), machine.factors.toArray()
            # fitted on a balanced sample: shift to the share of the labels
            bias = machine.intercept + math.log(bad / (n - bad)) - math.log(share / (1 - share))
        else:  # labelled texts of one kind only, or none, are there
            terms, bias = np.zeros(0, np.int64), math.log(bad / (n - bad))
    scored = docs.mapInArrow(_scored(terms, float(bias), linear, factors), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _chosen_terms(rows: DataFrame, bad: int, good: int, features: int | None) -> np.ndarray:
    """The places that tell the training rows, of which `bad` are toxic, apart: at most 2 ** BITS."""
    per = rows.mapInArrow(_counted, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    a, b = F.col("bad") / F.lit(bad), F.col("good") / F.lit(good)
    share = (F.col("bad") + F.col("good")) / F.lit(bad + good)
    chi = (a - b) ** 2 / (F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / bad + 1 / good))
    top = per.where(F.col("bad") + F.col("good") >= LEAST_ROWS).where(chi >= CHI)
    if features is not None:
        top = top.orderBy(chi.desc(), "term").limit(features)
    return np.array([r[0] for r in top.select("term").collect()], np.int64)

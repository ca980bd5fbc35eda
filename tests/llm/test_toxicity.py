"""The factorization machine's score term by term, and the terms of awkward texts."""

import math

import numpy as np
import pyarrow as pa
import pytest

from playsight.llm import toxicity as T


def _places(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return set(T._terms(data, np.array([0, len(data)]))[0].tolist())


def test_scores_are_the_sum_over_all_pairs():
    texts = ["you fool", "a fool and a group", "", "nothing here", "ÜNÏ fool you you", None]
    terms = np.array(sorted(_places("you fool group") | _places("nothing")))
    rng = np.random.default_rng(0)
    bias, linear, factors = 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), T.FACTORS))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = {}
    for out in T._scored(terms, bias, linear, factors)(iter([batch])):
        got |= dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    for k, text in enumerate(texts):
        here = [i for i, t in enumerate(terms.tolist()) if text and t in _places(text)]
        z = bias + sum(linear[i] for i in here) + sum(factors[i] @ factors[j] for i in here for j in here if i < j)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)))


def test_prefixes_are_characters_and_scripts_without_spaces_give_pairs():
    assert len(_places("éééé")) == 1 and len(_places("ééééé")) == 2 and len(_places("abcdefg")) == 4
    assert _places("éééééx") & _places("ééééüy")  # a common start of four characters
    for text in ("ไทย", "ພາສາ", "မြန်မာ", "ភាសា", "日本語", "한국어"):
        chars = [c for c in text]
        assert len(_places(text)) >= len(chars) - 1
    assert _places("ABC") == _places("abc")


def test_no_number_of_inputs_is_fixed(spark):
    """Forty toxic words of eighty training rows all count."""
    words = [f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(k, f"filler text {words[k % 40]} {words[(k + 1) % 40]} {words[(k + 2) % 40]} {words[(k + 3) % 40]} {words[(k + 4) % 40]}" if k % 2 else "filler text and more", int(k % 2)) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    chosen = T._chosen_terms(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), 200, 200, None)
    assert set().union(*(_places(w) for w in words)) <= set(chosen.tolist())
    got = {r["doc_id"]: r["predicted"] for r in T.toxicity_scores(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) >= 396

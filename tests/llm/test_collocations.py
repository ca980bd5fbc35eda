"""Phrases against SQL and a plain count; the filters against a dictionary."""

import re
from collections import Counter

import numpy as np
import pytest

from helpers import same
from playsight.llm import collocations, entry
from playsight.llm import quotient_filter as qf


@pytest.mark.parametrize("bits", [1, 2, 5, 16, 21, 22, 33, 42])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    half, shards = qf.half_bits(bits), 3
    want, merges = Counter(), [qf.Merge(half, 50) for _ in range(shards)]
    for n in (1, 2, 400, 3000):
        ids = [rng.integers(0, min(1 << bits, 40), n) * ((1 << bits) - 1) // min((1 << bits) - 1, 39) if bits > 5 else rng.integers(0, 1 << bits, n) for _ in range(3)]
        counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], n)
        hi, lo = qf.pack(*ids, bits)
        assert all((x == y).all() for x, y in zip(qf.unpack(hi, lo, bits), ids, strict=True))
        phi, plo = qf.permute(hi, lo, half)
        assert int(phi.max()) < 1 << half and int(plo.max()) < 1 << half
        assert all((x == y).all() for x, y in zip(qf.restore(phi, plo, half), (hi, lo), strict=True))
        keys = qf.summed(phi, plo, counts, half)
        at = qf.shard_bounds(keys[0], half, shards)
        assert at[0] == 0 and at[-1] == len(keys[0])
        for k in range(shards):
            if at[k + 1] > at[k]:
                part = [x[at[k] : at[k + 1]] for x in keys]
                stored = qf.store(*part, half, shards)
                assert all((x == y).all() for x, y in zip(qf.load(stored), part, strict=True))
                merges[k].add(stored)
        for row in zip(*(x.tolist() for x in ids), counts.tolist(), strict=True):
            want[row[:3]] += row[3]
    got = Counter()
    for m in merges:
        hi, lo, counts = m.total()
        for row in zip(*(x.tolist() for x in qf.unpack(*qf.restore(hi, lo, half), bits)), counts.tolist(), strict=True):
            assert row[:3] not in got
            got[row[:3]] = row[3]
    assert got == want


def test_agrees_with_sql(spark, sf, duck):
    same(entry.op11_collocations(spark, sf), duck.execute(collocations.ORACLE_SQL).df())


def _plain(rows, least, top, share):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang in {k[0] for k in f}:
        own = {k[1:]: n for k, n in f.items() if k[0] == lang}
        total, found = sum(n for k, n in own.items() if len(k) == 1), []
        for p, a in own.items():
            inside = any(len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in own.items())
            if len(p) > 1 and a >= least and not inside:
                score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_awkward_rows(spark):
    texts = [None, "", " \t ", "new york city. New York  city, new\tyork", "a a a a a", "x\x0by é b ü|ü|ü z", "A B C! a b c? a b\nc a b", "word " * 3000, "é ü ß " * 5, "q" * 70_000 + " tail " + "q" * 70_000 + " tail"]
    rows = [(t, lang, 1, "w") for t in texts for lang in ("en", None, "und", "de")] + [(texts[3], "en", 1, "w")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, w1 int, word string")
    for least, top, share in ((2, 50, 50), (3, 2, 90), (10, 5, 1)):
        got = sorted(tuple(r) for r in collocations.phrases(docs, least, top, share).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == _plain([r[:2] for r in rows], least, top, share)
    assert collocations.phrases(docs.limit(0)).count() == 0
    assert collocations.phrases(docs.where("text = ''")).count() == 0


def test_broadcasts_totals_only(spark, monkeypatch):
    """Spark takes a compressed table for small; words and pairs, repeated for the salts, must not go through the driver."""
    plans, cut = [], collocations.cut
    monkeypatch.setattr(collocations, "cut", lambda df: (cut(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    docs = spark.createDataFrame([(f"a b c. d e f. a b. a b {lang}", lang) for lang in ("en", "de")] * 10, "text string, lang string")
    assert collocations.phrases(docs).count() > 0
    final = plans[-1].partition("Initial Plan")[0]
    assert "isFinalPlan=true" in final
    assert [x.split("HashJoin ")[1].split("#")[0] for x in final.splitlines() if "HashJoin " in x] == ["[lang"]
    assert final.count("SortMergeJoin") == 8

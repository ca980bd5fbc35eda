"""Token alignment against whole-text encoding and a plain loop over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from playsight.llm import alignment
from playsight.llm.common import table
from playsight.llm.incidence import Csr
from playsight.llm.token_store import default_tokenizer


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def _tokens(models, text):
    """[(id, start, end)] of both sides from the libraries alone, or two empty lists."""
    from tokenizers.decoders import ByteLevel  # noqa: F401

    a, b = models
    if not text:
        return [], []
    whole = (" " + text).encode()
    stands = alignment._alphabet()
    sides = [[(e, bytes(stands[c] for c in a.id_to_token(e))) for e in a.encode(" " + text, add_special_tokens=False).ids]]
    sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    if any(b"".join(x for _, x in s) != whole for s in sides):
        return [], []
    out = []
    for s in sides:
        at, spans = 0, []
        for i, x in s:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def _plain(models, rows):
    per, total = [], Counter()
    for doc_id, text in rows:
        a, b = _tokens(models, text)
        over = Counter((i, j) for i, s, e in a for j, u, v in b if s < v and u < e)
        groups, x, y = [], 0, 0
        for end in sorted({t[2] for t in a} & {t[2] for t in b}):
            ga = [t[0] for t in a[x:] if t[2] <= end]
            gb = [t[0] for t in b[y:] if t[2] <= end]
            groups.append((ga, gb))
            x, y = x + len(ga), y + len(gb)
        total.update(over)
        per.append((doc_id, a, b, over, groups))
    most = defaultdict(int)
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, a, b, over, groups in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best, summed = sum(n for (i, j), n in over.items() if total[i, j] == most[j]), sum(n * total[p] for p, n in over.items())
        out.append((-1 if doc_id is None else doc_id, len(a), len(b), len(groups), sum(over.values()), best, summed, sum(len(x) * len(y) for x, y in groups), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out)


def _got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_products_are_matrix_products(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr("playsight.llm.incidence.RUN", 7)
    for _ in range(20):
        x, y = rng.integers(0, 3, (6, 5)), rng.integers(0, 3, (5, 4))
        csr = lambda m: Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0], m.shape[1])
        got = np.zeros((6, 4), int)
        for i, j, v in csr(x).times(csr(y)):
            got[i, j] = v
        assert (got == x @ y).all()
        back = csr(x).transposed()
        assert all((u == v).all() for u, v in zip((back.indptr, back.indices, back.values), (csr(x.T).indptr, csr(x.T).indices, csr(x.T).values), strict=True))
        assert (csr(x).column_sums() == x.sum(0)).all()


def test_cut_up_encoding_is_whole_encoding(models):
    rng = random.Random(4)
    alphabet = ["a", "the", "B", " ", "  ", "   ", "\n", "\t", "\r\n", ".", ",", "1", "23", "é", "ß", "中", "文", "🙂", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "'s", "\x00", "　", " ", "▁", "́", "Ünï"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    encoders = alignment.ByteTokens(default_tokenizer()), alignment.PieceTokens(alignment.default_pieces())
    found = alignment.Aligned(encoders, pa.array(texts))
    for i, text in enumerate(texts):
        want = _tokens(models, text)
        for side in (0, 1):
            assert found.ids[side][found.bounds[side][i] : found.bounds[side][i + 1]].tolist() == [t[0] for t in want[side]], text


def test_whole_table(spark, sf, models):
    docs = table(spark, sf, "documents")
    short = docs.where("length(text) < 3000")
    assert _got(alignment.alignments(short)) == _plain(models, [(r["doc_id"], r["text"]) for r in short.collect()])


def test_awkward_rows(spark, models):
    texts = [None, "", " ", "  ", "a", "a ", "twice twice", "twice twice", "x▁y", "<|endoftext|> <s>", "中文 é🙂\x00\n\n\t z", "w" * 3000, "naïve café " * 30]
    rows = [(k, t, 7, "b") for k, t in enumerate(texts)] + [(None, "no id", 7, "b"), (4, "a", 7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, code string")
    assert _got(alignment.alignments(docs)) == _plain(models, [r[:2] for r in rows])
    assert alignment.alignments(docs.limit(0)).count() == 0
    for shared in (False, True):
        got = Counter((r["doc_id"], r["a"], r["b"], r["n"]) for r in alignment.links(docs.where("doc_id = 12"), shared).collect())
        a, b = _tokens(models, texts[12])
        if shared:
            ends = sorted({t[2] for t in a} & {t[2] for t in b})
            of = lambda t: next(k for k, e in enumerate(ends) if t[2] <= e)
            want = Counter((12, i, j, 1) for i, x in enumerate(a) for j, y in enumerate(b) if of(x) == of(y))
        else:
            want = Counter((12, i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2])
        assert got == want

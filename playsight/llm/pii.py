"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of each whole text: the four base kinds, the
same kinds in looser or stricter shapes, secrets, and any run with a digit or an at sign.  Each
has features of its format (digits, letters, groups, ...) and context (characters around
it, words before it); the generator's name is not among them.  Boosted trees (Spark ML) learn on at
most SAMPLE candidates to tell those that pass a kind's validation from those that don't; a
threshold is calibrated on documents left out of the fit, for a precision of PRECISION.  Base spans
always count; the trees add further spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.llm.common import cut

#: Candidates that the trees are fitted on, at most.
SAMPLE = 20_000
PRECISION = 0.99
KINDS = ("email", "ip", "card", "phone", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, so the look-behind changes nothing but the cost
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MORE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+?[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i:password|passwd|token|secret|api[_-]?key) ?[=:] ?\"?([A-Za-z0-9+/_-]{12,128})")),
)
_AT = re.compile(r"[(\[]at[)\]]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]")
_HINT = re.compile(r"(?i:pass|token|secret|key|tel|phone|call|card|mail|ip|addr|version|section|no\.)[^\n]{0,12}$")


def luhn(digits: str) -> bool:
    """The check-digit rule of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in time linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(valid spans by kind and start, matches that failed their kind's validation)."""
    spans, failed = [], []
    if "@" in text:
        spans += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(int(x) <= 255 if len(x) < 20 else not x.strip("0") or int(x.lstrip("0")[:4]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))
            spans.append(("ip", *m.span())) if ok else failed.append(m.span())
        for m in _CARD.finditer(text):
            d = _digits(m.group()) if m.end() - m.start() >= 16 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
            elif m.end() - m.start() >= 8:
                failed.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                ok = 8 <= len(_digits(m.group())) <= 15
                spans.append(("phone", *m.span())) if ok else failed.append(m.span())
    return spans, failed


def _features(text: str, a: int, b: int) -> list[float]:
    """Format and context of text[a:b]."""
    s = text[a:b]
    digits = _digits(s)
    n = len(s)
    parts = s.split(".")
    side = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isdigit() else 3.0 if c.isalpha() else 4.0
    return [
        float(n),
        float(len(digits)),
        float(sum(c.isalpha() for c in s)),
        float(sum(c.isupper() for c in s)),
        float(sum(not c.isalnum() for c in s)),
        len(digits) / n,
        float(s.count(".")),
        float(s.count("@")),
        float(s[0] == "+"),
        float("(" in s and ")" in s),
        float(s.count("-") + s.count(" ")),
        float(len(parts)),
        float(max(map(len, parts))),
        float(len(set(s)) / n),
        float(max((len(x) for x in re.findall(r"[0-9A-Fa-f]+", s)), default=0)),
        float(s.startswith("AKIA")),
        side(text[a - 1 : a]),
        side(text[b : b + 1]),
        float(bool(_HINT.search(text[max(0, a - 24) : a]))),
    ]


class _Taken:
    """Spans in order of their start, none inside another's reach forgotten: does one overlap [a, b)?"""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def meets(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return before > 0 and self.reach[before - 1] > a


def _candidates(text: str, spans: list, failed: list) -> list[tuple[str, int, int, int, list[float]]]:
    """(kind, start, end, label, features); label 1 valid, 0 not, -1 open, 2 strict in form: proposed, for the trees to decide.

    Takes time in proportion to the text, whatever it holds.
    """
    out = [(k, a, b, 1, _features(text, a, b)) for k, a, b in spans]
    out += [("", a, b, 0, _features(text, a, b)) for a, b in failed]
    shut = _Taken([(a, b) for _, a, b in spans])
    digit = bool(_DIGIT.search(text))
    for kind, pattern in _MORE:
        # without these a pattern has no match; secrets may be letters only
        if not (_AT.search(text) if kind == "email" else kind == "secret" or digit):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "secret" and pattern.groups else m.span()
            if kind == "secret":
                out.append((kind, a, b, 2, _features(text, a, b)))
            elif not shut.meets(a, b):
                out.append((kind, a, b, -1, _features(text, a, b)))
    if digit or "@" in text:
        covered = _Taken([(a, b) for _, a, b, _, _ in out])
        for m in _WORD.finditer(text):
            a, b = m.span()
            if _SIGN.search(text, a, b) and not covered.meets(a, b):
                out.append(("", a, b, 0, _features(text, a, b)))
    return out


_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
_SPAN = pa.struct([("k", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            counts: list[list[int]] = [[], [], [], []]
            digest, base, found = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans, failed = base_spans(text)
                for i, k in enumerate(KINDS[:4]):
                    counts[i].append(sum(s[0] == k for s in spans))
                digest.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
                base.append([{"k": order[k], "start": a, "stop": b} for k, a, b in spans])
                found.append([{"kind": k, "start": a, "stop": b, "label": y, "x": x} for k, a, b, y, x in _candidates(text, spans, failed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"],
            )


def find_personal_data(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added, n_secret) for every row of docs (doc_id, text).

    Offsets are code points, the end exclusive.  The counts and base_sha256 are of base spans; `spans`
    names all, as kind:start:end, by kind (email, ip, card, phone, secret) and start.  Null and empty
    texts have none.  Rows that repeat an id are searched one by one.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<k:int,start:int,stop:int>>, found array<struct<kind:string,start:int,stop:int,label:int,x:array<double>>>"
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_extract, schema).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "doc_id", F.explode("found").alias("c")).select("row", "doc_id", "c.*")
    each = each.withColumn("features", array_to_vector("x")).drop("x")
    known = each.where("label >= 0").withColumn("y", (F.col("label") > 0).cast("double"))
    bounded = known.orderBy(F.xxhash64("doc_id", "start", "stop"), "row").limit(sample)
    bounded = cut(bounded.select("y", "features", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0).alias("aside")).coalesce(2))
    fit = bounded.where("not aside")
    kinds = fit.agg(F.count_distinct("y")).first()[0]
    if kinds == 2:
        model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(fit)
        odds = lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1])
        limit = _calibrated(odds(bounded.where("aside")), precision)
        added = odds(each.where("label in (-1, 2)")).where(F.col("score") >= limit)
    else:  # nothing to learn from: only what is strict in form is added
        added = each.where("label = 2").withColumn("score", F.lit(1.0))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    added = added.select("row", number.alias("k"), "start", "stop", "score")
    # of a run of overlapping additions the likeliest stays
    order = W.partitionBy("row").orderBy("start", "stop", "k")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    added = added.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    best = F.max_by(F.struct("k", "start", "stop"), F.struct("score", -F.col("start"), -F.col("k"))).alias("s")
    lists = added.groupBy("row", "run").agg(best).groupBy(F.col("row").alias("_row")).agg(F.collect_list("s").alias("added"))
    out = rows.join(lists, F.col("row") == F.col("_row"), "left")
    named = F.array(*[F.lit(k) for k in KINDS])
    more = F.coalesce("added", F.array().cast("array<struct<k:int,start:int,stop:int>>"))
    every = F.array_sort(F.concat("base", more))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(named, s["k"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    secrets = F.size(F.filter(more, lambda s: s["k"] == KINDS.index("secret"))).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size(more).cast("long").alias("n_added"), secrets.alias("n_secret"))


def _calibrated(scored: DataFrame, precision: float) -> float:
    """The lowest score from which on the share of valid candidates is `precision`, on a grid of hundredths; at least 0.5."""
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    limit, good, n = 0.95, 0.0, 0
    for b in sorted(bins, key=lambda r: -r["bin"]):
        good, n = good + b["good"], n + b["n"]
        if b["bin"] < 50:
            break
        if good / n >= precision:
            limit = b["bin"] / 100
    return limit


def redact(text: str, spans: str) -> str:
    """text with each span of a `spans` value replaced by its kind in brackets."""
    out, last = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
            last = b
        else:
            last = max(last, b)
    return "".join([*out, text[last:]])

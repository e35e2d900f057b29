"""Personal data by weak supervision (operator 4).

Patterns propose spans: strict ones, which are always kept, and loose ones (spelled-out mail addresses, phone numbers without a
plus, long addresses of hosts, numbers of card length that fail the check digit, assigned secrets). Four labelers vote on each span: its form, a
check of its content, the words before it, and a gazetteer. Votes are counted over all texts; expectation-maximisation
estimates how reliable each labeler is for each kind, and the resulting soft labels train a logistic span classifier that
decides on the loose spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import slices

#: Kinds in the order of the results, patterns and bounds of the strict spans.
KINDS = ["email", "ip", "card", "phone", "secret"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose patterns.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_SECRET = re.compile(r"(?i:api[_-]?key|access[_-]?token|token|secret|password|passwd)[\"']? {0,3}[=:] {0,3}[\"']?([A-Za-z0-9+/_-]{16,128})(?![A-Za-z0-9+/_-])")

# Words of the labelers, lower case.
_HINTS = {
    "email": ["mail", "contact", "write", "reply"],
    "ip": ["ip", "host", "server", "address", "login"],
    "card": ["card", "visa", "credit", "payment", "account"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "contact"],
    "secret": ["key", "secret", "token", "password"],
}
_AGAINST = ["version", "isbn", "issn", "order", "invoice", "serial", "build", "release", "chapter", "section"]
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us ch at it nl".split())
_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
BEFORE = 40
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strict patterns, leftmost and without overlap in each kind. Linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, 0, last))
        at = text.find("@", max(last, at + 1))
    for m in _DOTTED.finditer(text):
        parts, place = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = place + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                out.append((place, 1, end))
            place = end + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def loose_spans(text: str, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the loose patterns that overlap no strict span nor an earlier loose one."""
    found = []
    if "at)" in text or "at]" in text:
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if ":" in text:
        found += [(m.start(), 1, m.end()) for m in _LONG_IP.finditer(text)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and not luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    out, free, i = [], 0, 0
    for start, kind, end in sorted(found):
        while i < len(strict) and strict[i][2] <= start:
            i += 1
        j = i  # strict spans from here on may reach over the start
        while j < len(strict) and strict[j][0] < end and strict[j][2] <= start:
            j += 1
        if start >= free and (j == len(strict) or strict[j][0] >= end):
            out.append((start, kind, end))
            free = end
    return out


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    """For, against or no vote (1, -1, 0) of the labelers form, content, context and gazetteer, then three features of the span."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if c.isdigit())
    words = _WORD.findall(text[max(0, start - BEFORE) : start].lower())
    context = -1 if any(w in _AGAINST for w in words[-3:]) else int(any(w in _HINTS[name] for w in words))
    content = gazetteer = 0
    if name == "email":
        ending = re.split(r"[^a-z0-9-]+", span.lower())[-1]
        content, gazetteer = 1 if ending.isalpha() and len(ending) > 1 else -1, 1 if ending in _ENDINGS else 0
    elif name == "ip":
        content, gazetteer = (1 if len(digits) > 5 else -1, -1 if span.startswith(("0.", "255.", "127.")) else 0)
    elif name == "card":
        content, gazetteer = 1 if luhn(digits) else -1, 1 if digits[:1] in "3456" and 13 <= len(digits) <= 16 else -1
    elif name == "phone":
        content, gazetteer = 1 if 9 <= len(digits) <= 15 else -1, 1 if strict and digits.startswith(_CODES) else 0
    else:
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        content, gazetteer = 1 if mixed else -1, 1 if len(set(span)) > len(span) // 4 else -1
    gazetteer = -1 if len(digits) > 5 and len(set(digits)) == 1 else gazetteer
    return (int(strict), content, context, gazetteer, min(3, len(span) // 8), int(any(not c.isalnum() for c in span)), int(start == 0 or not text[start - 1].isalnum()))


def _spans(text: str) -> Iterator[tuple[int, int, int, bool]]:
    strict = strict_spans(text)
    yield from ((*s, True) for s in strict)
    yield from ((*s, False) for s in loose_spans(text, strict))


@dataclass
class SpanModel:
    """Reliabilities (kind, class, labeler, vote + 1), and weights of the span classifier per kind."""

    reliability: np.ndarray
    weights: np.ndarray

    def score(self, kind: int, vote: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-(_features(np.array([vote])) @ self.weights[kind])[0])))


def _features(v: np.ndarray) -> np.ndarray:
    """Each labeler's votes for and against, the length class, the two features, and a constant."""
    return np.concatenate([v[:, :4] == 1, v[:, :4] == -1, v[:, 4:5] / 3, v[:, 5:7], np.ones((len(v), 1))], 1).astype(float)


def estimate(counts: list[tuple[int, tuple[int, ...], int]], steps: int = 50) -> SpanModel:
    """EM over counted votes (kind, votes and features, number of spans), then a logistic regression on its soft labels.

    The number of different vote patterns is bounded, whatever the corpus. The start believes each labeler in four of five cases; a kind
    without spans keeps that.
    """
    reliability = np.zeros((len(KINDS), 2, 4, 3))
    reliability[:, 1] = [0.15, 0.25, 0.6]
    reliability[:, 0] = [0.6, 0.25, 0.15]
    weights = np.zeros((len(KINDS), 12))
    for kind in range(len(KINDS)):
        own = sorted((v, n) for k, v, n in counts if k == kind)
        v, n = np.array([x for x, _ in own]).reshape(-1, 7), np.array([x for _, x in own], float)
        share, soft = 0.5, np.full(len(n), 0.5)
        for _ in range(steps if len(own) else 0):
            log = [np.log(p) + sum(np.log(reliability[kind, c, j, v[:, j] + 1]) for j in range(4)) for c, p in ((0, 1 - share), (1, share))]
            soft = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            share = float(np.clip((soft @ n + 1) / (n.sum() + 2), 0.05, 0.95))
            for c, weight in ((0, (1 - soft) * n), (1, soft * n)):
                for j in range(4):
                    # ten spans' worth of the first belief keep a labeler from turning round on little evidence
                    prior = np.array([0.15, 0.25, 0.6] if c else [0.6, 0.25, 0.15]) * 10
                    seen = np.bincount(v[:, j] + 1, weight, 3) + prior
                    reliability[kind, c, j] = seen / seen.sum()
        x, w = _features(v) if len(own) else np.zeros((0, 12)), weights[kind]
        for _ in range(30 if len(own) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(12)
            w = w + np.linalg.solve(curve, x.T @ (n * (soft - p)) - w)
        weights[kind] = w
    return SpanModel(reliability, weights)


def fit_spans(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count the votes on the spans of all texts; only the counts of different vote patterns reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                seen.update((k, votes(t, s, k, e, strict)) for s, k, e, strict in _spans(t or ""))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([list(v) for _, v in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "kind int, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return estimate([(r.kind, tuple(r.votes), r.n) for r in rows.collect()])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("strict", T.BooleanType()), T.StructField("score", T.DoubleType())]))


def find_personal_data(docs: DataFrame, model: SpanModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Add ``spans`` (kind, start, end in code points, strict, score) in order of start and kind to every row.

    Strict spans always stay; loose ones need a score of ``threshold``. Null and empty texts have none. A column called ``spans`` is
    replaced, others stay; rows are independent of each other.
    """
    kept = docs.drop("spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        for batch in slices(batches, text):
            rows = []
            for t in batch.column(text).to_pylist():
                own = []
                for s, k, e, strict in _spans(t or ""):
                    vote = votes(t, s, k, e, strict)
                    score = known.get((k, vote))
                    if score is None:
                        score = known[k, vote] = model.score(k, vote)
                    if strict or score >= threshold:
                        own.append((s, k, e, strict, score))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "strict": strict, "score": score} for s, k, e, strict, score in sorted(own)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "spans"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("spans", SPAN)]))

"""Personal data: base patterns plus a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.common import refuse_clash

#: Fixed values of the base rules.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[\s\S]")
_DIGITS = re.compile(r"[0-9]+")
#: Hints closer than this are one region; a region reaches this far beyond its hints (characters).
GAP, MARGIN = 24, 40
#: Longer regions are decoded in overlapping windows of this many characters.
WINDOW, OVERLAP = 2400, 400
#: Longest entity, in tokens.
MAX_TOKENS = 24
BUCKETS = 4096

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[Span]:
    """Matches of the base rules by kind, then start; code points, end exclusive."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity: around digits and at signs. An entity holds one of them."""
    out: list[list[int]] = []
    for m in _HINT.finditer(text):
        if out and m.start() - out[-1][1] <= GAP:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    spans: list[tuple[int, int]] = []
    for s, e in out:
        s, e = max(0, s - MARGIN), min(len(text), e + MARGIN)
        if spans and s < spans[-1][1]:
            spans[-1] = (spans[-1][0], e)
        else:
            spans.append((s, e))
    return spans


def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % BUCKETS


def _side(c: str) -> str:
    return "-" if not c else "d" if c in "0123456789" else "a" if c.isalpha() else "s" if c.isspace() else c


class SpanFeatures(dict):
    """Feature buckets of a candidate span, by ``(text before, span, text after)`` of one character."""

    def __missing__(self, key: tuple[str, str, str]) -> np.ndarray:
        before, s, after = key
        d = _digits(s)
        groups = _DIGITS.findall(s)
        shape = re.sub(r"[A-Za-z]+", "a", _DIGITS.sub("9", s))
        marks = "".join(sorted({c for c in s if not c.isalnum()}))
        names = [
            "bias", f"digits={min(len(d), 20)}", f"groups={min(len(groups), 6)}", f"shape={shape[:24]}", f"marks={marks}",
            f"first={_side(s[0])}", f"last={_side(s[-1])}", f"before={_side(before)}", f"after={_side(after)}",
            f"luhn={13 <= len(d) <= 19 and luhn(d)}:{marks}", f"sizes={','.join(str(len(g)) for g in groups[:6])}",
            f"quad={len(groups) == 4 and marks == '.' and all(len(g) < 4 and int(g) < 256 for g in groups)}",
            f"at={min(s.count('@'), 2)}:{'.' in s.rpartition('@')[2]}", f"letters={any(c.isalpha() for c in s)}",
            f"cut={_side(before)}{_side(s[0])}|{_side(s[-1])}{_side(after)}",
        ]
        out = np.array([_bucket(f"{i}:{n}") for i, n in enumerate(names)])
        if len(self) < 200_000:
            self[key] = out
        return out


class Lattice:
    """Candidate segments of one region: ends of tokens, spans with features, and outside tokens."""

    def __init__(self, text: str, start: int, end: int, features: SpanFeatures):
        marks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.n, self.start = len(marks), start
        self.begin = [s for s, _ in marks] + [end]
        hint = [text[s] in "0123456789@" for s, _ in marks]
        blank = [text[s].isspace() for s, _ in marks]
        self.outside = np.array([[_bucket(f"o{_side(text[s])}"), _bucket(f"o{_side(text[s])}{min(e - s, 6)}")] for s, e in marks]).reshape(-1, 2)
        spans, feats = [], []
        for i in range(self.n):
            if blank[i]:
                continue
            seen = False
            for j in range(i, min(self.n, i + MAX_TOKENS)):
                if text[marks[j][0]] in "\n\r" or (blank[j] and j + 1 < self.n and blank[j + 1]):
                    break
                seen |= hint[j]
                if seen and not blank[j]:
                    s, e = marks[i][0], marks[j][1]
                    spans.append((i, j + 1))
                    feats.append(features[text[s - 1 : s] if s else "", text[s:e], text[e : e + 1]])
        self.spans = np.array(spans, np.int64).reshape(-1, 2)
        self.feats = np.array(feats, np.int64).reshape(len(spans), -1 if spans else 0)
        order = np.argsort(self.spans[:, 1], kind="stable")
        self.spans, self.feats = self.spans[order], self.feats[order]
        self.at_end = np.searchsorted(self.spans[:, 1], np.arange(self.n + 2))

    def scores(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = w[:-1][:, self.feats].sum(axis=2) if len(self.spans) else np.zeros((len(w) - 1, 0))
        return inside, w[-1][self.outside].sum(axis=1)

    def best(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """Viterbi: the best joint choice of boundaries and types, as ``(kind, start, end)``."""
        inside, outside = self.scores(w)
        top, kind = (inside.max(axis=0), inside.argmax(axis=0)) if len(self.spans) else (np.zeros(0), None)
        value, back = np.zeros(self.n + 1), np.full(self.n + 1, -1)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1] + outside[j - 1]
            a, b = self.at_end[j], self.at_end[j + 1]
            if b > a:
                c = value[self.spans[a:b, 0]] + top[a:b]
                k = int(c.argmax())
                if c[k] > value[j]:
                    value[j], back[j] = c[k], a + k
        out, j = [], self.n
        while j > 0:
            k = back[j]
            if k >= 0:
                i = self.spans[k, 0]
                out.append((int(kind[k]), self.begin[i], self._end(j)))
                j = i
            else:
                j -= 1
        return out[::-1]

    def _end(self, j: int) -> int:
        return self.begin[j]

    def gradient(self, w: np.ndarray, gold: list[tuple[int, int, int]], grad: np.ndarray) -> None:
        """Add the gradient of the log-likelihood of ``gold`` (forward-backward over segmentations)."""
        inside, outside = self.scores(w)
        kinds = len(w) - 1
        both = np.logaddexp.reduce(inside, axis=0) if len(self.spans) else np.zeros(0)
        fwd, bwd = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        fwd[0] = bwd[self.n] = 0.0
        for j in range(1, self.n + 1):
            a, b = self.at_end[j], self.at_end[j + 1]
            c = np.append(fwd[self.spans[a:b, 0]] + both[a:b], fwd[j - 1] + outside[j - 1])
            m = c.max()
            fwd[j] = m + np.log(np.exp(c - m).sum())
        by_start = np.argsort(self.spans[:, 0], kind="stable")
        first = np.searchsorted(self.spans[by_start, 0], np.arange(self.n + 1))
        for i in range(self.n - 1, -1, -1):
            k = by_start[first[i] : first[i + 1]]
            c = np.append(bwd[self.spans[k, 1]] + both[k], bwd[i + 1] + outside[i])
            m = c.max()
            bwd[i] = m + np.log(np.exp(c - m).sum())
        total = fwd[self.n]
        p_out = np.exp(fwd[:-1] + outside + bwd[1:] - total)
        inside_gold = np.zeros(self.n, bool)
        index = {(int(i), int(j)): k for k, (i, j) in enumerate(self.spans)}
        where = {b: i for i, b in enumerate(self.begin)}
        for kind, s, e in gold:
            i, j = where.get(s), where.get(e)
            k = index.get((i, j)) if i is not None and j is not None else None
            if k is not None and not inside_gold[i:j].any():
                inside_gold[i:j] = True
                np.add.at(grad[kind], self.feats[k], 1.0)
        np.add.at(grad[-1], self.outside.ravel(), np.repeat((~inside_gold) - p_out, 2))
        if len(self.spans):
            p = np.exp(inside + (fwd[self.spans[:, 0]] + bwd[self.spans[:, 1]] - total))
            for y in range(kinds):
                np.add.at(grad[y], self.feats.ravel(), -np.repeat(p[y], self.feats.shape[1]))


def train(texts: list[str], epochs: int = 12, rate: float = 0.15, penalty: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights ``(kinds + outside, buckets)`` from regions whose base spans are the labels (Adagrad)."""
    features = SpanFeatures()
    data = []
    for t in texts:
        gold = sorted(((KINDS.index(k), s, e) for k, s, e in base_spans(t)), key=lambda x: (x[1], -x[2]))
        data.append((Lattice(t, 0, len(t), features), gold))
    w = np.zeros((len(KINDS) + 1, BUCKETS))
    w[:-1, _bucket("0:bias")] = -4.0
    past = np.full_like(w, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(data)), max(1, len(data) // 16)):
            grad = -penalty * w
            for k in batch:
                data[k][0].gradient(w, data[k][1], grad)
            past += grad * grad
            w += rate * grad / np.sqrt(past)
    return w


def training_regions(docs: DataFrame, text_col: str = "text", train_docs: int = 4000, train_regions: int = 1500) -> list[str]:
    """A bounded sample: regions of about ``train_docs`` documents, at most ``train_regions`` short ones."""
    total = docs.count()
    share = min(1.0, train_docs / max(1, total))
    if share < 1:
        docs = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(share * (1 << 20)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [t[s:e] for t in b["text"] for s, e in regions(t) if e - s <= 300]
            if found:
                yield pd.DataFrame({"region": pd.Series(found, dtype=object)})

    found = (docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
             .mapInPandas(cut, "region string").distinct())
    return sorted(r[0] for r in found.orderBy(F.xxhash64("region"), "region").limit(train_regions).collect())


def find_spans(text: str | None, w: np.ndarray | None, features: SpanFeatures) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that the model adds (those that overlap no base span)."""
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    if w is not None:
        taken = sorted((x, y) for _, x, y in base)
        starts = [x for x, _ in taken]
        ends = list(accumulate((y for _, y in taken), max))
        last = 0
        for s, e in regions(text):
            for at in range(s, max(s + 1, e - OVERLAP), WINDOW - OVERLAP):
                # of an overlap, the first window gives the spans that start in its first half
                low = at + OVERLAP // 2 if at > s else s
                high = at + WINDOW - OVERLAP // 2 if at + WINDOW < e else e
                for kind, a, b in Lattice(text, at, min(e, at + WINDOW), features).best(w):
                    k = bisect_left(starts, b)  # base spans that start before its end
                    if low <= a < high and a >= last and (not k or ends[k - 1] <= a):
                        added.append((KINDS[kind], a, b))
                        last = b
    return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each (merged) span replaced by its kind in angle brackets."""
    out, last = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{k}>"]
        last = max(last, e)
    return "".join([*out, text[last:]]) if spans else text


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 4000,
                  train_regions: int = 1500, keep: tuple[str, ...] = (), with_redacted: bool = False) -> DataFrame:
    """``doc_id, base, added`` (arrays of ``kind, start, end``; code points, end exclusive), the columns
    named in ``keep`` and, on request, ``redacted`` text.

    The base rules run over every whole text. A semi-Markov CRF is trained on a sample bounded by
    ``train_docs`` and ``train_regions``, with the base spans as labels: features of a whole candidate
    span (digit groups, shape, checksum, both edges) score it under each kind, and dynamic programming
    over segmentations, with entities of at most ``MAX_TOKENS`` tokens, chooses boundaries and kinds
    jointly. The model's spans that overlap no base span are added. One pass, no shuffle of texts;
    tasks hold one region's lattice at a time.

    Null or empty text: no span. Null or repeated ``doc_id``: each row on its own. An empty table
    gives no row (and no training). Other columns are not read unless kept.
    """
    refuse_clash(keep, "base", "added", "base_joined", "added_joined", "joined", "redacted")
    sample = training_regions(docs, text_col, train_docs, train_regions)
    weights = docs.sparkSession.sparkContext.broadcast(train(sample) if sample else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, features = weights.value, SpanFeatures()
        for b in batches:
            found = [find_spans(t, w, features) for t in b["text"]]
            out = (b if "text" in keep else b.drop(columns="text")).copy()
            out["base_joined"] = pd.Series([_joined(x) for x, _ in found], index=b.index, dtype=object)
            out["added_joined"] = pd.Series([_joined(y) for _, y in found], index=b.index, dtype=object)
            out["joined"] = pd.Series([_joined(x + y) for x, y in found], index=b.index, dtype=object)
            if with_redacted:
                out["redacted"] = pd.Series([redact(t, x + y) for t, (x, y) in zip(b["text"], found, strict=True)], index=b.index, dtype=object)
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c for c in keep if c not in ("doc_id", "text")])
    names = ["base_joined", "added_joined", "joined", *(["redacted"] if with_redacted else [])]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text" or "text" in keep), *(T.StructField(n, T.StringType()) for n in names)])
    return rows.mapInPandas(run, schema).withColumns({"base": _parsed("base_joined"), "added": _parsed("added_joined")}).drop("added_joined")


def _parsed(column: str):
    """``kind:start:end`` joined by commas as an array of structs."""
    part = lambda s, i: F.element_at(F.split(s, ":"), i)
    return F.transform(F.filter(F.split(column, ","), lambda s: s != ""), lambda s: F.struct(
        part(s, 1).alias("kind"), part(s, 2).cast("long").alias("start"), part(s, 3).cast("long").alias("end")))


def report(found: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2("base_joined", 256).alias("base_sha256"), F.col("joined").alias("spans"))

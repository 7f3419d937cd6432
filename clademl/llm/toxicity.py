"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.common import refuse_clash
from clademl.llm.decontaminate import words

WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 12, 8, 8
CHAR_BUCKETS = 4096
#: Windows of so many words, one every ``STRIDE``; all windows of a text are scored.
WINDOW, STRIDE = 64, 48
FOLDS = 5
THRESHOLD = 0.7


@dataclass
class Model:
    """Weights by name, the word vocabulary (row 0: any other word), the smoothed log odds of its words
    among toxic texts, and the calibration of a text's score."""

    vocab: dict[bytes, int]
    odds: np.ndarray
    w: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, vocab: dict[bytes, int], odds: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM + 1, HIDDEN
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        w = {"word": normal(len(vocab) + 1, WORD_DIM, by=0.05), "char": normal(CHAR_BUCKETS, CHAR_DIM, by=0.1),
             "att": normal(ATTEND, 2 * h, by=0.3), "att_b": np.zeros(ATTEND, np.float32), "att_v": normal(ATTEND, by=0.3),
             "out": normal(2 * h, by=0.3), "out_b": np.full(1, -2.0, np.float32)}
        for side in "fb":
            w |= {f"x{side}": normal(d, 3 * h, by=0.3), f"b{side}": np.zeros(3 * h, np.float32), f"u{side}": normal(3 * h, h, by=0.3)}
        return cls(vocab, odds, w)


def char_buckets(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the words with marked ends: flat buckets and the first of each word."""
    joined = np.frombuffer(b"\x02" + b"\x03\x02".join(ws) + b"\x03", np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in ws], np.int64)
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(2 * np.arange(len(ws)), sizes)
    code = joined[at] << np.uint32(16) | joined[at + 1] << np.uint32(8) | joined[at + 2]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), first


def word_inputs(model: Model, ws: list[bytes], known: np.ndarray | None = None) -> np.ndarray:
    """Word embedding, mean character-trigram embedding and log odds of each distinct word."""
    known = np.fromiter((model.vocab.get(w, 0) for w in ws), np.int64, len(ws)) if known is None else known
    flat, first = char_buckets(ws)
    sizes = np.diff(np.append(first, len(flat)))
    chars = np.add.reduceat(model.w["char"][flat], first, axis=0) / sizes[:, None].astype(np.float32)
    return np.concatenate((model.w["word"][known], chars, model.odds[known, None]), axis=1)


def log_odds(docs: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds ``(size,)`` of each word in toxic against other texts, by texts that hold it."""
    count = np.zeros((2, size))
    for d, y in zip(docs, labels, strict=True):
        count[int(y), d] += 1
    share = (count + 0.5) / (np.array([[(labels == 0).sum()], [(labels == 1).sum()]]) + 1)
    return np.where(count.sum(axis=0) < 3, 0, np.log(share[1] / share[0])).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, backward: bool, trace: list | None = None) -> np.ndarray:
    """States ``(time, hidden, batch)`` from gate inputs ``(time, 3 * hidden, batch)``."""
    steps, h = x.shape[0], HIDDEN
    out = np.empty((steps, h, x.shape[2]), np.float32)
    state = np.zeros((h, x.shape[2]), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        g = u @ state
        zr = _sigmoid(x[t, : 2 * h] + g[: 2 * h])
        z, r = zr[:h], zr[h:]
        n = np.tanh(x[t, 2 * h :] + r * g[2 * h :])
        new = n + z * (state - n)
        new *= mask[t]
        if trace is not None:
            trace.append((t, state, z, r, n, g[2 * h :]))
        out[t] = state = new
    return out


def forward(model: Model, table: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logits of windows: ``ids`` ``(batch, time)`` are rows of the gate-input tables ``table``."""
    steps = ids.shape[1]
    mask = (np.arange(steps)[:, None] < sizes).astype(np.float32)
    states, kept = [], {}
    for side in "fb":
        x = np.ascontiguousarray(table[side][ids.T].transpose(0, 2, 1))
        kept[side] = [] if trace is not None else None
        states.append(_gru(x, model.w[f"u{side}"], mask, side == "b", kept[side]))
    both = np.concatenate(states, axis=1)
    att = np.tanh(np.matmul(model.w["att"], both) + model.w["att_b"][:, None])
    e = np.matmul(model.w["att_v"], att) + np.where(mask > 0, 0.0, -1e9).astype(np.float32)
    a = np.exp(e - e.max(axis=0))
    a *= mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = (both * a[:, None]).sum(axis=0)
    if trace is not None:
        trace.update(mask=mask, both=both, att=att, a=a, pooled=pooled, gru=kept)
    return model.w["out"] @ pooled + model.w["out_b"]


def backward(model: Model, tr: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Gradients of the weights, and of the gate inputs ``(time, 3 * hidden, batch)`` of each direction."""
    w, h = model.w, HIDDEN
    g = {"out": tr["pooled"] @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_pooled = w["out"][:, None] * d_logit
    d_both = tr["a"][:, None] * d_pooled
    d_a = (tr["both"] * d_pooled).sum(axis=1)
    d_e = tr["a"] * (d_a - (tr["a"] * d_a).sum(axis=0))
    g["att_v"] = np.einsum("tb,tab->a", d_e, tr["att"])
    d_pre = w["att_v"][:, None] * d_e[:, None] * (1 - tr["att"] ** 2)
    g["att"], g["att_b"] = np.einsum("tab,thb->ah", d_pre, tr["both"]), d_pre.sum(axis=(0, 2))
    d_both += np.matmul(w["att"].T, d_pre)
    d_x = {}
    for k, side in enumerate("fb"):
        u = w[f"u{side}"]
        d_states, d_u = d_both[:, k * h : (k + 1) * h], np.zeros_like(u)
        d_x[side] = np.empty((len(d_both), 3 * h, d_logit.shape[0]), np.float32)
        carry = np.zeros((h, d_logit.shape[0]), np.float32)
        for t, prev, z, r, n, un in reversed(tr["gru"][side]):
            d = (d_states[t] + carry) * tr["mask"][t]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (prev - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            d_x[side][t] = np.concatenate((dz, dr, dn))
            gates = np.concatenate((dz, dr, dn * r))
            d_u += gates @ prev.T
            carry = d * z + u.T @ gates
        g[f"u{side}"] = d_u
    return g, d_x


def gate_tables(model: Model, inputs: np.ndarray) -> dict[str, np.ndarray]:
    """Gate inputs of each distinct word, with a last row of zeros for padding."""
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    return {s: np.concatenate(((inputs @ model.w[f"x{s}"] + model.w[f"b{s}"]).astype(np.float32), pad)) for s in "fb"}


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and size of every window; a text of ``n`` words has one per ``STRIDE`` until its end."""
    count = np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // STRIDE), 1)
    doc = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, start, np.minimum(sizes[doc] - start, WINDOW)


class Scorer:
    """Scores batches of texts; keeps gate inputs of the words met so far, up to ``limit`` of them."""

    def __init__(self, model: Model, limit: int = 200_000, batch: int = 1536):
        self.model, self.limit, self.batch = model, limit, batch
        self.rows: dict[bytes, int] = {}
        self.table = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def _ids(self, ws: list[bytes]) -> np.ndarray:
        """Rows of the words. New words are added; the memo starts anew when it is full."""
        new = [w for w in set(ws) if w not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.limit and self.rows:
                self.rows, self.table = {}, {s: t[:0] for s, t in self.table.items()}
                new = list(set(ws))
            fresh = gate_tables(self.model, word_inputs(self.model, new))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.table = {s: np.concatenate((self.table[s], fresh[s][:-1])) for s in "fb"}
        return np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        out = np.empty(len(texts), np.float32)
        held: list[list[bytes]] = []
        size = first = 0
        for i, t in enumerate(texts):
            held.append(words(t))
            size += len(held[-1])
            if size > 400_000 or i == len(texts) - 1:
                out[first : i + 1] = self._group(held)
                held, size, first = [], 0, i + 1
        return out

    def _group(self, docs: list[list[bytes]]) -> np.ndarray:
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = self._ids([w for d in docs for w in d])
        table = {s: np.concatenate((t, np.zeros((1, 3 * HIDDEN), np.float32))) for s, t in self.table.items()}
        pad = len(table["f"]) - 1
        doc, start, length = windows(sizes)
        at = (np.cumsum(sizes) - sizes)[doc] + start
        ids = np.append(ids, pad)
        best = np.full(len(docs), -np.inf, np.float32)
        order = np.argsort(length, kind="stable")
        for k in range(0, len(order), self.batch):
            part = order[k : k + self.batch]
            steps = np.arange(max(1, int(length[part].max())))
            place = np.where(steps < length[part, None], at[part, None] + steps, len(ids) - 1)
            np.maximum.at(best, doc[part], forward(self.model, table, ids[place], length[part]))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.model.scale
        return 1 / (1 + np.exp(-(a * self.logits(texts).astype(np.float64) + b)))


def train(texts: list[str | None], labels: np.ndarray, steps: int = 200, rate: float = 0.01, seed: int = 11,
          max_vocab: int = 20_000, batch: int = 256) -> Model:
    """Fit on labelled texts. A text is as toxic as its most toxic window: the first epochs give all
    windows the label of their text, later ones train the windows that score highest. There are at
    least ``steps`` steps and at least 14 epochs. A fifth of the texts is kept aside to calibrate the score (logistic regression on the largest logit)."""
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = [np.fromiter((index.setdefault(w, len(index)) for w in words(t)), np.int32) for t in texts]
    all_words = list(index)
    seen = np.zeros(len(all_words), np.int64)
    for d in docs:
        seen[np.unique(d)] += 1
    common = [all_words[i] for i in np.lexsort((np.arange(len(seen)), -seen)) if seen[i] >= 4][:max_vocab]
    vocab = {w: i + 1 for i, w in enumerate(common)}
    if not len(labels) or labels.min() == labels.max():
        return Model.fresh(vocab, np.zeros(len(vocab) + 1, np.float32), seed)
    aside = rng.random(len(docs)) < 0.2
    use = np.flatnonzero(~aside)
    known = np.fromiter((vocab.get(w, 0) for w in all_words), np.int64, len(all_words))
    bags = [np.setdiff1d(known[docs[i]], [0]) for i in use]
    model = Model.fresh(vocab, log_odds(bags, labels[use], len(vocab) + 1), seed)
    fold = rng.integers(0, FOLDS, len(use))  # a training text meets odds from the other folds only
    others = [np.flatnonzero(fold != f) for f in range(FOLDS)]
    odds = np.stack([log_odds([bags[i] for i in o], labels[use[o]], len(vocab) + 1) for o in others])
    flat, first = char_buckets(all_words)
    char_sizes = np.diff(np.append(first, len(flat)))
    sizes = np.array([len(docs[i]) for i in use], np.int64)
    ids = np.concatenate([docs[i] for i in use]).astype(np.int64)
    pad = len(all_words)
    ids = np.append(ids, pad)
    doc, start, length = windows(sizes)
    at = (np.cumsum(sizes) - sizes)[doc] + start
    label = labels[use].astype(np.float32)
    weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3)).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    step = epoch = 0
    rows_rate = min(1.0, float(label.sum()) / 1000)  # rows of the embeddings see few toxic texts each
    batch = int(np.clip(len(use) / 12, 32, batch))
    while epoch < 14 or step < steps:
        epoch += 1
        if epoch <= 4 or step < 0.3 * steps:
            chosen = rng.permutation(len(doc))
            chosen = chosen[np.argsort(doc[chosen], kind="stable")]
            rank = np.arange(len(chosen)) - np.searchsorted(doc[chosen], doc[chosen])
            chosen = chosen[rank < 4]
        else:
            table = gate_tables(model, word_inputs(model, all_words, known))
            score = np.concatenate([forward(model, table, ids[np.where(np.arange(WINDOW) < length[p, None], at[p, None] + np.arange(WINDOW), len(ids) - 1)], length[p])
                                    for p in np.array_split(np.arange(len(doc)), max(1, len(doc) // 512))])
            order = np.lexsort((-score, doc))
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            chosen = order[rank < np.where(label[doc[order]] > 0, 1, 2)]
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
            step += 1
            place = np.where(np.arange(WINDOW) < length[part, None], at[part, None] + np.arange(WINDOW), len(ids) - 1)
            both = np.where(ids[place] == pad, pad * FOLDS, ids[place] * FOLDS + fold[doc[part]][:, None])
            ws, local = np.unique(both, return_inverse=True)
            local = local.reshape(place.shape)
            ws = ws[ws < pad * FOLDS]
            real = ws // FOLDS
            dropped = np.where(rng.random(len(real)) < 0.3, 0, known[real])
            char_at = np.repeat(first[real], char_sizes[real]) + _within(char_sizes[real])
            chars = np.add.reduceat(model.w["char"][flat[char_at]], np.cumsum(char_sizes[real]) - char_sizes[real], axis=0) / char_sizes[real][:, None].astype(np.float32) if len(real) else np.zeros((0, CHAR_DIM), np.float32)
            inputs = np.concatenate((model.w["word"][dropped], chars, odds[ws % FOLDS, known[real]][:, None]), axis=1)
            table = gate_tables(model, inputs)
            local = np.where(ids[place] == pad, len(real), local)
            tr: dict = {}
            logit = forward(model, table, local, length[part], tr)
            y = label[doc[part]]
            d_logit = ((1 / (1 + np.exp(-logit)) - y) * weight[doc[part]] / len(part)).astype(np.float32)
            grad, d_x = backward(model, tr, d_logit)
            d_in = np.zeros_like(inputs)
            for s in "fb":
                rows = np.zeros((len(real) + 1, 3 * HIDDEN), np.float32)
                np.add.at(rows, local.T.ravel(), d_x[s].transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
                rows = rows[:-1]
                grad[f"x{s}"], grad[f"b{s}"] = inputs.T @ rows, rows.sum(axis=0)
                d_in += rows @ model.w[f"x{s}"].T
            grad["word"], grad["char"] = np.zeros_like(model.w["word"]), np.zeros_like(model.w["char"])
            np.add.at(grad["word"], dropped, d_in[:, :WORD_DIM])
            np.add.at(grad["char"], flat[char_at], np.repeat(d_in[:, WORD_DIM:-1] / char_sizes[real][:, None], char_sizes[real], axis=0))
            for k, v in model.w.items():
                m, s2 = moment[k]
                g = grad[k] + 1e-5 * v
                m += 0.1 * (g - m)
                s2 += 0.001 * (g * g - s2)
                v -= (rate * rows_rate if k in ("word", "char") else rate) * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(aside) if aside.any() and labels[aside].min() < labels[aside].max() else use
    model.scale = _calibrate(Scorer(model).logits([texts[i] for i in held]).astype(float), labels[held].astype(float))
    return model


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps on a convex loss with a small penalty
        p = 1 / (1 + np.exp(-(a * x + b)))
        q = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        hess = np.array([[(q * x * x).sum() + 0.1, (q * x).sum()], [(q * x).sum(), q.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 0.05)), float(b)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int) -> pd.DataFrame:
    """A bounded sample of labelled rows (``text``, ``toxic``), a third of it toxic if there are enough."""
    usable = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, train_docs / 3 / max(1, count.get(1, 0)))).otherwise(
        min(1.0, 2 * train_docs / 3 / max(1, count.get(0, 0))))
    ids = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * train_docs)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").limit(2 * train_docs)  # 16 bytes an id
    return found.select("doc_id", "text", "toxic").toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = 5000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, with the columns named in ``keep``.

    The network reads each window of 64 words (one every 48) in both directions; a word's input is
    its embedding and the mean embedding of its character trigrams; attention pools the states; a
    text's score is its largest window's, calibrated. It is trained on the driver on at most about
    ``train_docs`` labelled texts (a third toxic where possible), never on rows whose
    ``crc32(doc_id) mod 3`` is 1. Labels, lang, source and doc_id are no inputs. Scoring is one map
    over the documents: nothing is shuffled, and tasks hold a bounded memo of word inputs.

    Null, empty or wordless text: one empty window, so the score of the bias alone. Null ``doc_id``:
    ``held_out`` null, scored like any row. Repeated rows: each scored. Without labels of both kinds
    the network stays untrained. An empty table gives no row.
    """
    refuse_clash(keep, "held_out", "score", "predicted")
    sample = training_rows(docs, labels, train_docs)
    model = train(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = b if "text" in keep else b.drop(columns="text")
            yield out.assign(score=scorer.scores(b["text"].tolist()) if len(b) else np.zeros(0))

    rows = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text" or "text" in keep), T.StructField("score", T.DoubleType())])
    out = rows.mapInPandas(run, schema)
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "held_out", "score", "predicted")

"""Periodic runs of words: segments split at rare words until nothing splits, then a lag scan of what survives."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademl.llm.words import split_words, word_numbers

#: Fewest words of a run, and fewest times its period fits in it.
LEAST, TIMES = 12, 2


def surviving_segments(numbers: np.ndarray, edges: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """``(start, end)`` of the segments that may hold a run, for all texts of a batch at once.

    A run holds each of its words at least ``TIMES`` times, so a word that occurs less often in the segment it
    lies in belongs to no run there and splits it; the pieces have lower counts and are split again. Pieces of
    fewer than ``least`` words go, and pieces where nothing splits are done.
    """
    at = np.arange(len(numbers))
    seg = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    values, done = int(numbers.max(initial=0)) + 1, []
    while len(at):
        large = np.bincount(seg)[seg] >= least
        at, seg = at[large], seg[large]
        if not len(at):
            break
        _, which, count = np.unique(seg * values + numbers[at], return_inverse=True, return_counts=True)
        often = count[which] >= TIMES
        first = np.flatnonzero(np.concatenate(([True], np.diff(seg) != 0)))
        size = np.diff(np.append(first, len(seg)))
        stable = np.logical_and.reduceat(often, first)
        done += [(int(at[f]), int(at[f]) + int(n)) for f, n in zip(first[stable], size[stable], strict=True)]
        go_on = often & ~np.repeat(stable, size)
        at, seg = at[go_on], seg[go_on]
        seg = np.cumsum(np.concatenate(([0], (np.diff(at) != 1) | (np.diff(seg) != 0)))) if len(at) else seg
    return sorted(done)


def scan_lags(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a segment, by rising lag.

    A run of period ``q`` gives at least ``max(least - q, q)`` places in a row that equal the place ``q``
    later. Only every fourth part of that stretch is looked at; where four in a row are equal the stretch is
    compared whole and cut to its ends. A lag that is a multiple of the period of a run holds nothing new
    inside that run (a word of period ``kq`` that holds a power of a word of length ``q`` has period ``q``),
    so those places are left out, and what still touches them is no run of its own.
    """
    m, found, known = len(w), [], defaultdict(list)
    for q in range(1, m // TIMES + 1):
        need = max(least - q, (TIMES - 1) * q)
        step = max(1, need // 4)
        equal = w[: m - q : step] == w[q::step]
        for s, e in known.pop(q, ()):
            equal[-(-s // step) : -(-(e - q) // step)] = False
        if np.count_nonzero(equal) < need // step:
            continue
        turn = np.flatnonzero(np.diff(equal, prepend=False, append=False))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a < need // step:
                continue
            lo, hi = max(0, (a - 1) * step + 1), min(m - q, b * step)
            cut = np.flatnonzero(np.diff(w[lo:hi] == w[lo + q : hi + q], prepend=False, append=False)) + lo
            for s, t in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
                if t - s < need or (s and w[s - 1] == w[s - 1 + q]) or (t < m - q and w[t] == w[t + q]):
                    continue
                found.append((s, t - s + q, q))
                for k in range(2 * q, (t - s + q) // 2 + 1, q):
                    known[k].append((s, t + q))
    return found


def find_runs(numbers: np.ndarray, edges: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text its runs ``(start, length, period)``, words numbered from 0, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(edges) - 1)]
    for s, e in surviving_segments(numbers, edges, least):
        text = int(np.searchsorted(edges, s, side="right")) - 1
        out[text] += [(s - int(edges[text]) + a, n, q) for a, n, q in scan_lags(numbers[s:e], least)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words left when of every run only the first period stays."""
    mark = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        mark[s + q] += 1
        mark[s + n] -= 1
    return [w for w, k in zip(words, np.cumsum(mark[:-1]) > 0, strict=True) if not k] if runs else words


def copied_tails(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The fixed rule of the query's own copies: of every tenth document (by crc32 of its id) the words from
    some place on repeat with a period that fits at least three times."""
    h, n = zlib.crc32(doc_id.encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + j % p] for j in range(n - a)]


def periodic_runs(docs: DataFrame, prepare: Callable[[str | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed``: every run of a text.

    A run is a stretch of words between ASCII white space whose words ``q`` apart are identical, ``q`` being its
    smallest period, of at least ``max(least, 2 * q)`` words, that no neighbouring word extends. The four
    columns after ``n_runs`` are the longest run's (ties: smallest start, then period; null without a run),
    ``runs`` is all of them (an array of structs by start, then period) and ``collapsed`` the words left, joined by one space,
    when of each run only the first period stays. ``prepare(id as text, words)`` may change a text's words first.

    Rows are independent: no shuffle, whole texts, and a task holds one batch of texts. Null or empty text: no
    words, no run, empty ``collapsed``. Null ids, repeated rows: each row has its own result. An empty
    table gives no row. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [split_words(t) for t in b["text"]]
            if prepare is not None:
                texts = [prepare(i if isinstance(i, str) else None, ws) for i, ws in zip(b["id"], texts, strict=True)]
            found = find_runs(*word_numbers(texts), least)
            yield pd.DataFrame({
                "id": b["id"], "n_words": np.array([len(ws) for ws in texts], np.int64),
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found],
                "collapsed": [b" ".join(collapsed(ws, r)).decode() for ws, r in zip(texts, found, strict=True)]})

    one = "struct<start:long,length:long,period:long>"
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # text: a long beside a null would turn double
    out = rows.mapInPandas(run, f"id string, n_words long, runs array<{one}>, collapsed string")
    best = F.reduce("runs", F.lit(None).cast(one), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    out = out.withColumn("_best", best)
    return out.select(F.col("id").cast(kind).alias("doc_id"), "n_words", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length",
                      "_best.period", F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"), "runs", "collapsed")


def report(found: DataFrame) -> DataFrame:
    """Digests in place of the runs and the collapsed text."""
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                  r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(text, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")

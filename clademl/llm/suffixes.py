"""Repeated passages through sparse suffix arrays at content-selected minimiser positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademl.llm.common import stored
from clademl.llm.minhash import WordHashes, _mix

#: A passage has at least ``LENGTH`` words. Suffixes start at minimisers of ``GRAM``-word grams over
#: ``SPREAD`` grams in a row, so every ``LENGTH`` words hold a minimiser gram, at most ``SPREAD - 1`` words in.
LENGTH, GRAM = 50, 25
SPREAD = LENGTH - GRAM + 1
#: Larger groups of suffixes with one first gram are dealt out further.
GROUP = 20_000


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    ws = text.encode().lower().split() if text else []
    return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return _mix(out)


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Positions of the leftmost smallest of every ``SPREAD`` grams in a row."""
    if len(grams) < SPREAD:
        return np.zeros(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(grams, SPREAD).argmin(axis=1)
    return np.unique(best + np.arange(len(best)))


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sign(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for b in batches:
            hs = [word_hashes(t, memo) for t in b["text"]]
            grams = [gram_hashes(h, GRAM) for h in hs]
            at = [minimisers(g) for g in grams]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": np.array([len(h) for h in hs], np.int64), "words": [_digest(h) for h in hs],
                                "grams": [g[a].view(np.int64) for g, a in zip(grams, at, strict=True)], "at": [a.astype(np.int32) for a in at]})

    return rows.mapInPandas(run, "doc_id long, n_words long, words binary, grams array<long>, at array<int>")


def window_masks(first: np.ndarray, doc: np.ndarray, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray) -> np.ndarray:
    """For each suffix, bit ``l`` is set if the window that starts ``l`` words before it occurs in
    another document.

    Suffixes are sorted by their first gram and the words after it. Neighbours are compared once, and
    their common lengths cut the array into runs that share ``LENGTH - GRAM - l`` words more; within
    a run a suffix extends left over ``l`` words with every other one that has the same left words.
    """
    n, extra = len(first), SPREAD - 1
    same = right[1:] == right[:-1]
    common = np.minimum(np.where(same.all(axis=1), extra, same.argmin(axis=1)), np.minimum(right_len[1:], right_len[:-1]))
    common = np.where(first[1:] == first[:-1], common, -1)
    mask, back = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for l in range(extra + 1):
        if l:
            back = _mix(back * np.uint64(31) + left[:, l - 1].astype(np.uint64) + np.uint64(1))
        need = extra - l
        run = np.concatenate(([0], np.cumsum(common < need))).astype(np.uint64)
        ok = np.flatnonzero((right_len >= need) & (left_len >= l))
        if not len(ok):
            continue
        key = _mix(run[ok] * np.uint64(0xD6E8FEB86659FD93) + back[ok])
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        docs = doc[ok][order]
        many = np.minimum.reduceat(docs, edge) < np.maximum.reduceat(docs, edge)
        hit = np.repeat(many, np.diff(np.append(edge, len(order))))
        mask[ok[order[hit]]] |= 1 << l
    return mask


def _context(h: np.ndarray, p: int) -> tuple[bytes, bytes]:
    """Up to ``SPREAD - 1`` words after the gram at ``p``, and before it (nearest first), 32 bits each."""
    low = h.astype(np.uint32)
    return low[p + GRAM : p + LENGTH].tobytes(), low[max(0, p - SPREAD + 1) : p][::-1].tobytes()


def _matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    width = 4 * (SPREAD - 1)
    size = np.array([len(x) // 4 for x in column], np.int64)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), np.uint32).reshape(-1, SPREAD - 1), size


def _whole_groups(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Frames of many whole groups each, from rows sorted by ``by``."""
    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        cut = int(np.searchsorted(held[by].to_numpy(), held[by].iloc[-1])) if len(held) else 0
        if cut:
            yield held.iloc[:cut]
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def coverage(n: int, starts: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + LENGTH, -1)
    return np.cumsum(mark)[:n] > 0


def repeated_passages(docs: DataFrame, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_repeated, spans``: words that lie in a run of ``LENGTH`` words which occurs in
    another document too, and the merged passages as ``start:end`` in words (from 0, end exclusive).
    Words are those between ASCII white space with A-Z lower-cased.

    Texts of equal words collapse first (all their words are repeated if there are enough). Suffixes
    are kept at minimisers, each named by its first gram. Grams of two texts or more are found by
    aggregation; the words around their suffixes go to one task for each gram, which sorts them,
    compares neighbours and extends matches to both sides up to ``LENGTH`` words. Longer passages are
    the union of their windows. A gram with over ``group`` suffixes is matched exactly by aggregating
    window hashes instead, so no task holds an unbounded group.

    Null or empty text, or fewer than ``LENGTH`` words: nothing repeated. Null ``doc_id``: takes no
    part, nothing repeated. Rows that repeat an id with the same text are one document. An empty
    table gives no row. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(_sign(rows), "signed")
    classes = stored(signed.filter("doc_id is not null").filter(F.col("n_words") >= LENGTH).groupBy("words").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.min_by(F.struct("grams", "at"), "doc_id").alias("s")), "classes")
    suffixes = classes.select("low", F.explode(F.arrays_zip("s.grams", "s.at")).alias("x")).select("low", F.col("x.grams").alias("gram"), F.col("x.at").alias("at"))
    shared = (suffixes.groupBy("gram").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.count(F.lit(1)).alias("n"))
              .filter("a < b").select("gram", (F.col("n") > group).alias("hot")))
    places = (suffixes.join(shared.hint("shuffle_hash"), "gram").groupBy(F.col("low").alias("id"))
              .agg(F.collect_list(F.struct("at", "hot")).alias("places")))  # at most one entry a word of a text

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for b in batches:
            out = []
            for i, t, found in zip(b["doc_id"], b["text"], b["places"], strict=True):
                h = word_hashes(t, memo)
                grams, here = gram_hashes(h, GRAM).view(np.int64), {}
                for x in found:
                    p = int(x["at"])
                    if p < len(grams):  # else the place is of another text under the same id
                        here.setdefault((int(grams[p]), i, bool(x["hot"]), *_context(h, p)), []).append(p)
                out += [(*k, at) for k, at in here.items()]  # a text that repeats itself gives one row
            if out:
                yield pd.DataFrame(out, columns=["gram", "doc_id", "hot", "after", "before", "at"])

    around = stored(rows.join(places, F.col("doc_id") == F.col("id")).select("doc_id", "text", "places")
                    .mapInPandas(contexts, "gram long, doc_id long, hot boolean, after binary, before binary, at array<int>"), "contexts")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _whole_groups(batches, "key"):
            right, right_len = _matrix(g["after"])
            left, left_len = _matrix(g["before"])
            mask = window_masks(g["key"].to_numpy(), g["doc_id"].to_numpy(np.int64), right, right_len, left, left_len)
            hit = mask > 0
            if hit.any():
                yield pd.DataFrame({"doc_id": g["doc_id"][hit], "at": g["at"][hit], "mask": mask[hit]})

    half, words = SPREAD // 2, SPREAD - 1  # what two windows share beyond the gram is half on one side at least
    cold = around.filter(~F.col("hot")).withColumn("key", F.col("gram")).drop("hot", "gram")
    sides = around.filter("hot").select("*", F.explode(F.array(F.lit("after"), F.lit("before"))).alias("side"))
    text = F.when(F.col("side") == "after", F.col("after")).otherwise(F.col("before"))
    sides = (sides.filter(F.octet_length(text) >= 4 * half)
             .withColumn("key", F.xxhash64("gram", "side", F.substring(text, 1, 4 * half))))
    sizes = sides.groupBy("key").agg((F.count(F.lit(1)) > group).alias("large"))
    sides = sides.join(sizes, "key")
    dealt = cold.unionByName(sides.filter(~F.col("large")).select(*cold.columns))
    near = (dealt.repartition("key").sortWithinPartitions("key", "after").mapInPandas(match, "doc_id long, at array<int>, mask long"))

    whole = (sides.filter("large").select("gram", "doc_id", "after", "before", "at").distinct()
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(words))).alias("l"))
             .filter((F.octet_length("before") >= 4 * F.col("l")) & (F.octet_length("after") >= 4 * (words - F.col("l"))))
             .select("doc_id", "at", "l", F.xxhash64("gram", "l", F.substring("before", F.lit(1), 4 * F.col("l")),
                                                     F.substring("after", F.lit(1), 4 * (words - F.col("l")))).alias("window")))
    twice = whole.groupBy("window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("window")
    far = whole.join(twice, "window").select("doc_id", "at", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l")).alias("mask"))
    windows = near.unionByName(far)
    found = windows.groupBy(F.col("doc_id").alias("low")).agg(F.collect_list(F.struct("at", "mask")).alias("found"))
    by_class = classes.select("words", "low", (F.col("low") < F.col("top")).alias("copied")).join(found, "low", "left").drop("low")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count, spans = [], []
            for i, n, copied, found in zip(b["doc_id"], b["n_words"], b["copied"], b["found"], strict=True):
                hit = np.zeros(n, bool)
                if not pd.isna(i) and copied is not None and copied == True:  # noqa: E712  (a numpy bool or null)
                    hit[:] = True
                elif not pd.isna(i) and found is not None:
                    starts = [int(p) - l for x in found for l in range(SPREAD) if int(x["mask"]) >> l & 1 for p in x["at"]]
                    hit = coverage(n, np.array([s for s in starts if 0 <= s <= n - LENGTH], np.int64))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                count.append(int(hit.sum()))
                spans.append(",".join(f"{s}:{e}" for s, e in zip(edge[::2], edge[1::2], strict=True)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": b["n_words"], "n_repeated": np.array(count, np.int64), "spans": spans})

    return (signed.select("doc_id", "n_words", "words").join(by_class, "words", "left").select("doc_id", "n_words", "copied", "found")
            .mapInPandas(merge, "doc_id long, n_words long, n_repeated long, spans string"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
j AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g SEMI JOIN r USING (h)),
s AS (SELECT doc_id, min(j) AS a, max(j) + 1 AS b FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS k FROM j) GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)
"""

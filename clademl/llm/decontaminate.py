"""Benchmark decontamination: an FM-index per shard of training text, searched for item windows."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.common import refuse_clash
from clademl.llm.fm_index import FMIndex

#: Bytes of a word, after A-Z became a-z: digits, letters and every byte of a non-ASCII character.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of test items that the driver or a task holds at once.
PATTERN_BYTES = 64 * 1024 * 1024


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; none for null."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Phrases:
    """Distinct windows of the test items as symbol rows, grouped by width, with their items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, self.symbols = window, {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ws = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words(text)]
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                found.setdefault(tuple(ws[i : i + window]), set()).add(item)
        self.by_width: dict[int, tuple[np.ndarray, list[set]]] = {}
        for width in sorted({len(p) for p in found}):
            rows = [p for p in found if len(p) == width]
            self.by_width[width] = np.array(rows, np.int64), [found[p] for p in rows]
        self.shortest = min(self.by_width, default=0)


def _runs(symbols: np.ndarray, shortest: int) -> np.ndarray:
    """Mask of the positions in runs of at least ``shortest`` known words (only they can hold a window)."""
    known = symbols > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= shortest
    mask = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(mask, start[keep], 1)
    np.add.at(mask, end[keep], -1)
    return np.cumsum(mask)[:-1] > 0


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, np.ndarray, set]]:
    """For each text of one shard: its number of words, the mask of hit words, its items."""
    get = phrases.symbols.get
    sizes, parts = [], []
    for t in texts:
        ws = words(t)
        sizes.append(len(ws))
        parts.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
        parts.append(np.zeros(1, np.int64))  # documents never join
    everything = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    hit, items = np.zeros(len(everything) + 1, np.int64), [set() for _ in texts]
    if phrases.shortest and len(everything):
        mask = _runs(everything, phrases.shortest)
        mask[1:] |= mask[:-1] & (everything[1:] == 0)  # one separator after each run
        place = np.flatnonzero(mask)
        if len(place):
            index = FMIndex(everything[place], len(phrases.symbols))
            for width, (rows, owners) in phrases.by_width.items():
                lo, hi = index.search(rows)
                found = np.flatnonzero(hi > lo)
                count = (hi - lo)[found]
                if not len(found):
                    continue
                which = np.repeat(found, count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = place[index.locate(np.repeat(lo[found], count) + step)]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + width, -1)
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                    items[d] |= owners[p]
    covered = np.cumsum(hit) > 0
    return [(n, covered[s : s + n], i) for n, s, i in zip(sizes, starts, items, strict=False)]


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Removal spans in characters: from the first to the last word of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[s][0], "end": at[e - 1][1]} for s, e in zip(edge[::2], edge[1::2], strict=True)]


def without(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans cut out; the gap keeps the space or line around it."""
    if not spans:
        return text
    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1_000_000,
                  id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_cleaned: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, item_ids`` (as strings, sorted) and removal ``spans``
    (code points, end exclusive), with the columns of ``docs`` named in ``keep`` and, on request,
    the ``cleaned`` text without the spans.

    A window is ``window`` consecutive words of a test item, or the whole item if it is shorter. Each
    task cuts its rows into shards of about ``shard_words`` words (a longer document is a shard of
    its own). A shard's words become symbols of the items' vocabulary, other words separators; runs
    too short for any window are left out of the index, as no window can lie there. Backward search
    through wavelet-tree ranks finds every window's suffix interval, sampled suffix positions locate
    the occurrences, and overlapping ones merge into spans. Documents are never shuffled.

    The test set goes to every task in slices of about ``PATTERN_BYTES``, which hold whole items; a
    shard is searched slice by slice and the hits are merged.

    Null or empty text: no words, no hits. Null, repeated ``doc_id``: each row on its own. Items with
    null id or without words take no part; items with equal ids are one item. An empty table on
    either side gives no row, or no hit.
    """
    refuse_clash(keep, "n_words", "n_hit", "item_ids", "spans", "cleaned")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    weight = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-weight // PATTERN_BYTES) or 1
    spark, packed = docs.sparkSession, []
    for k in range(slices):  # one slice at a time on the driver and in a task
        part = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == k)
        packed.append(spark.sparkContext.broadcast(pickle.dumps(Phrases([tuple(r) for r in part.collect()], window))))
    shard_bytes = shard_words * 6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = pickle.loads(packed[0].value) if len(packed) == 1 else None

        def flush(rows: list[pd.DataFrame]) -> pd.DataFrame:
            shard = pd.concat(rows, ignore_index=True) if len(rows) > 1 else rows[0].reset_index(drop=True)
            texts = shard["text"].tolist()
            found = search_shard(texts, only or pickle.loads(packed[0].value))
            for more in packed[1:]:
                again = search_shard(texts, pickle.loads(more.value))
                found = [(n, h | g, i | j) for (n, h, i), (_, g, j) in zip(found, again, strict=True)]
            shard["n_words"] = [n for n, _, _ in found]
            shard["n_hit"] = [int(h.sum()) for _, h, _ in found]
            shard["item_ids"] = [sorted(i) for _, _, i in found]
            shard["spans"] = [_spans(t, h) if i else [] for t, (_, h, i) in zip(shard["text"], found, strict=True)]
            if with_cleaned:
                shard["cleaned"] = pd.Series([without(t, x) for t, x in zip(texts, shard["spans"], strict=True)], dtype=object)
            return shard if "text" in keep else shard.drop(columns="text")

        held, size = [], 0
        for b in batches:
            cut = 0
            for i, t in enumerate(b["text"]):
                size += len(t or "")
                if size >= shard_bytes:
                    yield flush([*held, b.iloc[cut : i + 1]])
                    held, size, cut = [], 0, i + 1
            if cut < len(b):
                held.append(b.iloc[cut:])
        if held:
            yield flush(held)

    extra = [c for c in keep if c not in ("text", "doc_id")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    fields = [f for f in rows.schema.fields if f.name != "text" or "text" in keep]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", span),
                           *([T.StructField("cleaned", T.StringType())] if with_cleaned else [])])
    return rows.mapInPandas(run, schema)


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, w[i : i + 9] AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(ws) AS n FROM p),
g AS (SELECT doc_id, n, i, w[i : i + n - 1] AS ws FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p USING (ws)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

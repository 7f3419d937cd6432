"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures, confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.common import bounded_broadcast, components, stored

WORDS = 5
#: 21 chunks of 5 symbols of 16 bits. By the pigeonhole principle a pair that differs in at most
#: 2 * 21 - 1 = 41 of the 105 symbols has a chunk with at most one error. At a similarity of 0.80 a
#: symbol differs with probability 0.20, and more than 41 of 105 do so in 2.1 of 10^6 pairs (at 0.85
#: in 5 of 10^10).
CHUNKS, WIDTH = 21, 5
SYMBOLS = CHUNKS * WIDTH
MOST_ERRORS = 2 * CHUNKS - 1

_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 1 << 32, (2, SYMBOLS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_STEP = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_KEY_MUL = _RNG.integers(1, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64) | np.uint64(1)
_KEY_ADD = _RNG.integers(1, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of each word, kept up to ``limit`` entries."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a text."""
    ws = text.encode().lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only
    n = len(ws)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, n)
    width = min(n, words)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = _mix(out * _STEP[0] + h[j : n - width + 1 + j])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of each of the ``SYMBOLS`` hash functions."""
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 2048):
        y = x[i : i + 2048, None] * _MUL[0] + _ADD
        y ^= y >> np.uint32(15)
        y *= _MUL[1]
        y ^= y >> np.uint32(16)
        np.minimum(low, y.min(axis=0), out=low)
    return low.astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature one key per chunk and symbol left out: a chunk with at most one error
    shares the key that leaves that symbol out."""
    part = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64) * _KEY_MUL
    return _mix(part.sum(axis=2, dtype=np.uint64)[:, :, None] - part + _KEY_ADD).reshape(-1, SYMBOLS).view(np.int64)


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_shingles": np.array([len(s) for s in sets], np.int64),
                "cls": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets]})

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("cls", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sig = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(-1, SYMBOLS)
                yield pd.DataFrame({"cid": b["cid"], "keys": list(chunk_keys(sig))})

    arrays = classes.select(F.xxhash64("cls").alias("cid"), "sig").mapInPandas(run, "cid long, keys array<long>")
    return arrays.select("cid", F.explode("keys").alias("key"))


def loose_groups(classes: DataFrame) -> DataFrame:
    """``(cid, grp)`` of the classes that share an index key, directly or through others.

    Each key gives links from its smallest class to the others, never all pairs; keys are counted
    with map-side aggregation and the join splits hot keys.
    """
    keys = _keys(classes)
    shared = (keys.groupBy("key").agg(F.min("cid").alias("rep"), F.max("cid").alias("top"))
              .filter(F.col("rep") < F.col("top")).select("key", "rep"))
    links = (keys.join(shared.hint("shuffle_hash"), "key").filter(F.col("cid") != F.col("rep"))
             .select(F.col("cid").alias("u"), F.col("rep").alias("v")).distinct())
    return components(links, "loose").select(F.col("node").alias("cid"), F.col("component").alias("grp"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_block(sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of one block (or across two, if ``side`` tells them apart).

    Every pair within the signature distance is confirmed on its full sets unless the two are already
    connected, so components are whole while copies of copies cost one comparison each.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    comp, out = np.arange(n), []
    for x in range(n - 1):
        rest = slice(x + 1, n)
        ok = (sigs[rest] != sigs[x]).sum(axis=1) <= MOST_ERRORS
        ok &= (100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])) & (comp[rest] != comp[x])
        if side is not None:
            ok &= side[rest] != side[x]
        for y in (np.flatnonzero(ok) + x + 1).tolist():
            if comp[y] != comp[x] and similar(sets[x], sets[y], percent):
                out.append((x, y))
                comp[comp == comp[y]] = comp[x]
    return out


def _grouped(batches: Iterable[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal ``by`` (the input is sorted by it), one frame for each group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        key = b[by].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for i, (s, e) in enumerate(zip([0, *edge], [*edge, len(b)], strict=True)):
            piece = b.iloc[s:e]
            if held and (i or (held[-1][by].iloc[-1].to_numpy() != piece[by].iloc[0].to_numpy()).any()):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _confirm(docs: DataFrame, members: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Spanning links ``(u, v)`` between classes: each loose group is dealt out as pairs of blocks."""
    count = members.count()
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(bounded_broadcast(members, count, 48), "doc_id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            found = [shingle_set(t, hashes) for t in b["text"]]
            yield pd.DataFrame({"grp": b["grp"], "blk": b["blk"], "blocks": b["blocks"],
                                "cls": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found],
                                "shingles": [s.tobytes() for s in found]})

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _grouped(batches, ["grp", "i", "j"]):
            g = g.drop_duplicates("cls")
            if len(g) < 2:
                continue
            found = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            sigs = np.stack([signature(s) for s in found])
            side = None if g["i"].iloc[0] == g["j"].iloc[0] else g["blk"].to_numpy()
            cls = g["cls"].tolist()
            pairs = link_block(found, sigs, side, percent)
            if pairs:
                yield pd.DataFrame({"u": [cls[x] for x, _ in pairs], "v": [cls[y] for _, y in pairs]})

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (rows.mapInPandas(sets, "grp long, blk int, blocks int, cls binary, shingles binary")
             .select("*", other)
             .select("grp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cls", "shingles")
             .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j"))
    return dealt.mapInPandas(links, "u binary, v binary")


def near_duplicates(docs: DataFrame, percent: int = 80, block_docs: int = 512, block_bytes: int = 24 * 1024 * 1024,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked when ``100 * intersection >=
    percent * union`` of their sets of 5-word shingles, and the smallest ``doc_id`` reachable.

    Signatures are 105 symbols of 16 bits. Each is split into 21 chunks, and each chunk gives a key for
    every symbol left out, so all pairs within 41 differing symbols share a key. Equal sets collapse
    into classes first. Classes that share keys form loose groups (through star links, not pairs); a
    group larger than a block is dealt out as pairs of blocks of at most ``block_docs`` classes or
    ``block_bytes`` of sets on average, and each task confirms on full sets every pair within the
    signature distance whose ends are not yet connected. Only spanning links leave a task. Links,
    classes and components stay on the executors.

    Null or empty text, or text without words: ``n_shingles`` 0, linked with nothing. Fewer than five
    words: one shingle, the whole sequence. Null ``doc_id``: linked with nothing, ``component_id``
    null, kept. Repeated rows: each gets the result of its text; rows that repeat a ``doc_id`` with
    different texts keep their own links under that id. An empty table gives no row. Other columns
    are not read.
    """
    signed = stored(_sign(docs, id_col, text_col), "signed")
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(real.groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig"),
                                             F.first("n_shingles").alias("n")), "classes")
    grouped = classes.drop("sig").withColumn("cid", F.xxhash64("cls")).join(loose_groups(classes), "cid")
    grouped = stored(grouped, "grouped")
    sizes = grouped.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum("n") * 8 / block_bytes)).cast("int").alias("blocks"))
    members = stored(grouped.join(sizes, "grp").select(
        F.col("low").alias("doc_id"), "grp", "blocks", F.pmod(F.hash("cls"), F.col("blocks")).alias("blk")).distinct(), "members")
    parts = components(stored(_confirm(docs, members, percent, id_col, text_col), "links"), "near")
    named = (classes.select("cls", "low").join(parts, F.col("cls") == F.col("node"), "left")
             .select("cls", "low", F.coalesce("component", "cls").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = named.join(lowest, "component").select("cls", "component_id")
    alone = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id"))
    out = signed.drop("sig").join(by_class, "cls", "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), alone).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(min(b), a) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""

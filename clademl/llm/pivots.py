"""Embedding near-duplicates through a pivot-permutation index, verified by cosine in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.common import components, stored
from clademl.llm.minhash import _grouped

#: Reference points per dimension, how many nearest ones describe a vector, how many a pair must share.
PIVOTS, NEAREST, SHARED = 256, 7, 3
BLOCK = 1024
_TRIPLES = np.array(list(combinations(range(NEAREST), SHARED)))


def _valid(v) -> np.ndarray | None:
    """The vector in double precision; None if it is null, empty, zero or holds a null or non-finite part."""
    if v is None:
        return None
    x = np.asarray(v, dtype=np.float64) + 0.0  # negative zero becomes zero; null parts become nan
    return x if x.size and np.isfinite(x).all() and x.any() else None


def choose_pivots(sample: list[np.ndarray], dim: int, count: int = PIVOTS, apart: float = 0.6) -> np.ndarray:
    """``count`` unit reference points: sampled vectors that lie apart (so that a large group of near
    copies gives one), filled up with fixed random directions."""
    chosen = np.zeros((0, dim))
    for v in sample:
        u = v / np.linalg.norm(v)
        if len(chosen) < count and (not len(chosen) or np.abs(chosen @ u).max() < apart):
            chosen = np.vstack((chosen, u))
    fill = np.random.default_rng(dim).standard_normal((count - len(chosen), dim))
    return np.vstack((chosen, fill / np.linalg.norm(fill, axis=1)[:, None]))


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The ``NEAREST`` pivots of each vector by falling cosine (ties by pivot number)."""
    s = vectors @ pivots.T
    return np.argsort(-s, axis=1, kind="stable")[:, :NEAREST]


def list_keys(dim: int, order: np.ndarray) -> np.ndarray:
    """The inverted lists a vector is in, one for each ``SHARED`` of its nearest pivots: their numbers
    in rising order, 12 bits each, below the vector's length."""
    near, key = np.sort(order, axis=1).astype(np.int64), np.full((len(order), len(_TRIPLES)), dim, np.int64)
    for c in range(SHARED):
        key = key << 12 | near[:, _TRIPLES[:, c]]
    return key


def _pivots_of(key: int) -> np.ndarray:
    return np.array([key >> 12 * c & 4095 for c in range(SHARED)])


def _classes(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cls, vec = [], []
            for v, label, i in zip(b["vec"], b["label"], b["vec_id"], strict=True):
                x = None if pd.isna(label) or pd.isna(i) else _valid(v)
                vec.append(None if x is None else x.tobytes())
                cls.append(None if x is None else hashlib.blake2b(x.tobytes() + str(int(label)).encode(), digest_size=16).digest())
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"].astype("Int64"), "cls": cls, "vec": vec})

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("long").alias("label")
                       ).mapInPandas(run, "vec_id long, label long, cls binary, vec binary")


def _lists(classes: DataFrame, pivots) -> DataFrame:
    """``(cls, label, near, keys)``: the nearest pivots of a class and its inverted lists."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby(b["vec"].map(len) // 8):
                x = np.frombuffer(b"".join(g["vec"]), np.float64).reshape(len(g), dim)
                points = pivots.value.get(dim)
                order = nearest(x, choose_pivots([], dim) if points is None else points)
                yield pd.DataFrame({"cls": g["cls"], "label": g["label"], "near": list(np.sort(order, axis=1).astype(np.int32)),
                                    "keys": list(list_keys(int(dim), order))})

    return classes.select("cls", "label", "vec").mapInPandas(run, "cls binary, label long, near array<int>, keys array<long>")


def _first_shared(near: np.ndarray, other: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """Whether the ``SHARED`` smallest pivots that two vectors share are this list's own, so that a
    pair in several lists counts in one."""
    top = triple.max()
    ids = np.unique(np.concatenate((near[near <= top], other[other <= top])))
    a = (near[:, :, None] == ids).any(axis=1).astype(np.float32)
    b = (other[:, :, None] == ids).any(axis=1).astype(np.float32)
    return a @ b.T == SHARED


def compare_block(x: np.ndarray, near: np.ndarray, y: np.ndarray, near_y: np.ndarray, triple: np.ndarray, cosine: float,
                  same: bool) -> np.ndarray:
    """Matrix of the links between two blocks of one list (above the diagonal if they are the same)."""
    ok = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)) >= cosine
    ok &= _first_shared(near, near_y, triple)
    return np.triu(ok, 1) if same else ok


def _spanning(u: np.ndarray, v: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what the links ``(u, v)`` connect."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def near_duplicates(rows: DataFrame, cosine: float = 0.98, sample_rows: int = 2048, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: vectors of equal label linked at ``cosine`` or more, the
    number of other vectors linked directly, and the smallest ``vec_id`` reachable.

    Equal vectors of a label collapse into classes. A class is described by its nearest 7 of 256
    reference points (chosen on the driver from at most ``sample_rows`` classes, the lowest by
    hash) and enters an inverted list for every three of them and its label; classes that share at
    least three meet in a list. Lists are dealt out in blocks of 1024 classes, a task compares two
    blocks at a time with the original vectors, counts each pair in the first list that it shares, and
    returns counts and spanning links only. Measured recall on the given tables is 1.0 (README).

    Null, empty or zero vectors, those with null or non-finite parts, and null labels or ids: no
    links, own component (null for a null id), kept. Vectors of different lengths never link. Rows
    that repeat an id with the same vector count as one vector, each with a result. An empty table
    gives no row. Other columns are not read.
    """
    spark = rows.sparkSession
    signed = stored(_classes(rows, id_col, vec_col, label_col), "vectors")
    classes = stored(signed.filter("cls is not null").groupBy("cls").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("low"), F.count_distinct("vec_id").alias("n")), "classes")
    sample: dict[int, list[np.ndarray]] = {}
    for r in classes.select("vec").orderBy(F.xxhash64("cls"), "cls").limit(sample_rows).collect():
        v = np.frombuffer(r["vec"], np.float64)
        sample.setdefault(len(v), []).append(v)
    pivots = spark.sparkContext.broadcast({dim: choose_pivots(vs, dim) for dim, vs in sample.items()})

    described = stored(_lists(classes, pivots), "described")
    lists = described.select("cls", "label", F.explode("keys").alias("key"))
    used = (lists.groupBy("label", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
            .select("label", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    member = lists.join(used.hint("shuffle_hash"), ["label", "key"]).withColumn("blk", F.pmod(F.hash("cls"), F.col("blocks")))
    carried = classes.select("cls", "vec", "n").join(described.select("cls", "near"), "cls")
    dealt = (member.join(carried, "cls").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("label", "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cls", "vec", "near", "n")
             .repartition("label", "key", "i", "j").sortWithinPartitions("label", "key", "i", "j"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _grouped(batches, ["label", "key", "i", "j"]):
            first = g.iloc[0]
            x = np.frombuffer(b"".join(g["vec"]), np.float64).reshape(len(g), -1)
            near, blk = np.stack(g["near"].to_list()), g["blk"].to_numpy()
            left = np.flatnonzero(blk == first["i"])
            right = left if first["i"] == first["j"] else np.flatnonzero(blk == first["j"])
            links = compare_block(x[left], near[left], x[right], near[right], _pivots_of(int(first["key"])), cosine, first["i"] == first["j"])
            a, b = np.nonzero(links)
            if len(a):
                a, b = left[a], right[b]
                cls, weight = g["cls"].to_numpy(), g["n"].to_numpy()
                span = _spanning(a, b, len(g))
                yield pd.DataFrame({"u": [cls[s] for s, _ in span], "v": [cls[e] for _, e in span], "n": 0})
                count = np.bincount(a, weight[b], len(g)) + np.bincount(b, weight[a], len(g))
                some = np.flatnonzero(count)
                yield pd.DataFrame({"u": cls[some], "v": None, "n": count[some].astype(np.int64)})

    found = stored(dealt.mapInPandas(compare, "u binary, v binary, n long"), "found")
    parts = components(found.filter("v is not null").select("u", "v"), "vectors")
    links = found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("links"))
    named = (classes.select("cls", "low", "n").join(links, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left")
             .select("cls", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = named.join(lowest, "component").select("cls", "n_links", "component_id")
    out = signed.select("vec_id", "cls").join(by_class, "cls", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.col("vec_id").eqNullSafe(own).alias("kept"))


ORACLE = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT vec_id, label, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM e WHERE len([x FOR x IN v IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(min(b), a) AS low FROM r GROUP BY a), c AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

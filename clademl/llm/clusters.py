"""Exact k-means on integer vectors, with lower bounds loosened by planar geometry instead of whole drifts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademl.llm.common import shared_path, small_batches

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Components from this on are not clustered: squared distances of 64 of them no longer fit a long.
LIMIT = 1 << 27
_CHUNK = 2048


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid (64-bit integers)."""
    out = np.empty((len(x), len(centres)), np.int64)
    for i in range(0, len(x), _CHUNK):
        for j, c in enumerate(centres):
            gap = x[i : i + _CHUNK] - c
            out[i : i + _CHUNK, j] = np.einsum("nd,nd->n", gap, gap)
    return out


def loosening(old: np.ndarray, new: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """``out[i, j]``: by how much the distance to centroid ``j`` can have shrunk, at most, for a vector
    within ``reach[i]`` of the old centroid ``i``, when ``j`` moved from ``old`` to ``new``.

    In the plane of the sphere's centre and the move, the places whose distance shrank by more than ``s`` lie
    inside a branch of a hyperbola around the new place, and that inside the cone from the middle of the move whose
    half angle has cosine ``s / drift``. A sphere seen from there at an angle ``phi`` to the move, with half
    angle ``beta``, stays outside the cone of ``phi - beta``: the bound is ``drift * cos(phi - beta)``. It is zero
    for a sphere behind the middle, and the whole drift only for one that holds the middle or the axis.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.linalg.norm(move, axis=1)
    axis = move / np.where(drift, drift, 1)[:, None]
    p = old[:, None, :] - (old + move / 2)[None, :, :]
    far = np.linalg.norm(p, axis=2)
    along = np.einsum("ijd,jd->ij", p, axis)
    across = np.linalg.norm(p - along[:, :, None] * axis, axis=2)
    r = reach[:, None]
    outside = far > r
    by = np.where(outside, far, 1)
    cos_phi, sin_phi, sin_beta = along / by, across / by, np.where(outside, r / by, 0)
    cos_beta = np.sqrt(np.maximum(0, 1 - sin_beta)) * np.sqrt(1 + sin_beta)
    cosine = np.where(cos_phi >= cos_beta, 1.0, cos_phi * cos_beta + sin_phi * sin_beta)
    cosine = np.where(outside, np.clip(cosine, 0, 1), 1.0)
    return drift * np.minimum(1, cosine + 1e-9)  # the slack covers rounding


@dataclass
class Assigned:
    """Vectors of one block with their cluster, a distance not below its own, and distances not above the others'."""

    x: np.ndarray
    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0
    measured: int = 0

    @classmethod
    def first(cls, x: np.ndarray, centres: np.ndarray) -> Assigned:
        n, k = len(x), len(centres)
        out = cls(x, np.zeros(n, np.uint16), np.zeros(n, np.float32), np.zeros((n, k), np.float32))
        out._scan(np.arange(n), centres)
        return out

    def _scan(self, rows: np.ndarray, centres: np.ndarray) -> None:
        d = squared(self.x[rows], centres)
        best = d.argmin(axis=1)  # ties: the smaller number
        root = np.sqrt(d.astype(np.float64))
        self.own[rows], self.upper[rows], self.lower[rows] = best, _up(root[np.arange(len(rows)), best]), _down(root)
        self.scanned += len(rows)

    def own_squared(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        gap = self.x[rows] - centres[self.own[rows]]
        return np.einsum("nd,nd->n", gap, gap)

    def _open(self, rows: np.ndarray) -> np.ndarray:
        """Vectors for which another centroid may be as near as their own."""
        others = self.lower[rows].copy()
        others[np.arange(len(rows)), self.own[rows]] = np.inf
        return rows[~(others.min(axis=1) > self.upper[rows])]

    def move(self, centres: np.ndarray, loosen: np.ndarray, drift: np.ndarray) -> None:
        """Bounds after the centroids moved, then the exact scan of the vectors that are still open."""
        self.lower = _down(self.lower.astype(np.float64) - loosen[self.own])
        self.upper = _up(self.upper.astype(np.float64) + drift[self.own])
        rows = self._open(np.arange(len(self.own)))
        self.upper[rows] = _up(np.sqrt(self.own_squared(rows, centres).astype(np.float64)))
        self.measured += len(rows)
        self._scan(self._open(rows), centres)


@dataclass
class Clustering:
    """``rows``: the result of :func:`cluster`; ``rounds``: for each assignment how many vectors were scanned
    against all centroids, how many were measured against their own alone or first, and how many there are."""

    rows: DataFrame
    rounds: list[dict[str, int]] = field(default_factory=list)


_STATE = ("ids array<string>, x binary, width int, own binary, upper binary, lower binary, sums array<long>, counts array<long>, "
          "reach array<double>, inertia array<decimal(38,0)>, scanned long, measured long")


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """Components in the narrowest of 2, 4 or 8 bytes."""
    top = int(np.abs(x).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return x.astype(f"<i{width}").tobytes(), width


def _block(row, dim: int, k: int) -> Assigned:
    own = np.frombuffer(row.own, np.uint16).copy()
    return Assigned(np.frombuffer(row.x, f"<i{row.width}").reshape(-1, dim).astype(np.int64), own,
                    np.frombuffer(row.upper, np.float32).copy(), np.frombuffer(row.lower, np.float32).reshape(len(own), k).copy())


class _Totals:
    """What a task adds up over its blocks: one row, whatever the number of vectors."""

    def __init__(self, k: int, dim: int):
        self.sums, self.counts, self.reach = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k)
        self.inertia, self.scanned, self.measured, self.k = [0] * k, 0, 0, k

    def add(self, a: Assigned, centres: np.ndarray, last: bool) -> None:
        order = np.argsort(a.own, kind="stable")
        for j, rows in enumerate(np.split(order, np.searchsorted(a.own[order], np.arange(1, self.k)))):
            if len(rows):
                self.sums[j] += a.x[rows].sum(axis=0)
                self.counts[j] += len(rows)
                self.reach[j] = max(self.reach[j], float(a.upper[rows].max()))
                if last:
                    self.inertia[j] += sum(a.own_squared(rows, centres).tolist())
        self.scanned += a.scanned
        self.measured += a.measured

    def row(self) -> dict:
        return {"ids": None, "x": None, "width": None, "own": None, "upper": None, "lower": None, "sums": self.sums.ravel(), "counts": self.counts,
                "reach": self.reach, "inertia": [Decimal(v) for v in self.inertia], "scanned": self.scanned, "measured": self.measured}


def _kept(rows: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    whole = lambda c: c.cast("double") * F.lit(float(scale))
    ok = F.forall(vec_col, lambda c: F.coalesce(F.abs(whole(c)) < F.lit(float(LIMIT)), F.lit(False)))
    return (rows.filter(F.size(vec_col) == dim).filter(F.coalesce(ok, F.lit(False)))
            .select(F.col(id_col).cast("string").alias("id"), F.transform(vec_col, lambda c: F.floor(whole(c)).cast("long")).alias("x")))


def _written(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """Write a round's state in the shared folder; the state before it is no longer read, and goes."""
    spark = df.sparkSession
    path = shared_path(spark, "clusters")
    df.write.option("compression", "zstd").parquet(path)
    if old is not None:
        there = spark._jvm.org.apache.hadoop.fs.Path(old)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return spark.read.schema(df.schema).parquet(path), path


def _total(state: DataFrame, k: int, dim: int) -> _Totals:
    """Sums over the tasks' rows: ``k * dim`` numbers reach the driver."""
    out, rows = _Totals(k, dim), state.filter(F.col("sums").isNotNull())
    for r in rows.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("v")).collect():
        out.sums[r["pos"] // dim, r["pos"] % dim] = int(r["v"])
    parts = rows.select("scanned", "measured", F.posexplode(F.arrays_zip("counts", "reach", "inertia")).alias("j", "c"))
    for r in parts.groupBy("j").agg(F.sum("c.counts").alias("n"), F.max("c.reach").alias("r"), F.sum("c.inertia").alias("i"),
                                    F.sum("scanned").alias("s"), F.sum("measured").alias("m")).collect():
        j = r["j"]
        out.counts[j], out.reach[j], out.inertia[j] = r["n"], r["r"], int(r["i"])
        out.scanned, out.measured = int(r["s"]), int(r["m"])
    return out


def _next(old: np.ndarray, total: _Totals) -> np.ndarray:
    return np.array([[int(s) // int(n) for s in row] if n else c.tolist() for c, row, n in zip(old, total.sums, total.counts, strict=True)], np.int64)


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED,
        id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Exact Lloyd rounds on the vectors ``floor(scale * x)``: ``vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256`` for every vector of ``dim`` finite components.

    The first centroids are the vectors with the smallest SHA-256 of ``seed:id``. A round assigns every vector to
    its nearest centroid (squared distance in integers; ties: the smaller number) and moves each centroid to
    the floor of the mean; an empty one stays. One more assignment follows. Each vector keeps an upper bound for its
    own centroid and a lower bound for each other one; when centroids move, the lower bounds of a cluster's
    vectors fall by :func:`loosening` of the cluster's sphere, and only vectors whose bounds then leave a doubt are scanned
    exactly. The rounds end early only when no centroid moved, since nothing can change after that.

    Vectors lie packed, a batch a row, in a table in the shared folder, rewritten with its bounds every round;
    a task gives one row of sums, so only ``clusters * dim`` numbers meet on the driver, and a vector that many rows
    share makes no hot key. Vectors that are null, of another length or hold null or non-finite parts are left out,
    and so are those with a component of 2^27 or more after scaling, whose distances do not fit a long. Fewer
    vectors than ``clusters``: as many centroids. Repeated rows count each; a null id is never a first
    centroid while others are left. A sum of distances beyond a long is null. An empty table gives no row.
    Other columns are not read.
    """
    spark: SparkSession = rows.sparkSession
    small_batches(spark)
    kind = rows.schema[id_col].dataType.simpleString()
    kept = _kept(rows, id_col, vec_col, dim, scale)
    start = (kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256).asc_nulls_last(), "x").limit(clusters).collect())
    centres = np.array([r["x"] for r in start], np.int64).reshape(len(start), dim)
    k = len(start)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = _Totals(k, dim), False
        for b in batches:
            if len(b) and k:
                a = Assigned.first(np.stack(b["x"].to_list()).astype(np.int64), centres)
                total.add(a, centres, False)
                some = True
                yield _state_row(a, b["id"].tolist())
        if some:
            yield pd.DataFrame([total.row()])

    state, path = _written(kept.mapInPandas(begin, _STATE), None)
    total = _total(state, k, dim)
    history = [{"scanned": total.scanned, "measured": total.measured, "rows": int(total.counts.sum())}]

    def moved(state: DataFrame, old: np.ndarray, new: np.ndarray, reach: np.ndarray, last: bool) -> DataFrame:
        loosen, drift = loosening(old, new, reach), np.linalg.norm((new - old).astype(np.float64), axis=1) * (1 + 1e-12)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, some = _Totals(k, dim), False
            for b in batches:
                for row in b.itertuples():
                    a = _block(row, dim, k)
                    a.move(new, loosen, drift)
                    total.add(a, new, last)
                    some = True
                    yield _state_row(a, row.ids, row.x, row.width)
            if some:
                yield pd.DataFrame([total.row()])

        return state.filter(F.col("x").isNotNull()).select("ids", "x", "width", "own", "upper", "lower").mapInPandas(run, _STATE)

    for r in range(rounds):
        new = _next(centres, total) if k else centres
        still = r + 1 < rounds and np.array_equal(new, centres)
        last = still or r + 1 == rounds
        state, path = _written(moved(state, centres, new, total.reach, last), path)
        centres, total = new, _total(state, k, dim)
        history.append({"scanned": total.scanned, "measured": total.measured, "rows": int(total.counts.sum())})
        if last:
            break
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    inertia = [v if v < 1 << 63 else None for v in [*total.inertia, sum(total.inertia)]]
    ends = centres

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                a = _block(row, dim, k)
                yield pd.DataFrame({"id": row.ids, "cluster": a.own.astype(np.int32), "distance": a.own_squared(np.arange(len(a.own)), ends)})

    each = (state.filter(F.col("x").isNotNull()).select("ids", "x", "width", "own", "upper", "lower")
            .mapInPandas(unpack, "id string, cluster int, distance long"))
    by = lambda values, of: F.element_at(F.array(*[F.lit(v).cast(of) for v in values] or [F.lit(None).cast(of)]), F.col("cluster") + 1)
    out = each.select(F.col("id").cast(kind).alias("vec_id"), "cluster", "distance", by(inertia[:-1], "long").alias("cluster_inertia"),
                      F.lit(inertia[-1]).cast("long").alias("inertia"), by(digest, "string").alias("centroid_sha256"))
    return Clustering(out, history)


def _state_row(a: Assigned, ids, x: bytes | None = None, width: int | None = None) -> pd.DataFrame:
    if x is None:
        x, width = _packed(a.x)
    return pd.DataFrame([{"ids": list(ids), "x": x, "width": width, "own": a.own.tobytes(), "upper": a.upper.tobytes(), "lower": a.lower.tobytes(),
                          "sums": None, "counts": None, "reach": None, "inertia": None, "scanned": None, "measured": None}])


def cluster(rows: DataFrame, **options) -> DataFrame:
    """The rows of :func:`fit`."""
    return fit(rows, **options).rows


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    start = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT r, vec_id, unnest(range({DIM})) AS i, CAST(floor(unnest(v) * {SCALE}) AS HUGEINT) AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM e QUALIFY c < {clusters}),
c0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN s USING (r)),"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d
  FROM v JOIN c{k} c USING (i) GROUP BY v.r, c.c) GROUP BY r),""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (r) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN m{k} USING (c, i)),""")
    return start + "".join(steps) + f"""
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
t AS (SELECT c, sum(d) AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, t.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM t)::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN t USING (c) JOIN h USING (c)
"""


ORACLE = _sql()

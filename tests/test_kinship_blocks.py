"""Kinship over blocks with few calls: products call by call and as matrices, calls that occur twice, pairs dealt over tasks."""

import math

import numpy as np
import pandas as pd
import pytest

from clademl.operators import genotypes as N

SCHEMA = "fid string, iid string, variant_id string, chrom int, pos long, a1 string, a2 string, dosage int"


def _block(rng, calls, variants, samples):
    r, c = np.sort(rng.integers(0, variants, calls)).astype(np.uint16), rng.integers(0, samples, calls).astype(np.uint16)
    return r, c, rng.standard_normal(calls)


@pytest.mark.parametrize("dense_cells", [0, 10**9])
def test_pair_sums_equal_the_products_of_all_calls(monkeypatch, dense_cells):
    monkeypatch.setattr(N, "DENSE_CELLS", dense_cells)
    monkeypatch.setattr(N, "PRODUCTS", 50)
    rng, nv, ns = np.random.default_rng(1), 9, 7
    sums, g, m = N._PairSums(nv, ns), np.zeros((20, 20)), np.zeros((20, 20))
    for _ in range(4):
        left, right = _block(rng, 60, nv, ns), _block(rng, 45, nv, ns)
        sums.add(left, right)
        for ra, ca, za in zip(*left):
            for rb, cb, zb in zip(*right):
                if ra == rb:
                    g[7 + ca, 14 - 7 + cb] += za * zb
                    m[7 + ca, 14 - 7 + cb] += 1
    got = pd.concat(sums.cells(1, 1))
    assert len(got) == (m > 0).sum()
    for x in got.itertuples():
        assert x.gs == pytest.approx(g[x.i, x.j]) and x.m == m[x.i, x.j]


def test_groups_stay_whole_over_batches():
    rows = pd.DataFrame({"a": np.repeat(np.arange(6), [1, 5, 9, 1, 2, 7]), "b": 0, "x": np.arange(25)})
    for size in (1, 4, 25):
        got = list(N.whole_groups((rows.iloc[i : i + size] for i in range(0, 25, size)), ["a", "b"]))
        assert [x for p in got for x in p["x"]] == list(range(25))
        assert all(not set(p["a"]) & set(q["a"]) for k, p in enumerate(got) for q in got[k + 1 :])
        assert [len(p) for p in got for _ in N.group_bounds(p, ["a", "b"])[1:]]


@pytest.mark.parametrize("task_products", [10, 10**9])
def test_few_calls_in_many_blocks_and_calls_that_occur_twice(spark, monkeypatch, task_products):
    monkeypatch.setattr(N, "TASK_PRODUCTS", task_products)
    rng = np.random.default_rng(3)
    rows = [(f"F{s % 2}", f"S{s}", f"rs{v}", 1, int(v), "A", "C", int(d) if d < 3 else None)
            for s, v, d in zip(rng.integers(0, 23, 400), rng.integers(0, 60, 400), rng.choice([0, 1, 1, 2, 3], 400))]
    got = N.kinship(spark.createDataFrame(rows, SCHEMA), variant_block=16, sample_block=5).collect()
    z: dict[tuple[str, str], list[tuple[str, float]]] = {}
    for v in {r[2] for r in rows}:
        seen = [(r[:2], r[7]) for r in rows if r[2] == v and r[7] is not None]
        p = sum(d for _, d in seen) / len(seen) / 2 if seen else 0.0
        for who, d in seen if min(p, 1 - p) >= 0.01 else []:
            z.setdefault(who, []).append((v, (d - 2 * p) / math.sqrt(2 * p * (1 - p))))
    want = {}
    for a in z:
        for b in z:
            both = [x * y for v, x in z[a] for u, y in z[b] if u == v]
            if both:
                want[a, b] = (sum(both) / len(both), len(both))
    assert len(got) == len(want)
    for r in got:
        g, m = want[(r["fid_i"], r["iid_i"]), (r["fid_j"], r["iid_j"])]
        assert r["m"] == m and r["g"] == pytest.approx(g, abs=1e-9)

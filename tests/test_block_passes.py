"""Blocks packed from streams of calls, working sets and residuals in parts, one shuffle by variant."""

import numpy as np
import pytest

from clademl.operators import blocks as B
from clademl.operators import genotypes as N
from clademl.operators import lasso_path as L
from tests.test_lasso_path import SCHEMA, _calls, _dense


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_imputation_shuffle_the_calls_once(spark):
    g = spark.createDataFrame(_calls(6, 9, 4, 0.2)[3], SCHEMA)
    assert _plan(N.impute_dosage(N.maf_filter(g))).count("Exchange") == 1


def test_blocks_close_when_full_or_large(spark, monkeypatch):
    x, _, gone, rows = _calls(20, 30, 5, 0.1)
    odd = [(None, None, 1, 500, "lost", "A", "C", 2), ("F0", "S000", None, None, None, "A", "C", 1), ("F0", "S000", None, None, None, "A", "C", 2)]
    b = B.dosage_blocks(spark.createDataFrame(rows + odd, SCHEMA), 7, 4)
    at = [(r["vb"], r["sb"]) for r in b.table.collect()]
    assert len(at) == len(set(at))
    got = {(r["iid"], r["variant_id"]): r["dosage"] for r in B.block_cells(b).collect()}
    want = {(f"S{i:03d}", f"rs{j}"): None if gone[i, j] else int(x[i, j]) for i in range(20) for j in range(30) if gone[i, j] or x[i, j]}
    assert got == want | {("S000", None): 2}
    assert {r["variant_id"] for r in b.variants.collect()} == {f"rs{j}" for j in range(30)} | {"lost", None}


def test_parts_of_a_path_do_not_change_it(spark, monkeypatch):
    x, y, _, rows = _calls(60, 30, 6)
    b = B.dosage_blocks(spark.createDataFrame(rows, SCHEMA), sample_block=16, variant_block=8)
    t = spark.createDataFrame([(f"F{i % 3}", f"S{i:03d}", float(y[i]), i % 3) for i in range(60)], "fid string, iid string, y double, fold int")
    whole = L.lasso_path(b, t, n_lambda=6, ratio=0.2, tol=1e-8)
    for name, value in (("GRAM_FEATURES", 12), ("WORK_FEATURES", 10), ("SHARED_BYTES", 1), ("TASK_CELLS", 0)):
        monkeypatch.setattr(L, name, value)
    parts = L.lasso_path(b, t, n_lambda=6, ratio=0.2, tol=1e-8, step=3)
    for k in range(6):
        assert x @ _dense(whole, k, b)[0][:30] == pytest.approx(x @ _dense(parts, k, b)[0][:30], abs=1e-4)
    assert [r["cvm"] for r in whole.cv.orderBy("lam_id").collect()] == pytest.approx([r["cvm"] for r in parts.cv.orderBy("lam_id").collect()], rel=1e-5)

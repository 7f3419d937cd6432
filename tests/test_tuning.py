"""Tuning over a shared prediction table: failed fits as NULL rows, weighted learners, released caches."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clademl.operators import models as M
from clademl.operators import resample as R
from clademl.operators import tuning as T

LEVELS = ["neg", "pos"]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, LEVELS[int(i % 7 > 4)], float(i % 7) + (i * 37 % 11) / 10, float(i % 5)) for i in range(140)]
    df = spark.createDataFrame(rows, "row_id long, label string, a double, b double").withColumn("label_index", (F.col("label") == "pos").cast("double"))
    return df, R.vfold(df, v=2, repeats=2, seed=3, strata="label")


def _recipe():
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])


def test_failed_cells_have_null_metrics_and_caches_go(spark, made):
    df, folds = made
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    grid = [{"min_n": 1}, {"min_n": 0}]  # no tree takes fewer than one row a node
    m = T.tune(df, folds, _recipe, lambda c: M.forest(trees=3, min_n=max(1, c["min_n"])).setMaxDepth(3) if c["min_n"] else _Refused(), grid, LEVELS, "neg", "pos")
    rows = m.collect()
    assert len(rows) == 2 * 4 * len(T.METRICS)
    assert all((r["estimate"] is None) == (r["cell_id"] == 1) for r in rows if r["metric"] == "accuracy")
    mean = {(r["cell_id"], r["metric"]): r["n"] for r in T.collect_metrics(m).collect()}
    assert mean[0, "accuracy"] == 4 and mean[1, "accuracy"] == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before + 2  # the metric step's own


class _Refused:
    def fit(self, _):
        raise M.NotConverged("never")


def test_oneclass_scores_are_null_for_a_failed_cell(made):
    df, folds = made
    grid = [{"nu": 0.2}, {"nu": 2.0}, {"nu": 0.2, "steps": 0}]
    got = T.tune_oneclass(df, folds, _recipe, grid, lambda c: M.OneClassSVM(nu=c["nu"], sigma=0.1, n_components=16, n_input=2, max_iter=c.get("steps", 500)))
    score = {r["cell_id"]: r["score"] for r in got.collect()}
    assert 0.5 < score[0] < 1 and score[1] is None and score[2] is None


@pytest.mark.parametrize("balance", ["weights", "upsample"])
def test_weighted_learners_per_resample(made, balance):
    df, folds = made
    w = T.fold_weights(df, folds, "label", balance).join(df, "row_id")
    sums = w.groupBy("repeat", "fold", "label").agg(F.sum(T.WEIGHT).alias("s")).collect()
    for r, f in {(x["repeat"], x["fold"]) for x in sums}:
        a, b = (x["s"] for x in sums if (x["repeat"], x["fold"]) == (r, f))
        assert a == pytest.approx(b)
    plain = T.fit_resample_cells(df, folds, _recipe, lambda c: M.lasso_logit(c["penalty"]), [{"penalty": 0.3}], LEVELS)
    even = T.fit_resample_cells(df, folds, _recipe, lambda c: M.lasso_logit(c["penalty"]), [{"penalty": 0.3}], LEVELS, balance=balance)
    mean = [d.agg(F.avg("pred_pos")).first()[0] for d in (plain, even)]
    assert mean[1] > mean[0] + 0.1 and mean[1] == pytest.approx(0.5, abs=0.1)  # the rare class counts as much
    trees = T.fit_resample_cells(df, folds, _recipe, lambda c: M.forest(trees=5).setMaxDepth(3), [{}], LEVELS, balance=balance)
    assert trees.count() == 280

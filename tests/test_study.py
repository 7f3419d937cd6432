"""Replicate study: choice of cells and replicates, refit under balance, held-out predictions of the final set; text rounding."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clademl.operators import models as M
from clademl.operators import resample as R
from clademl.operators import shape as P
from clademl.operators import study as ST

LEVELS = ["neg", "pos"]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, LEVELS[int(i % 7 > 4)], float(i % 7) + (i * 37 % 11) / 10, float(i % 5)) for i in range(140)]
    df = spark.createDataFrame(rows, "row_id long, label string, a double, b double")
    return M.label_index(df, "label", LEVELS)


def _recipe():
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])


def test_choice_skips_failed_folds_and_breaks_ties_low(spark):
    rows = [("x", 0, 0, 0, 0.5), ("x", 0, 0, 1, 0.7), ("x", 1, 0, 0, 0.7), ("x", 1, 0, 1, 0.5), ("x", 2, 0, 0, 0.9), ("x", 2, 0, 1, None),
            ("x", 0, 1, 0, 0.6), ("x", 0, 1, 1, 0.6), ("y", 0, 0, 0, None), ("y", 0, 0, 1, None), ("y", 0, 1, 0, 0.1), ("y", 0, 1, 1, 0.3), ("z", 0, 0, 0, None)]
    m = spark.createDataFrame(rows, "method string, cell_id int, repeat int, fold int, estimate double").withColumn("metric", F.lit("accuracy"))
    tuned = {(r["method"], r["repeat"]): (r["cell_id"], r["mean"]) for r in ST.tuned_replicas(m).collect()}
    assert tuned == {("x", 0): (0, 0.6), ("x", 1): (0, 0.6), ("y", 1): (0, 0.2)}  # cell 2 lost a fold, z has no whole cell
    best = {r["method"]: r["repeat"] for r in ST.best_replicas(ST.tuned_replicas(m)).collect()}
    assert best == {"x": 0, "y": 1}


class _Refused:
    def fit(self, _):
        raise ValueError("refused")


def test_study_refits_the_chosen_cells_and_keeps_their_held_out_rows(spark, made):
    folds = R.vfold(made, v=2, repeats=2, seed=3, strata="label")
    methods = {"forest": ST.Method(_recipe, lambda c: M.forest(trees=5, min_n=c["min_n"]).setMaxDepth(3), [{"min_n": 60}, {"min_n": 2}]),
               "linear": ST.Method(_recipe, lambda c: M.lasso_logit(c["penalty"]), [{"penalty": 5.0}, {"penalty": 0.01}], ["a", "b"]),
               "mixed": ST.Method(_recipe, lambda c: M.lasso_logit(0.01) if c["ok"] else _Refused(), [{"ok": 0}, {"ok": 1}])}
    got = ST.replicate_study(made, folds, methods, LEVELS, "neg", "pos")
    chosen = {c["method"]: c for c in got.chosen}
    assert list(chosen) == list(methods) and chosen["forest"]["cell_id"] == chosen["linear"]["cell_id"] == chosen["mixed"]["cell_id"] == 1
    lost = got.metrics.filter("method = 'mixed' and cell_id = 0")
    assert lost.count() == 4 * 5 and lost.filter("estimate is not null").count() == 0
    acc = {}
    for r in got.predictions.collect():
        acc.setdefault((r["method"], r["cell_id"], r["repeat"], r["fold"]), []).append(r["label"] == r["pred_class"])
    means = {}
    for (meth, cell, rep, _), hits in acc.items():
        means.setdefault((meth, cell, rep), []).append(sum(hits) / len(hits))
    for meth, c in chosen.items():
        own = {(cell, rep): sum(v) / len(v) for (mm, cell, rep), v in means.items() if mm == meth}
        assert abs(c["mean"] - max(own.values())) < 1e-9 and abs(own[c["cell_id"], c["repeat"]] - c["mean"]) < 1e-9
    cv = got.cv_predictions.filter("chosen").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("d")).collect()
    assert {(r["method"], r["n"], r["d"]) for r in cv} == {(m, 140, 140) for m in methods}
    final = ST.final_predictions(got.models, made, LEVELS)
    assert final.columns == ["method", "row_id", "label", "pred_neg", "pred_pos", "pred_class"] and final.count() == 3 * 140


def test_all_failed_leaves_an_empty_final_set(spark, made):
    folds = R.vfold(made, v=2, repeats=1, seed=3)
    half = {"forest": ST.Method(_recipe, lambda c: M.forest(trees=2).setMaxDepth(2), [{}])}
    preds = ST.held_out(made, folds, half, LEVELS, "neg", "pos").filter("fold = 1")
    assert ST.tuned_replicas(ST.study_metrics(preds, folds, half, "neg", "pos")).count() == 0


def test_refit_balances_classes(spark, made):
    share = {}
    for b in (None, "upsample", "weights"):
        model = ST.refit(made, _recipe, M.lasso_logit(10.0), balance=b)
        share[b] = ST.final_predictions({"m": model}, made, LEVELS).agg(F.avg("pred_pos")).first()[0]
    assert abs(share[None] - 40 / 140) < 1e-4 and abs(share["upsample"] - 0.5) < 1e-4 and abs(share["weights"] - 0.5) < 1e-4
    with pytest.raises(ValueError):
        ST.refit(made, _recipe, M.lasso_logit(10.0), balance="other")


def test_round_text(spark):
    d = spark.createDataFrame([(1.0,), (0.0625,), (-0.0625,), (2.71828,), (None,), (-0.0001,)], "x double")
    assert [r["x"] for r in P.round_text(d, ["x"], 3).collect()] == ["1.000", "0.063", "-0.063", "2.718", None, "-0.000"]

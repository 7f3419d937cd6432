"""Model invariants: recipe on train only, lasso KKT, one-class outlier share, kernel SVM on rings,
model persistence with the run-id guard, streaming discovery."""

import math
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clademl.operators import models as M
from clademl.operators import recipe as E
from clademl.plans import fixtures as fx
from clademl.plans import workflows as wf
from clademl.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def test_normalize_uses_train_only(spark):
    train, test = wf.flagship_split(spark, SF)
    m = E.Normalize(inputCols=["f01", "f02"]).fit(train)
    tr = m.transform(train).agg(F.avg("f01").alias("m"), F.stddev_samp("f01").alias("s")).first()
    assert tr["m"] == pytest.approx(0.0, abs=1e-9) and tr["s"] == pytest.approx(1.0, abs=1e-9)
    # the test rows are scaled with train statistics, so they are not exactly standardised
    te = m.transform(test).agg(F.avg("f01").alias("m")).first()
    assert abs(te["m"]) > 1e-12


def test_recipe_drops_expected(spark):
    train, _ = wf.flagship_split(spark, SF)
    model = E.recipe(fx.FEATURES, ("zv", "nzv", "corr")).fit(train)
    kept = E.kept_features(model, fx.FEATURES)
    assert "f66" not in kept and "f67" not in kept
    assert ("f02" in kept) != ("f65" in kept)  # exactly one of the collinear pair survives


def test_lasso_kkt(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.5, size=300) > 0).astype(float)
    df = spark.createDataFrame([(float(v), *map(float, r)) for v, r in zip(y, x)],
                               "label_index double, a double, b double, c double, d double, e double")
    df = VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df)
    lam = 0.02
    m = M.lasso_logit(lam, max_iter=500).fit(df)
    beta = m.coefficients.toArray()
    sd = x.std(axis=0, ddof=1)
    eta = m.intercept + x @ beta
    p = 1 / (1 + np.exp(-eta))
    grad = x.T @ (y - p) / len(y) * sd  # gradient on the standardised scale
    for j in range(5):
        if abs(beta[j]) > 1e-8:
            assert abs(grad[j] - lam * np.sign(beta[j])) < 5e-3
        else:
            assert abs(grad[j]) <= lam + 5e-3


def test_oneclass_outlier_share(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    m = M.OneClassSVM(nu=0.1, sigma=0.2, n_components=64, n_input=3).fit(df)
    share = m.transform(df).agg(F.avg((F.col("decision") < 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.1, abs=0.04)
    assert m.history[-1] <= m.history[0]


def test_kernel_svm_rings(spark):
    rng = np.random.default_rng(3)
    n = 300
    r = np.where(np.arange(n) % 2 == 0, 1.0, 3.0) + rng.normal(scale=0.2, size=n)
    t = rng.uniform(0, 2 * math.pi, n)
    rows = [(float(i % 2), float(a * math.cos(b)), float(a * math.sin(b))) for i, (a, b) in enumerate(zip(r, t))]
    df = spark.createDataFrame(rows, "label_index double, x double, y double")
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df).withColumn(
        "label", F.when(F.col("label_index") == 1, "outer").otherwise("inner"))
    m = M.KernelSVM(cost=10.0, sigma=0.5, n_components=128, n_input=2, max_iter=50).fit(df)
    p = M.class_probabilities(m.transform(df), ["inner", "outer"])
    from clademl.operators.metrics import roc_auc

    assert roc_auc(p, "label", "pred_outer", "outer").first()["roc_auc"] > 0.95  # linear models cannot separate rings


def test_save_load_guard(spark, tmpdir_path):
    model, _, test = wf.flagship_model(spark, SF)
    path = os.path.join(tmpdir_path, "m")
    SK.save_model(model, path, 1785000000)
    back = SK.load_model(path, 1785000000)
    a = model.transform(test).select("probability").collect()
    b = back.transform(test).select("probability").collect()
    assert [r[0] for r in a] == [r[0] for r in b]
    with pytest.raises(ValueError):
        SK.load_model(path, 1)


def test_streaming_discovery(spark, tmpdir_path):
    from clademl.streaming.scoring import discover_stream, read_feature_stream

    model, _, _ = wf.flagship_model(spark, SF)
    unl = fx.fx7(spark, SF).dropna(subset=fx.FEATURES)
    src = os.path.join(tmpdir_path, "in")
    unl.write.parquet(src)
    stream = read_feature_stream(spark, src, unl.schema)
    out = discover_stream(model, stream, fx.LEVELS, fx.NEG, fx.POS, ["row_id"], 1785000000)
    q = (out.writeStream.format("memory").queryName("disc_stream").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["row_id"] for r in spark.sql("SELECT row_id FROM disc_stream").collect()}
    batch = {r["row_id"] for r in wf.discovery_flagship(spark, SF).collect()}
    assert got == batch


def test_forest_keeps_its_node_ids_and_the_same_trees(spark):
    rows = [(float(i * 37 % 101), float(i * 53 % 89), float((i * i) % 7 > 2)) for i in range(300)]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label_index double"))
    learner = M.forest(trees=5, min_n=2)
    assert learner.getCacheNodeIds()
    assert learner.fit(d).toDebugString.split("\n")[1:] == learner.copy().setCacheNodeIds(False).fit(d).toDebugString.split("\n")[1:]

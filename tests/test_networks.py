"""Network with weight decay: gradient, decay, a problem no linear model solves, weights, persistence, tuning grid."""

import os

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clademl.operators import networks as NN
from clademl.operators import resample as R
from clademl.operators import tuning as T


@pytest.fixture(scope="module")
def xor(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (240, 2))
    rows = [(i, "pos" if a * b > 0 else "neg", float(a * b > 0), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, label string, label_index double, a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y, weight, size = rng.normal(size=(30, 3)), rng.integers(0, 2, 30).astype(float), rng.uniform(0.5, 2, 30), 4
    w = rng.normal(size=4 * size + 1 + size)
    g = NN.loss_and_gradient(w, x, y, weight, size)[1:]
    for j in range(len(w)):
        e = np.eye(len(w))[j] * 1e-6
        slope = (NN.loss_and_gradient(w + e, x, y, weight, size)[0] - NN.loss_and_gradient(w - e, x, y, weight, size)[0]) / 2e-6
        assert slope == pytest.approx(g[j], abs=1e-5)


def test_solver_reaches_a_known_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    w, history = NN.minimise(lambda v: (0.5 * (v - 1) @ a @ (v - 1), a @ (v - 1)), np.array([5.0, -3.0, 2.0]), 100, 1e-12)
    assert w == pytest.approx(np.ones(3), abs=1e-4) and all(b <= a for a, b in zip(history, history[1:]))


def test_solves_what_no_linear_model_does_and_reloads(xor, tmpdir_path):
    model = NN.DecayNet(size=6, decay=1e-3, max_iter=120, seed=3).fit(xor)
    out = model.transform(xor)
    assert out.agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double"))).first()[0] > 0.95
    path = os.path.join(tmpdir_path, "net")
    pipe = PipelineModel([model])
    pipe.write().overwrite().save(path)
    col = vector_to_array("probability")[1].alias("p")
    same = {r["row_id"]: r["p"] for r in PipelineModel.load(path).transform(xor).select("row_id", col).collect()}
    assert all(same[r["row_id"]] == pytest.approx(r["p"], abs=1e-12) for r in out.select("row_id", col).collect())


def test_decay_shrinks_and_weights_count(xor):
    norms = [float(np.square(NN.DecayNet(size=3, decay=d, max_iter=40).fit(xor).w).sum()) for d in (0.01, 1.0, 1000.0)]
    assert norms[0] > norms[1] > norms[2] and norms[2] < 1e-2
    heavy = xor.withColumn("w", F.when(F.col("label_index") == 1, 9.0).otherwise(1.0))
    p = NN.DecayNet(size=2, decay=1000.0, max_iter=30).setWeightCol("w").fit(heavy).transform(xor).agg(F.avg(vector_to_array("probability")[1])).first()[0]
    assert p > 0.5
    for bad in ({"size": 0}, {"decay": -1.0}):
        with pytest.raises(ValueError):
            NN.DecayNet(**bad).fit(xor)
    with pytest.raises(ValueError, match="no training row"):
        NN.DecayNet().fit(xor.limit(0))


def test_size_by_decay_grid_over_resamples(xor):
    df = xor.drop("features")
    folds = R.vfold(df, v=2, repeats=1, seed=3, strata="label")
    grid = [{"size": s, "decay": d} for s in (1, 5) for d in (0.001, 100.0)]
    recipe = lambda: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])
    m = T.tune(df, folds, recipe, lambda c: NN.DecayNet(size=c["size"], decay=c["decay"], max_iter=60, seed=3), grid, ["neg", "pos"], "neg", "pos", balance="weights")
    acc = {r["cell_id"]: r["mean"] for r in T.collect_metrics(m).filter("metric = 'accuracy'").collect()}
    assert len(acc) == 4 and acc[2] > acc[0] and acc[2] > acc[3] and acc[2] > 0.8

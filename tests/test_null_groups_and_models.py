"""NULL groups in metrics and summaries, greedy thinning over blocks, saved kernel models."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clademl.operators import aggregate as A
from clademl.operators import genotypes as N
from clademl.operators import metrics as V
from clademl.operators import models as M
from clademl.operators import recipe as E
from clademl.sources import sinks as SK

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_null_group_has_every_metric(spark):
    rng = np.random.default_rng(0)
    rows = [(g, "p" if (i + rng.integers(0, 2)) % 3 else "n", float(rng.integers(0, 9)) / 10, "p" if rng.random() < 0.6 else "n") for g in ("a", None) for i in range(60)]
    both = spark.createDataFrame(rows, "g string, truth string, score double, pred string")
    named = both.withColumn("g", F.coalesce("g", F.lit("z")))

    def same(fn, keys):
        got = {tuple("z" if v is None and c == "g" else v for c, v in r.asDict().items() if c in keys): r for r in fn(both).collect()}
        want = {tuple(r[c] for c in r.asDict() if c in keys): r for r in fn(named).collect()}
        assert set(got) == set(want) and len(want) >= 2
        for k, w in want.items():
            for c, v in w.asDict().items():
                if c != "g":
                    assert got[k][c] == pytest.approx(v) if isinstance(v, float) else got[k][c] == v, (k, c)

    same(lambda d: V.roc_curve(d, "truth", "score", "p", by=["g"]), ["g", "threshold"])
    same(lambda d: V.auc_ci(d, "truth", "score", "p", by=["g"]), ["g"])
    same(lambda d: V.confusion_stats(d, "truth", "pred", "p", by=["g"]), ["g"])
    same(lambda d: A.summarize(d, ["score"], by=["g"]), ["g", "variable"])
    same(lambda d: A.class_weights(d.select("g"), "g").distinct(), ["g"])


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [1, 5, 1, 1, 1e-3] + [0, 1e6, 3, 0, 7]
    x[:, 3] = x[:, 0] * 2 - 1
    x[rng.random((300, 5)) < 0.1] = np.nan
    x[:, 2] = 4.0
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(5))).repartition(7)
    got = {(r["i"], r["j"]): r["r"] for r in E.corr_matrix(df, df.columns).collect()}
    for i in range(5):
        for j in range(5):
            on = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if 2 in (i, j) else float(np.corrcoef(x[on, i], x[on, j])[0, 1])
            assert got[f"c{i}", f"c{j}"] == (None if want is None else pytest.approx(want, abs=1e-7))
    assert E.corr_matrix(df.limit(0), df.columns).filter("r is not null").count() == 0


def _greedy(sites, d):
    out = []
    for c in {s[0] for s in sites}:
        last = None
        for s in sorted((s for s in sites if s[0] == c), key=lambda s: s[1]):
            if last is None or s[1] - last >= d:
                out.append(s)
                last = s[1]
    return set(out)


@pytest.mark.parametrize(("d", "block", "spread"), [(50, 200, 12), (50, 200, 400), (7, 7, 3), (300, 100, 90), (5, 1_000_000, 3)])
def test_greedy_thinning_equals_a_walk(spark, d, block, spread):
    rng = np.random.default_rng(d + spread)
    sites = []
    for c in (1, 2, None):
        pos = np.cumsum(rng.integers(1, spread, 400 if c == 1 else 60)) + (10**6 if c == 2 else 0)
        sites += [(c, int(p), f"rs{c}_{p}") for p in pos]
    df = spark.createDataFrame(sites + [(1, None, "lost")], "chrom int, pos long, variant_id string").repartition(5)
    got = N.greedy_sites(df, d, block)
    assert {tuple(r) for r in got.collect()} == _greedy(sites, d)
    assert N.greedy_sites(df.limit(0), d, block).count() == 0


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(3)
    r = np.where(np.arange(200) % 2 == 0, 1.0, 3.0) + rng.normal(scale=0.2, size=200)
    t = rng.uniform(0, 2 * np.pi, 200)
    return spark.createDataFrame([(i, float(i % 2), float(a * np.cos(b)), float(a * np.sin(b))) for i, (a, b) in enumerate(zip(r, t))],
                                 "row_id long, label_index double, x double, y double")


@pytest.mark.parametrize("kind", ["two", "one"])
def test_kernel_models_score_equally_after_reload_in_a_fresh_session(spark, rings, tmpdir_path, kind):
    learner = M.KernelSVM(cost=5.0, sigma=0.5, n_components=32, n_input=2, max_iter=20) if kind == "two" else M.OneClassSVM(
        nu=0.2, sigma=0.3, n_components=32, n_input=2)
    model = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), learner]).fit(rings)
    col = "margin" if kind == "two" else "decision"
    want = {r["row_id"]: r[col] for r in model.transform(rings).select("row_id", col).collect()}
    path = os.path.join(tmpdir_path, kind)
    SK.save_model(model, path, 1785000001)
    with pytest.raises(ValueError, match="belongs to run"):
        SK.load_model(path, 2)
    assert isinstance(SK.load_model(path, 1785000001), PipelineModel)
    rings.write.parquet(f"{path}/rows")
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from clademl.session import get_spark
from clademl.sources import sinks as SK
spark = get_spark(master="local[2]", driver_memory="1g")
m = SK.load_model({path!r}, 1785000001)
m.transform(spark.read.parquet({path + '/rows'!r})).select("row_id", {col!r}).write.parquet({path + '/scored'!r})
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, capture_output=True, timeout=300)
    got = {r["row_id"]: r[col] for r in spark.read.parquet(f"{path}/scored").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)

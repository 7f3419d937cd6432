"""Committed run folders and nominal indicators."""

import os

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clademl.operators import nominal as NI
from clademl.operators.discovery import RUN_FILES, combine_runs
from clademl.sources import runs as RN


def _tables(spark, mcc, rows, named=True):
    best = spark.createDataFrame([("mcc", mcc), ("accuracy", 0.99)], "metric string, mean double")
    preds = spark.createDataFrame(rows, "row_id string, label string, pred_class string")
    return {RUN_FILES["best"]: best if named else best.drop("metric"), RUN_FILES["metrics"]: best, RUN_FILES["predictions"]: preds,
            RUN_FILES["errors"]: preds.filter("label <> pred_class"), RUN_FILES["discoveries"]: preds.filter("pred_class = 'P'")}


def test_only_committed_runs_are_combined(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "runs")
    assert RN.manifests(spark, root).count() == 0
    RN.write_run(root, 1700000000, _tables(spark, 0.4, [("a", "P", "P"), ("b", "N", "P"), (None, "N", "N")]), {"penalty": 0.1})
    RN.write_run(root, 1700000100, _tables(spark, 0.6, [("c", "P", "N")]), {"penalty": 0.2})
    half = _tables(spark, 0.9, [("x", "P", "P")])
    for name in (RUN_FILES["best"], RUN_FILES["predictions"]):  # cut off half way: no manifest
        RN.write_csv(half[name], f"{root}/1700000200/{name}")
    got = combine_runs(spark, root, "P", committed=True)
    assert {(r["run_ts"], r["TP"], r["FP"], r["FN"], r["TN"]) for r in got["confusion"].collect()} == {(1700000000, 1, 1, 0, 1), (1700000100, 0, 0, 1, 0)}
    assert {(r["run_ts"], r["mean"]) for r in got["best"].collect()} == {(1700000000, 0.4), (1700000100, 0.6)}  # not the accuracy
    assert got["metrics"].count() == 4 and got["errors"].count() == 2 and got["discoveries"].count() == 2
    assert {r["value"] for r in RN.manifests(spark, root).filter("name = 'penalty'").collect()} == {"0.1", "0.2"}
    with pytest.raises(FileExistsError):
        RN.write_run(root, 1700000000, half, {})
    RN.write_run(root, 1700000200, half, {})  # a broken attempt is written anew
    assert RN.read_committed(spark, root, RUN_FILES["predictions"]).filter("run_ts = 1700000200").count() == 1
    RN.write_run(root, 1700000300, _tables(spark, 0.1, [("z", "P", "P")], named=False), {})
    assert RN.new_run_id(1785000000.9) == 1785000000 and RN.new_run_id() > 1_700_000_000


def test_best_files_must_name_their_metrics(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "bare")
    RN.write_run(root, 5, _tables(spark, 0.1, [("z", "P", "P")], named=False), {})
    with pytest.raises(ValueError, match="name their metrics"):
        combine_runs(spark, root, "P", committed=True)


def test_indicators_of_new_null_and_empty_values(spark, tmpdir_path):
    train = spark.createDataFrame([("red", 1), ("", 2), ("blue", None), (None, 1)], "colour string, code int")
    model = NI.NominalIndicators(inputCols=["colour", "code"], outputCol="ind").fit(train)
    assert model.sizes == [5, 4]
    place = {(r["column"], r["level"]): r["ix"] for r in model.levels.collect()}
    rows = [(0, "red", 1), (1, "", 2), (2, "green", 3), (3, None, None), (4, "blue", 1)]
    test = spark.createDataFrame(rows, "row_id long, colour string, code int")

    def check(m):
        got = {r["row_id"]: r["ind"] for r in m.transform(test).collect()}
        for i, colour, code in rows:
            a = 1 if colour is None else place.get(("colour", colour), 0)
            b = 1 if code is None else place.get(("code", str(code)), 0)
            assert got[i].size == 9 and got[i].indices.tolist() == [a, 5 + b] and got[i].values.tolist() == [1.0, 1.0]

    check(model)
    y = test.withColumn("label_index", (F.col("row_id") % 2).cast("double"))
    pipe = Pipeline(stages=[NI.NominalIndicators(inputCols=["colour", "code"], outputCol="ind"),
                            VectorAssembler(inputCols=["ind"], outputCol="features"), LogisticRegression(labelCol="label_index", regParam=0.1)]).fit(y)
    pipe.write().overwrite().save(os.path.join(tmpdir_path, "m"))
    back = PipelineModel.load(os.path.join(tmpdir_path, "m"))
    assert {r["row_id"]: r["prediction"] for r in back.transform(y).collect()} == {r["row_id"]: r["prediction"] for r in pipe.transform(y).collect()}
    model.write().overwrite().save(os.path.join(tmpdir_path, "n"))
    check(NI.NominalIndicatorsModel.load(os.path.join(tmpdir_path, "n")))


def test_many_levels(spark):
    many = spark.range(200_000).select(F.concat(F.lit("v"), "id").alias("name"))
    model = NI.NominalIndicators(inputCols=["name"], outputCol="ind").fit(many)
    assert model.sizes == [200_002]
    out = model.transform(many.filter("name in ('v5', 'v199999')").union(spark.createDataFrame([("w",)], "name string"))).collect()
    assert len({r["ind"].indices[0] for r in out}) == 3 and all(r["ind"].size == 200_002 for r in out)

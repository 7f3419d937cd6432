"""Repeated calls in dosage vectors; classifiers that score in a session with an audit."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from clademl.operators import genotypes as N
from clademl.operators import models as M
from clademl.operators import quality as Q

SCHEMA = "fid string, iid string, chrom int, pos long, variant_id string, a1 string, a2 string, dosage int"


def test_repeated_calls_of_a_dosage_vector_add_up(spark):
    rows = [("F1", "S1", 1, 5, "rs1", "A", "C", 2), ("F1", "S1", 1, 5, "rs1", "A", "C", 1), ("F1", "S1", 1, 5, "rs1", "A", "C", None),
            ("F1", "S1", 1, 6, "rs2", "A", "C", 0), ("F1", None, 2, None, "rs3", "A", "C", 1), ("F1", None, 2, None, "rs3", "A", "C", 1)]
    got = {r["iid"]: r["features"] for r in N.dosage_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: sorted(v.values.tolist()) for k, v in got.items()} == {"S1": [0.0, 3.0], None: [2.0]}
    assert all(v.size == 3 for v in got.values())


def test_classifiers_score_after_an_audit(spark):
    d = spark.createDataFrame([(i, float(i % 5), float(i > 9)) for i in range(20)], "row_id long, a double, label_index double")
    kept, n = Q.audit(d.filter("a > 0"), "some")
    assert kept.count() == 16 and n.get["rows"] == 16
    for learner in (M.lasso_logit(0.01), M.forest(trees=2)):
        m = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), learner]).fit(kept)
        assert len(m.transform(d).collect()) == 20

"""Dosage vectors read without one number for every variant."""

from pyspark.sql import functions as F

from tests.test_block_passes import _plan


def test_wide_vectors_are_read_as_sparse_as_they_are(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(s, p, 10 * s + p) for s in range(1, 6) for p in range(1, 40) if (s * p) % 3]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries()["n10_dosage_vectors"](spark, str(tmp_path))
    assert "vector_to_array" not in _plan(got) and "aggregate(" not in _plan(got).lower().replace("hashaggregate(", "").replace("objecthashaggregate(", "")
    from clademl.plans import fixtures as fx

    want = {(r["fid"], r["iid"]): r["s"] for r in fx.fx5(spark, str(tmp_path)).filter("dosage is not null").groupBy("fid", "iid").agg(F.sum("dosage").alias("s")).collect()}
    assert {(r["fid"], r["iid"]): r["dosage_sum"] for r in got.collect()} == want and got.first()["size"] == len({p for _, p, _ in rows})

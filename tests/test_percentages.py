"""Dinucleotide percentages: overlapping pairs, worked out once a document whatever filters follow."""

import os

from clademl.operators.quality import complete_cases
from clademl.plans import fixtures as fx


def test_percentages_are_worked_out_once_a_document(spark, tmpdir_path):
    texts = [(1, "aaAxa-cc g"), (2, "t"), (3, None), (4, "GATTACA tt"), (4, "AAAA")]
    spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string").write.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, quality int").write.parquet(os.path.join(tmpdir_path, "labels.parquet"))
    cols = [f"pct_{xy.lower()}" for xy in fx.DINUCLEOTIDES]
    d = fx.fx2(spark, tmpdir_path)
    kept = complete_cases(d, cols)
    seqs = {(i, "".join(c for c in (t or "").upper() if c in "ACGT")) for i, t in texts}
    want = sorted((i, *(round(100 * sum(s[k : k + 2] == xy for k in range(len(s) - 1)) / (len(s) - 1), 9) for xy in fx.DINUCLEOTIDES)) for i, s in seqs if len(s) > 1)
    assert sorted((r["species"], *(round(r[c], 9) for c in cols)) for r in kept.collect()) == want and d.count() == 5
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 10

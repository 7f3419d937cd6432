"""Registered queries: sources, projections, filters, joins, aggregates, windows, set ops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import order_key
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import shape as P
from ..sources import tables as S
from . import fixtures as fx
from .fixtures import FX1_SQL, FX2_SQL, FX3_SQL, FX4_SQL, FX5_SQL, FX6_SQL, with_ctes
from .registry import query, r6

PRED_SQL = "CASE WHEN p_nonprobiotic >= 0.5 THEN 'Nonprobiotic' ELSE 'Probiotic' END"


def scored(spark, sf):
    """FX3 with the thresholded prediction."""
    return P.threshold_class(fx.fx3(spark, sf), "p_nonprobiotic", fx.NEG, fx.POS)


FX3P_SQL = FX3_SQL + f", fx3p AS (SELECT *, {PRED_SQL} AS pred_class FROM fx3)"

# ---------------------------------------------------------------- sources
CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("s1_read_table", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s1(spark, sf):
    return S.read_table(spark, f"{sf}/customer.parquet", CUSTOMER_SCHEMA).select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


_CODED = ("CASE c_custkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '.' WHEN 2 THEN ' - ' "
          "ELSE CAST(c_acctbal AS VARCHAR) END")


def _coded(spark, sf):
    c = S.read_table(spark, f"{sf}/customer.parquet")
    k = F.col("c_custkey") % 7
    txt = F.when(k == 0, "NA").when(k == 1, ".").when(k == 2, " - ").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", txt.alias("acctbal_txt"), "c_mktsegment")


@query("s3_nullify", f"SELECT c_custkey, TRY_CAST(CASE WHEN trim(t) IN ('.', '-', 'NA') THEN NULL ELSE t END AS DOUBLE) AS acctbal "
       f"FROM (SELECT c_custkey, {_CODED} AS t FROM customer)")
def s3(spark, sf):
    d = S.nullify(_coded(spark, sf), ["acctbal_txt"])
    return S.to_double(d, ["acctbal_txt"]).select("c_custkey", F.col("acctbal_txt").alias("acctbal"))


@query("s4_decimal_comma", "SELECT c_custkey, TRY_CAST(replace(replace(CAST(c_acctbal AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) "
       "AS acctbal FROM customer")
def s4(spark, sf):
    c = S.read_table(spark, f"{sf}/customer.parquet")
    c = c.select("c_custkey", F.regexp_replace(F.col("c_acctbal").cast("string"), r"\.", ",").alias("acctbal"))
    return S.parse_decimal_comma(c, ["acctbal"])


@query("s10_read_lines",
       "SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ("
       "SELECT doc_id, regexp_replace(l, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS line "
       "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) "
       "WHERE length(line) > 0 GROUP BY doc_id")
def s10(spark, sf):
    d = fx.table(spark, sf, "documents")
    lines = S.text_lines(d, "text", ["doc_id"])
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


# ---------------------------------------------------------------- projections
FEATS_SQL = ", ".join(fx.FEATURES)


@query("p1_drop_cols", with_ctes(FX1_SQL) + "SELECT * EXCLUDE (taxon, habitat) FROM fx1")
def p1(spark, sf):
    return P.drop_cols(fx.fx1(spark, sf), "taxon", "habitat")


@query("p2_front", with_ctes(FX1_SQL) + "SELECT label, organism, row_id, f01 FROM fx1")
def p2(spark, sf):
    return P.front(fx.fx1(spark, sf).select("row_id", "f01", "organism", "label"), "label", "organism")


@query("p3_rename", with_ctes(FX1_SQL) + "SELECT row_id, organism AS Organism_Name, label AS Label FROM fx1")
def p3(spark, sf):
    return P.rename(fx.fx1(spark, sf).select("row_id", "organism", "label"), {"organism": "Organism_Name", "label": "Label"})


@query("p4_numeric_cols", with_ctes(FX1_SQL) + "SELECT row_id, " + FEATS_SQL + " FROM fx1")
def p4(spark, sf):
    d = fx.fx1(spark, sf)
    return d.select("row_id", *P.numeric_cols(d, exclude=["row_id"]))


@query("p5_cols_like", with_ctes(FX1_SQL) + "SELECT row_id, " + ", ".join(f"f0{i}" for i in range(1, 10)) + " FROM fx1")
def p5(spark, sf):
    d = fx.fx1(spark, sf)
    return d.select("row_id", *P.cols_like(d, "f0"))


@query("p6_project_features", with_ctes(FX1_SQL) + "SELECT row_id, label, organism, f03, f10, f33 FROM fx1")
def p6(spark, sf):
    return P.project_features(fx.fx1(spark, sf), ["row_id", "label", "organism"], ["f03", "f10", "f33"])


@query("p7_strand_average", with_ctes(FX2_SQL) + "SELECT species, ordo, outcome, " + ", ".join(
    f"round((pct_{a.lower()} + pct_{b.lower()}) / 2, 6) AS {a}_{b}_avg" for a, b in P.STRAND_PAIRS) + " FROM fx2")
def p7(spark, sf):
    return r6(P.strand_average(fx.fx2(spark, sf)))


@query("p8_constant", with_ctes(FX1_SQL) + "SELECT row_id, 'Probiotic' AS label, 'strains' AS problem FROM fx1 "
       "WHERE label = 'Probiotic'")
def p8(spark, sf):
    d = Q.keep_class(fx.fx1(spark, sf), "label", fx.POS).select("row_id")
    return P.constant(P.constant(d, "label", fx.POS), "problem", "strains")


@query("p9_encode_label", with_ctes(FX3_SQL) + "SELECT row_id, label, CASE label WHEN 'Nonprobiotic' THEN 0.0 "
       "WHEN 'Probiotic' THEN 1.0 END::DOUBLE AS label_index FROM fx3")
def p9(spark, sf):
    return P.encode_label(fx.fx3(spark, sf).select("row_id", "label"), "label", fx.LEVELS)


@query("p10_method_names", with_ctes(FX3_SQL) + "SELECT row_id, CASE l_suppkey % 4 + 1 WHEN 1 THEN 'RLR' WHEN 2 THEN 'RF' "
       "WHEN 3 THEN 'SVM' ELSE 'NN' END AS methods FROM fx3")
def p10(spark, sf):
    d = fx.fx3(spark, sf).select("row_id", (F.col("l_suppkey") % 4 + 1).alias("methods"))
    # Method index -> name of the replicate study.
    return P.method_names(d, "methods", {1: "RLR", 2: "RF", 3: "SVM"}, "NN")


@query("p11_argmax_class", with_ctes(FX3_SQL) + "SELECT row_id, CASE WHEN p_nonprobiotic >= p_probiotic THEN 'Nonprobiotic' "
       "ELSE 'Probiotic' END AS pred_class FROM fx3")
def p11(spark, sf):
    d = fx.fx3(spark, sf).select("row_id", "p_nonprobiotic", "p_probiotic")
    return P.argmax_class(d, {fx.NEG: "p_nonprobiotic", fx.POS: "p_probiotic"}).select("row_id", "pred_class")


@query("p12_threshold_class", with_ctes(FX3P_SQL) + "SELECT row_id, pred_class FROM fx3p")
def p12(spark, sf):
    return scored(spark, sf).select("row_id", "pred_class")


@query("p13_attach", with_ctes(FX3P_SQL) + "SELECT p.row_id, o.o_orderpriority, o.o_orderstatus, p.label, p.pred_class "
       "FROM orders o JOIN fx3p p ON o.o_orderkey = p.l_orderkey")
def p13(spark, sf):
    meta = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    preds = scored(spark, sf).select("l_orderkey", "row_id", "label", "pred_class")
    return P.attach(meta, preds, on="l_orderkey").drop("l_orderkey")


@query("p16_tidy_round", with_ctes(FX3_SQL) + "SELECT method, run_ts, CASE WHEN abs(m - round(m, 0)) < 1.49e-8 THEN m "
       "ELSE round(m, 2) END AS mean_qty FROM (SELECT method, run_ts, avg(l_linenumber) AS m FROM fx3 GROUP BY ALL)")
def p16(spark, sf):
    d = fx.fx3(spark, sf).groupBy("method", "run_ts").agg(F.avg("l_linenumber").alias("mean_qty"))
    return P.tidy_round(d, ["mean_qty"], 2)


@query("p16_round_text", with_ctes(FX1_SQL) + "SELECT row_id, " + ", ".join(f"printf('%.3f', round({c}, 3)) AS {c}" for c in ("f01", "f65", "f66")) + " FROM fx1")
def p16t(spark, sf):
    return P.round_text(fx.fx1(spark, sf).select("row_id", "f01", "f65", "f66"), ["f01", "f65", "f66"], 3)


# ---------------------------------------------------------------- filters
_EXCL = "'org_1', 'org_2', " + ", ".join(f"'{s}'" for s in Q.STRAINS_TO_REMOVE)


@query("f1_filter", with_ctes(FX6_SQL) + "SELECT strain, target_raw FROM fx6 WHERE confirmed = 'Yes' AND genome = 'YES'")
def f1(spark, sf):
    d = fx.fx6(spark, sf)
    return d.filter((F.col("confirmed") == "Yes") & (F.col("genome") == "YES")).select("strain", "target_raw")


@query("f2_exclude", with_ctes(FX1_SQL) + f"SELECT row_id, organism FROM fx1 WHERE organism NOT IN ({_EXCL})")
def f2(spark, sf):
    return Q.exclude(fx.fx1(spark, sf).select("row_id", "organism"), "organism",
                     ["org_1", "org_2", *Q.STRAINS_TO_REMOVE])


@query("f3_keep_class", with_ctes(FX1_SQL) + "SELECT row_id, label FROM fx1 WHERE label = 'Probiotic'")
def f3(spark, sf):
    return Q.keep_class(fx.fx1(spark, sf), "label", fx.POS).select("row_id", "label")


@query("f4_complete_cases", with_ctes(FX1_SQL) + "SELECT row_id, label FROM fx1 WHERE habitat IS NOT NULL AND "
       + " AND ".join(f"{c} IS NOT NULL" for c in fx.FEATURES))
def f4(spark, sf):
    return Q.complete_cases(fx.fx1(spark, sf)).select("row_id", "label")


_F5_COLS = ["label", "habitat", *fx.FEATURES]


@query("f5_missing_report", with_ctes(FX1_SQL) + "SELECT * FROM (UNPIVOT (SELECT "
       + ", ".join(f"count_if({c} IS NULL) AS {c}" for c in _F5_COLS)
       + ", " + " + ".join(f"count_if({c} IS NULL)" for c in _F5_COLS) + " AS __total__, count_if("
       + " OR ".join(f"{c} IS NULL" for c in _F5_COLS) + ") AS __rows__ FROM fx1) ON COLUMNS(*) INTO NAME variable VALUE n_missing)")
def f5(spark, sf):
    return Q.missing_report(fx.fx1(spark, sf), _F5_COLS)


@query("f6_drop_failed", with_ctes(FX4_SQL) + "SELECT cell_id, rep, fold, mean FROM (SELECT cell_id, rep, fold, "
       "CASE WHEN cell_id % 7 = 3 THEN NULL ELSE round(mcc, 6) END AS mean FROM fx4) WHERE mean IS NOT NULL")
def f6(spark, sf):
    d = fx.fx4(spark, sf).select("cell_id", "rep", "fold",
                                 F.when(F.col("cell_id") % 7 == 3, F.lit(None)).otherwise(F.round("mcc", 6)).alias("mean"))
    return Q.drop_failed(d, "mean")


@query("f8_drop_by_mean", with_ctes(FX5_SQL) + "SELECT variant_id, count(*) AS n FROM fx5 WHERE variant_id IN ("
       "SELECT variant_id FROM fx5 GROUP BY variant_id HAVING avg(dosage) >= 0.05 AND avg(dosage) <= 1.95) GROUP BY variant_id")
def f8(spark, sf):
    return Q.drop_by_mean(fx.fx5(spark, sf), "variant_id", "dosage").groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n"))


_CTRL_RE = "^(HG00264|HG00097)(_[0-9]+)?$"


@query("f9_drop_samples", with_ctes(FX5_SQL) + f"SELECT fid, iid, variant_id, dosage FROM fx5 WHERE NOT regexp_matches(iid, '{_CTRL_RE}')")
def f9(spark, sf):
    return Q.drop_samples(fx.fx5(spark, sf), "iid", fx.CONTROL_SAMPLES).select("fid", "iid", "variant_id", "dosage")


@query("f10_audit", with_ctes(FX1_SQL) + "SELECT 'read' AS step, count(*) AS rows FROM fx1 UNION ALL "
       "SELECT 'complete_cases', count(*) FROM fx1 WHERE habitat IS NOT NULL AND f65 IS NOT NULL")
def f10(spark, sf):
    """Both counts come from :func:`audit`."""
    d, read = Q.audit(fx.fx1(spark, sf), "read")
    _, complete = Q.audit(Q.complete_cases(d), "complete_cases")
    return spark.createDataFrame([("read", read.get["rows"]), ("complete_cases", complete.get["rows"])], "step string, rows long")


@query("f11_errors", with_ctes(FX3P_SQL) + "SELECT row_id, label, pred_class FROM fx3p WHERE label <> pred_class")
def f11(spark, sf):
    return Q.errors(scored(spark, sf)).select("row_id", "label", "pred_class")


@query("f12_decision_label", with_ctes(FX3_SQL) + "SELECT row_id, CASE WHEN p_probiotic - 0.5 < 0 THEN 'outlier' "
       "ELSE 'inlier' END AS predicted_label FROM fx3")
def f12(spark, sf):
    d = fx.fx3(spark, sf).select("row_id", (F.col("p_probiotic") - 0.5).alias("decision"))
    return Q.decision_label(d).select("row_id", "predicted_label")


# ---------------------------------------------------------------- joins
@query("j2_keep_samples", with_ctes(FX5_SQL) + "SELECT fid, iid, variant_id FROM fx5 WHERE (fid, iid) IN ("
       "SELECT ('F' || CAST(s_suppkey % 10 AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_nationkey < 20)")
def j2(spark, sf):
    su = fx.table(spark, sf, "supplier").filter(F.col("s_nationkey") < 20)
    keep = su.select(F.concat(F.lit("F"), (F.col("s_suppkey") % 10).cast("string")).alias("fid"),
                     F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("iid"))
    return J.keep_samples(fx.fx5(spark, sf), keep).select("fid", "iid", "variant_id")


_ACC_SQL = "regexp_replace(refseq_ftp, '^.*/', '')"


@query("j3_pending", with_ctes(FX6_SQL) + f"SELECT {_ACC_SQL} AS accession FROM fx6 WHERE {_ACC_SQL} NOT IN ("
       "SELECT regexp_replace(f.refseq_ftp, '^.*/', '') FROM fx6 f JOIN supplier s ON f.strain = 'strain_' || CAST(s.s_suppkey AS VARCHAR) "
       "WHERE s.s_acctbal > 0)")
def j3(spark, sf):
    from ..functions.exprs import last_segment

    d = fx.fx6(spark, sf).select("strain", last_segment("refseq_ftp").alias("accession"))
    su = fx.table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0).select(
        F.concat(F.lit("strain_"), F.col("s_suppkey").cast("string")).alias("strain"))
    existing = d.join(su, "strain", "left_semi")
    return J.pending(d.select("accession"), existing)


@query("j4_resolve_accessions", with_ctes(FX6_SQL) + "SELECT i.nc, m.gcf, m.gcf IS NOT NULL AS resolved FROM "
       "(SELECT 'NC_' || CAST(s_suppkey AS VARCHAR) AS nc FROM supplier) i LEFT JOIN "
       "(SELECT 'NC_' || substr(strain, 8) AS nc, regexp_replace(refseq_ftp, '^.*/', '') AS gcf FROM fx6 f "
       "JOIN supplier s ON f.strain = 'strain_' || CAST(s.s_suppkey AS VARCHAR) WHERE s.s_acctbal > 0) m ON i.nc = m.nc")
def j4(spark, sf):
    from ..functions.exprs import last_segment

    su = fx.table(spark, sf, "supplier")
    ids = su.select(F.concat(F.lit("NC_"), F.col("s_suppkey").cast("string")).alias("nc"))
    pos = su.filter(F.col("s_acctbal") > 0).select(F.concat(F.lit("strain_"), F.col("s_suppkey").cast("string")).alias("strain"))
    mapping = fx.fx6(spark, sf).join(pos, "strain", "left_semi").select(
        F.concat(F.lit("NC_"), F.substring("strain", 8, 100)).alias("nc"), last_segment("refseq_ftp").alias("gcf"))
    resolved, unresolved = J.resolve_accessions(ids, mapping, "nc", "gcf")
    return resolved.withColumn("resolved", F.lit(True)).unionByName(
        unresolved.withColumn("gcf", F.lit(None).cast("string")).withColumn("resolved", F.lit(False)))


@query("j5_with_scalars", with_ctes(FX3_SQL) + "SELECT row_id, round(p_probiotic - (SELECT avg(p_probiotic) FROM fx3), 6) "
       "AS p_centered FROM fx3")
def j5(spark, sf):
    d = fx.fx3(spark, sf)
    stats = d.agg(F.avg("p_probiotic").alias("p_mean"))
    return r6(J.with_scalars(d, stats).select("row_id", (F.col("p_probiotic") - F.col("p_mean")).alias("p_centered")))


# ---------------------------------------------------------------- aggregates
@query("a1_class_counts", with_ctes(FX3_SQL) + "SELECT method, label, count(*) AS n FROM fx3 GROUP BY ALL")
def a1(spark, sf):
    return A.class_counts(fx.fx3(spark, sf), "label", by=["method"])


def curated(spark, sf):
    from ..operators.strains import curate

    return curate(fx.fx6(spark, sf))


@query("a2_crosstab", with_ctes(FX6_SQL) + "SELECT lower(genome) AS ncbi_genome, count_if(lower(confirmed) = 'no') AS no, "
       "count_if(lower(confirmed) = 'yes') AS yes FROM fx6 GROUP BY ALL")
def a2(spark, sf):
    c = A.crosstab(curated(spark, sf), "ncbi_genome", "probiotic", ["no", "yes"])
    return c.fillna(0, ["no", "yes"])


_PCT = [f"pct_{x.lower()}" for x in fx.DINUCLEOTIDES]


@query("a3_describe_numeric", with_ctes(FX2_SQL) + "SELECT variable, round(mean, 6) AS mean, round(sd, 6) AS sd FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS variable, avg({c}) AS mean, stddev_samp({c}) AS sd FROM fx2" for c in _PCT) + ")")
def a3(spark, sf):
    return r6(A.describe_numeric(fx.fx2(spark, sf), _PCT))


_A4_COLS = fx.FEATURES


@query("a4_summarize", with_ctes(FX1_SQL) + "SELECT variable, count(x) AS n, count_if(x IS NULL) AS n_missing, round(avg(x), 6) AS mean, "
       "round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, "
       "round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max FROM (SELECT " + ", ".join(_A4_COLS)
       + " FROM fx1) UNPIVOT INCLUDE NULLS (x FOR variable IN (" + ", ".join(_A4_COLS) + ")) GROUP BY variable")
def a4(spark, sf):
    return r6(A.summarize(fx.fx1(spark, sf), _A4_COLS))


@query("a5_corr_matrix", with_ctes(FX2_SQL) + "SELECT a.c AS i, b.c AS j, round(corr(a.x, b.x), 6) AS r FROM "
       "(UNPIVOT (SELECT species, " + ", ".join(_PCT) + " FROM fx2 WHERE pct_aa IS NOT NULL) ON " + ", ".join(_PCT)
       + " INTO NAME c VALUE x) a JOIN (UNPIVOT (SELECT species, " + ", ".join(_PCT)
       + " FROM fx2 WHERE pct_aa IS NOT NULL) ON " + ", ".join(_PCT) + " INTO NAME c VALUE x) b ON a.species = b.species "
       "GROUP BY a.c, b.c")
def a5(spark, sf):
    from ..operators.recipe import corr_matrix

    return r6(corr_matrix(Q.complete_cases(fx.fx2(spark, sf), _PCT), _PCT))


@query("a6_histogram", with_ctes(FX3_SQL) + "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM ("
       "SELECT bin, mn + bin * w AS lo, mn + (bin + 1) * w AS hi, count(*) AS n FROM (SELECT CAST(least(floor((p_probiotic - mn) / w), 19) AS INTEGER) AS bin, mn, w "
       "FROM fx3, (SELECT min(p_probiotic) AS mn, (max(p_probiotic) - min(p_probiotic)) / 20 AS w FROM fx3)) GROUP BY bin, mn, w)")
def a6(spark, sf):
    return r6(A.histogram(fx.fx3(spark, sf), "p_probiotic", 20))


@query("a10_melt", with_ctes(FX1_SQL) + "SELECT row_id, key, value FROM (UNPIVOT (SELECT row_id, f01, f02, f03 FROM fx1) "
       "ON f01, f02, f03 INTO NAME key VALUE value)")
def a10(spark, sf):
    return A.melt(fx.fx1(spark, sf), ["row_id"], ["f01", "f02", "f03"])


@query("a13_confusion_by_run", with_ctes(FX3P_SQL) + "SELECT run_ts, count_if(label = 'Probiotic' AND pred_class = 'Probiotic') AS TP, "
       "count_if(label <> 'Probiotic' AND pred_class <> 'Probiotic') AS TN, count_if(label <> 'Probiotic' AND pred_class = 'Probiotic') AS FP, "
       "count_if(label = 'Probiotic' AND pred_class <> 'Probiotic') AS FN FROM fx3p GROUP BY run_ts")
def a13(spark, sf):
    return A.confusion_by(scored(spark, sf), ["run_ts"], "label", "pred_class", fx.POS)


_CONF_SQL = ("SELECT method, run_ts, count_if(label = 'Probiotic' AND pred_class = 'Probiotic') AS TP, "
             "count_if(label <> 'Probiotic' AND pred_class <> 'Probiotic') AS TN, count_if(label <> 'Probiotic' AND pred_class = 'Probiotic') AS FP, "
             "count_if(label = 'Probiotic' AND pred_class <> 'Probiotic') AS FN FROM fx3p GROUP BY ALL")


@query("a14_mean_confusion", with_ctes(FX3P_SQL, f"c AS ({_CONF_SQL})", "m AS (SELECT method, avg(TP) AS TP, avg(TN) AS TN, avg(FP) AS FP, avg(FN) AS FN FROM c GROUP BY method)")
       + "SELECT method, 'TP' AS cell, 'Probiotic' AS truth, 'Probiotic' AS prediction, round(TP, 6) AS mean_n FROM m UNION ALL "
         "SELECT method, 'TN', 'Nonprobiotic', 'Nonprobiotic', round(TN, 6) FROM m UNION ALL "
         "SELECT method, 'FP', 'Nonprobiotic', 'Probiotic', round(FP, 6) FROM m UNION ALL "
         "SELECT method, 'FN', 'Probiotic', 'Nonprobiotic', round(FN, 6) FROM m")
def a14(spark, sf):
    c = A.confusion_by(scored(spark, sf), ["method", "run_ts"], "label", "pred_class", fx.POS)
    return r6(A.mean_confusion(c, "method", fx.POS, fx.NEG))


@query("a15_conf_mat", with_ctes(FX3P_SQL, "lv AS (SELECT unnest(['Nonprobiotic', 'Probiotic']) AS v), ms AS (SELECT DISTINCT method FROM fx3p)")
       + "SELECT ms.method, t.v AS truth, p.v AS prediction, (SELECT count(*) FROM fx3p x WHERE x.method = ms.method AND x.label = t.v "
         "AND x.pred_class = p.v) AS n FROM ms, lv t, lv p")
def a15(spark, sf):
    return A.conf_mat(scored(spark, sf), "label", "pred_class", fx.LEVELS, by=["method"])


@query("a16_mismatch_count", with_ctes(FX3P_SQL) + "SELECT method, count_if(label <> pred_class) AS n_mismatch, count(*) AS n FROM fx3p GROUP BY method")
def a16(spark, sf):
    return A.mismatch_count(scored(spark, sf), "label", "pred_class", by=["method"])


@query("a17_distinct", with_ctes(FX3_SQL) + "SELECT DISTINCT method FROM fx3")
def a17(spark, sf):
    return fx.fx3(spark, sf).select("method").distinct()


@query("a18_class_weights", with_ctes(FX1_SQL) + "SELECT row_id, label, round(N / (K * nc), 6) AS weight FROM fx1 JOIN "
       "(SELECT label, count(*) AS nc, sum(count(*)) OVER () AS N, count(*) OVER () AS K FROM fx1 GROUP BY label) USING (label)")
def a18(spark, sf):
    return r6(A.class_weights(fx.fx1(spark, sf).select("row_id", "label"), "label"))


# ---------------------------------------------------------------- windows / top-k
@query("w2_argmax_rows", with_ctes(FX3_SQL) + "SELECT run_ts, row_id, p_probiotic FROM fx3 WHERE (run_ts, p_probiotic) IN "
       "(SELECT (run_ts, max(p_probiotic)) FROM fx3 GROUP BY run_ts)")
def w2(spark, sf):
    return W.argmax_rows(fx.fx3(spark, sf).select("run_ts", "row_id", "p_probiotic"), ["run_ts"], "p_probiotic")


@query("w6_preview", with_ctes(FX1_SQL) + "SELECT row_id, organism, label FROM fx1 ORDER BY row_id LIMIT 6")
def w6(spark, sf):
    return fx.fx1(spark, sf).select("row_id", "organism", "label").orderBy("row_id").limit(6)


@query("w7_global_rank", with_ctes(FX3_SQL) + "SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY "
       "md5(concat_ws('|', '42', row_id))) AS rank FROM fx3")
def w7(spark, sf):
    d = fx.fx3(spark, sf).select("row_id", "label")
    return W.global_rank(d, order_key(42, "row_id"), strata=["label"]).select("row_id", "label", "rank")


# ---------------------------------------------------------------- set operations
@query("u1_union_loose", with_ctes(FX1_SQL) + "SELECT row_id, organism, label FROM fx1 WHERE label = 'Probiotic' UNION ALL "
       "SELECT row_id + 1000000, organism, NULL FROM fx1 WHERE label = 'Nonprobiotic'")
def u1(spark, sf):
    d = fx.fx1(spark, sf)
    pos = Q.keep_class(d, "label", fx.POS).select("row_id", "organism", "label")
    extra = Q.keep_class(d, "label", fx.NEG).select((F.col("row_id") + 1000000).alias("row_id"), "organism")
    return P.union_loose(pos, extra)


@query("u2_union_strict", with_ctes(FX3P_SQL, f"c AS ({_CONF_SQL})") + "SELECT * FROM c WHERE method IN ('RLR', 'RF') "
       "UNION ALL SELECT * FROM c WHERE method IN ('SVM', 'NN')")
def u2(spark, sf):
    c = A.confusion_by(scored(spark, sf), ["method", "run_ts"], "label", "pred_class", fx.POS)
    return P.union_strict(c.filter(F.col("method").isin("RLR", "RF")), c.filter(F.col("method").isin("SVM", "NN")))


@query("u3_rest", with_ctes(FX1_SQL) + "SELECT row_id, label FROM fx1 WHERE row_id NOT IN (SELECT row_id FROM "
       "(SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '7', row_id))) AS rk FROM fx1) "
       "WHERE rk <= 5)")
def u3(spark, sf):
    d = fx.fx1(spark, sf).select("row_id", "label")
    ranked = W.global_rank(d, order_key(7, "row_id"), strata=["label"], rank_col="rk")
    return P.rest(d, ranked.filter(F.col("rk") <= 5))


@query("a6_pair_sample", with_ctes(FX1_SQL) + "SELECT row_id, f01, f02, f03 FROM fx1 ORDER BY md5(concat_ws('|', '42', row_id)) LIMIT 50")
def a6s(spark, sf):
    """A bounded sample for pairwise plots: the limit is the operator (a sampling feature)."""
    return A.pair_sample(fx.fx1(spark, sf), ["f01", "f02", "f03"], 50, seed=42)


@query("p15_feature_spec", with_ctes(FX1_SQL) + "SELECT row_id, label, " + ", ".join(fx.FEATURES) + ", organism, taxon, habitat FROM fx1")
def p15(spark, sf):
    from ..spec import FeatureSpec

    d = fx.fx1(spark, sf)
    return FeatureSpec.from_df(d, "label", ids=["row_id"]).select(d)

"""Registered queries: genotype filters, imputation, kinship, dosage vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotypes as N
from . import fixtures as fx
from .fixtures import FX5_SQL, with_ctes
from .registry import query, r6

_ST_SQL = ("st AS (SELECT variant_id, count(*) AS n, count_if(dosage IS NULL) AS n_missing, count_if(dosage IS NULL) / count(*) AS miss, "
           "avg(dosage) / 2 AS p, least(avg(dosage) / 2, 1 - avg(dosage) / 2) AS maf FROM fx5 GROUP BY variant_id)")


@query("n1_remove_controls", with_ctes(FX5_SQL) + "SELECT DISTINCT fid, iid FROM fx5 WHERE NOT regexp_matches(iid, '^(HG00264|HG00097)(_[0-9]+)?$')")
def n1(spark, sf):
    return N.remove_controls(fx.fx5(spark, sf), fx.CONTROL_SAMPLES).select("fid", "iid").distinct()


@query("n2_autosomes", with_ctes(FX5_SQL) + "SELECT DISTINCT variant_id, chrom FROM fx5 WHERE chrom BETWEEN 1 AND 22")
def n2(spark, sf):
    return N.autosomes(fx.fx5(spark, sf)).select("variant_id", "chrom").distinct()


@query("n3_snps_only", with_ctes(FX5_SQL) + "SELECT DISTINCT variant_id, a1, a2 FROM fx5 WHERE a1 IN ('A', 'C', 'G', 'T') AND a2 IN ('A', 'C', 'G', 'T')")
def n3(spark, sf):
    return N.snps_only(fx.fx5(spark, sf)).select("variant_id", "a1", "a2").distinct()


@query("n4_geno_filter", with_ctes(FX5_SQL, _ST_SQL) + "SELECT variant_id, round(miss, 6) AS miss FROM st WHERE miss <= 0.01")
def n4(spark, sf):
    st = N.variant_stats(fx.fx5(spark, sf))
    return r6(st.filter(F.col("miss") <= N.GENO_MAX).select("variant_id", "miss"))


@query("n4_geno_filter_calls", with_ctes(FX5_SQL, _ST_SQL) + "SELECT count(*) AS calls, count(DISTINCT variant_id) AS variants FROM fx5 "
       "WHERE variant_id IN (SELECT variant_id FROM st WHERE miss <= 0.01)")
def n4c(spark, sf):
    g = N.geno_filter(fx.fx5(spark, sf))
    return g.agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("variant_id").alias("variants"))


@query("n5_maf_filter", with_ctes(FX5_SQL, _ST_SQL) + "SELECT variant_id, round(maf, 6) AS maf FROM st WHERE maf >= 0.01")
def n5(spark, sf):
    return r6(N.variant_stats(N.maf_filter(fx.fx5(spark, sf))).select("variant_id", "maf"))


def _hwe_sql(stats: str) -> list[str]:
    """Exact test per genotype-count triple of ``stats``: every heterozygote count with its log probability."""
    return [
        f"tr AS (SELECT DISTINCT n0, n1, n2, n0 + n1 + n2 AS n, 2 * least(n0, n2) + n1 AS rare FROM {stats})",
        "hets AS (SELECT n0, n1, n2, n, rare, unnest(range(rare % 2, rare + 1, 2)) AS h FROM tr)",
        "lp AS (SELECT n0, n1, n2, h, h * ln(2.0) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma(n - h - (rare - h) / 2 + 1) AS l FROM hets)",
        "sn AS (SELECT *, max(CASE WHEN h = n1 THEN l END) OVER (PARTITION BY n0, n1, n2) AS seen, max(l) OVER (PARTITION BY n0, n1, n2) AS top FROM lp)",
        "hw AS (SELECT n0, n1, n2, least(1.0, sum(CASE WHEN l <= seen + 1e-9 THEN exp(l - top) ELSE 0 END) / sum(exp(l - top))) AS p_hwe FROM sn GROUP BY n0, n1, n2)",
    ]


_COUNTS = "count(CASE WHEN dosage = 0 THEN 1 END) AS n0, count(CASE WHEN dosage = 1 THEN 1 END) AS n1, count(CASE WHEN dosage = 2 THEN 1 END) AS n2"


@query("n6_hwe_pvalues", with_ctes(FX5_SQL, f"cs AS (SELECT variant_id, {_COUNTS} FROM fx5 GROUP BY variant_id)", *_hwe_sql("cs"))
       + "SELECT variant_id, n0, n1, n2, round(p_hwe, 6) AS p_hwe FROM cs JOIN hw USING (n0, n1, n2)")
def n6(spark, sf):
    return r6(N.hwe_pvalues(N.variant_stats(fx.fx5(spark, sf))).select("variant_id", "n0", "n1", "n2", "p_hwe"))


@query("n4_n6_qc_filter", with_ctes(
    FX5_SQL, "q AS (SELECT * FROM fx5 WHERE NOT regexp_matches(iid, '^(" + "|".join(fx.CONTROL_SAMPLES) + ")(_[0-9]+)?$') AND chrom BETWEEN 1 AND 22 "
    "AND a1 IN ('A', 'C', 'G', 'T') AND a2 IN ('A', 'C', 'G', 'T'))",
    f"cs AS (SELECT variant_id, {_COUNTS}, avg(CASE WHEN dosage IS NULL THEN 1.0 ELSE 0.0 END) AS miss, avg(dosage) / 2 AS p FROM q GROUP BY variant_id)",
    *_hwe_sql("cs")) + "SELECT variant_id FROM cs JOIN hw USING (n0, n1, n2) WHERE miss <= 0.01 AND least(p, 1 - p) >= 0.01 AND p_hwe >= 1e-6")
def n46(spark, sf):
    g = N.remove_controls(fx.fx5(spark, sf), fx.CONTROL_SAMPLES)
    g = N.snps_only(N.autosomes(g))
    return N.qc_filter(g).select("variant_id").distinct()


@query("n7_bp_space", with_ctes(FX5_SQL) + "SELECT DISTINCT chrom, pos, variant_id FROM fx5 WHERE variant_id IN "
       "(SELECT min(variant_id) FROM fx5 GROUP BY chrom, pos)")
def n7(spark, sf):
    return N.bp_space(fx.fx5(spark, sf)).select("chrom", "pos", "variant_id").distinct()


@query("n8_impute_dosage", with_ctes(FX5_SQL) + "SELECT fid, iid, variant_id, CAST(coalesce(dosage, round(avg(dosage) OVER (PARTITION BY variant_id))) "
       "AS INTEGER) AS dosage FROM fx5")
def n8(spark, sf):
    return N.impute_dosage(fx.fx5(spark, sf)).select("fid", "iid", "variant_id", "dosage")


@query("n9_kinship", with_ctes(
    FX5_SQL, "st AS (SELECT variant_id, avg(dosage) / 2 AS p FROM fx5 GROUP BY variant_id)",
    "z AS (SELECT fid, iid, variant_id, (dosage - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM fx5 JOIN st USING (variant_id) "
    "WHERE dosage IS NOT NULL AND least(p, 1 - p) >= 0.01)")
    + "SELECT a.fid AS fid_i, a.iid AS iid_i, b.fid AS fid_j, b.iid AS iid_j, round(sum(a.z * b.z) / count(*), 6) AS g, count(*) AS m "
      "FROM z a JOIN z b USING (variant_id) GROUP BY ALL")
def n9(spark, sf):
    return r6(N.kinship(fx.fx5(spark, sf)))


@query("n10_dosage_vectors", with_ctes(FX5_SQL) + "SELECT fid, iid, (SELECT count(DISTINCT variant_id) FROM fx5) AS size, "
       "CAST(sum(dosage) AS DOUBLE) AS dosage_sum FROM fx5 WHERE dosage IS NOT NULL GROUP BY fid, iid")
def n10(spark, sf):
    v = N.dosage_vectors(fx.fx5(spark, sf))

    @F.udf("size long, total double")
    def told(x):  # as sparse as it is: an array would hold every variant for every sample
        return x.size, float(x.values.sum())

    return v.select("fid", "iid", told("features").alias("t")).select("fid", "iid", "t.size", F.col("t.total").alias("dosage_sum"))


_GREEDY_SQL = (
    "WITH RECURSIVE " + FX5_SQL + ", x AS (SELECT chrom, pos * 37 + length(variant_id) AS pos, variant_id FROM fx5), "
    "s AS (SELECT chrom, pos, min(variant_id) AS variant_id FROM x GROUP BY chrom, pos), "
    "k(chrom, pos) AS (SELECT chrom, min(pos) FROM s GROUP BY chrom UNION ALL "
    "SELECT k.chrom, (SELECT min(s.pos) FROM s WHERE s.chrom = k.chrom AND s.pos >= k.pos + 50) FROM k WHERE k.pos IS NOT NULL) "
    "SELECT s.chrom, s.pos, s.variant_id FROM s JOIN k ON s.chrom = k.chrom AND s.pos = k.pos")


@query("n7_bp_space_greedy", _GREEDY_SQL)
def n7g(spark, sf):
    """d = 50 bp greedy thinning per chromosome; the oracle walks the same rule with a recursive CTE."""
    g = fx.fx5(spark, sf)
    g = g.withColumn("pos", F.col("pos") * 37 + F.length("variant_id"))  # spread sites so d matters
    return N.bp_space(g, 50).select("chrom", "pos", "variant_id").distinct()

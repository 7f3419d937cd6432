"""Registered queries: resampling, recipe steps, grids, metrics, tuning tables, discovery, strains."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import discovery as D
from ..operators import grids as G
from ..operators import metrics as V
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import recipe as E
from ..operators import resample as R
from ..operators import shape as P
from ..operators import strains as C
from ..operators import study as ST
from ..operators import tuning as T
from ..operators import nominal as NI
from ..operators.discovery import RUN_FILES, combine_runs
from ..operators.joins import expand
from ..session import checkpoint_dir
from ..sources.runs import write_run
from . import fixtures as fx
from .fixtures import FX1_SQL, FX3_SQL, FX4_SQL, FX6_SQL, with_ctes
from .q_relational import FX3P_SQL, scored
from .registry import query, r6

FEATS = fx.FEATURES
FEATS_SQL = ", ".join(FEATS)
CC_SQL = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)  # complete cases over the features


def _names(spark, cols, name="variable"):
    return spark.createDataFrame([(c,) for c in cols], f"{name} string")


# ---------------------------------------------------------------- R: sampling / splitting / folds
@query("r1_thin", with_ctes(FX3_SQL) + "SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY "
       "md5(concat_ws('|', '42', row_id))) AS rk, count(*) OVER () AS n FROM fx3) WHERE rk <= round(n * 0.1)")
def r1(spark, sf):
    return R.thin(fx.fx3(spark, sf).select("row_id"), 0.1, seed=42)


_SPLIT_SQL = ("split AS (SELECT row_id, label, CASE WHEN rk <= ceil(n * 0.8 - 1e-9) THEN 'train' ELSE 'test' END AS set "
              "FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', row_id))) AS rk, "
              f"count(*) OVER (PARTITION BY label) AS n FROM fx1 WHERE {CC_SQL}))")


def _split(spark, sf):
    return R.split_stratified(Q.complete_cases(fx.fx1(spark, sf), FEATS), "label", 0.8, seed=42)


@query("r2_split_stratified", with_ctes(FX1_SQL, _SPLIT_SQL) + "SELECT row_id, label, set FROM split")
def r2(spark, sf):
    return _split(spark, sf).select("row_id", "label", "set")


@query("r3_split_fixed", with_ctes(FX1_SQL) + "SELECT row_id, label, CASE WHEN rk <= CASE label WHEN 'Probiotic' THEN 8 "
       "WHEN 'Nonprobiotic' THEN 32 ELSE 0 END THEN 'test' ELSE 'train' END AS set FROM (SELECT row_id, label, "
       "row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', row_id))) AS rk FROM fx1)")
def r3(spark, sf):
    d = fx.fx1(spark, sf).select("row_id", "label")
    return R.split_fixed(d, "label", {fx.POS: 8, fx.NEG: 32}, seed=42)


@query("r4_split_random", with_ctes(FX3_SQL) + "SELECT row_id, CASE WHEN rk <= round(n * 0.75) THEN 'train' ELSE 'test' END AS set "
       "FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', row_id))) AS rk, count(*) OVER () AS n FROM fx3)")
def r4(spark, sf):
    return R.split_random(fx.fx3(spark, sf).select("row_id"), 0.75, seed=42)


def _vfold_sql(src: str, v: int, repeats: int, strata: str | None, cols: str = "row_id") -> str:
    part = "PARTITION BY r" + (f", {strata}" if strata else "")
    sc = f", {strata}" if strata else ""
    return (f"SELECT {cols}{sc}, CAST(r AS INTEGER) AS repeat, CAST((row_number() OVER ({part} ORDER BY "
            f"md5(concat_ws('|', '42', r, row_id))) - 1) % {v} AS INTEGER) AS fold FROM {src}, range(1, {repeats + 1}) t(r)")


@query("r5_vfold", with_ctes(FX1_SQL) + _vfold_sql("fx1", 5, 3, None))
def r5(spark, sf):
    return R.vfold(fx.fx1(spark, sf), v=5, repeats=3, seed=42)


@query("r6_vfold_stratified", with_ctes(FX1_SQL) + _vfold_sql("fx1", 5, 3, "label"))
def r6_(spark, sf):
    return R.vfold(fx.fx1(spark, sf), v=5, repeats=3, seed=42, strata="label")


@query("r7_replicate_folds", with_ctes(FX3_SQL) + _vfold_sql("fx3", 10, 2, "label"))
def r7(spark, sf):
    return R.vfold(fx.fx3(spark, sf), v=10, repeats=2, seed=42, strata="label")


@query("r8_upsample", with_ctes(
    FX1_SQL,
    "c AS (SELECT label, count(*) AS n FROM fx1 GROUP BY label)",
    "t AS (SELECT max(n) AS tgt FROM c)",
    "r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', row_id))) AS rk FROM fx1)",
    "d AS (SELECT c.label, c.n, unnest(range(0, t.tgt - c.n)) AS j FROM c, t WHERE t.tgt > c.n)",
    "dr AS (SELECT label, CAST(j + 1 AS INTEGER) AS copy, 1 + (('0x' || substr(md5(concat_ws('|', '42', 'u', j)), 1, 8))::BIGINT % n) AS rk FROM d)")
    + "SELECT row_id, label, 0 AS copy FROM fx1 UNION ALL SELECT r.row_id, r.label, dr.copy FROM dr JOIN r ON dr.label = r.label AND dr.rk = r.rk")
def r8(spark, sf):
    return R.upsample(fx.fx1(spark, sf).select("row_id", "label"), "label", 1.0, seed=42)


@query("r9_sample_variants", with_ctes(fx.FX5_SQL) + "SELECT DISTINCT variant_id FROM fx5 WHERE "
       "('0x' || substr(md5(concat_ws('|', '42', variant_id)), 1, 8))::BIGINT / 4294967296.0 < 0.5")
def r9(spark, sf):
    return R.sample_variants(fx.fx5(spark, sf).select("variant_id").distinct(), "variant_id", false_reps=1.0, seed=42)


# ---------------------------------------------------------------- E: recipe steps
_UNPIV = f"(SELECT {FEATS_SQL} FROM fx1) UNPIVOT (x FOR variable IN ({FEATS_SQL}))"


@query("e1_zero_var", with_ctes(FX1_SQL) + f"SELECT variable FROM {_UNPIV} GROUP BY variable HAVING min(x) = max(x)")
def e1(spark, sf):
    m = E.ZeroVar(inputCols=FEATS).fit(fx.fx1(spark, sf))
    return _names(spark, m.getDropCols())


@query("e2_near_zero_var", with_ctes(
    FX1_SQL, f"vc AS (SELECT variable, x, count(*) AS cnt FROM {_UNPIV} GROUP BY ALL)",
    "s AS (SELECT variable, count(*) AS nd, list_sort(list(cnt), 'DESC') AS cs FROM vc GROUP BY variable)")
    + "SELECT variable FROM s WHERE len(cs) = 1 OR (cs[1] / cs[2] > 19 AND 100.0 * nd / (SELECT count(*) FROM fx1) <= 10)")
def e2(spark, sf):
    m = E.NearZeroVar(inputCols=FEATS).fit(fx.fx1(spark, sf))
    return _names(spark, m.getDropCols())


_E3_FEATS = [c for c in FEATS if c != "f66"]  # after the zero-variance step
_E3_IDX = ", ".join(f"('{c}', {i})" for i, c in enumerate(_E3_FEATS))
_E3_LONG = (f"(SELECT row_id, {', '.join(_E3_FEATS)} FROM fx1 WHERE {CC_SQL}) "
            f"UNPIVOT (x FOR variable IN ({', '.join(_E3_FEATS)}))")


@query("e3_corr_filter", with_ctes(
    FX1_SQL, f"l AS (SELECT * FROM {_E3_LONG})", f"ix AS (SELECT * FROM (VALUES {_E3_IDX}) v(variable, k))",
    "r AS (SELECT a.variable AS vi, b.variable AS vj, abs(corr(a.x, b.x)) AS r FROM l a JOIN l b ON a.row_id = b.row_id GROUP BY ALL)",
    "m AS (SELECT vi AS variable, round(avg(coalesce(r, 0)), 9) AS m FROM r GROUP BY vi)",
    "p AS (SELECT r.vi, r.vj, r.r, ia.k AS ki, ib.k AS kj FROM r JOIN ix ia ON r.vi = ia.variable JOIN ix ib ON r.vj = ib.variable WHERE ia.k < ib.k AND r.r > 0.9)")
    + "SELECT DISTINCT CASE WHEN mj.m > mi.m THEN p.vj ELSE p.vi END AS variable FROM p JOIN m mi ON p.vi = mi.variable JOIN m mj ON p.vj = mj.variable")
def e3(spark, sf):
    d = Q.complete_cases(fx.fx1(spark, sf), FEATS)
    m = E.CorrFilter(inputCols=_E3_FEATS, threshold=0.9).fit(d)
    return _names(spark, m.getDropCols())


_NORM_COLS = [c for c in fx.FEATURES if c != "f66"]  # a constant column cannot be scaled


@query("e4_normalize", with_ctes(FX1_SQL, _SPLIT_SQL, "tr AS (SELECT fx1.* FROM fx1 JOIN split USING (row_id) WHERE set = 'train')",
                                 "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _NORM_COLS) + " FROM tr)")
       + "SELECT row_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _NORM_COLS)
       + " FROM fx1 JOIN split USING (row_id), st WHERE set = 'test'")
def e4(spark, sf):
    sp = _split(spark, sf)
    m = E.Normalize(inputCols=_NORM_COLS).fit(sp.filter(F.col("set") == "train"))
    return r6(m.transform(sp.filter(F.col("set") == "test")).select("row_id", *_NORM_COLS))


_E6_TR = "tr AS (SELECT fx1.* FROM fx1 JOIN split USING (row_id) WHERE set = 'train')"
_E6_ALL = f"UNPIVOT (x FOR variable IN ({FEATS_SQL}))"


@query("e6_recipe_values", with_ctes(
    FX1_SQL, _SPLIT_SQL, _E6_TR, f"st AS (SELECT variable, avg(x) AS mu, stddev_samp(x) AS sd FROM (SELECT {FEATS_SQL} FROM tr) {_E6_ALL} GROUP BY variable HAVING min(x) < max(x))",
    f"l AS (SELECT * FROM (SELECT row_id, {FEATS_SQL} FROM tr) {_E6_ALL} WHERE variable IN (SELECT variable FROM st))",
    "ix AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATS)) + ") v(variable, k))",
    "r AS (SELECT a.variable AS vi, b.variable AS vj, abs(corr(a.x, b.x)) AS r FROM l a JOIN l b ON a.row_id = b.row_id GROUP BY ALL)",
    "m AS (SELECT vi AS variable, round(avg(coalesce(r, 0)), 9) AS m FROM r GROUP BY vi)",
    "p AS (SELECT r.vi, r.vj FROM r JOIN ix ia ON r.vi = ia.variable JOIN ix ib ON r.vj = ib.variable WHERE ia.k < ib.k AND r.r > 0.9)",
    "gone AS (SELECT DISTINCT CASE WHEN mj.m > mi.m THEN p.vj ELSE p.vi END AS variable FROM p JOIN m mi ON p.vi = mi.variable JOIN m mj ON p.vj = mj.variable)")
    + f"SELECT row_id, variable, round((x - mu) / sd, 6) AS value FROM (SELECT row_id, {FEATS_SQL} FROM fx1 JOIN split USING (row_id) WHERE set = 'test') {_E6_ALL} "
      "JOIN st USING (variable) WHERE variable NOT IN (SELECT variable FROM gone)")
def e6v(spark, sf):
    """The whole recipe, fitted on the training rows: every entry of the test rows' feature vectors with its name."""
    sp = _split(spark, sf)
    model = E.recipe(FEATS).fit(sp.filter(F.col("set") == "train"))
    names = F.array(*[F.lit(c) for c in E.kept_features(model, FEATS)])
    d = model.transform(sp.filter(F.col("set") == "test")).select("row_id", F.posexplode(vector_to_array("features")).alias("i", "value"))
    return r6(d.select("row_id", F.element_at(names, F.col("i") + 1).alias("variable"), "value"))


@query("e5_nominal_levels", with_ctes(FX1_SQL) + "SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} IN (SELECT {c} FROM fx1 WHERE label = 'Probiotic' AND {c} IS NOT NULL) "
    f"THEN {c} ELSE 'new' END AS {c}" for c in ("taxon", "habitat")) + " FROM fx1")
def e5(spark, sf):
    d = fx.fx1(spark, sf).select("row_id", "label", "taxon", "habitat")
    m = E.NominalLevels(inputCols=["taxon", "habitat"]).fit(Q.keep_class(d, "label", fx.POS))
    return m.transform(d).select("row_id", "taxon", "habitat")


_IND_COLS = ("taxon", "habitat")


@query("e5_nominal_indicators", with_ctes(
    FX1_SQL, *[f"lv_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY md5(concat_ws('|', 'level', '{c}', {c}))) + 1 AS ix FROM "
               f"(SELECT DISTINCT {c} FROM fx1 WHERE label = 'Probiotic' AND {c} IS NOT NULL))" for c in _IND_COLS])
    + "SELECT row_id, CASE WHEN taxon IS NULL THEN 1 ELSE coalesce(t.ix, 0) END AS taxon_at, (SELECT count(*) FROM lv_taxon) + 2 + "
      "CASE WHEN habitat IS NULL THEN 1 ELSE coalesce(h.ix, 0) END AS habitat_at, (SELECT count(*) FROM lv_taxon) + (SELECT count(*) FROM lv_habitat) + 5 AS size, "
      "round(f01, 6) AS last FROM fx1 LEFT JOIN lv_taxon t ON t.v = taxon LEFT JOIN lv_habitat h ON h.v = habitat")
def e5i(spark, sf):
    """Nominal predictors in the model matrix: where each row's two indicators are, the vector's size, and the numeric feature at its end."""
    d = fx.fx1(spark, sf).select("row_id", "label", "taxon", "habitat", "f01")
    m = NI.NominalIndicators(inputCols=list(_IND_COLS), outputCol="__ind").fit(Q.keep_class(d, "label", fx.POS))
    at = lambda k: F.get(F.filter(F.sequence(F.lit(0), F.size("a") - 2), lambda i: F.get("a", i) == 1.0), F.lit(k)).cast("long")
    return r6(NI.assemble(m.transform(d), ["__ind", "f01"], "x").select("row_id", vector_to_array("x").alias("a")).select(
        "row_id", at(0).alias("taxon_at"), at(1).alias("habitat_at"), F.size("a").cast("long").alias("size"), F.element_at("a", -1).alias("last")))


_E7_COLS = list(fx.FEATURES)


@query("e7_fold_stats", with_ctes(FX1_SQL, "f AS (" + _vfold_sql("fx1", 5, 2, "label") + ")",
                                  "g AS (SELECT DISTINCT repeat, fold FROM f)")
       + " UNION ALL ".join(
           f"SELECT g.repeat, g.fold, '{c}' AS variable, count(x.{c}) AS n, round(avg(x.{c}), 6) AS mean, "
           f"round(stddev_samp(x.{c}), 6) AS sd FROM g JOIN f ON f.repeat = g.repeat AND f.fold <> g.fold "
           f"JOIN fx1 x ON x.row_id = f.row_id GROUP BY g.repeat, g.fold" for c in _E7_COLS))
def e7(spark, sf):
    d = fx.fx1(spark, sf)
    folds = R.vfold(d, v=5, repeats=2, seed=42, strata="label")
    return r6(E.fold_stats(d, folds, _E7_COLS))


# ---------------------------------------------------------------- G: grids expanded over resamples
def _resamples(spark, sf):
    return R.vfold(fx.fx1(spark, sf), v=5, repeats=3, seed=42, strata="label").select("repeat", "fold").distinct()


_RES_SQL = "res AS (SELECT DISTINCT repeat, fold FROM (" + _vfold_sql("fx1", 5, 3, "label") + "))"


@query("g1_grid_log_expand", with_ctes(FX1_SQL, _RES_SQL) + "SELECT repeat, fold, CAST(i AS INTEGER) AS cell_id, "
       "round(-5 + i * (CAST(5 AS DOUBLE) / 19), 6) AS log_penalty FROM res, range(0, 20) t(i)")
def g1(spark, sf):
    grid = [{"log_penalty": g["log_penalty"]} for g in G.grid_log(*G.LASSO_PENALTY_LOG10, 20)]
    return r6(expand(_resamples(spark, sf), grid))


@query("g2_grid_int_expand", with_ctes(FX1_SQL, _RES_SQL) + "SELECT repeat, fold, CAST(a * 6 + b AS INTEGER) AS cell_id, "
       "CAST(3 + a AS DOUBLE) AS mtry, CAST(3 + b AS DOUBLE) AS min_n FROM res, range(0, 6) s(a), range(0, 6) t(b)")
def g2(spark, sf):
    grid = G.grid_int({"mtry": G.RF_MTRY, "min_n": G.RF_MIN_N})
    return expand(_resamples(spark, sf), grid)


@query("g3_grid_regular_expand", with_ctes(FX1_SQL, _RES_SQL) + "SELECT repeat, fold, CAST(a * 10 + b AS INTEGER) AS cell_id, "
       "round(-4 + a * (CAST(8 AS DOUBLE) / 9), 6) AS log2_cost, round(-5 + b * (CAST(2 AS DOUBLE) / 9), 6) AS log10_sigma "
       "FROM res, range(0, 10) s(a), range(0, 10) t(b)")
def g3(spark, sf):
    grid = G.grid_regular({"log2_cost": (*G.SVM_COST_LOG2, 10, 0.0), "log10_sigma": (*G.SVM_SIGMA_LOG10, 10, 0.0)})
    return r6(expand(_resamples(spark, sf), grid))


@query("g5_grid_cross_expand", with_ctes(FX1_SQL, _RES_SQL) + "SELECT repeat, fold, CAST(a * 10 + b AS INTEGER) AS cell_id, "
       "round(0.005 + 0.02 * a, 6) AS nu, round(pow(2, -12 + b * (CAST(10 AS DOUBLE) / 9)), 9) AS sigma "
       "FROM res, range(0, 10) s(a), range(0, 10) t(b)")
def g5(spark, sf):
    grid = G.grid_cross({"nu": G.ONECLASS_NU, "sigma": G.ONECLASS_SIGMA})
    d = expand(_resamples(spark, sf), grid)
    return d.withColumn("nu", F.round("nu", 6)).withColumn("sigma", F.round("sigma", 9))


# ---------------------------------------------------------------- V: metrics on FX3 by method
_EV_NEG = "label = 'Nonprobiotic'"
_CNT_SQL = ("cnt AS (SELECT method, count_if(label = 'Probiotic' AND pred_class = 'Probiotic')::DOUBLE AS TP, "
            "count_if(label <> 'Probiotic' AND pred_class <> 'Probiotic')::DOUBLE AS TN, "
            "count_if(label <> 'Probiotic' AND pred_class = 'Probiotic')::DOUBLE AS FP, "
            "count_if(label = 'Probiotic' AND pred_class <> 'Probiotic')::DOUBLE AS FN FROM fx3p GROUP BY method)")


@query("v1_accuracy", with_ctes(FX3P_SQL) + "SELECT method, round(avg(CASE WHEN label = pred_class THEN 1 ELSE 0 END), 6) "
       "AS accuracy FROM fx3p GROUP BY method")
def v1(spark, sf):
    return r6(V.accuracy(scored(spark, sf), by="method"))


def _auc_sql(score: str, event: str, by: str = "method") -> str:
    return (f"st AS (SELECT {by}, {score} AS s, count_if(label = '{event}') AS pos, count_if(label <> '{event}') AS neg "
            f"FROM fx3 WHERE {score} IS NOT NULL GROUP BY ALL), "
            f"cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, "
            f"coalesce(sum(pos) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, "
            f"sum(pos) OVER (PARTITION BY {by}) AS P, sum(neg) OVER (PARTITION BY {by}) AS N FROM st)")


@query("v2_roc_auc", with_ctes(FX3_SQL, _auc_sql("p_nonprobiotic", "Nonprobiotic"))
       + "SELECT method, round(sum(pos * (nb + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM cu GROUP BY method")
def v2(spark, sf):
    return r6(V.roc_auc(fx.fx3(spark, sf), "label", "p_nonprobiotic", fx.NEG, by="method"))


@query("v3_mcc", with_ctes(FX3P_SQL, _CNT_SQL) + "SELECT method, round(CASE WHEN (TP + FP) * (TP + FN) * (TN + FP) * (TN + FN) = 0 "
       "THEN NULL ELSE (TP * TN - FP * FN) / sqrt((TP + FP) * (TP + FN) * (TN + FP) * (TN + FN)) END, 6) AS mcc FROM cnt")
def v3(spark, sf):
    return r6(V.mcc(scored(spark, sf), positive=fx.POS, by="method"))


@query("v4_brier", with_ctes(FX3_SQL) + "SELECT method, round(avg(pow(p_nonprobiotic - CASE WHEN label = 'Nonprobiotic' "
       "THEN 1.0 ELSE 0.0 END, 2)), 6) AS brier FROM fx3 GROUP BY method")
def v4(spark, sf):
    return r6(V.brier(fx.fx3(spark, sf), "label", "p_nonprobiotic", fx.NEG, by="method"))


@query("v5_sens_spec", with_ctes(FX3P_SQL, _CNT_SQL) + "SELECT method, round(TP / (TP + FN), 6) AS sensitivity, "
       "round(TN / (TN + FP), 6) AS specificity FROM cnt")
def v5(spark, sf):
    return r6(V.sens_spec(scored(spark, sf), "label", "pred_class", fx.POS, by="method"))


@query("v6_error_rates", with_ctes(FX3P_SQL, _CNT_SQL) + "SELECT method, 'FPR' AS error, round(100 * FP / (FP + TN), 6) AS percentage FROM cnt "
       "UNION ALL SELECT method, 'FNR', round(100 * FN / (FN + TP), 6) FROM cnt UNION ALL "
       "SELECT method, 'TER', round(100 * (FP + FN) / (TP + TN + FP + FN), 6) FROM cnt")
def v6(spark, sf):
    return r6(V.error_rates(scored(spark, sf), "label", "pred_class", fx.POS, by="method"))


_KAPPA_SQL = ("((TP + TN) / (TP + TN + FP + FN) - ((TP + FN) * (TP + FP) + (TN + FP) * (TN + FN)) / ((TP + TN + FP + FN) * (TP + TN + FP + FN))) "
              "/ (1 - ((TP + FN) * (TP + FP) + (TN + FP) * (TN + FN)) / ((TP + TN + FP + FN) * (TP + TN + FP + FN)))")


@query("v7_kappa", with_ctes(FX3P_SQL, _CNT_SQL) + f"SELECT method, round({_KAPPA_SQL}, 6) AS kappa FROM cnt")
def v7(spark, sf):
    return r6(V.kappa(scored(spark, sf), positive=fx.POS, by="method"))


@query("v8_confusion_rates", with_ctes(FX3P_SQL, _CNT_SQL) + "SELECT method, CAST(TP AS BIGINT) AS TP, CAST(TN AS BIGINT) AS TN, "
       "CAST(FP AS BIGINT) AS FP, CAST(FN AS BIGINT) AS FN, round((TP + TN) / (TP + TN + FP + FN), 6) AS accuracy, "
       f"round({_KAPPA_SQL}, 6) AS kappa, round(TP / (TP + FN), 6) AS sensitivity, round(TN / (TN + FP), 6) AS specificity, "
       "round(TP / (TP + FP), 6) AS pos_pred_value, round(TN / (TN + FN), 6) AS neg_pred_value, round(TP / (TP + FP), 6) AS precision, "
       "round(TP / (TP + FN), 6) AS recall, round(2 * (TP / (TP + FP)) * (TP / (TP + FN)) / (TP / (TP + FP) + TP / (TP + FN)), 6) AS f1, "
       "round((TP + FN) / (TP + TN + FP + FN), 6) AS prevalence, round(TP / (TP + TN + FP + FN), 6) AS detection_rate, "
       "round((TP + FP) / (TP + TN + FP + FN), 6) AS detection_prevalence, round((TP / (TP + FN) + TN / (TN + FP)) / 2, 6) AS balanced_accuracy FROM cnt")
def v8(spark, sf):
    c = V.counts(scored(spark, sf), "label", "pred_class", fx.POS, by="method")
    return r6(V.confusion_rates(c, by="method"))


@query("v8_confusion_stats")
def v8s(spark, sf):
    return V.confusion_stats(scored(spark, sf), "label", "pred_class", fx.POS, by="method")


@query("v9_roc_curve", with_ctes(FX3_SQL, _auc_sql("p_probiotic", "Probiotic"))
       + "SELECT method, s AS threshold, round(100 * (N - nb) / N, 6) AS fpr_pct, round(100 * (P - pb) / P, 6) AS tpr_pct FROM cu")
def v9(spark, sf):
    return r6(V.roc_curve(fx.fx3(spark, sf), "label", "p_probiotic", fx.POS, by="method"))


@query("v10_auc_ci", with_ctes(
    FX3_SQL, _auc_sql("p_probiotic", "Probiotic"),
    "pl AS (SELECT method, P, N, pos, neg, (nb + neg / 2) / N AS v10, ((P - pb - pos) + pos / 2) / P AS v01 FROM cu)",
    "agg AS (SELECT method, any_value(P)::DOUBLE AS P, any_value(N)::DOUBLE AS N, sum(pos * v10) AS s10, sum(pos * v10 * v10) AS q10, "
    "sum(neg * v01) AS s01, sum(neg * v01 * v01) AS q01 FROM pl GROUP BY method)",
    "fin AS (SELECT method, s10 / P AS auc, sqrt(((q10 - s10 * s10 / P) / (P - 1)) / P + ((q01 - s01 * s01 / N) / (N - 1)) / N) AS se FROM agg)")
    + "SELECT method, round(auc, 6) AS roc_auc, round(se, 6) AS se, round(greatest(0.0, auc - 1.959964 * se), 6) AS ci_low, "
      "round(least(1.0, auc + 1.959964 * se), 6) AS ci_high FROM fin")
def v10(spark, sf):
    return r6(V.auc_ci(fx.fx3(spark, sf), "label", "p_probiotic", fx.POS, by="method"))


@query("v11_mse", with_ctes(FX3_SQL, "y AS (SELECT method, CASE WHEN label = 'Probiotic' THEN 1.0 ELSE 0.0 END::DOUBLE AS t, p_probiotic AS p FROM fx3)")
       + "SELECT method, round(avg(pow(t - p, 2)), 6) AS mse, round(sqrt(avg(pow(t - p, 2))), 6) AS rmse, round(corr(t, p), 6) AS corr FROM y GROUP BY method")
def v11(spark, sf):
    d = fx.fx3(spark, sf).withColumn("t", (F.col("label") == fx.POS).cast("double"))
    return r6(V.mse(d, "t", "p_probiotic", by="method"))


_METRIC_SET_SQL = with_ctes(FX3P_SQL, _CNT_SQL.replace("GROUP BY method", "GROUP BY method"),
                            _auc_sql("p_nonprobiotic", "Nonprobiotic"))


@query("v12_metric_set", _METRIC_SET_SQL
       + "SELECT method, 'accuracy' AS metric, round((TP + TN) / (TP + TN + FP + FN), 6) AS estimate, 'binary' AS estimator FROM cnt "
         "UNION ALL SELECT method, 'mcc', round((TP * TN - FP * FN) / sqrt((TP + FP) * (TP + FN) * (TN + FP) * (TN + FN)), 6), 'binary' FROM cnt "
         f"UNION ALL SELECT method, 'kap', round({_KAPPA_SQL}, 6), 'binary' FROM cnt "
         "UNION ALL SELECT method, 'roc_auc', round(sum(pos * (nb + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6), 'binary' FROM cu GROUP BY method "
         "UNION ALL SELECT method, 'brier_class', round(avg(pow(p_nonprobiotic - CASE WHEN label = 'Nonprobiotic' THEN 1.0 ELSE 0.0 END, 2)), 6), "
         "'binary' FROM fx3p GROUP BY method")
def v12(spark, sf):
    return r6(V.metric_set(scored(spark, sf), "label", "pred_class", "p_nonprobiotic", fx.NEG, fx.POS, by="method"))


# ---------------------------------------------------------------- T / A / W on tuning tables
def _fx4_metrics(spark, sf):
    return fx.fx4(spark, sf).select("cell_id", F.col("rep").alias("repeat"), "fold", F.lit("mcc").alias("metric"),
                                    F.col("mcc").alias("estimate"))


_T2_SQL = ("t2 AS (SELECT cell_id, 'mcc' AS metric, avg(mcc) AS mean, count(mcc) AS n, stddev_samp(mcc) / sqrt(count(mcc)) AS std_err "
           "FROM fx4 GROUP BY cell_id)")


@query("t2_collect_metrics", with_ctes(FX4_SQL, _T2_SQL) + "SELECT cell_id, metric, round(mean, 6) AS mean, n, round(std_err, 6) AS std_err FROM t2")
def t2(spark, sf):
    return r6(T.collect_metrics(_fx4_metrics(spark, sf)))


@query("w1_best_per_group", with_ctes(FX4_SQL) + "SELECT cell_id, rep, fold, round(mcc, 6) AS mcc FROM (SELECT *, row_number() OVER "
       "(PARTITION BY cell_id ORDER BY mcc DESC, rep, fold) AS rn FROM fx4) WHERE rn = 1")
def w1(spark, sf):
    return r6(W.best_per_group(fx.fx4(spark, sf), ["cell_id"], "mcc", tiebreak=["rep", "fold"]))


@query("w3_select_best", with_ctes(FX4_SQL, _T2_SQL) + "SELECT cell_id, metric, round(mean, 6) AS mean, n, round(std_err, 6) AS std_err "
       "FROM t2 ORDER BY mean DESC, cell_id LIMIT 1")
def w3(spark, sf):
    return r6(W.select_best(T.collect_metrics(_fx4_metrics(spark, sf)), "mean", "cell_id", n=1))


@query("w4_show_best", with_ctes(FX4_SQL, _T2_SQL) + "SELECT cell_id, metric, round(mean, 6) AS mean, n, round(std_err, 6) AS std_err "
       "FROM t2 ORDER BY mean DESC, cell_id LIMIT 5")
def w4(spark, sf):
    return r6(W.select_best(T.collect_metrics(_fx4_metrics(spark, sf)), "mean", "cell_id", n=5))


_PARAMS_SQL = "CAST(3 + cell_id % 6 AS DOUBLE) AS mtry, CAST(3 + (cell_id // 6) % 6 AS DOUBLE) AS min_n"


def _with_params(df):
    return df.withColumns({"mtry": (3 + F.col("cell_id") % 6).cast("double"),
                           "min_n": (3 + F.floor(F.col("cell_id") / 6) % 6).cast("double")})


@query("a11_choice_frequency", with_ctes(FX4_SQL, "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, fold ORDER BY mcc DESC, cell_id) AS rn "
                                         f"FROM fx4) WHERE rn = 1)", f"bp AS (SELECT rep, {_PARAMS_SQL} FROM b)")
       + "SELECT rep, param, value, count(*) AS n FROM bp UNPIVOT (value FOR param IN (mtry, min_n)) GROUP BY ALL")
def a11(spark, sf):
    best = W.best_per_group(fx.fx4(spark, sf), ["rep", "fold"], "mcc", tiebreak=["cell_id"])
    return A.choice_frequency(_with_params(best), "rep", ["mtry", "min_n"])


@query("t15_tuning_curve", with_ctes(FX4_SQL, _T2_SQL, f"tp AS (SELECT mean, {_PARAMS_SQL} FROM t2)")
       + "SELECT param, value, round(mean, 6) AS mean FROM tp UNPIVOT (value FOR param IN (mtry, min_n))")
def t15(spark, sf):
    return r6(T.tuning_curve(_with_params(T.collect_metrics(_fx4_metrics(spark, sf))), ["mtry", "min_n"], "mcc"))


# resample results from FX3: replica = run, fold = l_orderkey % 10
def _resample_metrics(spark, sf):
    d = scored(spark, sf).withColumn("fold", (F.col("l_orderkey") % 10).cast("int")) \
        .withColumn("repeat", (F.col("run_ts") - 1785000000).cast("int"))
    return V.metric_set(d, "label", "pred_class", "p_nonprobiotic", fx.NEG, fx.POS, by=["method", "repeat", "fold"])


_METHOD_ORDER = ["RLR", "RF", "SVM", "NN"]
_RT_COLS = [f"{m}~{k}" for m in _METHOD_ORDER for k in ("Accuracy", "Kappa")]
_RS_SQL = ("rs AS (SELECT method, CAST(run_ts - 1785000000 AS INTEGER) AS REPLICA, CAST(l_orderkey % 10 AS INTEGER) AS fold, "
           "avg(CASE WHEN label = pred_class THEN 1 ELSE 0 END) AS acc, "
           "count_if(label = 'Probiotic' AND pred_class = 'Probiotic')::DOUBLE AS TP, count_if(label <> 'Probiotic' AND pred_class <> 'Probiotic')::DOUBLE AS TN, "
           "count_if(label <> 'Probiotic' AND pred_class = 'Probiotic')::DOUBLE AS FP, count_if(label = 'Probiotic' AND pred_class <> 'Probiotic')::DOUBLE AS FN "
           "FROM fx3p GROUP BY ALL), "
           f"rk AS (SELECT method, REPLICA, fold, acc, {_KAPPA_SQL} AS kap FROM rs), "
           "rt AS (SELECT REPLICA, fold, " + ", ".join(
               f"max(CASE WHEN method = '{m}' THEN {v} END) AS \"{m}~{k}\"" for m in _METHOD_ORDER
               for k, v in (("Accuracy", "acc"), ("Kappa", "kap"))) + " FROM rk GROUP BY REPLICA, fold)")


def _rt(spark, sf):
    return T.resample_table(_resample_metrics(spark, sf), _METHOD_ORDER)


@query("t8_resample_table", with_ctes(FX3P_SQL, _RS_SQL) + "SELECT REPLICA, fold, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _RT_COLS) + " FROM rt")
def t8(spark, sf):
    return r6(_rt(spark, sf).withColumnRenamed("REPLICA", "REPLICA"))


def _stat_names():
    return list(A.METRIC_STAT_NAMES)


_A7_FN = {"media": "avg({})", "median": "quantile_cont({}, 0.5)", "min": "min({})", "max": "max({})",
          "Q1": "quantile_cont({}, 0.25)", "Q3": "quantile_cont({}, 0.75)"}


@query("a7_metric_stats", with_ctes(FX3P_SQL, _RS_SQL) + "SELECT " + ", ".join(
    "round(" + _A7_FN[s].format(f'"{c}"') + f', 6) AS "{c}_{s}"' for c in _RT_COLS for s in _A7_FN) + " FROM rt")
def a7(spark, sf):
    return r6(A.metric_stats(_rt(spark, sf), _RT_COLS))


@query("a8_metric_table", with_ctes(FX3P_SQL, _RS_SQL) + "SELECT split_part(c, '~', 1) AS Method, 'Accuracy' AS Param, "
       "round(avg(v), 6) AS media, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, "
       "round(quantile_cont(v, 0.25), 6) AS Q1, round(quantile_cont(v, 0.75), 6) AS Q3 FROM "
       "(SELECT * FROM rt UNPIVOT (v FOR c IN (" + ", ".join(f'"{m}~Accuracy"' for m in _METHOD_ORDER) + "))) GROUP BY 1")
def a8(spark, sf):
    return r6(A.metric_table(A.metric_stats(_rt(spark, sf), _RT_COLS), "Accuracy"))


_ACC_COLS = [f"{m}~Accuracy" for m in _METHOD_ORDER]


def _a9(spark, sf):
    rt = _rt(spark, sf)
    return rt.groupBy("REPLICA").agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in _ACC_COLS])


@query("a9_mean_per_replicate", with_ctes(FX3P_SQL, _RS_SQL) + "SELECT REPLICA, " + ", ".join(
    f'round(avg("{c}"), 6) AS "{c}"' for c in _ACC_COLS) + " FROM rt GROUP BY REPLICA")
def a9(spark, sf):
    return r6(_a9(spark, sf))


@query("t9_best_models", with_ctes(FX3P_SQL, _RS_SQL, "me AS (SELECT REPLICA, " + ", ".join(f'avg("{c}") AS "{c}"' for c in _ACC_COLS)
                                  + " FROM rt GROUP BY REPLICA)", "lg AS (SELECT * FROM me UNPIVOT (ACC FOR pair IN ("
                                  + ", ".join(f'"{c}"' for c in _ACC_COLS) + ")))")
       + "SELECT split_part(pair, '~', 1) AS method, split_part(pair, '~', 2) AS param, REPLICA, round(ACC, 6) AS ACC FROM "
         "(SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ACC DESC, REPLICA) AS rn FROM lg) WHERE rn = 1")
def t9(spark, sf):
    long = A.melt(_a9(spark, sf), ["REPLICA"], _ACC_COLS, "pair", "ACC")
    best = W.best_per_group(long, ["pair"], "ACC", tiebreak=["REPLICA"])
    parts = F.split(F.col("pair"), "~")
    return r6(best.select(parts[0].alias("method"), parts[1].alias("param"), "REPLICA", "ACC"))


_T9C_SQL = ("tm AS (SELECT 'M' || CAST(cell_id % 4 AS VARCHAR) AS method, rep AS repeat, cell_id, round(avg(mcc), 10) AS mean FROM fx4 GROUP BY ALL), "
            "tb AS (SELECT *, row_number() OVER (PARTITION BY method, repeat ORDER BY mean DESC, cell_id) AS rn FROM tm)")


@query("t9_final_choice", with_ctes(FX4_SQL, _T9C_SQL) + "SELECT method, repeat, cell_id, round(mean, 8) AS mean FROM (SELECT *, row_number() OVER "
       "(PARTITION BY method ORDER BY mean DESC, repeat) AS best FROM tb WHERE rn = 1) WHERE best = 1")
def t9c(spark, sf):
    """The best cell of each replicate, then the best replicate of each method."""
    m = fx.fx4(spark, sf).select(F.concat(F.lit("M"), (F.col("cell_id") % 4).cast("string")).alias("method"), F.col("rep").alias("repeat"), "fold", "cell_id",
                                 F.lit("mcc").alias("metric"), F.col("mcc").alias("estimate"))
    return r6(ST.best_replicas(ST.tuned_replicas(m, "mcc")), 8)


@query("t10_compare", with_ctes(FX3P_SQL, _RS_SQL) + "SELECT variable, count(x) AS n, count_if(x IS NULL) AS n_missing, round(avg(x), 6) AS mean, "
       "round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, "
       "round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max FROM (SELECT " + ", ".join(f'"{c}"' for c in _RT_COLS)
       + " FROM rt) UNPIVOT INCLUDE NULLS (x FOR variable IN (" + ", ".join(f'"{c}"' for c in _RT_COLS) + ")) GROUP BY variable")
def t10(spark, sf):
    rt = _rt(spark, sf)
    return r6(A.summarize(rt.select(*[F.col(f"`{c}`").alias(c) for c in _RT_COLS]), _RT_COLS))


@query("a12_metrics_wide", with_ctes(FX3P_SQL, _RS_SQL, "lm AS (SELECT method, REPLICA, fold, acc, kap FROM rk)")
       + "SELECT method AS cell_id, round(avg(acc), 6) AS mean_accuracy, round(stddev_samp(acc) / sqrt(count(acc)), 6) AS std_err_accuracy, "
         "round(avg(kap), 6) AS mean_kap, round(stddev_samp(kap) / sqrt(count(kap)), 6) AS std_err_kap FROM lm GROUP BY method")
def a12(spark, sf):
    m = _resample_metrics(spark, sf).withColumnRenamed("method", "cell_id")
    c = T.collect_metrics(m.filter(F.col("metric").isin("accuracy", "kap")), keys=["cell_id"])
    return r6(A.metrics_wide(c, ["cell_id"], ["accuracy", "kap"]))


@query("t1_resample_metrics", with_ctes(FX3P_SQL, _RS_SQL) + "SELECT method, REPLICA AS repeat, fold, 'accuracy' AS metric, round(acc, 6) AS estimate "
       "FROM rk UNION ALL SELECT method, REPLICA, fold, 'kap', round(kap, 6) FROM rk")
def t1m(spark, sf):
    m = _resample_metrics(spark, sf).filter(F.col("metric").isin("accuracy", "kap"))
    return r6(m.select("method", "repeat", "fold", "metric", "estimate"))


_T14_FEATS = [c for c in FEATS if c not in ("f66",)]


@query("t14_filter_importance", with_ctes(
    FX1_SQL, f"l AS (SELECT label, variable, x FROM (SELECT label, {', '.join(_T14_FEATS)} FROM fx1) UNPIVOT (x FOR variable IN ({', '.join(_T14_FEATS)})))",
    "st AS (SELECT variable, x AS s, count_if(label = 'Nonprobiotic') AS pos, count_if(label <> 'Nonprobiotic') AS neg FROM l GROUP BY ALL)",
    "cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY variable ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM st)",
    "au AS (SELECT variable, sum(pos * (nb + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM cu GROUP BY variable)")
    + "SELECT variable, round(greatest(auc, 1 - auc), 6) AS importance FROM au")
def t14(spark, sf):
    return r6(T.filter_importance(fx.fx1(spark, sf), "label", _T14_FEATS, fx.NEG))


# ---------------------------------------------------------------- D: discovery and run combination
@query("d1_discover", with_ctes(FX3P_SQL) + "SELECT row_id, round(p_nonprobiotic, 6) AS p_nonprobiotic, round(p_probiotic, 6) AS p_probiotic, "
       "pred_class, run_ts FROM fx3p WHERE pred_class = 'Probiotic'")
def d1(spark, sf):
    return r6(D.discover_scored(scored(spark, sf), "pred_class", fx.POS,
                                ["row_id", "p_nonprobiotic", "p_probiotic", "pred_class", "run_ts"]))


@query("d2_discover_oneclass", with_ctes(FX3_SQL) + "SELECT row_id, round(p_probiotic - 0.5, 6) AS decision FROM fx3 WHERE p_probiotic - 0.5 >= 0")
def d2(spark, sf):
    d = fx.fx3(spark, sf).select("row_id", (F.col("p_probiotic") - 0.5).alias("decision"))
    return r6(D.discover_oneclass(d))


@query("d3_predictions_out", with_ctes(FX3P_SQL) + "SELECT row_id, label, pred_class, CAST(1785000000 AS BIGINT) AS tmstmp FROM fx3p")
def d3(spark, sf):
    return D.predictions_out(scored(spark, sf).select("row_id", "label", "pred_class"), 1785000000)


@query("d4_run_summary", with_ctes(FX3P_SQL) + "SELECT run_ts, count_if(label = 'Probiotic' AND pred_class = 'Probiotic') AS TP, "
       "count_if(label <> 'Probiotic' AND pred_class <> 'Probiotic') AS TN, count_if(label <> 'Probiotic' AND pred_class = 'Probiotic') AS FP, "
       "count_if(label = 'Probiotic' AND pred_class <> 'Probiotic') AS FN, count_if(label <> pred_class) AS n_errors, "
       "count_if(pred_class = 'Probiotic') AS n_discovered FROM fx3p GROUP BY run_ts")
def d4(spark, sf):
    """Every run of the scored rows is written as a run folder, and the committed folders are combined."""
    from concurrent.futures import ThreadPoolExecutor

    s = scored(spark, sf).select("run_ts", "row_id", "method", "label", "pred_class", "p_probiotic").persist()
    root = f"{checkpoint_dir(spark).rstrip('/')}/clademl-runs-{uuid.uuid4().hex}"
    per = V.counts(s, "label", "pred_class", fx.POS, ["run_ts", "method"])
    best = V.mcc(s, "label", "pred_class", fx.POS, by=["run_ts", "method"]).select("run_ts", "method", F.lit("mcc").alias("metric"), F.col("mcc").alias("mean"))
    best = best.unionByName(V.accuracy(s, "label", "pred_class", by=["run_ts", "method"]).select(
        "run_ts", "method", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("mean")))

    def one(run_ts: int) -> None:
        own = s.filter(F.col("run_ts") == run_ts).drop("run_ts")
        kinds = {"best": best.filter(F.col("run_ts") == run_ts).drop("run_ts"), "metrics": per.filter(F.col("run_ts") == run_ts).drop("run_ts"),
                 "predictions": own, "errors": own.filter("label <> pred_class"), "discoveries": own.filter(F.col("pred_class") == fx.POS)}
        write_run(root, run_ts, {RUN_FILES[k]: t for k, t in kinds.items()}, {"threshold": 0.5, "files": 5})

    runs = [r["run_ts"] for r in s.select("run_ts").distinct().collect()]  # one id per run
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, runs))
    s.unpersist()
    got = combine_runs(spark, root, fx.POS, committed=True)
    count = lambda t, name: t.groupBy("run_ts").agg(F.count(F.lit(1)).alias(name))
    out = got["confusion"].join(count(got["errors"], "n_errors"), "run_ts", "left").join(count(got["discoveries"], "n_discovered"), "run_ts", "left")
    return out.fillna(0, ["n_errors", "n_discovered"])


@query("d5_combine_problems", with_ctes(FX3P_SQL, "c AS (SELECT CASE WHEN method IN ('RLR', 'RF') THEN 'twoclass' ELSE 'oneclass' END AS problem, run_ts, "
                                        "count_if(label = 'Probiotic' AND pred_class = 'Probiotic') AS TP, count_if(label <> 'Probiotic' AND pred_class <> 'Probiotic') AS TN, "
                                        "count_if(label <> 'Probiotic' AND pred_class = 'Probiotic') AS FP, count_if(label = 'Probiotic' AND pred_class <> 'Probiotic') AS FN "
                                        "FROM fx3p GROUP BY ALL)")
       + "SELECT problem, round(avg(TP), 6) AS TP, round(avg(TN), 6) AS TN, round(avg(FP), 6) AS FP, round(avg(FN), 6) AS FN FROM c GROUP BY problem")
def d5(spark, sf):
    s = scored(spark, sf)
    two = A.confusion_by(s.filter(F.col("method").isin("RLR", "RF")), ["run_ts"], "label", "pred_class", fx.POS)
    one = A.confusion_by(s.filter(F.col("method").isin("SVM", "NN")), ["run_ts"], "label", "pred_class", fx.POS)
    comb = D.combine_problems({"twoclass": two, "oneclass": one})
    return r6(comb.groupBy("problem").agg(*[F.avg(c).alias(c) for c in ("TP", "TN", "FP", "FN")]))


# ---------------------------------------------------------------- C: strains and accessions
_CUR_SQL = ("cur AS (SELECT organism_name, strain, biosample, lower(confirmed) AS probiotic, lower(genome) AS ncbi_genome, "
            "lower(target_raw) AS target, regexp_replace(refseq_ftp, '^.*/', '') AS refseq_ftp FROM fx6)")


@query("c1_curate", with_ctes(FX6_SQL, _CUR_SQL) + "SELECT * FROM cur")
def c1(spark, sf):
    return C.curate(fx.fx6(spark, sf))


@query("c2_select_strains", with_ctes(FX6_SQL, _CUR_SQL) + "SELECT 'yes' AS flag, target, count(*) AS n FROM cur WHERE probiotic = 'yes' "
       "AND ncbi_genome = 'yes' GROUP BY target UNION ALL SELECT 'no', target, count(*) FROM cur WHERE probiotic = 'no' AND ncbi_genome = 'yes' GROUP BY target")
def c2(spark, sf):
    cur = C.curate(fx.fx6(spark, sf))
    out = None
    for flag in ("yes", "no"):
        c = A.class_counts(C.select_strains(cur, flag), "target").select(F.lit(flag).alias("flag"), "target", "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("c3_archive_url", with_ctes(FX6_SQL, _CUR_SQL, "a AS (SELECT refseq_ftp AS accession, regexp_extract(refseq_ftp, 'GCF_([0-9]+)\\.', 1) AS d FROM cur)")
       + "SELECT accession, CASE WHEN d = '' THEN NULL ELSE rtrim(regexp_replace(d, '([0-9]{3})', '\\1/', 'g'), '/') END AS triplets, "
         "CASE WHEN d = '' THEN NULL ELSE 'https://ftp.ncbi.nlm.nih.gov/genomes/all/GCF/' || rtrim(regexp_replace(d, '([0-9]{3})', '\\1/', 'g'), '/') "
         "|| '/' || accession || '/' || accession || '_genomic.gbff.gz' END AS file_url FROM a")
def c3(spark, sf):
    cur = C.accession_of(C.curate(fx.fx6(spark, sf)), "refseq_ftp")
    return C.archive_paths(cur.select("accession")).select("accession", "triplets", "file_url")


@query("c4_accession_of", with_ctes(FX6_SQL) + "SELECT strain, regexp_replace(refseq_ftp, '^.*/', '') AS accession FROM fx6")
def c4(spark, sf):
    return C.accession_of(fx.fx6(spark, sf)).select("strain", "accession")

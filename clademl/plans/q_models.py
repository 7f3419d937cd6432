"""Registered model-level queries (rows-only checks: fits are iterative, not SQL).

Each fits on FX1 (or the genotype table) at modest, explicit settings; the
library defaults stay the reference's grid sizes.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.exprs import order_key
from ..operators import blocks as BL
from ..operators import elimination as EL
from ..operators import genotypes as N
from ..operators import grids as G
from ..operators import lasso_path as LP
from ..operators import linear_tuning as LT
from ..operators import metrics as V
from ..operators import models as M
from ..operators import networks as NN
from ..operators import quality as Q
from ..operators import recipe as E
from ..operators import resample as R
from ..operators import study as ST
from ..operators import tuning as T
from ..operators.discovery import score
from ..operators.quality import complete_cases
from ..operators.ranking import global_rank
from ..session import stored
from . import fixtures as fx
from . import workflows as wf
from .fixtures import FX1_SQL, FX5_SQL, with_ctes
from .q_evaluation import _SPLIT_SQL, _vfold_sql
from .registry import query, r6

LEVELS, NEG, POS = fx.LEVELS, fx.NEG, fx.POS
OUT = ["row_id", "label", f"pred_{NEG}", f"pred_{POS}", "pred_class"]


def _prepared(spark, sf):
    """Train/test split with the recipe fitted on train (zv, corr, normalize) and assembled vectors."""
    train, test = wf.flagship_split(spark, sf)
    prep = E.recipe(fx.FEATURES, ("zv", "corr", "normalize")).fit(train)
    n_feat = len(E.kept_features(prep, fx.FEATURES))
    return prep.transform(train), prep.transform(test), n_feat


def _fit_score(spark, sf, learner_fn):
    tr, te, p = _prepared(spark, sf)
    model = learner_fn(p).fit(tr)
    return score(model, te, LEVELS, NEG, POS).select(*OUT)


@query("m1_lasso_predictions")
def m1(spark, sf):
    return _fit_score(spark, sf, lambda p: M.lasso_logit(0.01))


@query("m2_elastic_net_predictions")
def m2(spark, sf):
    return _fit_score(spark, sf, lambda p: M.elastic_net_logit(0.5, 0.01))


@query("m5_forest_predictions")
def m5(spark, sf):
    return _fit_score(spark, sf, lambda p: M.forest(trees=50, mtry=8, min_n=3))


@query("m6_boost_predictions")
def m6(spark, sf):
    return _fit_score(spark, sf, lambda p: M.boost(trees=10, tree_depth=4, min_n=2, sample_size=0.75, mtry=8,
                                                  learn_rate=0.1))


@query("m7_kernel_svm_predictions")
def m7(spark, sf):
    tr, te, p = _prepared(spark, sf)
    model = M.KernelSVM(cost=1.0, sigma=0.01, n_components=128, n_input=p, max_iter=20).fit(tr)
    return score(model, te, LEVELS, NEG, POS).select(*OUT)


@query("m8_oneclass_decisions")
def m8(spark, sf):
    """Trained on the positive class only; every test row gets a decision value and a label."""
    tr, te, p = _prepared(spark, sf)
    normal = Q.keep_class(tr, "label", POS)
    model = M.OneClassSVM(nu=0.1, sigma=0.01, n_components=128, n_input=p).fit(normal)
    out = model.transform(te).select("row_id", "label", "decision")
    return Q.decision_label(out, inlier=POS, outlier=NEG)


@query("m9_net_predictions")
def m9(spark, sf):
    return _fit_score(spark, sf, lambda p: M.net(p, size=5, max_iter=50))


@query("m9_decay_net_predictions")
def m9d(spark, sf):
    """One hidden layer with the weight decay that the reference tunes."""
    return _fit_score(spark, sf, lambda p: NN.DecayNet(size=5, decay=0.1, max_iter=60))


@query("m10_flagship_metrics")
def m10(spark, sf):
    return wf.flagship_metrics(spark, sf)


@query("d1_flagship_discovery")
def d1f(spark, sf):
    return wf.discovery_flagship(spark, sf)


@query("e6_recipe")
def e6(spark, sf):
    tr, te, _ = _prepared(spark, sf)
    return te.select("row_id", "label", vector_to_array("features").alias("features"))


@query("t1_tune_lasso")
def t1(spark, sf):
    """20 penalties x 5 folds x 3 repeats, upsampled inside each analysis set: 300 fits from shared passes."""
    train, _ = wf.flagship_split(spark, sf)
    folds = R.vfold(train, v=5, repeats=3, seed=7, strata="label")
    grid = G.grid_log(-5, 0, 20)
    got = LT.tune_linear(train, folds, fx.FEATURES, grid, LEVELS, NEG, POS, balance="upsample", corr_threshold=0.95)
    return T.with_grid(T.collect_metrics(got.metrics), [{"penalty": g["penalty"]} for g in grid])


# Complete cases of FX1 without a split: rows with a NULL feature are those with one in f65.
_CC_SQL = "cc AS (SELECT row_id, label FROM fx1 WHERE f65 IS NOT NULL)"
_CC_FOLDS_SQL = _vfold_sql("cc", 3, 2, "label")


@query("t5_null_fit", with_ctes(FX1_SQL, _CC_SQL, f"fo AS ({_CC_FOLDS_SQL})",
       "s AS (SELECT repeat, fold, count(*) FILTER (label = 'Probiotic') AS k, count(*) AS n FROM fo GROUP BY ALL)",
       "t AS (SELECT repeat, sum(k) AS k, sum(n) AS n FROM s GROUP BY repeat)")
       + "SELECT row_id, label, repeat, fold, round((t.k - s.k) / (t.n - s.n), 5) AS pred_positive, CASE WHEN 2 * (t.k - s.k) <= t.n - s.n THEN 'Nonprobiotic' "
         "ELSE 'Probiotic' END AS pred_class FROM fo JOIN s USING (repeat, fold) JOIN t USING (repeat)")
def t5(spark, sf):
    """Fixed-model resampling at a penalty that leaves no feature: each row's prediction is its analysis set's class share."""
    data = complete_cases(fx.fx1(spark, sf), fx.FEATURES)
    folds = R.vfold(data, v=3, repeats=2, seed=42, strata="label")
    got = LT.tune_linear(data, folds, fx.FEATURES, [{"penalty": 10.0}], LEVELS, NEG, POS, tol=1e-8)
    return got.predictions.select("row_id", "label", "repeat", "fold", F.round(f"pred_{POS}", 5).alias("pred_positive"), "pred_class")


_FOLD_COUNTS_SQL = (
    f"fo AS ({_vfold_sql('fx1', 5, 3, 'label')})",
    "fc AS (SELECT repeat, fold, label, count(*) AS n FROM fo GROUP BY ALL)",
    "an AS (SELECT f.repeat, f.fold, t.label, t.n - coalesce(fc.n, 0) AS n FROM (SELECT DISTINCT repeat, fold FROM fo) f "
    "JOIN (SELECT repeat, label, sum(n)::BIGINT AS n FROM fc GROUP BY ALL) t USING (repeat) LEFT JOIN fc USING (repeat, fold, label))",
)


@query("a18_fold_weights", with_ctes(FX1_SQL, *_FOLD_COUNTS_SQL) + "SELECT repeat, fold, label, round(sum(n) OVER (PARTITION BY repeat, fold) / "
       "(count(*) OVER (PARTITION BY repeat, fold) * n), 6) AS weight FROM an")
def a18f(spark, sf):
    """Class weights of every analysis set, from the fold counts."""
    d = fx.fx1(spark, sf).select("row_id", "label")
    return r6(R.fold_class_weights(d, R.vfold(d, v=5, repeats=3, seed=42, strata="label"), "label"))


@query("r8_fold_copies", with_ctes(
    FX1_SQL, *_FOLD_COUNTS_SQL,
    "rk AS (SELECT fo.row_id, fo.label, fo.repeat, a.fold, row_number() OVER (PARTITION BY fo.repeat, a.fold, fo.label ORDER BY md5(concat_ws('|', '42', fo.row_id))) AS k "
    "FROM fo JOIN (SELECT DISTINCT repeat, fold FROM fo) a ON a.repeat = fo.repeat AND a.fold <> fo.fold)",
    "mx AS (SELECT repeat, fold, max(n) AS most FROM an GROUP BY ALL)",
    "dr AS (SELECT repeat, fold, label, n, unnest(range(0, most - n)) AS j FROM an JOIN mx USING (repeat, fold))",
    "hi AS (SELECT repeat, fold, label, 1 + (('0x' || substr(md5(concat_ws('|', '42', 'u', repeat, fold, label, j)), 1, 8))::BIGINT % n) AS k, count(*) AS hits FROM dr GROUP BY ALL)")
    + "SELECT row_id, repeat, fold, 1 + coalesce(hits, 0) AS copies FROM rk LEFT JOIN hi USING (repeat, fold, label, k)")
def r8f(spark, sf):
    """How often every analysis row counts when its class is grown to the largest one's size, in all 15 resamples."""
    d = fx.fx1(spark, sf).select("row_id", "label")
    return R.fold_multiplicities(d, R.vfold(d, v=5, repeats=3, seed=42, strata="label"), "label")


@query("t4_last_fit")
def t4(spark, sf):
    train, test = wf.flagship_split(spark, sf)
    _, _, mets = T.last_fit(train, test, lambda: E.recipe(fx.FEATURES), M.lasso_logit(0.01), LEVELS, NEG, POS)
    return mets


# A penalty that leaves no feature: every prediction is the class share of the training rows, the most frequent class wins.
_NULL_FIT = "tr AS (SELECT avg((label = 'Nonprobiotic')::DOUBLE) AS p FROM split WHERE set = 'train')"


@query("t4_null_last_fit", with_ctes(
    FX1_SQL, _SPLIT_SQL, _NULL_FIT, "te AS (SELECT p, (label = 'Nonprobiotic')::DOUBLE AS neg FROM split, tr WHERE set = 'test')",
    "ms AS (SELECT avg((neg = (p >= 0.5)::DOUBLE)::DOUBLE) AS accuracy, avg((p - neg) * (p - neg)) AS brier_class FROM te)")
    + "SELECT metric, 'binary' AS estimator, round(estimate, 5) AS estimate FROM (SELECT 'accuracy' AS metric, accuracy AS estimate FROM ms "
      "UNION ALL SELECT 'brier_class', brier_class FROM ms UNION ALL SELECT 'roc_auc', 0.5 UNION ALL SELECT 'mcc', NULL UNION ALL SELECT 'kap', 0.0)")
def t4n(spark, sf):
    train, test = wf.flagship_split(spark, sf)
    _, _, mets = T.last_fit(train, test, lambda: E.recipe(fx.FEATURES), M.lasso_logit(10.0), LEVELS, NEG, POS)
    return r6(mets, 5)


@query("t3_null_refit", with_ctes(FX1_SQL, _SPLIT_SQL, "k AS (SELECT label, count(*) AS n FROM split WHERE set = 'train' GROUP BY label)")
       + "SELECT balance, row_id, label, round(p, 5) AS pred_negative FROM split, (SELECT 'none' AS balance, (SELECT n FROM k WHERE label = 'Nonprobiotic') / (SELECT sum(n) FROM k) AS p "
         "UNION ALL SELECT 'upsample', 0.5 UNION ALL SELECT 'weights', 0.5) WHERE set = 'test'")
def t3(spark, sf):
    """Refit on all training rows without balance, with upsampled rows and with class weights; the last two give every class the same say."""
    train, test = wf.flagship_split(spark, sf)
    models = {b or "none": ST.refit(train, lambda: E.recipe(fx.FEATURES), M.lasso_logit(10.0), balance=b) for b in (None, "upsample", "weights")}
    d = ST.final_predictions(models, test, LEVELS)
    return d.select(F.col("method").alias("balance"), "row_id", "label", F.round(f"pred_{NEG}", 5).alias("pred_negative"))


_T11_FOLDS = _vfold_sql("cc", 3, 3, "label")


@query("t11_null_study", with_ctes(
    FX1_SQL, _CC_SQL, f"fo AS ({_T11_FOLDS})", "s AS (SELECT repeat, fold, count(*) FILTER (label = 'Probiotic') AS k, count(*) AS n FROM fo GROUP BY ALL)",
    "t AS (SELECT repeat, sum(k) AS k, sum(n) AS n FROM s GROUP BY repeat)",
    "f AS (SELECT repeat, fold, (t.k - s.k) / (t.n - s.n) AS p, s.k / s.n AS share FROM s JOIN t USING (repeat))",
    "b AS (SELECT repeat FROM (SELECT repeat, round(avg(CASE WHEN p <= 0.5 THEN 1 - share ELSE share END), 10) AS mean FROM f GROUP BY repeat) ORDER BY mean DESC, repeat LIMIT 1)")
    + "SELECT method, cell_id, repeat, fold, row_id, label, round(p, 5) AS pred_positive, cell_id = 0 AS chosen FROM fo JOIN b USING (repeat) JOIN f USING (repeat, fold), "
      "(SELECT unnest(['lasso', 'elastic_net']) AS method), (SELECT unnest([0, 1]) AS cell_id)")
def t11(spark, sf):
    """Study of two methods whose grids leave no feature: held-out predictions of the final set, from the replicate and cell that ties choose."""
    data = complete_cases(fx.fx1(spark, sf), fx.FEATURES)
    data = M.label_index(data, "label", LEVELS)
    folds = R.vfold(data, v=3, repeats=3, seed=42, strata="label")
    learner = lambda c: M.elastic_net_logit(c.get("mixture", 1.0), c["penalty"])
    methods = {"lasso": ST.Method(lambda: E.recipe(fx.FEATURES), learner, [{"penalty": 10.0}, {"penalty": 20.0}], fx.FEATURES),
               "elastic_net": ST.Method(lambda: E.recipe(fx.FEATURES), learner, [{"penalty": 30.0, "mixture": 0.5}, {"penalty": 40.0, "mixture": 0.5}], fx.FEATURES)}
    got = ST.replicate_study(data, folds, methods, LEVELS, NEG, POS)
    return got.cv_predictions.select("method", F.col("cell_id").cast("int"), "repeat", "fold", "row_id", "label", F.round(f"pred_{POS}", 5).alias("pred_positive"), "chosen")


@query("t6_tune_oneclass")
def t6(spark, sf):
    """Score = mean inlier share of held-out normal rows; NULL for a cell that fails (nu = 2 is no share)."""
    train, _ = wf.flagship_split(spark, sf)
    normal = Q.keep_class(train, "label", POS)
    folds = R.vfold(normal, v=3, repeats=1, seed=7)
    grid = [{"nu": 0.05, "sigma": 0.01}, {"nu": 0.2, "sigma": 0.01}, {"nu": 2.0, "sigma": 0.01}]
    scores = T.tune_oneclass(normal, folds, lambda: E.recipe(fx.FEATURES), grid, lambda c: M.OneClassSVM(nu=c["nu"], sigma=c["sigma"], n_components=64))
    return T.with_grid(scores, grid)


@query("t12_rfe_profile")
def t12(spark, sf):
    """Every size from 1 to all features, nested by the permutation importance of a forest in each resample."""
    train, _ = wf.flagship_split(spark, sf)
    folds = R.vfold(train, v=3, repeats=1, seed=7, strata="label")
    profile, final = EL.eliminate(train, folds, fx.FEATURES, lambda: M.forest(trees=20, seed=1, min_n=2), LEVELS, NEG, POS)
    return profile.withColumn("final_features", F.lit(",".join(final)))


@query("t13_importance")
def t13(spark, sf):
    tr, _, _ = _prepared(spark, sf)
    prep_feats = [c for c in fx.FEATURES if c in tr.columns]
    rf = M.forest(trees=50, mtry=8, min_n=3).fit(tr)
    rows = T.importance_table(rf, prep_feats, k=10)
    return spark.createDataFrame(rows, "variable string, importance double")


# ---------------------------------------------------------------- regression on dosages
def _imputed(spark, sf):
    return N.impute_dosage(N.maf_filter(N.remove_controls(fx.fx5(spark, sf), fx.CONTROL_SAMPLES)))


CV_FOLDS = 5


def _dosage_rows(spark, sf, g):
    """Samples with their target; a fifth by order key is the test set, the rest has folds dealt by the same rank."""
    sup = fx.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("iid"), F.col("s_acctbal").alias("y"))
    rows = g.select("fid", "iid").distinct().join(sup, "iid").withColumn("row_id", F.concat_ws("|", "fid", "iid"))
    rank = global_rank(rows, order_key(3, "row_id"), rank_col="k")
    fold = F.when(F.col("k") % 5 == 0, F.lit(LP.HELD)).otherwise((F.floor(F.col("k") / 5) % CV_FOLDS).cast("int"))
    return rank.select("fid", "iid", "y", fold.alias("fold"))


def _chain_input(spark, sf):
    g = stored(_imputed(spark, sf).select(*N.SAMPLE, *N.VARIANT, "dosage"), "calls")
    return BL.dosage_blocks(g), _dosage_rows(spark, sf, g)


_DOSAGE_SQL = (
    "cs AS (SELECT * FROM fx5 WHERE NOT regexp_matches(iid, '^(" + "|".join(fx.CONTROL_SAMPLES) + ")(_[0-9]+)?$')), "
    "ms AS (SELECT chrom, pos, variant_id, avg(dosage) / 2 AS p, round(avg(dosage))::INTEGER AS fill FROM cs GROUP BY ALL), "
    "im AS (SELECT fid, iid, variant_id, coalesce(dosage, fill) AS d FROM cs JOIN ms USING (chrom, pos, variant_id) WHERE least(p, 1 - p) >= 0.01), "
    "rk AS (SELECT fid, iid, y, row_number() OVER (ORDER BY md5(concat_ws('|', '3', fid || '|' || iid))) AS k FROM "
    "(SELECT DISTINCT fid, iid FROM im) JOIN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS iid, s_acctbal AS y FROM supplier) USING (iid)), "
    f"tg AS (SELECT fid, iid, y, CASE WHEN k % 5 = 0 THEN -1 ELSE (k // 5) % {CV_FOLDS} END AS fold FROM rk)"
)


@query("n10_dosage_blocks", with_ctes(FX5_SQL) + "SELECT fid, iid, chrom, pos, variant_id, dosage FROM fx5 WHERE dosage IS NULL OR dosage <> 0")
def n10b(spark, sf):
    """Every cell of the blocked matrix back in long form: a failed call stays NULL, only zeros are left out."""
    return BL.block_cells(BL.dosage_blocks(fx.fx5(spark, sf)))


@query("f8_matrix_means", with_ctes(FX5_SQL) + "SELECT variant_id, round(coalesce(sum(dosage), 0) / ((SELECT count(*) FROM (SELECT DISTINCT fid, iid FROM fx5)) "
       "- count(*) FILTER (dosage IS NULL)), 6) AS mean FROM fx5 GROUP BY chrom, pos, variant_id")
def f8m(spark, sf):
    b = BL.dosage_blocks(fx.fx5(spark, sf))
    return r6(BL.variant_means(b).join(b.variants, "vi").select("variant_id", "mean"))


@query("m3_lasso_linear_coefs")
def m3(spark, sf):
    """Non-zero coefficients at one fixed penalty (F7, M12), names joined from the variant table."""
    b, rows = _chain_input(spark, sf)
    path = LP.lasso_path(b, rows.withColumn("fold", F.lit(0)), lambdas=[50.0])
    return Q.nonzero(path.coefficients.select("variant_id", "coef"), "coef")


@query("m3_lambda_max", with_ctes(
    FX5_SQL, _DOSAGE_SQL, "tr AS (SELECT * FROM tg WHERE fold >= 0)", "st AS (SELECT count(*) AS n, avg(y) AS my FROM tr)",
    "xs AS (SELECT variant_id, sum(d) AS sx, sum(d * d) AS sxx, sum(d * (y - my)) AS sxy FROM im JOIN tr USING (fid, iid), st GROUP BY variant_id)",
    "lm AS (SELECT max(abs(sxy) / n / sqrt(sxx / n - (sx / n) * (sx / n))) AS lam FROM xs, st WHERE sxx / n - (sx / n) * (sx / n) > 1e-12)",
    "fm AS (SELECT f.fold, (SELECT avg(y) FROM tr WHERE tr.fold <> f.fold) AS m FROM (SELECT DISTINCT fold FROM tr) f)",
    "fe AS (SELECT fold, avg((y - m) * (y - m)) AS e FROM tr JOIN fm USING (fold) GROUP BY fold)")
    + "SELECT round(lam, 6) AS lam, round(my, 6) AS intercept, 0 AS nonzero, round((SELECT avg(e) FROM fe), 4) AS cvm, "
      "round((SELECT stddev_samp(e) / sqrt(count(*)) FROM fe), 4) AS cvsd FROM lm, st")
def m3max(spark, sf):
    """Above lambda-max no variant is in: the prediction is the training mean, in fit 0 and in every fold."""
    b, rows = _chain_input(spark, sf)
    path = LP.lasso_path(b, rows, lambdas=[1e9])
    return path.cv.select(F.round(F.lit(path.lam_max), 6).alias("lam"), F.round("intercept", 6).alias("intercept"), "nonzero",
                          F.round("cvm", 4).alias("cvm"), F.round("cvsd", 4).alias("cvsd"))


@query("m4_cv_lambda")
def m4(spark, sf):
    """The chain in one entry: k-fold errors along 100 penalties, then along the refined sequence around the best (G6); the
    refined row at the best penalty carries the refit's coefficients (M12) and its error and correlation on the test rows (M11)."""
    chain = LP.lambda_chain(*_chain_input(spark, sf))
    stage = lambda path, name: path.cv.withColumn("stage", F.lit(name))
    rows = stage(chain.coarse, "path").unionByName(stage(chain.refined, "refined"))
    best = (F.col("stage") == "refined") & (F.abs(F.col("lam") - F.lit(chain.lambda_min)) <= F.lit(1e-9 * chain.lambda_min))
    coefs = chain.coefficients.agg(F.sort_array(F.collect_list(F.struct("variant_id", "coef"))).alias("coefficients"))  # at most max_features
    test = chain.test.select(F.col("mse").alias("test_mse"), F.col("corr").alias("test_corr"), F.lit(True).alias("best"))
    refit = coefs.withColumn("best", F.lit(True)).join(test, "best")  # one row each
    return rows.withColumn("best", best).join(refit, "best", "left")


@query("m11_predict_corr")
def m11(spark, sf):
    """Linear prediction of the test rows at one penalty: error and correlation."""
    b, rows = _chain_input(spark, sf)
    path = LP.lasso_path(b, rows.withColumn("fold", F.when(F.col("fold") == LP.HELD, LP.HELD).otherwise(0)), lambdas=[400.0])
    return V.mse(path.predict(400.0).filter(F.col("fold") == LP.HELD), "y", "prediction")


@query("t7_train_many")
def t7(spark, sf):
    """Two methods x 2 replicates x 2 folds on shared folds -> T8 resample table from the predictions."""
    train, _ = wf.flagship_split(spark, sf)
    folds = R.vfold(train, v=2, repeats=2, seed=11, strata="label")
    methods = {"RLR": (lambda: E.recipe(fx.FEATURES), lambda c: M.lasso_logit(c["penalty"], max_iter=30), [{"penalty": 0.01}]),
               "RF": (lambda: E.recipe(fx.FEATURES), lambda c: M.forest(trees=20, mtry=8, min_n=3), [{"trees": 20}])}
    preds = T.train_many(train, folds, methods, LEVELS)
    m = V.metric_set(preds, "label", "pred_class", f"pred_{NEG}", NEG, POS, by=["method", "repeat", "fold"])
    return T.resample_table(m, ["RLR", "RF"])

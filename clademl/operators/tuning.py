"""Grid tuning over resamples, resample evaluation and feature selection.

Fits are distributed Spark ML jobs submitted from a bounded driver thread pool
(as ``CrossValidator(parallelism=...)`` does). Per resample the recipe is refitted
on the analysis rows once and its output cached; every grid cell then fits only
the learner. Each resample's held-out predictions go to one shared table and every
metric comes from one grouped aggregation of it over ``(cell_id, repeat, fold)``.
Penalised logistic regression has a way of its own (``linear_tuning``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import IllegalArgumentException
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as V
from .models import NotConverged, class_probabilities
from .resample import fold_class_weights, fold_multiplicities, in_analysis
from ..session import checkpoint_dir, stored


def _prob_cols(preds: DataFrame, levels: Sequence[str]) -> DataFrame:
    if "probability" in preds.columns:
        return class_probabilities(preds, levels)
    return preds


def with_folds(df: DataFrame, folds: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows tagged with their (repeat, fold) -- one join for all resamples, persisted so every
    resample is a filter instead of its own join."""
    f = folds.select(key, F.col("repeat").alias("__repeat"), F.col("fold").alias("__fold"))
    return df.join(f, key).persist(StorageLevel.MEMORY_AND_DISK)


def split_resample(tagged: DataFrame, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """(analysis, assessment) rows of one resample of a :func:`with_folds` table."""
    r = tagged.filter(F.col("__repeat") == repeat)
    a = r.filter(F.col("__fold") != fold).drop("__repeat", "__fold")
    b = r.filter(F.col("__fold") == fold).drop("__repeat", "__fold")
    return a, b


#: Column with the weight of an analysis row under ``balance``.
WEIGHT = "__weight"


def fold_weights(df: DataFrame, folds: DataFrame, label: str, balance: str, key: str = "row_id", ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """``(key, repeat, fold, __weight)`` of every analysis row: balanced class weights (A18) or the copies of upsampling."""
    if balance == "upsample":
        return fold_multiplicities(df, folds, label, ratio, seed, key).withColumn(WEIGHT, F.col("copies").cast("double")).drop("copies")
    if balance != "weights":
        raise ValueError(f"unknown balance {balance!r}")
    w = fold_class_weights(df, folds, label, key, WEIGHT).withColumnsRenamed({"repeat": "__r", "fold": "__f", label: "__l"})
    return in_analysis(df, folds, label, key).join(F.broadcast(w), (F.col("repeat") == F.col("__r")) & (F.col("fold") == F.col("__f"))
                                                   & F.col(label).eqNullSafe(F.col("__l"))).select(key, "repeat", "fold", WEIGHT)


def fit_resample_cells(df: DataFrame, folds: DataFrame, make_recipe: Callable[[], Pipeline] | None,
                       make_model: Callable[[Mapping], object], grid: Sequence[Mapping], levels: Sequence[str],
                       key: str = "row_id", label: str = "label", keep: Sequence[str] = (),
                       parallelism: int = 4, balance: str | None = None) -> DataFrame:
    """Held-out predictions of every (cell, resample): ``(cell_id, repeat, fold, key, label, pred_*)``.

    Each resample's predictions are written to one shared table as its cells finish and its cached rows released,
    so the result is a scan whatever the number of fits. A cell whose parameters the model refuses or whose solver does
    not converge has no prediction rows; :func:`tune` and :func:`with_failed` give it NULL metrics. ``balance``
    (``"weights"`` or ``"upsample"``) weighs the analysis rows of every resample (learners need a weight column).
    """
    resamples = sorted((r["repeat"], r["fold"]) for r in folds.select("repeat", "fold").distinct().collect())
    tagged = with_folds(df, folds, key)
    weights = stored(fold_weights(df, folds, label, balance, key), "weights") if balance else None
    root = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/clademl-fits-{uuid.uuid4().hex}"

    def run_resample(rf):
        rep, fold = rf
        analysis, assessment = split_resample(tagged, rep, fold)
        if make_recipe is not None:
            prep = make_recipe().fit(analysis)
            a = prep.transform(analysis)
            b = prep.transform(assessment)
        else:
            a, b = analysis, assessment
        if weights is not None:
            a = a.join(weights.filter((F.col("repeat") == rep) & (F.col("fold") == fold)).select(key, WEIGHT), key)
        a = a.persist(StorageLevel.MEMORY_AND_DISK)
        b = b.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            out = None
            for i, cell in enumerate(grid):
                learner = make_model(cell)
                if weights is not None:
                    learner.setWeightCol(WEIGHT)
                try:
                    m = learner.fit(a)
                except (IllegalArgumentException, ValueError, NotConverged):  # anything else is a failed run
                    continue
                p = _prob_cols(m.transform(b), levels)
                cols = [key, label, *keep] + [c for c in p.columns if c.startswith("pred_") or c == "decision"]
                p = p.select(F.lit(i).alias("cell_id"), F.lit(rep).alias("repeat"), F.lit(fold).alias("fold"), *cols)
                out = p if out is None else out.unionByName(p, allowMissingColumns=True)
            if out is None:
                return None
            path = f"{root}/r{rep}f{fold}"
            out.write.parquet(path)
            return out.schema
        finally:
            a.unpersist()
            b.unpersist()

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            schemas = [s for s in pool.map(run_resample, resamples) if s is not None]
    finally:
        tagged.unpersist()
    if not schemas:
        raise RuntimeError("every fit failed")
    widest = max(schemas, key=lambda s: len(s.fields))
    return df.sparkSession.read.schema(widest).parquet(f"{root}/*")


def with_failed(m: DataFrame, folds: DataFrame, cells: int, names: Sequence[str] = ()) -> DataFrame:
    """Metric rows of every (cell, resample), with a NULL value where the fit failed. ``names``: the
    metrics of a long table."""
    keys = ["cell_id", "repeat", "fold"] + (["metric"] if names else [])
    every = folds.select(F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold")).distinct().withColumn(
        "cell_id", F.explode(F.array(*[F.lit(i) for i in range(cells)])))
    if names:
        every = every.withColumn("metric", F.explode(F.array(*[F.lit(n) for n in names])))
    return every.join(m, keys, "left").select(*m.columns)


METRICS = ("accuracy", "mcc", "kap", "roc_auc", "brier_class")


def tune(df: DataFrame, folds: DataFrame, make_recipe, make_model, grid: Sequence[Mapping], levels: Sequence[str],
         event: str, positive: str, key: str = "row_id", label: str = "label", parallelism: int = 4, balance: str | None = None) -> DataFrame:
    """Long metrics ``(cell_id, repeat, fold, metric, estimator, estimate)`` with
    roc_auc, accuracy, mcc, kap, brier_class per (cell, resample); NULL for a failed fit."""
    preds = fit_resample_cells(df, folds, make_recipe, make_model, grid, levels, key, label, parallelism=parallelism, balance=balance)
    m = V.metric_set(preds, label, "pred_class", f"pred_{event}", event, positive, by=["cell_id", "repeat", "fold"])
    return with_failed(m, folds, len(grid), METRICS).withColumn("estimator", F.lit("binary"))


def tune_oneclass(normal: DataFrame, folds: DataFrame, make_recipe, grid: Sequence[Mapping], make_model: Callable[[Mapping], object],
                  key: str = "row_id", label: str = "label", parallelism: int = 4) -> DataFrame:
    """``(cell_id, score)``, the mean share of held-out normal rows that each cell's model accepts. A cell with a fit
    that failed or did not converge has a NULL score."""
    preds = fit_resample_cells(normal, folds, make_recipe, make_model, grid, (), key, label, parallelism=parallelism)
    per = preds.groupBy("cell_id", "repeat", "fold").agg(F.avg((F.col("decision") >= 0).cast("double")).alias("score"))
    per = with_failed(per, folds, len(grid))
    whole = F.count("score") == F.count(F.lit(1))
    return per.groupBy("cell_id").agg(F.when(whole, F.avg("score")).alias("score"))


def collect_metrics(m: DataFrame, keys: Sequence[str] = ("cell_id",), metric: str = "metric",
                    value: str = "estimate") -> DataFrame:
    """Mean, n and std_err (= sd / sqrt(n), NULL for n = 1) per cell and metric; NULL estimates ignored."""
    g = m.groupBy(*keys, metric).agg(F.avg(value).alias("mean"), F.count(value).alias("n"),
                                     F.stddev_samp(value).alias("__sd"))
    return g.select(*keys, metric, "mean", "n", (F.col("__sd") / F.sqrt(F.col("n"))).alias("std_err"))


def with_grid(m: DataFrame, grid: Sequence[Mapping], cell_col: str = "cell_id") -> DataFrame:
    """Attach the grid's parameter values to a metric table (the grid is a bounded parameter list)."""
    names = list(grid[0])
    rows = [(i, *[float(g[n]) for n in names]) for i, g in enumerate(grid)]
    schema = ", ".join([f"{cell_col} int"] + [f"`{n}` double" for n in names])
    g = m.sparkSession.createDataFrame(rows, schema)
    return m.join(F.broadcast(g), cell_col)


def finalize(make_model: Callable[[Mapping], object], best: Mapping) -> object:
    """The learner with the chosen parameters."""
    return make_model(best)


def last_fit(train: DataFrame, test: DataFrame, make_recipe, learner, levels: Sequence[str], event: str,
             positive: str, label: str = "label") -> tuple[object, DataFrame, DataFrame]:
    """T4: fit recipe + learner on train, score test once; returns (model, predictions, metrics)."""
    stages = (make_recipe().getStages() if make_recipe else []) + [learner]
    model = Pipeline(stages=stages).fit(train)
    preds = _prob_cols(model.transform(test), levels)
    mets = V.metric_set(preds, label, "pred_class", f"pred_{event}", event, positive)
    return model, preds, mets


def resample_table(m: DataFrame, methods: Sequence[str], metrics: Mapping[str, str] | None = None,
                   replica: str = "repeat") -> DataFrame:
    """Per (replica, fold) one row, columns ``<method>~Accuracy`` and ``<method>~Kappa``."""
    metrics = metrics or {"accuracy": "Accuracy", "kap": "Kappa"}
    d = m.filter(F.col("metric").isin(list(metrics))).withColumn(
        "__name", F.concat(F.col("method"), F.lit("~"),
                           F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in metrics.items()])))
    names = [f"{meth}~{v}" for meth in methods for v in metrics.values()]
    return d.groupBy(F.col(replica).alias("REPLICA"), "fold").pivot("__name", names).agg(F.first("estimate"))


def importance_table(model, names: Sequence[str], k: int | None = None, scale: bool = True) -> list[tuple[str, float]]:
    """(feature, importance) scaled to 0-100, largest first; forests use
    ``featureImportances``, linear models |coefficient| of standardised features."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(x) for x in model.coefficients.toArray().tolist()]
    rows = list(zip(names, vals))
    if scale and rows:
        lo, hi = min(v for _, v in rows), max(v for _, v in rows)
        rows = [(n, 100.0 * (v - lo) / (hi - lo) if hi > lo else 0.0) for n, v in rows]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return rows[:k] if k else rows


def filter_importance(df: DataFrame, label: str, features: Sequence[str], event: str) -> DataFrame:
    """Model-free importance = per-feature ROC AUC of the raw value, ``max(auc, 1 - auc)``."""
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [label], list(features), "variable", "x")
    auc = V.roc_auc(long, label, "x", event, by=["variable"])
    return auc.select("variable", F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("importance"))


def tuning_curve(m: DataFrame, params: Sequence[str], metric: str = "mcc") -> DataFrame:
    """(param, value, mean) rows of one metric -- the table behind a tuning plot."""
    d = m.filter(F.col("metric") == metric)
    long = d.select("mean", *[F.col(p).cast("double").alias(p) for p in params]).unpivot(
        ["mean"], list(params), "param", "value")
    return long.select("param", "value", "mean")


def rfe(df: DataFrame, folds: DataFrame, features: Sequence[str], sizes: Sequence[int], make_ranker,
        make_model, levels: Sequence[str], event: str, positive: str, key: str = "row_id", label: str = "label",
        parallelism: int = 4) -> tuple[DataFrame, list[str]]:
    """Recursive feature elimination over resamples.

    Per resample: the full-feature ranker (a forest) ranks features by importance
    on the analysis rows; for every size s a model on the top-s features is scored
    on the assessment rows. Profile = mean accuracy per size; chosen size = best
    mean (ties -> smaller); final features = lowest mean rank over resamples.
    """
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    resamples = [(r["repeat"], r["fold"]) for r in folds.select("repeat", "fold").distinct().collect()]
    features = list(features)

    tagged = with_folds(df, folds, key)

    def one(rf):
        rep, fold = rf
        analysis, assessment = split_resample(tagged, rep, fold)
        va = VectorAssembler(inputCols=features, outputCol="features")
        a = va.transform(analysis).persist(StorageLevel.MEMORY_AND_DISK)
        ranker = make_ranker().fit(a)
        imp = ranker.featureImportances.toArray().tolist()
        order = sorted(range(len(features)), key=lambda i: (-imp[i], i))
        ranks = [(features[j], r + 1) for r, j in enumerate(order)]
        preds = []
        for s in sizes:
            top = [features[j] for j in order[:s]]
            vs = VectorAssembler(inputCols=top, outputCol="__fs")
            m = make_model().setFeaturesCol("__fs").fit(vs.transform(analysis))
            p = _prob_cols(m.transform(vs.transform(assessment)), levels)
            preds.append(p.select(F.lit(s).alias("size"), F.lit(rep).alias("repeat"), F.lit(fold).alias("fold"),
                                  label, "pred_class"))
        a.unpersist()
        return ranks, preds

    all_ranks, all_preds = [], []
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for (rep, fold), (ranks, preds) in zip(resamples, pool.map(one, resamples)):
            all_ranks += [(rep, fold, f, r) for f, r in ranks]
            all_preds += preds
    u = all_preds[0]
    for p in all_preds[1:]:
        u = u.unionByName(p)
    per = V.accuracy(u, label, "pred_class", by=["size", "repeat", "fold"])
    profile = per.groupBy("size").agg(F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("sd"))
    best = profile.orderBy(F.col("accuracy").desc(), F.col("size").asc()).first()["size"]
    rk = spark.createDataFrame(all_ranks, "repeat int, fold int, variable string, rank int")  # p x resamples rows
    final = [r["variable"] for r in rk.groupBy("variable").agg(F.avg("rank").alias("m"))
             .orderBy("m", "variable").limit(int(best)).collect()]
    return profile.withColumn("selected", F.col("size") == F.lit(int(best))), final


def train_many(df: DataFrame, folds: DataFrame, methods: Mapping[str, tuple], levels: Sequence[str],
               key: str = "row_id", label: str = "label", parallelism: int = 4) -> DataFrame:
    """Several methods on the same replicate folds (``repeat`` = replica).

    ``methods`` maps a name to ``(make_recipe, make_model, grid)``. Returns every
    held-out prediction with ``method``, ``cell_id``, ``repeat``, ``fold`` -- the saved
    cross-validation predictions (T11); metrics follow from one grouped aggregate.
    """
    out = None
    for name, (make_recipe, make_model, grid) in methods.items():
        p = fit_resample_cells(df, folds, make_recipe, make_model, grid, levels, key, label, parallelism=parallelism)
        p = p.withColumn("method", F.lit(name))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out

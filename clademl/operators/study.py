"""Replicate study: methods tuned on the same replicate folds, the best replicate of each refitted.

A replicate is one repeat of the folds. Inside it every method picks its best cell; over the replicates it picks its best one,
and the model of that cell is refitted on all training rows. Predictions are one stored table, all metrics one aggregate of
it, and only the choice (a row per method) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as V
from .aggregate import class_weights
from .linear_tuning import tune_linear
from .ranking import best_per_group
from .resample import upsample
from .tuning import METRICS, WEIGHT, _prob_cols, fit_resample_cells
from ..session import persist, stored

#: Means that agree to this many places are ties: sums of doubles depend on the order of their rows.
TIE_PLACES = 10


@dataclass(frozen=True)
class Method:
    """A learner with its recipe and grid. With ``features`` it is a penalised logistic regression whose grid is fitted in shared
    passes (cells have ``penalty`` and optionally ``mixture``)."""

    make_recipe: Callable[[], Pipeline]
    make_model: Callable[[Mapping], object]
    grid: Sequence[Mapping]
    features: Sequence[str] | None = None


@dataclass(frozen=True)
class Study:
    predictions: DataFrame  #: every held-out prediction: method, cell_id, repeat, fold, key, label, pred_*
    metrics: DataFrame  #: long, NULL where a fit failed
    chosen: list[dict]  #: a row per method: method, repeat, cell_id, mean
    models: dict[str, object]  #: the refitted pipeline of each method
    cv_predictions: DataFrame  #: held-out predictions of the chosen replicates, ``chosen`` marks the chosen cell


def tuned_replicas(m: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Best cell of each (method, repeat) by its mean over the folds: ``(method, repeat, cell_id, mean)``.

    A cell with a failed fold (NULL) is out, as is a replicate without a whole cell. Ties: the smaller cell."""
    whole = F.count("estimate") == F.count(F.lit(1))
    mean = F.when(whole, F.round(F.avg("estimate"), TIE_PLACES)).alias("mean")
    means = m.filter(F.col("metric") == metric).groupBy("method", "repeat", "cell_id").agg(mean).filter("mean is not null")
    return best_per_group(means, ["method", "repeat"], "mean", tiebreak=["cell_id"]).select("method", "repeat", "cell_id", "mean")


def best_replicas(tuned: DataFrame) -> DataFrame:
    """Best replicate of each method, ties to the smaller number."""
    return best_per_group(tuned, ["method"], "mean", tiebreak=["repeat"]).select("method", "repeat", "cell_id", "mean")


def held_out(df: DataFrame, folds: DataFrame, methods: Mapping[str, Method], levels: Sequence[str], event: str, positive: str, key: str = "row_id",
             label: str = "label", parallelism: int = 4, balance: str | None = None) -> DataFrame:
    """Held-out predictions of every method, cell and resample; a failed fit has no rows."""
    out = None
    for name, m in methods.items():
        if m.features is not None:
            p = tune_linear(df, folds, m.features, m.grid, levels, event, positive, key, label, balance=balance).predictions
            p = p.filter(F.col(f"pred_{positive}").isNotNull())
        else:
            p = fit_resample_cells(df, folds, m.make_recipe, m.make_model, m.grid, levels, key, label, parallelism=parallelism, balance=balance)
        p = p.withColumn("method", F.lit(name))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def study_metrics(preds: DataFrame, folds: DataFrame, methods: Mapping[str, Method], event: str, positive: str, label: str = "label") -> DataFrame:
    """Metric rows of every (method, cell, resample), NULL where there is no prediction."""
    by = ["method", "cell_id", "repeat", "fold"]
    m = V.metric_set(preds, label, "pred_class", f"pred_{event}", event, positive, by=by)
    cells = F.array(*[F.struct(F.lit(name).alias("method"), F.lit(i).alias("cell_id")) for name, x in methods.items() for i in range(len(x.grid))])
    every = folds.select(F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold")).distinct()
    every = every.withColumn("__c", F.explode(cells)).select("__c.*", "repeat", "fold").withColumn("metric", F.explode(F.array(*[F.lit(n) for n in METRICS])))
    return every.join(m.select(*by, "metric", "estimate"), [*by, "metric"], "left")


def refit(train: DataFrame, make_recipe: Callable[[], Pipeline], learner, label: str = "label", key: str = "row_id", balance: str | None = None,
          ratio: float = 1.0, seed: int = 42):
    """Recipe and learner on all training rows -> one pipeline model.

    ``balance``: ``"upsample"`` weighs a row by its copies when its class grows to the largest one's size, ``"weights"``
    by its class (learners need a weight column); the recipe sees every row once."""
    prep = make_recipe().fit(train)
    rows = train
    if balance == "upsample":
        copies = upsample(train.select(key, label), label, ratio, seed, key).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
        rows = train.join(copies, key)
    elif balance == "weights":
        rows = class_weights(train, label, WEIGHT)
    elif balance is not None:
        raise ValueError(f"unknown balance {balance!r}")
    if balance:
        learner.setWeightCol(WEIGHT)
    rows = persist(prep.transform(rows))
    try:
        model = learner.fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([prep, model])


def replicate_study(train: DataFrame, folds: DataFrame, methods: Mapping[str, Method], levels: Sequence[str], event: str, positive: str, key: str = "row_id",
                    label: str = "label", metric: str = "accuracy", parallelism: int = 4, balance: str | None = None) -> Study:
    """T7, T9, T3 and T11 in one: tune, choose, refit, and keep the held-out predictions of the final set.

    A method none of whose cells fits in all folds of a replicate has no final model and no row in ``chosen``."""
    preds = stored(held_out(train, folds, methods, levels, event, positive, key, label, parallelism, balance), "study")
    mets = stored(study_metrics(preds, folds, methods, event, positive, label), "study-metrics")
    best = best_replicas(tuned_replicas(mets, metric))
    chosen = sorted((r.asDict() for r in best.collect()), key=lambda r: list(methods).index(r["method"]))  # a row per method
    models = {c["method"]: refit(train, methods[c["method"]].make_recipe, methods[c["method"]].make_model(methods[c["method"]].grid[c["cell_id"]]),
                                 label, key, balance) for c in chosen}
    picked = F.array(*[F.struct(F.lit(c["method"]).alias("m"), F.lit(c["repeat"]).cast("int").alias("r"), F.lit(c["cell_id"]).cast("int").alias("c")) for c in chosen])
    pair = F.filter(picked, lambda p: (p["m"] == F.col("method")) & (p["r"] == F.col("repeat")))
    cv = preds.withColumn("__p", pair).filter(F.size("__p") == 1).withColumn("chosen", F.col("cell_id") == F.col("__p")[0]["c"]).drop("__p") if chosen else \
        preds.filter(F.lit(False)).withColumn("chosen", F.lit(False))
    return Study(preds, mets, chosen, models, cv)


def final_predictions(models: Mapping[str, object], df: DataFrame, levels: Sequence[str], keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """Rows scored by every model of the final set: ``(method, keep..., pred_*, pred_class)``."""
    cols = [*keep, *[f"pred_{lv}" for lv in levels], "pred_class"]
    out = None
    for name, model in models.items():
        p = _prob_cols(model.transform(df), levels).select(F.lit(name).alias("method"), *cols)
        out = p if out is None else out.unionByName(p)
    return out

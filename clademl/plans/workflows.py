"""End-to-end workflows built from the operators.

Flagship ("how good is a lasso classifier on held-out strains, and which
unlabelled rows are positive?"): FX1 -> complete cases (F4) -> stratified split
(R2) -> recipe zv/corr/normalize fitted on train (E6) -> lasso logistic (M1) ->
test metrics (V1-V3) and the discovery list over unlabelled rows (D1).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as V
from ..operators.discovery import discover
from ..operators.models import class_probabilities, label_index, lasso_logit
from ..operators.quality import complete_cases
from ..operators.recipe import recipe
from ..operators.resample import split_stratified
from ..session import persist
from . import fixtures as fx

FLAGSHIP_PENALTY = 0.01


def flagship_split(spark: SparkSession, sf_dir: str, seed: int = 42):
    data = complete_cases(fx.fx1(spark, sf_dir), fx.FEATURES)
    data = label_index(data, "label", fx.LEVELS)
    split = persist(split_stratified(data, "label", 0.8, seed))
    return split.filter(F.col("set") == "train"), split.filter(F.col("set") == "test")


def flagship_model(spark: SparkSession, sf_dir: str, penalty: float = FLAGSHIP_PENALTY, seed: int = 42):
    train, test = flagship_split(spark, sf_dir, seed)
    stages = recipe(fx.FEATURES, ("zv", "corr", "normalize")).getStages() + [lasso_logit(penalty)]
    model = Pipeline(stages=stages).fit(train)
    return model, train, test


def flagship_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, test = flagship_model(spark, sf_dir)
    preds = class_probabilities(model.transform(test), fx.LEVELS)
    return V.metric_set(preds, "label", "pred_class", f"pred_{fx.NEG}", fx.NEG, fx.POS)


def discovery_flagship(spark: SparkSession, sf_dir: str, run_ts: int = 1785000000) -> DataFrame:
    model, _, _ = flagship_model(spark, sf_dir)
    unl = complete_cases(fx.fx7(spark, sf_dir), fx.FEATURES)
    return discover(model, unl, fx.LEVELS, negative=fx.NEG, positive=fx.POS,
                    ids=["row_id", "organism", "taxon"], run_ts=run_ts)

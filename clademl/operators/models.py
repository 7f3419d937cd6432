"""Classifiers and regressors on executors.

Built-in Spark ML learners carry the reference's models (lasso / elastic-net
logistic and linear regression, random forest, gradient boosting, one-hidden-
layer network). The RBF-kernel SVMs use random Fourier features (Rahimi & Recht
2007): a seeded ``RandomFourier`` transformer maps the standardised features to
``sqrt(2/D) cos(Wx + b)`` so that a linear model on them approximates the kernel
model; the one-class nu-SVM dual is then solved by fully corrective Frank-Wolfe
steps, each step one distributed pass over the cached feature vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import case_map

LABEL_INDEX = "label_index"


class NotConverged(RuntimeError):
    """A solver that did not reach its tolerance; tuning records the fit as failed."""


# ---------------------------------------------------------------- spark ML learners
def lasso_logit(penalty: float, weight_col: str | None = None, features: str = "features",
                label: str = LABEL_INDEX, max_iter: int = 100) -> LogisticRegression:
    """M1: L1 logistic regression on standardised features."""
    return elastic_net_logit(1.0, penalty, weight_col, features, label, max_iter)


def elastic_net_logit(alpha: float, lam: float, weight_col: str | None = None, features: str = "features",
                      label: str = LABEL_INDEX, max_iter: int = 100) -> LogisticRegression:
    """M2."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=float(alpha), regParam=float(lam),
                            standardization=True, family="binomial", maxIter=max_iter)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def lasso_linear(lam: float, alpha: float = 1.0, features: str = "features", label: str = "y",
                 max_iter: int = 100) -> LinearRegression:
    """M3: lasso / ridge / elastic-net linear regression."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=float(lam), elasticNetParam=float(alpha),
                            standardization=True, maxIter=max_iter)


def forest(trees: int = 500, mtry: int | None = None, min_n: int = 1, weight_col: str | None = None,
           seed: int = 42, features: str = "features", label: str = LABEL_INDEX) -> RandomForestClassifier:
    """M5: random forest; ``min_n`` maps to the minimum rows per child node, depth cap 30. A row's node in every tree is
    kept from level to level, so that deep trees are not walked from the root again at each of them."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=int(trees), maxDepth=30, cacheNodeIds=True,
                                minInstancesPerNode=int(min_n), seed=seed,
                                featureSubsetStrategy=str(int(mtry)) if mtry else "sqrt")
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def boost(trees: int = 500, tree_depth: int = 6, min_n: int = 1, sample_size: float = 1.0, mtry: int | None = None,
          learn_rate: float = 0.1, loss_reduction: float = 0.0, seed: int = 42, features: str = "features",
          label: str = LABEL_INDEX) -> GBTClassifier:
    """M6: gradient boosted trees."""
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=int(trees), maxDepth=int(tree_depth),
                         minInstancesPerNode=int(min_n), subsamplingRate=float(sample_size),
                         featureSubsetStrategy=str(int(mtry)) if mtry else "sqrt", stepSize=float(learn_rate),
                         minInfoGain=float(loss_reduction), seed=seed)


def net(n_features: int, size: int = 5, max_iter: int = 100, seed: int = 42, features: str = "features",
        label: str = LABEL_INDEX) -> MultilayerPerceptronClassifier:
    """M9: one hidden layer of ``size`` units (no weight decay in Spark: documented gap)."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[n_features, int(size), 2],
                                          maxIter=max_iter, seed=seed)


# ---------------------------------------------------------------- random Fourier features
def rff_weights(p: int, n_components: int, sigma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W ~ N(0, 2 sigma I) (kernel exp(-sigma ||x - y||^2)), b ~ U(0, 2 pi); seeded."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * sigma), size=(n_components, p))
    b = rng.uniform(0.0, 2 * math.pi, size=n_components)
    return w, b


class RandomFourier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Vector column -> random Fourier feature vector (Arrow-batched numpy matmul)."""

    inputCol = Param(Params._dummy(), "inputCol", "input vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output vector column", TypeConverters.toString)
    nComponents = Param(Params._dummy(), "nComponents", "number of features D", TypeConverters.toInt)
    sigma = Param(Params._dummy(), "sigma", "RBF kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of W and b", TypeConverters.toInt)
    nInput = Param(Params._dummy(), "nInput", "input dimension", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", nComponents=256, sigma=0.1, seed=42, nInput=1):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="rff", nComponents=256, sigma=0.1, seed=42, nInput=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        w, b = rff_weights(g(self.nInput), g(self.nComponents), g(self.sigma), g(self.seed))
        scale = math.sqrt(2.0 / g(self.nComponents))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            m = np.stack(x.to_numpy())
            z = scale * np.cos(m @ w.T + b)
            return pd.Series(list(z))

        out = g(self.outputCol)
        return df.withColumn(out, array_to_vector(rff(vector_to_array(F.col(g(self.inputCol))))))


# ---------------------------------------------------------------- persistence of models made of arrays and parts
class _PartsWriter(MLWriter):
    """Metadata and parameters as JSON, arrays as Parquet, fitted parts by their own writers."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        parts, arrays, numbers = self.model._state()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"numbers": numbers, "parts": sorted(parts)})
        for name, part in parts.items():
            part.write().overwrite().save(f"{path}/parts/{name}")
        rows = [(n, [float(x) for x in a]) for n, a in arrays.items()]
        spark.createDataFrame(rows, "name string, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")


class _PartsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        parts = {n: DefaultParamsReader.loadParamsInstance(f"{path}/parts/{n}", spark) for n in meta["parts"]}
        arrays = {r["name"]: np.array(r["value"]) for r in spark.read.parquet(f"{path}/arrays").collect()}  # the model's own weights
        model = self.cls._from_state(parts, arrays, meta["numbers"])
        model._resetUid(meta["uid"])
        return model


class _Parts(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _PartsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PartsReader(cls)


# ---------------------------------------------------------------- two-class kernel SVM
class KernelSVMModel(Model, _Parts):
    def __init__(self, rff: RandomFourier, svm, platt, features: str):
        super().__init__()
        self.rff, self.svm, self.platt, self.features = rff, svm, platt, features

    def _state(self):
        return {"rff": self.rff, "svm": self.svm, "platt": self.platt}, {}, {"features": self.features}

    @classmethod
    def _from_state(cls, parts, arrays, numbers):
        return cls(parts["rff"], parts["svm"], parts["platt"], numbers["features"])

    def _transform(self, df: DataFrame) -> DataFrame:
        z = self.rff.transform(df)
        m = self.svm.transform(z).withColumn("margin", vector_to_array("rawPrediction")[1]) \
            .drop("rawPrediction", "prediction", self.rff.getOrDefault(self.rff.outputCol))
        m = m.withColumn("__mv", array_to_vector(F.array("margin")))
        out = self.platt.transform(m).drop("__mv", "rawPrediction")
        return out


class KernelSVM(Estimator):
    """M7: RBF SVM ~ linear SVM on random Fourier features, with Platt-scaled
    probabilities fitted on out-of-fold margins (3 hashed folds)."""

    def __init__(self, cost: float = 1.0, sigma: float = 0.1, n_components: int = 256, seed: int = 42,
                 features: str = "features", label: str = LABEL_INDEX, n_input: int | None = None, max_iter: int = 100):
        super().__init__()
        self.cost, self.sigma, self.D, self.seed = cost, sigma, n_components, seed
        self.features, self.label, self.n_input, self.max_iter = features, label, n_input, max_iter

    def _fit(self, df: DataFrame) -> KernelSVMModel:
        p = self.n_input or len(df.select(self.features).first()[0])
        rff = RandomFourier(inputCol=self.features, outputCol="__rff", nComponents=self.D, sigma=self.sigma,
                            seed=self.seed, nInput=p)
        z = rff.transform(df).select(self.label, "__rff", F.pmod(F.xxhash64(vector_to_array(F.col(self.features))), F.lit(3)).alias("__f"))
        z = z.persist(StorageLevel.MEMORY_AND_DISK)
        n = z.count()
        reg = 1.0 / (self.cost * max(n, 1))

        def svc():
            # the Fourier features approximate the kernel as they are: rescaling them would change it
            return LinearSVC(featuresCol="__rff", labelCol=self.label, regParam=reg, maxIter=self.max_iter, standardization=False)

        oof = None
        for f in range(3):
            m = svc().fit(z.filter(F.col("__f") != f))
            part = m.transform(z.filter(F.col("__f") == f)).select(
                self.label, array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("__mv"))
            oof = part if oof is None else oof.unionByName(part)
        platt = LogisticRegression(featuresCol="__mv", labelCol=self.label, regParam=0.0).fit(oof)
        svm = svc().fit(z)
        z.unpersist()
        return KernelSVMModel(rff, svm, platt, self.features)


# ---------------------------------------------------------------- one-class nu-SVM
class OneClassSVMModel(Model, _Parts):
    def __init__(self, rff: RandomFourier, w: np.ndarray, rho: float, history: list[float]):
        super().__init__()
        self.rff, self.w, self.rho, self.history = rff, w, rho, history

    def _state(self):
        return {"rff": self.rff}, {"w": self.w, "history": self.history}, {"rho": float(self.rho)}

    @classmethod
    def _from_state(cls, parts, arrays, numbers):
        return cls(parts["rff"], arrays["w"], numbers["rho"], arrays["history"].tolist())

    def _transform(self, df: DataFrame) -> DataFrame:
        z = self.rff.transform(df)
        wl = F.array(*[F.lit(float(x)) for x in self.w])
        dot = F.aggregate(F.zip_with(vector_to_array("__rff"), wl, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        return z.withColumn("decision", dot - F.lit(self.rho)).drop("__rff")


class OneClassSVM(Estimator):
    """M8: nu-SVM on the normal class; Frank-Wolfe on the dual over random features.

    Step t: scores s_i = w . z_i (one pass), the nu-share of lowest scores defines the
    linear minimiser g (mean of their z, one ``Summarizer`` pass); w is then the shortest
    vector in the convex hull of the minimisers so far (a small driver-side problem). Stops
    when the duality gap w.(w - g) <= tol * w.w; a solver that gets no further than that
    within ``max_iter`` steps raises. rho is the nu-quantile of training scores, so about
    nu of the training rows are outliers.
    """

    def __init__(self, nu: float = 0.1, sigma: float = 0.1, n_components: int = 256, seed: int = 42,
                 features: str = "features", max_iter: int = 500, tol: float = 1e-3, n_input: int | None = None):
        super().__init__()
        self.nu, self.sigma, self.D, self.seed = nu, sigma, n_components, seed
        self.features, self.max_iter, self.tol, self.n_input = features, max_iter, tol, n_input

    def _fit(self, df: DataFrame) -> OneClassSVMModel:
        if not 0 < self.nu <= 1:
            raise ValueError(f"nu is a share above 0, not {self.nu}")
        p = self.n_input or len(df.select(self.features).first()[0])
        rff = RandomFourier(inputCol=self.features, outputCol="__rff", nComponents=self.D, sigma=self.sigma,
                            seed=self.seed, nInput=p)
        z = rff.transform(df.select(self.features)).select("__rff").persist(StorageLevel.MEMORY_AND_DISK)
        w = np.array(z.select(Summarizer.mean(F.col("__rff")).alias("m")).first()["m"].toArray())
        history, atoms, share = [], [w], np.ones(1)
        for _ in range(self.max_iter):
            scored = z.withColumn("__s", _dot(w))
            thr = scored.approxQuantile("__s", [self.nu], 1e-4)[0]
            g = scored.filter(F.col("__s") <= thr).select(Summarizer.mean(F.col("__rff")).alias("m")).first()["m"]
            g = np.array(g.toArray())
            gap = float(w @ (w - g))
            history.append(gap)
            if gap <= self.tol * float(w @ w):
                break
            atoms.append(g)
            share = _shortest(np.array(atoms), np.append(share, 0.0))
            w = share @ np.array(atoms)
        else:
            z.unpersist()
            raise NotConverged(f"one-class SVM: gap {history[-1] if history else math.inf:.3g} after {self.max_iter} steps, above {self.tol} of w.w")
        rho = z.withColumn("__s", _dot(w)).approxQuantile("__s", [self.nu], 1e-4)[0]
        z.unpersist()
        return OneClassSVMModel(rff, w, rho, history)


def _shortest(atoms: np.ndarray, a: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """Convex weights of the shortest vector in the hull of ``atoms``, by pairwise steps from ``a``."""
    k, a = atoms @ atoms.T, a.copy()
    for _ in range(steps):
        grad = k @ a
        to, off = int(grad.argmin()), int(np.where(a > 0, grad, -np.inf).argmax())
        gap, curve = grad[off] - grad[to], k[to, to] + k[off, off] - 2 * k[to, off]
        if gap <= 1e-10 * (a @ grad) or curve <= 0:
            break
        step = min(a[off], gap / curve)
        a[to] += step
        a[off] -= step
    return a


def _dot(w: np.ndarray):
    wl = F.array(*[F.lit(float(x)) for x in w])
    return F.aggregate(F.zip_with(vector_to_array("__rff"), wl, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


# ---------------------------------------------------------------- scoring helpers
def class_probabilities(preds: DataFrame, levels: Sequence[str], prob_col: str = "probability",
                        prefix: str = "pred_") -> DataFrame:
    """Probability vector -> one ``pred_<level>`` column per level + ``pred_class`` (argmax, ties first)."""
    arr = vector_to_array(F.col(prob_col))
    d = preds.withColumns({f"{prefix}{lv}": arr[i] for i, lv in enumerate(levels)})
    from ..functions.exprs import argmax_class

    return d.withColumn("pred_class", argmax_class({lv: f"{prefix}{lv}" for lv in levels}))


def coef_table(model, names: Sequence[str], intercept: bool = True) -> list[tuple[str, float]]:
    """(feature, coefficient) pairs of a linear model (driver side: p values)."""
    coefs = model.coefficients.toArray().tolist()
    rows = list(zip(names, coefs))
    if intercept:
        rows = [("(Intercept)", float(model.intercept))] + rows
    return rows


def label_index(df: DataFrame, label: str, levels: Sequence[str], out: str = LABEL_INDEX) -> DataFrame:
    """Label -> 0-based index in the fixed level order."""
    return df.withColumn(out, case_map(label, {lv: float(i) for i, lv in enumerate(levels)}, None).cast("double"))

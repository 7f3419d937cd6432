"""One-hidden-layer network with weight decay (M9): gradients on executors, L-BFGS on the driver over the weights only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import persist
from .models import LABEL_INDEX, _Parts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def split_weights(w: np.ndarray, p: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer ((1 + p) x size, biases first) and output layer (1 + size)."""
    return w[: (1 + p) * size].reshape(1 + p, size), w[(1 + p) * size :]


def loss_and_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """``[entropy, gradient...]`` summed over the rows (without the decay term)."""
    hidden, out = split_weights(w, x.shape[1], size)
    a = _sigmoid(hidden[0] + x @ hidden[1:])
    z = out[0] + a @ out[1:]
    p = _sigmoid(z)
    entropy = (weight * (np.logaddexp(0, z) - y * z)).sum()
    d = weight * (p - y)
    back = d[:, None] * out[1:] * a * (1 - a)
    return np.concatenate(([entropy], back.sum(axis=0), (x.T @ back).ravel(), [d.sum()], a.T @ d))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with backtracking to the sufficient-decrease rule; stops when a step improves by less than ``tol`` of the value."""
    value, g = f(w)
    history, pairs = [value], []
    for _ in range(max_iter):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope = -(g @ q)
        if slope >= 0:  # no descent left in the memory's metric
            q, slope, pairs = g, -(g @ g), []
        step = 1.0 if pairs else min(1.0, 1.0 / max(1e-12, float(np.abs(g).sum())))
        for _ in range(40):
            new = w - step * q
            there, h = f(new)
            if there <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - w) @ (h - g) > 1e-12:
            pairs = [*pairs[-memory + 1 :], (new - w, h - g)]
        gain, w, value, g = value - there, new, there, h
        history.append(value)
        if gain <= tol * (abs(value) + tol):
            break
    return w, history


class DecayNetModel(Model, _Parts):
    """Adds ``probability`` (vector of both classes) and ``prediction``."""

    def __init__(self, w: np.ndarray, size: int, p: int, features: str, history: list[float]):
        super().__init__()
        self.w, self.size, self.p, self.features, self.history = np.asarray(w), size, p, features, history

    def _state(self):
        return {}, {"w": self.w, "history": np.asarray(self.history)}, {"size": self.size, "p": self.p, "features": self.features}

    @classmethod
    def _from_state(cls, parts, arrays, numbers):
        return cls(arrays["w"], numbers["size"], numbers["p"], numbers["features"], arrays["history"].tolist())

    def _transform(self, df: DataFrame) -> DataFrame:
        hidden, out = split_weights(self.w, self.p, self.size)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def prob(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            p = _sigmoid(out[0] + _sigmoid(hidden[0] + np.stack(x.to_numpy()) @ hidden[1:]) @ out[1:])
            return pd.Series(list(np.column_stack((1 - p, p))))

        d = df.withColumn("probability", array_to_vector(prob(vector_to_array(F.col(self.features)))))
        return d.withColumn("prediction", (vector_to_array("probability")[1] > 0.5).cast("double"))


class DecayNet(Estimator):
    """M9: ``size`` logistic hidden units, logistic output; minimises the summed entropy plus ``decay`` times the sum of all
    squared weights.

    A step of the solver is one pass: each task returns one row with its loss and gradient (as long as the weights). Starting
    weights are uniform in +-0.7 by ``seed``. Like the reference's learner it stops at ``max_iter`` steps without complaint. Rows with a
    NULL label or weight are left out.
    """

    def __init__(self, size: int = 5, decay: float = 0.0, max_iter: int = 100, seed: int = 42, tol: float = 1e-6, features: str = "features",
                 label: str = LABEL_INDEX, weight_col: str | None = None):
        super().__init__()
        self.size, self.decay, self.max_iter, self.seed, self.tol = int(size), float(decay), max_iter, seed, tol
        self.features, self.label, self.weight_col = features, label, weight_col

    def setWeightCol(self, name: str) -> DecayNet:
        self.weight_col = name
        return self

    def _fit(self, df: DataFrame) -> DecayNetModel:
        if self.size < 1 or self.decay < 0:
            raise ValueError("at least one hidden unit and no negative decay")
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        rows = df.select(vector_to_array(F.col(self.features)).alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"))
        rows = persist(rows.filter("y is not null and w is not null"))
        try:
            one = rows.first()
            if one is None:
                raise ValueError("no training row")
            p, size, decay = len(one["x"]), self.size, self.decay

            def value(w: np.ndarray) -> tuple[float, np.ndarray]:
                def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                    acc = np.zeros(len(w) + 1)
                    for b in batches:
                        if len(b):
                            acc += loss_and_gradient(w, np.stack(b["x"].to_list()), b["y"].to_numpy(), b["w"].to_numpy(), size)
                    yield pd.DataFrame({"v": [acc]})

                got = rows.mapInPandas(run, "v array<double>").agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"].toArray()
                return float(got[0] + decay * (w @ w)), got[1:] + 2 * decay * w

            start = np.random.default_rng(self.seed).uniform(-0.7, 0.7, (1 + p) * size + 1 + size)
            w, history = minimise(value, start, self.max_iter, self.tol)
        finally:
            rows.unpersist()
        return DecayNetModel(w, size, p, self.features, history)

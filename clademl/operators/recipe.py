"""Preprocessing estimators fitted on training rows, applied to any rows.

Every step is a Spark ML ``Estimator`` whose fit is one (or two) aggregate jobs
and whose model is a pure column-expression ``Transformer`` (whole-stage codegen,
no UDF). Steps chain in a ``pyspark.ml.Pipeline``; the fitted ``PipelineModel``
persists with ``save``/``load`` (all state lives in Params).
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- shared params
class _Cols(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns the step looks at", TypeConverters.toListString)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


class _Drop(Params):
    dropCols = Param(Params._dummy(), "dropCols", "columns removed by the fitted step", TypeConverters.toListString)

    def getDropCols(self) -> list[str]:
        return self.getOrDefault(self.dropCols)


class DropColumnsModel(Model, _Cols, _Drop, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted filter step: drops the columns chosen at fit time."""

    @keyword_only
    def __init__(self, inputCols=None, dropCols=None):
        super().__init__()
        self._setDefault(inputCols=[], dropCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.getDropCols() if c in df.columns])


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


# ---------------------------------------------------------------- E1
class ZeroVar(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Drop columns with a single distinct non-NULL value (or none). One aggregate."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DropColumnsModel:
        cols = _present(df, self.getInputCols())
        if not cols:
            return DropColumnsModel(inputCols=[], dropCols=[])
        row = df.agg(*[(F.min(c).eqNullSafe(F.max(c)) | F.max(c).isNull()).alias(c) for c in cols]).first()
        return DropColumnsModel(inputCols=cols, dropCols=[c for c in cols if row[c]])


# ---------------------------------------------------------------- E2
class NearZeroVar(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Drop ``freq_ratio > freqCut and unique_pct <= uniqueCut`` (or a single value).

    ``freq_ratio`` = most / second most frequent value count, ``unique_pct`` =
    100 * distinct non-NULL values / rows. A HyperLogLog pass first rules out
    clearly high-cardinality columns (estimate above twice the cut, far beyond the
    5 % estimator error); the exact counts run only on the remaining columns, among
    them every column with a handful of values. A column without any value has
    ``n_distinct`` 0 and no ratio; -0.0 and 0.0 are one value.
    """

    freqCut = Param(Params._dummy(), "freqCut", "frequency ratio cut", TypeConverters.toFloat)
    uniqueCut = Param(Params._dummy(), "uniqueCut", "percent unique cut", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, freqCut=95 / 5, uniqueCut=10.0):
        super().__init__()
        self._setDefault(inputCols=[], freqCut=95 / 5, uniqueCut=10.0)
        self._set(**self._input_kwargs)

    def stats(self, df: DataFrame) -> DataFrame:
        cols = _present(df, self.getInputCols())
        cut = self.getOrDefault(self.uniqueCut)
        spark = df.sparkSession
        empty = spark.createDataFrame([], "variable string, freq_ratio double, unique_pct double, n_distinct long")
        if not cols:
            return empty
        # long form: one small HLL buffer per column group, partial aggregation map-side
        kinds = dict(df.dtypes)
        plain = {c: F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in cols}  # -0.0 + 0.0 = 0.0
        long = df.select(*[e.cast("string").alias(c) for c, e in plain.items()]).unpivot([], cols, "variable", "value")
        est = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"),
                                           F.approx_count_distinct("value", 0.05).alias("nd")).collect()
        n = max((r["n"] for r in est), default=0)
        bare = [r["variable"] for r in est if r["nd"] == 0]
        cand = [r["variable"] for r in est if r["nd"] and (r["nd"] <= 8 or 100.0 * r["nd"] / n <= 2 * cut)]
        if bare:
            empty = spark.createDataFrame([(c, None, 0.0, 0) for c in bare], empty.schema)
        if not cand:
            return empty
        vc = (long.filter(F.col("variable").isin(cand) & F.col("value").isNotNull())
              .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt")))
        # top two counts per column without a window over the column's values
        top = vc.groupBy("variable").agg(F.max_by("value", "cnt").alias("top_value"), F.max("cnt").alias("c1"),
                                         F.count(F.lit(1)).alias("n_distinct"))
        second = vc.join(F.broadcast(top.select("variable", "top_value")), "variable") \
            .filter(F.col("value") != F.col("top_value")).groupBy("variable").agg(F.max("cnt").alias("c2"))
        s = top.join(second, "variable", "left")
        found = s.select("variable", (F.col("c1") / F.col("c2")).alias("freq_ratio"),
                         (100.0 * F.col("n_distinct") / F.lit(n)).alias("unique_pct"), "n_distinct")
        return found.unionByName(empty) if bare else found

    def _fit(self, df: DataFrame) -> DropColumnsModel:
        cols = _present(df, self.getInputCols())
        fcut, ucut = self.getOrDefault(self.freqCut), self.getOrDefault(self.uniqueCut)
        drop = []
        for r in self.stats(df).collect():  # one row per candidate column
            single = r["freq_ratio"] is None
            if single or (r["freq_ratio"] > fcut and r["unique_pct"] <= ucut):
                drop.append(r["variable"])
        order = {c: i for i, c in enumerate(cols)}
        return DropColumnsModel(inputCols=cols, dropCols=sorted(drop, key=order.get))


# ---------------------------------------------------------------- E3
def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: Pearson correlation of each pair over the rows where both are present -> pair table
    ``(i, j, r)``; undefined -> NULL.

    One distributed pass of pair sums; only the p x p result reaches the driver.
    """
    cols = list(cols)
    m = _corr_array(df, cols)
    rows = [(a, b, None if (m[i][j] is None or math.isnan(m[i][j])) else float(m[i][j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "i string, j string, r double")


def _corr_array(df: DataFrame, cols: list[str]):
    """Pairwise-complete correlations from sums over the rows where both columns are present, in one pass.

    Each task adds up five p x p matrices (counts, sums of either column, squares, products) of values centred on the means of its
    own first batch; one row per column and task is shuffled, and a column's rows are moved to one centre and added.
    """
    p = len(cols)
    num = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def sums(batches):
        mu, acc = None, np.zeros((5, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            there = ~np.isnan(x)
            if mu is None and len(x):
                mu = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
            if mu is not None:
                m, x = there.astype(float), np.where(there, x - mu, 0.0)
                s = x.T @ m
                acc += np.stack([m.T @ m, s, m.T @ x, (x * x).T @ m, x.T @ x])
        if mu is not None:
            yield pd.DataFrame({"i": range(p), "mu": [mu] * p, "v": list(acc.transpose(1, 0, 2).reshape(p, 5 * p))})

    def one_centre(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, centre, total = int(key[0]), pdf["mu"].iloc[0], 0.0
        for mu, v in zip(pdf["mu"], pdf["v"]):
            n, si, sj, q, xy = np.reshape(v, (5, p))
            di, dj = mu[i] - centre[i], mu - centre
            total = total + np.concatenate((n, si + n * di, sj + n * dj, q + 2 * di * si + n * di * di, xy + di * sj + dj * si + n * di * dj))
        return pd.DataFrame([{"i": i, "mu": float(centre[i]), "v": total}])

    parts = num.mapInPandas(sums, "i int, mu array<double>, v array<double>")
    found = parts.repartition("i").sortWithinPartitions("i", "mu").groupBy("i").applyInPandas(one_centre, "i int, mu double, v array<double>").collect()
    n, si, sj, q, xy = np.zeros((5, p, p))
    mu = np.zeros(p)
    for r in found:
        mu[r["i"]] = r["mu"]
        n[r["i"]], si[r["i"]], sj[r["i"]], q[r["i"]], xy[r["i"]] = np.array(r["v"]).reshape(5, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = q - si * si / n
        flat = ~(var > 1e-12 * q) | ~(var > 1e-24 * n * (mu * mu)[:, None])  # constant on the pair's rows
        r = (xy - si * sj / n) / np.sqrt(var * var.T)
    r[flat | flat.T | (n < 2)] = math.nan
    return np.clip(r, -1.0, 1.0).tolist()


def corr_drop(cols: Sequence[str], m, threshold: float) -> list[str]:
    """E3 rule (non-iterative): for each pair i<j with |r| > t drop j if its mean |r| is
    larger than i's, else i. NULL correlations count as 0."""
    p = len(cols)
    a = [[0.0 if (m[i][j] is None or m[i][j] != m[i][j]) else abs(m[i][j]) for j in range(p)] for i in range(p)]
    mean_abs = [round(sum(row) / p, 9) for row in a]  # rounded: exact collinearity must not hinge on the last bit
    drop = set()
    for i in range(p):
        for j in range(i + 1, p):
            if a[i][j] > threshold:
                drop.add(j if mean_abs[j] > mean_abs[i] else i)
    return [cols[k] for k in sorted(drop)]


class CorrFilter(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Remove one column of each highly correlated pair (see :func:`corr_drop`)."""

    threshold = Param(Params._dummy(), "threshold", "absolute correlation cut", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, threshold=0.9):
        super().__init__()
        self._setDefault(inputCols=[], threshold=0.9)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DropColumnsModel:
        cols = _present(df, self.getInputCols())
        if len(cols) < 2:
            return DropColumnsModel(inputCols=cols, dropCols=[])
        m = _corr_array(df, cols)
        return DropColumnsModel(inputCols=cols, dropCols=corr_drop(cols, m, self.getOrDefault(self.threshold)))


# ---------------------------------------------------------------- E4
class NormalizeModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    sds = Param(Params._dummy(), "sds", "training sample sds", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, means=None, sds=None):
        super().__init__()
        self._setDefault(inputCols=[], means=[], sds=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, mu, sd = self.getInputCols(), self.getOrDefault(self.means), self.getOrDefault(self.sds)
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, mu, sd) if c in df.columns})


class Normalize(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Centre and scale by the training mean and sample sd (one aggregate)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NormalizeModel:
        cols = _present(df, self.getInputCols())
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        sds = [row[f"s{i}"] for i in range(len(cols))]
        bad = [c for c, s in zip(cols, sds) if s is None or s == 0 or s != s]
        if bad:
            raise ValueError(f"zero or undefined sd (run ZeroVar first): {bad}")
        return NormalizeModel(inputCols=cols, means=[float(row[f"m{i}"]) for i in range(len(cols))],
                              sds=[float(s) for s in sds])


# ---------------------------------------------------------------- E5
class NominalLevelsModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    levels = Param(Params._dummy(), "levels", "per column the training levels as a JSON list", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, levels=None):
        super().__init__()
        self._setDefault(inputCols=[], levels=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, lv in zip(self.getInputCols(), self.getOrDefault(self.levels)):
            known = json.loads(lv)
            out[c] = (F.when(F.col(c).isNull(), F.lit("unknown"))
                      .when(F.col(c).isin(known), F.col(c)).otherwise(F.lit("new")))
        return df.withColumns(out)


class NominalLevels(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """E5: levels learned on training rows; NULL -> ``unknown``, unseen -> ``new``."""

    maxLevels = Param(Params._dummy(), "maxLevels", "refuse columns with more levels", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, maxLevels=100_000):
        super().__init__()
        self._setDefault(inputCols=[], maxLevels=100_000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NominalLevelsModel:
        cols = _present(df, self.getInputCols())
        cap = self.getOrDefault(self.maxLevels)
        long = df.select(*cols).unpivot([], cols, "column", "value").filter(F.col("value").isNotNull()).distinct()
        counts = {r["column"]: r["n"] for r in long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        too_many = [c for c, n in counts.items() if n > cap]
        if too_many:
            raise ValueError(f"not nominal (more than {cap} levels): {too_many}")
        got = {r["column"]: r["lv"] for r in long.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("lv")).collect()}
        return NominalLevelsModel(inputCols=cols, levels=[json.dumps(got.get(c, [])) for c in cols])


# ---------------------------------------------------------------- assembly
class AssembleFeatures(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Pack the feature columns still present after the filters into one vector."""

    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(inputCols=[], outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Transformer:
        cols = _present(df, self.getInputCols())
        return VectorAssembler(inputCols=cols, outputCol=self.getOrDefault(self.outputCol), handleInvalid="error")


def recipe(features: Sequence[str], steps: Sequence[str] = ("zv", "corr", "normalize"), corr_threshold: float = 0.9,
           nominal: Sequence[str] = (), assemble: bool = True) -> Pipeline:
    """An ordered recipe. Step names: ``zv``, ``nzv``, ``corr``, ``normalize``, ``nominal``."""
    features = list(features)
    stages = []
    for s in steps:
        if s == "zv":
            stages.append(ZeroVar(inputCols=features))
        elif s == "nzv":
            stages.append(NearZeroVar(inputCols=features))
        elif s == "corr":
            stages.append(CorrFilter(inputCols=features, threshold=corr_threshold))
        elif s == "normalize":
            stages.append(Normalize(inputCols=features))
        elif s == "nominal":
            stages.append(NominalLevels(inputCols=list(nominal)))
        else:
            raise ValueError(f"unknown step {s}")
    if assemble:
        stages.append(AssembleFeatures(inputCols=features))
    return Pipeline(stages=stages)


def kept_features(model, features: Sequence[str]) -> list[str]:
    """Feature columns that survive the fitted filter steps of a recipe model."""
    dropped = set()
    for st in getattr(model, "stages", [model]):
        if isinstance(st, DropColumnsModel):
            dropped |= set(st.getDropCols())
    return [c for c in features if c not in dropped]


# ---------------------------------------------------------------- E7
def fold_stats(df: DataFrame, folds: DataFrame, cols: Sequence[str], key: str = "row_id") -> DataFrame:
    """Analysis-set mean and sample sd of every column for every (repeat, fold) at once.

    Sufficient statistics of values centred on the global mean are summed per
    assessment fold (one join + one aggregate); analysis = total - fold. Output
    long: ``(repeat, fold, variable, n, mean, sd)``.
    """
    cols = list(cols)
    centre = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    cen = df.select(key, *[(F.col(c) - F.lit(centre[c])).alias(c) for c in cols])
    tot = cen.agg(*[F.count(c).alias(f"n_{c}") for c in cols], *[F.sum(c).alias(f"s_{c}") for c in cols],
                  *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in cols]).first()
    part = cen.join(folds.select(key, "repeat", "fold"), key).groupBy("repeat", "fold").agg(
        *[F.count(c).alias(f"n_{c}") for c in cols], *[F.sum(c).alias(f"s_{c}") for c in cols],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in cols])
    rows = []
    for c in cols:
        n = F.lit(tot[f"n_{c}"]) - F.col(f"n_{c}")
        s = F.lit(tot[f"s_{c}"] or 0.0) - F.coalesce(F.col(f"s_{c}"), F.lit(0.0))
        q = F.lit(tot[f"q_{c}"] or 0.0) - F.coalesce(F.col(f"q_{c}"), F.lit(0.0))
        mean = F.lit(centre[c]) + F.try_divide(s, n)  # NULL where the fold holds every row
        var = F.try_divide(q - F.try_divide(s * s, n), n - 1)
        rows.append(F.struct(F.lit(c).alias("variable"), n.alias("n"), mean.alias("mean"),
                             F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd")))
    return part.select("repeat", "fold", F.explode(F.array(*rows)).alias("s")).select("repeat", "fold", "s.*")

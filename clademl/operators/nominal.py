"""Nominal predictors as sparse indicators of the model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import order_key
from ..session import stored
from .ranking import global_rank
from .recipe import _Cols, _present

#: Indices of values that are no level: unseen ones, and NULL.
NEW, UNKNOWN, FIRST = 0, 1, 2


class _Out(Params):
    outputCol = Param(Params._dummy(), "outputCol", "sparse indicator vector", TypeConverters.toString)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"sizes": self.model.sizes})
        self.model.levels.write.mode("overwrite").parquet(f"{path}/levels")


class _Reader(MLReader):
    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = NominalIndicatorsModel(self.sparkSession.read.parquet(f"{path}/levels"), meta["sizes"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model._resetUid(meta["uid"])
        return model


class NominalIndicatorsModel(Model, _Cols, _Out, MLWritable, MLReadable):
    """``levels`` (column, level, ix) as a table; ``sizes`` per column with the two places that are no level."""

    def __init__(self, levels: DataFrame, sizes: list[int]):
        super().__init__()
        self._setDefault(inputCols=[], outputCol="indicators")
        self.levels, self.sizes = levels, sizes

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, spark = self.getInputCols(), df.sparkSession
        at = [f"__ix_{c}" for c in cols]
        out = df
        for c, ix in zip(cols, at):
            own = self.levels.filter(F.col("column") == c).select(F.col("level").alias(f"__lv_{c}"), F.col("ix").alias(ix))
            out = out.join(own, F.col(c).cast("string") == F.col(f"__lv_{c}"), "left").drop(f"__lv_{c}")
            out = out.withColumn(ix, F.when(F.col(c).isNull(), UNKNOWN).otherwise(F.coalesce(ix, F.lit(NEW))).cast("double"))
        places = [f"__at_{c}" for c in cols]
        encoder = OneHotEncoder(inputCols=at, outputCols=places, dropLast=False).fit(  # sizes from one row of last places
            spark.createDataFrame([tuple(float(n - 1) for n in self.sizes)], ", ".join(f"`{x}` double" for x in at)))
        joined = VectorAssembler(inputCols=places, outputCol=self.getOrDefault(self.outputCol))
        return joined.transform(encoder.transform(out)).drop(*at, *places)


class NominalIndicators(Estimator, _Cols, _Out, DefaultParamsReadable, DefaultParamsWritable):
    """E5 into P14: one sparse indicator per training level, unseen value (place 0) and NULL (place 1) of each column.

    Levels are numbered by the order key of their text in a table that stays distributed (never a list of literals, no cap on
    their number); rows look their place up in an equi-join per column. The empty text is a level like any
    other.
    """

    @keyword_only
    def __init__(self, inputCols=None, outputCol="indicators"):
        super().__init__()
        self._setDefault(inputCols=[], outputCol="indicators")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NominalIndicatorsModel:
        cols = _present(df, self.getInputCols())
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "level").filter("level is not null").distinct()
        ranked = global_rank(long, order_key("level", "column", "level"), strata=["column"], rank_col="__k")
        levels = stored(ranked.select("column", "level", (F.col("__k") - 1 + FIRST).alias("ix")), "levels")
        count = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        model = NominalIndicatorsModel(levels, [FIRST + count.get(c, 0) for c in cols])
        model._set(inputCols=cols, outputCol=self.getOrDefault(self.outputCol))
        return model


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns and indicator vectors in one (sparse) vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)

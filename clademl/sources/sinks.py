"""Writers, model persistence and run manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import to_decimal_comma


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", single_file: bool = False) -> None:
    """Delimited text with a header; ``single_file`` only for small result tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_csv2(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """European CSV -- ``;`` separator and decimal commas in floating columns."""
    cols = [to_decimal_comma(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name) for f in df.schema.fields]
    write_csv(df.select(*cols), path, sep=";", mode=mode, single_file=single_file)


def write_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """One column as bare text lines (no header, no quoting)."""
    df.select(F.col(col).cast("string")).write.mode(mode).text(path)


def manifest(spark: SparkSession, run_ts: int, params: Mapping) -> DataFrame:
    """Parameter name/value rows of a run."""
    rows = [(int(run_ts), str(k), json.dumps(v) if not isinstance(v, str) else v) for k, v in params.items()]
    return spark.createDataFrame(rows, "run_ts long, name string, value string")


def save_model(model: PipelineModel, path: str, run_ts: int) -> None:
    """Persist a fitted pipeline plus a one-row manifest holding its run id."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(int(run_ts),)], "run_ts long").write.mode("overwrite").json(f"{path}/manifest")


def load_model(path: str, run_ts: int | None = None) -> PipelineModel:
    """Reload; stop when the stored run id differs from the expected one."""
    spark = SparkSession.getActiveSession()
    stored = spark.read.json(f"{path}/manifest").first()["run_ts"]
    if run_ts is not None and int(stored) != int(run_ts):
        raise ValueError(f"model at {path} belongs to run {stored}, expected {run_ts}")
    return PipelineModel.load(f"{path}/model")

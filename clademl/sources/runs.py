"""Run folders: every file of a run under ``<root>/<run_ts>/``, committed by its manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import manifest, write_csv
from .tables import read_runs

MANIFEST = "manifest"
_ROW = "run_ts long, name string, value string"


def new_run_id(now: float | None = None) -> int:
    """A run id from the clock: seconds since 1970."""
    return int(time.time() if now is None else now)


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_ROW).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ROW)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Parameters ``(run_ts, name, value)`` of every committed run; an empty table without any."""
    return _manifests(spark, f"{root.rstrip('/')}/*/{MANIFEST}")


def write_run(root: str, run_ts: int, tables: Mapping[str, DataFrame], params: Mapping) -> None:
    """Write a run: each table as a CSV file kind (name -> table), the manifest last.

    A run without a manifest is not committed: readers ignore it, and writing it again replaces what a broken attempt
    left. A committed run is never touched again (``FileExistsError``). The manifest lists the files.
    """
    if not tables:
        raise ValueError("a run has at least one file")
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root.rstrip('/')}/{int(run_ts)}"
    if not _manifests(spark, f"{folder}/{MANIFEST}").isEmpty():
        raise FileExistsError(f"run {run_ts} is committed under {root}")
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    rows = manifest(spark, run_ts, {**params, "files": json.dumps(sorted(tables))})
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}")


def read_committed(spark: SparkSession, root: str, filename: str, schema=None) -> DataFrame:
    """S5 over committed runs only: rows of one file kind of every run that has a manifest, tagged ``run_ts``."""
    done = manifests(spark, root).select("run_ts").distinct()
    return read_runs(spark, root, filename, schema).join(done, "run_ts", "left_semi")

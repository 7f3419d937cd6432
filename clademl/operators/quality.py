"""Filters, predicates and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strains excluded from the two-class data set before splitting.
STRAINS_TO_REMOVE = ["Akkermansia_muciniphila_ATCC_BAA-835", "Escherichia_coli_str._K-12_substr._MG1655"]


def exclude(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """drop rows whose ``col`` is in a list (or a key table -> left anti join)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(), col, "left_anti")
    return df.filter(~F.col(col).isin(list(values)) | F.col(col).isNull())


def keep_class(df: DataFrame, label: str, cls: str) -> DataFrame:
    """F3."""
    return df.filter(F.col(label) == cls)


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a NULL (or NaN) in ``cols`` (all columns by default)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """one pass -> long table (column, n_missing) plus rows ``__total__`` and ``__rows__``
    (rows with at least one missing value)."""
    cols = list(cols or df.columns)
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    aggs.append(F.count_if(any_null).alias("__rows__"))
    wide = df.agg(*aggs)
    wide = wide.withColumn("__total__", sum((F.col(c) for c in cols), F.lit(0)))
    names = cols + ["__total__", "__rows__"]
    return wide.unpivot([], names, "variable", "n_missing")


def drop_failed(df: DataFrame, col: str = "mean") -> DataFrame:
    """drop tuning cells whose metric is NULL or NaN."""
    return df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col)))


def nonzero(df: DataFrame, col: str = "coef") -> DataFrame:
    """F7."""
    return df.filter(F.abs(F.col(col)) > 0)


def drop_by_mean(df: DataFrame, key: str, value: str, lo: float = 0.05, hi: float = 1.95) -> DataFrame:
    """F8 (long form): drop keys whose mean value is < lo or > hi (left semi on the kept keys)."""
    keep = df.groupBy(key).agg(F.avg(value).alias("__m")).filter((F.col("__m") >= lo) & (F.col("__m") <= hi))
    return df.join(keep.select(key), key, "left_semi")


def drop_samples(df: DataFrame, col: str, ids: Sequence[str], suffix: bool = True) -> DataFrame:
    """drop sample ids equal to an id or ``id_<n>`` (anchored, not a raw substring)."""
    alt = "|".join(ids)
    pat = f"^({alt})(_[0-9]+)?$" if suffix else f"^({alt})$"
    return df.filter(~F.col(col).rlike(pat))


@dataclass(frozen=True)
class RowCount:
    """Row count of a step; ``get`` counts the step's rows."""

    step: str
    rows: DataFrame

    @property
    def get(self) -> dict[str, int]:
        return {"rows": self.rows.count()}


def audit(df: DataFrame, step: str) -> tuple[DataFrame, RowCount]:
    """a step's rows and their count, taken when it is asked for.

    Not an ``Observation``: the first one of a session gives the session a manager that cannot be serialised, and
    fitted classifiers carry the session in their training summaries, so that none could score any more.
    """
    return df, RowCount(step, df)


def errors(preds: DataFrame, truth: str = "label", pred: str = "pred_class") -> DataFrame:
    """F11."""
    return preds.filter(F.col(truth) != F.col(pred))


def decision_label(df: DataFrame, decision: str = "decision", inlier: str = "inlier", outlier: str = "outlier",
                   out: str = "predicted_label") -> DataFrame:
    """``decision < 0`` -> outlier, else inlier."""
    return df.withColumn(out, F.when(F.col(decision) < 0, F.lit(outlier)).otherwise(F.lit(inlier)))

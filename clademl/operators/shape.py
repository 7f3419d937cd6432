"""Projections, column shaping and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import argmax_class as _argmax_expr
from ..functions.exprs import case_map, round_text as _round_text_expr, threshold_class as _threshold_expr, tidy_round as _tidy_round_expr

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Reference-dinucleotide pairs averaged into strand-symmetric features.
STRAND_PAIRS = [("AA", "TT"), ("CC", "GG"), ("TG", "CA"), ("CT", "AG"), ("AC", "GT"), ("GA", "TC")]


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    """P1."""
    return df.drop(*cols)


def front(df: DataFrame, *cols: str) -> DataFrame:
    """Move ``cols`` to the front, keep the rest in order."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*cols, *rest)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P3."""
    return df.withColumnsRenamed(dict(mapping))


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns (schema only, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def cols_like(df: DataFrame, substr: str) -> list[str]:
    """P5: columns whose name contains ``substr``."""
    return [c for c in df.columns if substr in c]


def project_features(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """id/label columns plus a chosen feature subset."""
    return df.select(*keep, *features)


def strand_average(df: DataFrame, pairs: Sequence[tuple[str, str]] = STRAND_PAIRS,
                   name=lambda a, b: f"pct_{a.lower()}", out=lambda a, b: f"{a}_{b}_avg") -> DataFrame:
    """``(x + y) / 2`` per complementary pair, source columns dropped."""
    new = {out(a, b): (F.col(name(a, b)) + F.col(name(b, a))) / 2 for a, b in pairs}
    src = [name(a, b) for a, b in pairs] + [name(b, a) for a, b in pairs]
    return df.withColumns(new).drop(*src)


def constant(df: DataFrame, col: str, value) -> DataFrame:
    """P8."""
    return df.withColumn(col, F.lit(value))


def encode_label(df: DataFrame, col: str, levels: Sequence[str], out: str | None = None) -> DataFrame:
    """Fixed-level index of a label (0-based in ``levels`` order), unknown -> NULL."""
    out = out or f"{col}_index"
    return df.withColumn(out, case_map(col, {lv: float(i) for i, lv in enumerate(levels)}, None).cast("double"))


def method_names(df: DataFrame, col: str, mapping: Mapping, default, out: str | None = None) -> DataFrame:
    """P10."""
    return df.withColumn(out or col, case_map(col, mapping, default))


def argmax_class(df: DataFrame, prob_cols: Mapping[str, str], out: str = "pred_class") -> DataFrame:
    """``prob_cols`` maps level -> probability column, in level order (ties -> first)."""
    return df.withColumn(out, _argmax_expr(prob_cols))


def threshold_class(df: DataFrame, prob_neg: str, negative: str, positive: str, t: float = 0.5,
                    out: str = "pred_class") -> DataFrame:
    """P12."""
    return df.withColumn(out, _threshold_expr(prob_neg, negative, positive, t))


def attach(df: DataFrame, preds: DataFrame, on: str | Sequence[str] = "row_id", how: str = "inner") -> DataFrame:
    """Predictions next to ids by key (Spark rows have no position)."""
    return df.join(preds, on, how)


def tidy_round(df: DataFrame, cols: Sequence[str], dp: int = 2) -> DataFrame:
    """P16."""
    return df.withColumns({c: _tidy_round_expr(c, dp) for c in cols})


def round_text(df: DataFrame, cols: Sequence[str], dp: int = 3) -> DataFrame:
    """Numbers as text with ``dp`` places, trailing zeros kept."""
    return df.withColumns({c: _round_text_expr(c, dp) for c in cols})


# ---------------------------------------------------------------- set operations
def union_loose(*dfs: DataFrame) -> DataFrame:
    """``bind_rows`` -- by name, missing columns -> NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_strict(*dfs: DataFrame) -> DataFrame:
    """``rbind`` -- same column set required."""
    cols = set(dfs[0].columns)
    for d in dfs[1:]:
        if set(d.columns) != cols:
            raise ValueError(f"column sets differ: {sorted(cols ^ set(d.columns))}")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def rest(df: DataFrame, sample: DataFrame, key: str | Sequence[str] = "row_id") -> DataFrame:
    """Rows of ``df`` not in ``sample`` (``x[-vec, ]``)."""
    return df.join(sample.select(key if isinstance(key, str) else list(key)).distinct(), key, "left_anti")

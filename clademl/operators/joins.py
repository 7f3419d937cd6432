"""Joins implied by the reference's data work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shape import attach  # noqa: F401  (J1 is P13)

def keep_samples(geno: DataFrame, keep: DataFrame, keys: Sequence[str] = ("fid", "iid")) -> DataFrame:
    """Semi join on the sample key list (Spark broadcasts the list if its measured size is small)."""
    return geno.join(keep.select(*keys).distinct(), list(keys), "left_semi")


def pending(accessions: DataFrame, existing: DataFrame, col: str = "accession") -> DataFrame:
    """Accessions not already present (anti join)."""
    return accessions.join(existing.select(col).distinct(), col, "left_anti")


def resolve_accessions(ids: DataFrame, mapping: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Left join to a lookup table -> (resolved, unresolved)."""
    j = ids.join(mapping.select(key, value), key, "left")
    return j.filter(F.col(value).isNotNull()), j.filter(F.col(value).isNull()).select(key)


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row as literals (no join at all)."""
    rows = stats.take(2)
    if len(rows) != 1:
        raise ValueError("statistics frame must have exactly one row")
    return df.withColumns({k: F.lit(v) for k, v in rows[0].asDict().items()})


def expand(df: DataFrame, grid: Sequence[Mapping[str, float]], cell_col: str = "cell_id") -> DataFrame:
    """Every row of ``df`` (e.g. distinct resamples) once per grid candidate.

    The grid is a bounded parameter list, so this is a generate of literal rows,
    not a join: no shuffle and no broadcast of data-sized input.
    """
    if not grid:
        raise ValueError("empty grid")
    names = list(grid[0].keys())
    structs = [F.struct(F.lit(i).cast("int").alias(cell_col), *[F.lit(float(g[n])).alias(n) for n in names])
               for i, g in enumerate(grid)]
    return df.select("*", F.explode(F.array(*structs)).alias("__cell")).select(
        *[F.col(c) for c in df.columns], F.col(f"__cell.{cell_col}"), *[F.col(f"__cell.{n}") for n in names])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL (a NULL group is a group); ``left``'s key columns stay."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"__r_{k}" for k in keys])

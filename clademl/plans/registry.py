"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``fn(spark, sf_dir) -> DataFrame`` with its optional oracle SQL."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def r6(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every double column (cross-engine float sums differ in the last bits)."""
    return df.select(*[F.round(F.col(f.name), dp).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


_DUCK_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
                "benchmark labels conversations").split()


_TYPED_CACHE: dict[str, dict[str, str]] = {}


def typed_oracles(sf_dir: str = "/root/testdata/sf0.001") -> dict[str, str]:
    if sf_dir not in _TYPED_CACHE or len(_TYPED_CACHE[sf_dir]) != len(ORACLES):
        _TYPED_CACHE[sf_dir] = _typed_oracles(sf_dir)
    return dict(_TYPED_CACHE[sf_dir])


def _typed_oracles(sf_dir: str) -> dict[str, str]:
    """Oracle SQL with DuckDB-only result types aligned to Spark's: ``count_if`` / integer
    ``sum`` give HUGEINT and decimal literals DECIMAL in DuckDB, ``bigint`` / ``double`` in
    Spark. Types are read once with ``DESCRIBE`` on the smallest tables; values are untouched."""
    try:
        import duckdb

        con = duckdb.connect()
        for t in _DUCK_TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    except Exception:
        return dict(ORACLES)
    out = {}
    for name, sql in ORACLES.items():
        try:
            desc = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:
            out[name] = sql
            continue
        casts = []
        for col, typ, *_ in desc:
            if typ in ("HUGEINT", "UBIGINT"):
                casts.append(f'CAST("{col}" AS BIGINT) AS "{col}"')
            elif typ.startswith("DECIMAL"):
                casts.append(f'CAST("{col}" AS DOUBLE) AS "{col}"')
        out[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS q" if casts else sql
    return out

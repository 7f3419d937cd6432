"""Helpers shared by the corpus operators: input tables, shared-folder tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademl.session import checkpoint_dir

#: A side is broadcast only when its measured rows times its row width stay under this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


#: Rows handed to Python at once: rows here are whole texts, and Spark's own default is 10,000.
ARROW_ROWS = 1000
_ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for the session, unless it has a smaller bound already."""
    if not 0 < int(spark.conf.get(_ARROW_CONF)) <= ARROW_ROWS:
        spark.conf.set(_ARROW_CONF, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/clademl-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and survives lost executors: readers open the committed files,
    whichever machines are still there.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def refuse_clash(keep: tuple[str, ...], *own: str) -> None:
    """Raise if a column to keep has the name of one that the operator adds (Spark ignores the case)."""
    clash = sorted({c.lower() for c in keep} & set(own))
    if clash:
        raise ValueError(f"columns to keep have the names of the operator's own: {clash}")


def fits(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows * row_bytes`` is within the bound, else as it is
    (Spark then shuffles both sides and splits skewed keys)."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of the undirected links ``(u, v)``: rows ``(node, component)`` with the
    smallest reachable node as component. Nodes without a link do not appear.

    Alternating large-star / small-star contraction; links never leave the executors. Each round is
    written to the shared folder, and the loop ends when the set of links no longer changes. Null
    ends and self links are dropped; an empty input gives an empty result.
    """
    ok = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    now = stored(edges.filter(ok).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        now = stored(_small_star(_large_star(now)), label)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    root = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

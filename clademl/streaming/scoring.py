"""Discovery scoring on a stream (D1 is stateless, so it runs unchanged on ``readStream``).

The reference has no streaming operator; this is the same ``transform`` + threshold
+ filter as :func:`clademl.operators.discovery.discover`, applied micro-batch by
micro-batch to rows arriving in a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.discovery import discover


def read_feature_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                        max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def discover_stream(model, stream: DataFrame, levels: Sequence[str], negative: str, positive: str,
                    ids: Sequence[str], run_ts: int) -> DataFrame:
    """Streaming discovery list; write it with ``writeStream`` (append mode, checkpointed)."""
    return discover(model, stream, levels, negative, positive, ids, run_ts)

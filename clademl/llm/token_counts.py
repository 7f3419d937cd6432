"""Token counts through a stored digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademl.llm.encoders import PieceModel
from clademl.llm.common import shared_path
from clademl.session import checkpoint_dir

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenizer_digest(path: str) -> str:
    """Digest of the model file and the library version: either changing makes new cache rows."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_path: str, model: str | None = None, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    The normalised content (null becomes empty; nothing else may change, or counts would) has a
    SHA-256 digest. Digests without a stored count under this tokenizer digest are encoded, one text
    each, and their counts are appended to the cache at ``cache_path``, which a later run joins
    instead of encoding. Copies collapse before the shuffle, so a text that fills a third of all
    rows is one row per task. The cache may hold a digest twice after concurrent appends; it is made
    distinct on reading.

    Null or empty text: 0 bytes, 0 tokens. Null or repeated ``doc_id``: one result row per input row.
    An empty table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    path = model or default_model()
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = (rows.groupBy("digest").agg(F.first("text").alias("text"))
               .join(known.select("digest").distinct(), "digest", "left_anti"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = PieceModel(model or default_model())
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "tokenizer": version, "n_tokens": [len(pieces.ids(t)) for t in b["text"]]})

    missing.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache_path)
    counts = (read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")))
    return (rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def cache_path(spark: SparkSession, model: str | None = None) -> str:
    """The tokenizer's cache in the shared folder: the same for every run, so that later runs find its counts."""
    return f"{checkpoint_dir(spark).rstrip('/')}/clademl-token-cache-{tokenizer_digest(model or default_model())[:32]}"


def new_cache_path(spark: SparkSession) -> str:
    return shared_path(spark, "token-cache")

"""Packing: concatenate all token ids and cut at fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.encoders import ByteBpe
from clademl.llm.common import stored

END_ID = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = END_ID) -> DataFrame:
    """First pass: ``doc_id, part, start, n, ids`` with the ids of a whole text plus ``end_id``
    (little-endian unsigned 32 bit), the task's number and the tokens that this task wrote before."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(tokenizer or default_tokenizer())
        part, start, end = TaskContext.get().partitionId(), 0, int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = [bpe.ids(t or "") + end for t in batch["text"]]
            sizes = pd.Series([len(x) // 4 for x in ids], dtype="int64")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "part": part, "start": start + sizes.cumsum() - sizes, "n": sizes, "ids": ids})
            start += int(sizes.sum())

    key = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("part", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(encode, schema)


def pack(docs: DataFrame, length: int = 2048, **encode_options) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of the corpus written as
    one token stream and cut every ``length`` tokens.

    Pass one encodes each partition and stores it in the shared folder with running token counts.
    The partition totals (one row a task, the only thing the driver sees) are summed into the global
    offset of each partition. Pass two is a map over the stored table: a document is cut at the
    window bounds it crosses, and each piece records where it lies. Only the last sequence is short.

    Null or empty text: one piece that holds the end id. Null or repeated ``doc_id``: each row is
    packed on its own. An empty table gives no piece. Other columns are not read.
    """
    spark = docs.sparkSession
    tokens = stored(encode_parts(docs, **encode_options), "tokens")
    totals = sorted((r["part"], r["total"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    base, rows = 0, []
    for part, total in totals:
        rows.append((part, base))
        base += total
    bases = spark.createDataFrame(rows, "part int, base long")
    at = (tokens.join(F.broadcast(bases), "part")  # one row for each task of pass one
          .withColumn("at", F.col("base") + F.col("start")))
    size = F.lit(length).cast("long")
    cut = at.select("*", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))).alias("sequence_id"))
    begin = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * size - F.col("at"))
    end = F.least(F.col("n"), (F.col("sequence_id") + 1) * size - F.col("at"))
    cut = cut.withColumn("p", begin).withColumn("q", end)
    return cut.select(
        "doc_id", F.col("p").alias("start"), (F.col("q") - F.col("p")).alias("length"),
        F.substring(F.col("ids"), (F.col("p") * 4 + 1).cast("int"), ((F.col("q") - F.col("p")) * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", (F.col("at") + F.col("p") - F.col("sequence_id") * size).alias("offset"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

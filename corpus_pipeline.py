"""Corpus cleaning in five stages: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``;
a text that a stage changes gets its new length as ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademl.llm import decontaminate, minhash, packing, pii, toxicity
from clademl.llm.common import bounded_broadcast, small_batches, stored, table


def _carried(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but ``doc_id`` and ``text`` under a reserved name, by place, so that no
    column of the documents meets an operator's column of the same name."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_document_{i}" for i, c in enumerate(docs.columns)))


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def _restored(found: DataFrame, carried: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*carried.columns).toDF(*docs.columns)


def _with_text(found: DataFrame, new: str, carried: DataFrame, docs: DataFrame) -> DataFrame:
    """Replace ``text`` by the column ``new``; ``n_chars`` follows where the text changed."""
    changed = ~F.col("text").eqNullSafe(F.col(new))
    if "n_chars" in docs.columns:
        size = carried.columns[docs.columns.index("n_chars")]
        found = found.withColumn(size, F.when(changed, F.char_length(new).cast(found.schema[size].dataType)).otherwise(F.col(size)))
    return _restored(found.withColumn("text", F.col(new)), carried, docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents predicted toxic go."""
    carried = _carried(docs)
    found = toxicity.toxicity(carried, table(spark, sf_dir, "labels"), keep=_others(carried))
    return _restored(found.filter("predicted = 0"), carried, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near copies (similarity of 0.80 or more) the smallest ``doc_id`` stays.

    Rows without a ``doc_id`` take part under a number of their own above all ids, so one stays only
    where no copy has an id. Of rows that repeat both ``doc_id`` and text one stays; different texts under
    one ``doc_id`` stay as long as one of them does. Texts without words (null, empty) are no copies of
    each other. An empty table stays empty.
    """
    small_batches(spark)
    carried = _carried(docs)
    rows = stored(carried.withColumn("_document_row", F.monotonically_increasing_id()), "numbered")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.col("_document_row"))
    rows = rows.withColumn("_document_key", key)
    found = minhash.near_duplicates(rows, percent=80, id_col="_document_key")
    gone = stored(found.groupBy(F.col("doc_id").alias("_document_key")).agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select("_document_key"), "dropped")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    again = (rows.groupBy("_document_key", digest.alias("digest")).agg(F.min("_document_row").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("_document_key").alias("key"), "digest", "first"))
    kept = rows.join(bounded_broadcast(gone, gone.count(), 16), "_document_key", "left_anti")
    kept = kept.join(again, (F.col("_document_key") == F.col("key")) & (digest == F.col("digest")) & (F.col("_document_row") > F.col("first")), "left_anti")
    return _restored(kept, carried, docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: benchmark passages are cut out of the texts; every document stays."""
    carried = _carried(docs)
    found = decontaminate.contamination(carried, table(spark, sf_dir, "benchmark"), keep=_others(carried), with_cleaned=True)
    return _with_text(found, "cleaned", carried, docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: spans of personal data become their kind in angle brackets; every document stays."""
    small_batches(spark)
    carried = _carried(docs)
    found = pii.personal_data(carried, keep=_others(carried), with_redacted=True)
    return _with_text(found, "redacted", carried, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents' tokens as sequences of 2048."""
    small_batches(spark)
    return packing.piece_digests(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark),
          ("personal_data", redact_personal_data), ("packing", pack)]

#: No SQL states the trained networks; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

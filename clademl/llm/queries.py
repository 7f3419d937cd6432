"""Registered queries of the corpus operators and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clademl.llm import clusters, decontaminate, lm, minhash, packing, pii, pivots, quality, runs, secrets, suffixes, token_counts, toxicity
from clademl.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@_query("op1_toxicity_bigru")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@_query("op2_decontaminate_fm_index", decontaminate.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@_query("op3_repeated_passages", suffixes.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@_query("op4_personal_data_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.personal_data(table(spark, sf_dir, "documents")))


@_query("op5_pack_concat_cut")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


@_query("op6_near_duplicates", minhash.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@_query("op7_lm_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@_query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.cache_path(spark))


@_query("op9_secret_scan_trigrams")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


@_query("op10_embedding_pivot_index", pivots.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op11_line_rules", quality.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.clean_lines(table(spark, sf_dir, "documents")))


@_query("op12_centroid_clusters", clusters.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


@_query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=runs.copied_tails))

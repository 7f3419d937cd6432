"""Views over the supplied tables that stand in for the classification inputs.

Each fixture exists twice: a Spark builder ``fxN(spark, sf_dir)`` and the same
derivation as a DuckDB CTE ``FXN_SQL`` used by the oracle queries. Every view
reads the *whole* source table; none filters by id, prefix or row cap.

FX1 strains          embeddings -> labelled wide feature table (row_id, ids, label, habitat, f01..f67)
FX2 k-mers           documents joined with labels -> dinucleotide percentages of the whole text
FX3 scored rows      lineitem -> (key, run_ts, method, label, p_probiotic)
FX4 fold metrics     orders -> (cell_id, rep, fold, mcc)
FX5 genotypes        lineitem distinct (supplier, part) -> long genotype calls
FX6 curation sheet   supplier -> strain curation rows
FX7 unlabelled       FX1 without label, row_id + 1000000
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import wide_table_conf

N_EMB = 64
FEATURES = [f"f{i:02d}" for i in range(1, N_EMB + 4)]  # f01..f67
POS, NEG = "Probiotic", "Nonprobiotic"
LEVELS = [NEG, POS]  # alphabetical factor order; the first level is the event for AUC
# The 12 dinucleotides of the k-mer table, in the source table's order.
DINUCLEOTIDES = ["AA", "TT", "CC", "GG", "TG", "CA", "CT", "AG", "AC", "GT", "GA", "TC"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- FX1 strains
def fx1(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide_table_conf(spark)
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    feats = [F.col("embedding")[i].cast("double").alias(f"f{i + 1:02d}") for i in range(N_EMB)]
    return e.select(
        v.alias("row_id"),
        F.concat(F.lit("org_"), v.cast("string")).alias("organism"),
        F.concat(F.lit("tax_"), F.col("label").cast("string")).alias("taxon"),
        F.when(F.col("label").isin(0, 1), F.lit(POS)).otherwise(F.lit(NEG)).alias("label"),
        F.when(v % 11 == 0, F.lit(None).cast("string")).when(v % 4 == 0, "soil").when(v % 4 == 1, "gut")
        .otherwise("milk").alias("habitat"),
        *feats,
        F.when(v % 97 == 5, F.lit(None).cast("double")).otherwise(2 * F.col("embedding")[1].cast("double")).alias("f65"),
        F.lit(1.0).alias("f66"),
        F.when(v % 50 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("f67"),
    )


FX1_SQL = (
    "fx1 AS (SELECT vec_id AS row_id, 'org_' || CAST(vec_id AS VARCHAR) AS organism, "
    "'tax_' || CAST(label AS VARCHAR) AS taxon, "
    "CASE WHEN label IN (0, 1) THEN 'Probiotic' ELSE 'Nonprobiotic' END AS label, "
    "CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN 'soil' WHEN vec_id % 4 = 1 THEN 'gut' ELSE 'milk' END AS habitat, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS f{i:02d}" for i in range(1, N_EMB + 1))
    + ", CASE WHEN vec_id % 97 = 5 THEN NULL ELSE 2 * CAST(embedding[2] AS DOUBLE) END AS f65, "
    "CAST(1.0 AS DOUBLE) AS f66, CASE WHEN vec_id % 50 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS f67 "
    "FROM embeddings)"
)


def fx7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx1(spark, sf_dir).drop("label").withColumn("row_id", F.col("row_id") + 1000000)


FX7_SQL = "fx7 AS (SELECT * EXCLUDE (label, row_id), row_id + 1000000 AS row_id FROM fx1)"


# ---------------------------------------------------------------- FX2 k-mers
def _count_sub(s, sub: str):
    """Non-overlapping occurrences of a 2-letter pattern."""
    return (F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / 2


def _count_pair(s, xy: str):
    """Occurrences of ``xy`` at every position (overlapping for ``xx``)."""
    x, y = xy[0], xy[1]
    if x != y:
        return _count_sub(s, xy)
    return F.length(s) - F.length(F.regexp_replace(s, f"{x}(?={x})", ""))


def fx2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    seq = F.upper(F.regexp_replace(F.col("text"), "[^acgtACGT]+", ""))
    base = d.join(lab, "doc_id").select(
        F.col("doc_id").alias("species"), F.col("lang").alias("ordo"),
        F.when(F.col("quality") == 1, "vertebrate").otherwise("invertebrate").alias("outcome"),
        seq.alias("seq"))
    n = F.length("seq") - 1
    cols = [F.when(n < 1, F.lit(None).cast("double")).otherwise(100.0 * _count_pair(F.col("seq"), xy) / n)
            .alias(f"pct_{xy.lower()}") for xy in DINUCLEOTIDES]
    # one element to explode: a later filter on a percentage reads it and does not work out every percentage anew
    return base.select("species", "ordo", "outcome", F.explode(F.array(F.struct(*cols))).alias("pct")).select("species", "ordo", "outcome", "pct.*")


def _count_pair_sql(xy: str) -> str:
    x, y = xy[0], xy[1]
    if x != y:
        return f"((length(seq) - length(replace(seq, '{xy}', ''))) / 2)"
    return (f"((length(seq) - length(replace(seq, '{x}', ''))) - "
            f"(length(regexp_replace(seq, '{x}+', '{x}', 'g')) - length(replace(regexp_replace(seq, '{x}+', '{x}', 'g'), '{x}', ''))))")


FX2_SQL = (
    "fx2_base AS (SELECT d.doc_id AS species, d.lang AS ordo, "
    "CASE WHEN l.quality = 1 THEN 'vertebrate' ELSE 'invertebrate' END AS outcome, "
    "upper(regexp_replace(d.text, '[^acgtACGT]', '', 'g')) AS seq "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
    "fx2 AS (SELECT species, ordo, outcome, "
    + ", ".join(f"CASE WHEN length(seq) - 1 < 1 THEN NULL ELSE CAST(100 AS DOUBLE) * {_count_pair_sql(xy)} / (length(seq) - 1) END "
                f"AS pct_{xy.lower()}" for xy in DINUCLEOTIDES)
    + " FROM fx2_base)"
)


# ---------------------------------------------------------------- FX3 scored rows
FX3_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
METHODS = {0: "RLR", 1: "RF", 2: "SVM", 3: "NN"}


def fx3(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    r = F.col("l_returnflag") == "R"
    s4 = F.col("l_suppkey") % 4
    p = F.when(r, (F.col("l_quantity") + 25) / 80).otherwise(F.col("l_quantity") / 80)
    return li.select(
        *FX3_KEY,
        F.concat_ws("|", *[F.col(c).cast("string") for c in FX3_KEY]).alias("row_id"),
        (F.lit(1785000000) + F.col("l_linenumber")).cast("long").alias("run_ts"),
        F.when(s4 == 0, "RLR").when(s4 == 1, "RF").when(s4 == 2, "SVM").otherwise("NN").alias("method"),
        F.when(r, F.lit(POS)).otherwise(F.lit(NEG)).alias("label"),
        p.alias("p_probiotic"),
        (1 - p).alias("p_nonprobiotic"),
    )


FX3_SQL = (
    "fx3_base AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, "
    "CAST(1785000000 + l_linenumber AS BIGINT) AS run_ts, "
    "CASE l_suppkey % 4 WHEN 0 THEN 'RLR' WHEN 1 THEN 'RF' WHEN 2 THEN 'SVM' ELSE 'NN' END AS method, "
    "CASE WHEN l_returnflag = 'R' THEN 'Probiotic' ELSE 'Nonprobiotic' END AS label, "
    "CASE WHEN l_returnflag = 'R' THEN (l_quantity + 25) / 80 ELSE l_quantity / 80 END AS p_probiotic "
    "FROM lineitem), "
    "fx3 AS (SELECT *, 1 - p_probiotic AS p_nonprobiotic FROM fx3_base)"
)


# ---------------------------------------------------------------- FX4 fold metrics
def fx4(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (o.groupBy((F.col("o_custkey") % 20).alias("cell_id"),
                      (F.floor(F.col("o_orderkey") / 5) % 3).cast("long").alias("rep"),
                      (F.col("o_orderkey") % 5).alias("fold"))
            .agg((F.sum(cents).cast("double") / F.count(F.lit(1)) / 1e8).alias("mcc")))


FX4_SQL = (
    "fx4 AS (SELECT o_custkey % 20 AS cell_id, CAST((o_orderkey // 5) % 3 AS BIGINT) AS rep, o_orderkey % 5 AS fold, "
    "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1e8 AS mcc "
    "FROM orders GROUP BY ALL)"
)


# ---------------------------------------------------------------- FX5 genotypes
# Control sample ids removed by the cleaning step.
CONTROL_SAMPLES = ["HG00264", "HG00097"]


def fx5(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    calls = li.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(
        F.min("l_orderkey").alias("o"))
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    h1 = F.when((31 * s + 17 * p + (s * p) % 7) % 10 < 3, 1).otherwise(0)
    h2 = F.when((37 * s + 11 * p + (s * p) % 13) % 10 < 3, 1).otherwise(0)
    dosage = (F.when((13 * s + 7 * p + o) % 211 == 0, F.lit(None)).when(p % 17 == 0, 0).when(p % 19 == 0, 1)
              .otherwise(h1 + h2)).cast("int")
    return calls.select(
        F.concat(F.lit("F"), (s % 10).cast("string")).alias("fid"),
        F.when(s % 33 == 0, F.concat(F.lit("HG00264_"), s.cast("string")))
        .when(s % 47 == 0, F.lit("HG00097")).otherwise(F.concat(F.lit("S"), s.cast("string"))).alias("iid"),
        F.concat(F.lit("rs"), p.cast("string")).alias("variant_id"),
        (1 + p % 24).cast("int").alias("chrom"),
        (1000 + F.floor(p / 48)).cast("long").alias("pos"),
        F.when(p % 29 == 0, "AT").otherwise("A").alias("a1"),
        F.lit("C").alias("a2"),
        dosage.alias("dosage"),
    )


FX5_SQL = (
    "fx5_calls AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2), "
    "fx5 AS (SELECT 'F' || CAST(s % 10 AS VARCHAR) AS fid, "
    "CASE WHEN s % 33 = 0 THEN 'HG00264_' || CAST(s AS VARCHAR) WHEN s % 47 = 0 THEN 'HG00097' ELSE 'S' || CAST(s AS VARCHAR) END AS iid, "
    "'rs' || CAST(p AS VARCHAR) AS variant_id, CAST(1 + p % 24 AS INTEGER) AS chrom, CAST(1000 + p // 48 AS BIGINT) AS pos, "
    "CASE WHEN p % 29 = 0 THEN 'AT' ELSE 'A' END AS a1, 'C' AS a2, "
    "CAST(CASE WHEN (13 * s + 7 * p + o) % 211 = 0 THEN NULL WHEN p % 17 = 0 THEN 0 WHEN p % 19 = 0 THEN 1 "
    "ELSE (CASE WHEN (31 * s + 17 * p + (s * p) % 7) % 10 < 3 THEN 1 ELSE 0 END) "
    "+ (CASE WHEN (37 * s + 11 * p + (s * p) % 13) % 10 < 3 THEN 1 ELSE 0 END) END AS INTEGER) AS dosage "
    "FROM fx5_calls)"
)


# ---------------------------------------------------------------- FX6 curation sheet
def fx6(spark: SparkSession, sf_dir: str) -> DataFrame:
    su = table(spark, sf_dir, "supplier")
    s = F.col("s_suppkey")
    acc = F.concat(F.lit("GCF_"), F.lpad((7919 * s).cast("string"), 9, "0"), F.lit(".1"))
    return su.select(
        F.concat(F.lit("Organism "), F.col("s_name")).alias("organism_name"),
        F.concat(F.lit("strain_"), s.cast("string")).alias("strain"),
        F.concat(F.lit("SAMN"), s.cast("string")).alias("biosample"),
        F.when(s % 3 == 0, "Yes").when(s % 3 == 1, "NO").otherwise("no").alias("confirmed"),
        F.when(s % 5 == 0, "No").otherwise("YES").alias("genome"),
        F.when(F.col("s_nationkey") % 2 == 0, "Animal").otherwise("plant").alias("target_raw"),
        F.concat(F.lit("https://archive.example/genomes/all/GCF/x/"), acc, F.lit("_ASM"), s.cast("string"))
        .alias("refseq_ftp"),
    )


FX6_SQL = (
    "fx6 AS (SELECT 'Organism ' || s_name AS organism_name, 'strain_' || CAST(s_suppkey AS VARCHAR) AS strain, "
    "'SAMN' || CAST(s_suppkey AS VARCHAR) AS biosample, "
    "CASE s_suppkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'NO' ELSE 'no' END AS confirmed, "
    "CASE WHEN s_suppkey % 5 = 0 THEN 'No' ELSE 'YES' END AS genome, "
    "CASE WHEN s_nationkey % 2 = 0 THEN 'Animal' ELSE 'plant' END AS target_raw, "
    "'https://archive.example/genomes/all/GCF/x/GCF_' || lpad(CAST(7919 * s_suppkey AS VARCHAR), 9, '0') || '.1_ASM' "
    "|| CAST(s_suppkey AS VARCHAR) AS refseq_ftp FROM supplier)"
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "

"""Aggregation, reshaping and descriptive statistics.

Quantiles are exact (R type 7 = Spark ``percentile`` = DuckDB ``quantile_cont``)
but never gather a column into one task: values are counted per distinct value,
running counts come from :func:`running_totals`, and only the two order
statistics around each requested position are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import null_safe_join
from .ranking import running_totals

SUMMARY_PROBS = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def class_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """A1."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """A2: two-key counts spread to one column per value of ``cols`` (explicit values, no extra job)."""
    return df.groupBy(rows).pivot(cols, list(values)).agg(F.count(F.lit(1)))


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "key", value: str = "value") -> DataFrame:
    """A10: ``gather`` -- columns to key/value rows (values cast to one type first)."""
    return df.unpivot(list(ids), list(cols), var, value)


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: mean and sample sd of every column in one pass, long form (column, mean, sd)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__sd")]
    wide = df.agg(*aggs)
    packed = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__sd").alias("sd"))
        for c in cols])).alias("s"))
    return packed.select("s.*")


def exact_quantiles(long_df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact type-7 quantiles of ``value`` per group -> (groups..., name, q).

    NULL values are ignored. Work: one aggregate to distinct values, one running
    count (bucketed), one filter keeping at most two rows per (group, prob).
    """
    groups = list(groups)
    v = long_df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c")) \
        .persist(StorageLevel.MEMORY_AND_DISK)  # distinct values: read by the running count and the totals
    rt = running_totals(v, value, ["__c"], groups=groups, suffix="_below")
    if groups:
        rt = null_safe_join(rt, v.groupBy(*groups).agg(F.sum("__c").alias("__n")), groups)
    else:  # one total: a scalar, attached as a literal
        rt = rt.withColumn("__n", F.lit(v.agg(F.sum("__c")).first()[0] or 0).cast("long"))
    rows = []
    for name, p in probs.items():
        h = (F.col("__n") - 1) * F.lit(float(p)) + 1
        j = F.floor(h)
        rows.append(F.struct(F.lit(name).alias("__name"), h.alias("__h"), j.alias("__j")))
    d = rt.select(*groups, value, "__c", "__c_below", "__n", F.explode(F.array(*rows)).alias("__p")).select(
        *groups, value, "__c", "__c_below", "__n", "__p.*")
    lo, hi = F.col("__c_below"), F.col("__c_below") + F.col("__c")
    jlo = F.col("__j")
    jhi = F.least(F.col("__j") + 1, F.col("__n"))
    d = d.filter(((jlo > lo) & (jlo <= hi)) | ((jhi > lo) & (jhi <= hi)))
    d = d.withColumn("__is_lo", (jlo > lo) & (jlo <= hi)).withColumn("__is_hi", (jhi > lo) & (jhi <= hi))
    keys = groups or [F.lit(0).alias("__g")]
    agg = d.groupBy(*keys, "__name").agg(
        F.max(F.when(F.col("__is_lo"), F.col(value))).alias("__xlo"),
        F.max(F.when(F.col("__is_hi"), F.col(value))).alias("__xhi"),
        F.first("__h").alias("__h"), F.first("__j").alias("__j"))
    q = F.col("__xlo") + (F.col("__h") - F.col("__j")) * (F.col("__xhi") - F.col("__xlo"))
    return agg.select(*groups, F.col("__name").alias("stat"), q.cast("double").alias("q"))


def summarize(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column (and group): n, n_missing, mean, min, q1, median, q3, max (long by column)."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, list(cols), "variable", "x")
    basic = long.groupBy(*by, "variable").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing"), F.avg("x").alias("mean"))
    qs = exact_quantiles(long, by + ["variable"], "x", SUMMARY_PROBS)
    wide = qs.groupBy(*by, "variable").pivot("stat", list(SUMMARY_PROBS)).agg(F.first("q"))
    return null_safe_join(basic, wide, by + ["variable"], "left")


# Suffixes of the per-metric statistics of the replicate study.
METRIC_STAT_NAMES = {"media": None, "median": 0.5, "min": 0.0, "max": 1.0, "Q1": 0.25, "Q3": 0.75}


def metric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One wide row ``{col}_{media,median,min,max,Q1,Q3}``, NULLs ignored."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "x")
    probs = {k: v for k, v in METRIC_STAT_NAMES.items() if v is not None}
    qs = exact_quantiles(long, ["column"], "x", probs)
    means = long.groupBy("column").agg(F.avg("x").alias("q")).withColumn("stat", F.lit("media"))
    allst = qs.unionByName(means.select("column", "stat", "q"))
    names = [f"{c}_{s}" for c in cols for s in METRIC_STAT_NAMES]
    return (allst.select(F.concat_ws("_", "column", "stat").alias("name"), "q")
            .groupBy().pivot("name", names).agg(F.first("q")))


def metric_table(stats: DataFrame, contains: str, sep: str = r"[^A-Za-z0-9]+") -> DataFrame:
    """Wide stats -> long -> split name into (Method, Param, statistic) -> wide by statistic."""
    cols = [c for c in stats.columns if contains in c]
    long = stats.unpivot([], cols, "param", "stat")
    parts = F.split(F.col("param"), sep)
    long = long.select(parts[0].alias("Method"), parts[1].alias("Param"), parts[2].alias("statistic"), "stat")
    stat_names = list(dict.fromkeys(c.split("_")[-1] for c in cols))
    return long.groupBy("Method", "Param").pivot("statistic", stat_names).agg(F.first("stat"))


def choice_frequency(best: DataFrame, problem: str, params: Sequence[str]) -> DataFrame:
    """How often each hyper-parameter value was chosen, per problem."""
    long = best.select(problem, *[F.col(p).cast("double").alias(p) for p in params]).unpivot(
        [problem], list(params), "param", "value")
    return long.groupBy(problem, "param", "value").agg(F.count(F.lit(1)).alias("n"))


def metrics_wide(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], metric_col: str = "metric",
                 mean: str = "mean", std_err: str = "std_err") -> DataFrame:
    """Metric rows -> ``mean_<m>``, ``std_err_<m>`` columns (explicit metric list)."""
    p = df.groupBy(*keys).pivot(metric_col, list(metrics)).agg(F.first(mean).alias("mean"),
                                                                 F.first(std_err).alias("std_err"))
    ren = {}
    for m in metrics:
        ren[f"{m}_mean"] = f"mean_{m}"
        ren[f"{m}_std_err"] = f"std_err_{m}"
    return p.withColumnsRenamed(ren)


def confusion_by(df: DataFrame, keys: Sequence[str], truth: str, pred: str, positive: str) -> DataFrame:
    """TP/TN/FP/FN per group in a single conditional aggregate."""
    t, p = F.col(truth) == positive, F.col(pred) == positive
    return df.groupBy(*keys).agg(
        F.count_if(t & p).alias("TP"), F.count_if(~t & ~p).alias("TN"),
        F.count_if(~t & p).alias("FP"), F.count_if(t & ~p).alias("FN"))


def mean_confusion(conf: DataFrame, problem: str, positive: str, negative: str) -> DataFrame:
    """Mean TP/TN/FP/FN per problem, long form with truth and predicted labels."""
    m = conf.groupBy(problem).agg(*[F.avg(c).alias(c) for c in ("TP", "TN", "FP", "FN")])
    cells = F.array(
        F.struct(F.lit("TP").alias("cell"), F.lit(positive).alias("truth"), F.lit(positive).alias("prediction"), F.col("TP").alias("mean_n")),
        F.struct(F.lit("TN").alias("cell"), F.lit(negative).alias("truth"), F.lit(negative).alias("prediction"), F.col("TN").alias("mean_n")),
        F.struct(F.lit("FP").alias("cell"), F.lit(negative).alias("truth"), F.lit(positive).alias("prediction"), F.col("FP").alias("mean_n")),
        F.struct(F.lit("FN").alias("cell"), F.lit(positive).alias("truth"), F.lit(negative).alias("prediction"), F.col("FN").alias("mean_n")))
    return m.select(problem, F.explode(cells).alias("c")).select(problem, "c.*")


def conf_mat(preds: DataFrame, truth: str, pred: str, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Truth x prediction counts over the full level cross (zero cells kept), one pass."""
    aggs = [F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"{i}_{j}")
            for i, t in enumerate(levels) for j, p in enumerate(levels)]
    w = preds.groupBy(*by).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(p).alias("prediction"), F.col(f"{i}_{j}").alias("n"))
                      for i, t in enumerate(levels) for j, p in enumerate(levels)])
    return w.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def mismatch_count(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """A16."""
    return df.groupBy(*by).agg(F.count_if(F.col(a) != F.col(b)).alias("n_mismatch"),
                               F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights ``N / (K * n_c)`` attached to every row; a NULL label is a class of its own.

    The class table joins as it is: Spark broadcasts it only if its measured size is small.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    whole = counts.agg(F.sum("__nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    wt = counts.select(label, (F.lit(whole["n"] or 0) / (F.lit(whole["k"]) * F.col("__nc"))).alias(out))
    return null_safe_join(df, wt, [label], "left")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the column's min and max -> (bin, lo, hi, n)."""
    mm = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")).first()
    lo, hi = mm["__lo"], mm["__hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n"))


def pair_sample(df: DataFrame, cols: Sequence[str], n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """A bounded, deterministic sample of rows for pairwise plots (the limit is the feature)."""
    from ..functions.exprs import order_key

    return df.select(key, *cols).orderBy(order_key(seed, key)).limit(n)

"""Sampling, splitting and resampling.

Every decision is a deterministic function of ``(seed, row key)`` through the md5
order key, so a split or fold is the same in Spark and DuckDB, on every re-run and
after any executor loss (no RNG state, no ``rand()``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hex_to_long, order_key
from .ranking import global_rank

DRAW_BROADCAST_ROWS = 5_000_000


def thin(df: DataFrame, frac: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly ``round(n * frac)`` rows (half to even), without replacement."""
    r = global_rank(df, order_key(seed, key), rank_col="__rank", size_col="__n")
    size = F.bround(F.col("__n") * F.lit(float(frac)))
    return r.filter(F.col("__rank") <= size).drop("__rank", "__n")


def split_stratified(df: DataFrame, label: str, p: float, seed: int = 42, key: str = "row_id",
                     rounding: str = "ceil", out: str = "set") -> DataFrame:
    """R2: per class, the first ``ceil(p * n_c)`` rows by order key go to ``train``, the rest to ``test``.

    ``rounding="floor"`` gives the other common convention.
    """
    r = global_rank(df, order_key(seed, key), strata=[label], rank_col="__rank", size_col="__n")
    target = F.col("__n") * F.lit(float(p))
    size = F.ceil(target - F.lit(1e-9)) if rounding == "ceil" else F.floor(target + F.lit(1e-9))
    return r.withColumn(out, F.when(F.col("__rank") <= size, "train").otherwise("test")).drop("__rank", "__n")


def split_fixed(df: DataFrame, label: str, sizes: Mapping[str, int], seed: int = 42, key: str = "row_id",
                out: str = "set", check: bool = True) -> DataFrame:
    """A fixed number of test rows per class (rest -> train); error if a class is too small."""
    r = global_rank(df, order_key(seed, key), strata=[label], rank_col="__rank", size_col="__n")
    if check:
        counts = {row[label]: row["n"] for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        for cls, n in sizes.items():
            if counts.get(cls, 0) < n:
                raise ValueError(f"class {cls!r} has {counts.get(cls, 0)} rows, {n} requested")
    size = F.lit(None).cast("long")
    for cls, n in sizes.items():
        size = F.when(F.col(label) == cls, F.lit(int(n))).otherwise(size)
    return r.withColumn(out, F.when(F.col("__rank") <= F.coalesce(size, F.lit(0)), "test").otherwise("train")) \
        .drop("__rank", "__n")


def split_random(df: DataFrame, p: float, seed: int = 42, key: str = "row_id", out: str = "set") -> DataFrame:
    """Unstratified, ``round(p * n)`` rows (half to even) to train."""
    r = global_rank(df, order_key(seed, key), rank_col="__rank", size_col="__n")
    return r.withColumn(out, F.when(F.col("__rank") <= F.bround(F.col("__n") * F.lit(float(p))), "train")
                        .otherwise("test")).drop("__rank", "__n")


def vfold(df: DataFrame, v: int = 10, repeats: int = 1, seed: int = 42, strata: str | None = None,
          key: str = "row_id") -> DataFrame:
    """Long fold table ``(key, [strata], repeat, fold)``; assessment of (repeat, fold) = its rows.

    All repeats are ranked in one plan (one shuffle), folds dealt round-robin by rank
    inside each stratum so class shares are kept.
    """
    cols = [key] + ([strata] if strata else [])
    base = df.select(*cols).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(int(repeats)))))
    r = global_rank(base, order_key(seed, "repeat", key), strata=(["repeat"] + ([strata] if strata else [])),
                    rank_col="__rank")
    return r.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(int(v))).cast("int")).drop("__rank")


def upsample(df: DataFrame, label: str, ratio: float = 1.0, seed: int = 42, key: str = "row_id",
             copy_col: str = "copy") -> DataFrame:
    """Grow every class to ``floor(ratio * n_max)`` rows by drawing with replacement.

    Originals keep ``copy = 0``; draw ``j`` of a class takes the row of rank
    ``1 + (hex8(md5(seed|u|j)) mod n_c)`` and gets ``copy = j + 1``. Draws are
    generated with ``spark.range`` (distributed) and matched by an equi-join on
    (class, rank); a class table small enough is broadcast so a hot rank never
    lands in one task.
    """
    spark = df.sparkSession
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df.withColumn(copy_col, F.lit(0))
    target = math.floor(ratio * max(counts.values()))
    ranked = global_rank(df, order_key(seed, key), strata=[label], rank_col="__rank")
    out = df.withColumn(copy_col, F.lit(0))
    for cls, n_c in counts.items():
        m = target - n_c
        if m <= 0:
            continue
        kind = "int" if m < 1 << 31 else "long"
        draws = spark.range(0, m).select(
            (F.col("id") + 1).cast(kind).alias(copy_col),
            (F.lit(1) + F.pmod(hex_to_long(order_key(seed, F.lit("u"), F.col("id"))), F.lit(n_c))).alias("__rank"))
        side = ranked.filter(F.col(label).eqNullSafe(F.lit(cls)))
        side = F.broadcast(side) if n_c <= DRAW_BROADCAST_ROWS else side
        extra = draws.join(side, "__rank").drop("__rank")
        out = out.unionByName(extra.select(*out.columns))
    return out


#: Draws that one row of the draw table stands for before it is spread.
DRAW_BLOCK = 10_000


def in_analysis(df: DataFrame, folds: DataFrame, label: str, key: str) -> DataFrame:
    """``(key, label, repeat, fold)``: every row once for each resample whose analysis set it is in. Labels come
    from ``df``; no feature column is copied."""
    ids = folds.select("repeat", "fold").distinct().groupBy("repeat").agg(F.collect_set("fold").alias("all"))  # v numbers a repeat
    f = folds.select(key, "repeat", F.col("fold").alias("__own")).join(F.broadcast(ids), "repeat")
    f = f.select(key, "repeat", F.explode(F.array_remove("all", F.col("__own"))).alias("fold"))
    return f.join(df.select(key, label), key)


def fold_class_counts(df: DataFrame, folds: DataFrame, label: str, key: str = "row_id") -> DataFrame:
    """``(repeat, fold, label, n)``: rows of each class in every analysis set, as the repeat's total minus the fold."""
    per = folds.select(key, "repeat", "fold").join(df.select(key, label), key).groupBy("repeat", "fold", label).agg(F.count(F.lit(1)).alias("own"))
    total = per.groupBy("repeat", label).agg(F.sum("own").alias("all"))
    pairs = per.select("repeat", "fold").distinct().join(total, "repeat")
    own = per.select(F.col("repeat").alias("__r"), F.col("fold").alias("__f"), F.col(label).alias("__l"), "own")
    same = (F.col("repeat") == F.col("__r")) & (F.col("fold") == F.col("__f")) & F.col(label).eqNullSafe(F.col("__l"))
    n = (F.col("all") - F.coalesce("own", F.lit(0))).alias("n")
    return pairs.join(own, same, "left").select("repeat", "fold", label, n).filter(F.col("n") > 0)


def fold_class_weights(df: DataFrame, folds: DataFrame, label: str, key: str = "row_id", out: str = "weight") -> DataFrame:
    """A18 per resample: balanced weights ``N / (K * n_c)`` over the analysis rows, ``(repeat, fold, label, weight)``.

    A NULL label is a class of its own. The table has classes x resamples rows."""
    c = fold_class_counts(df, folds, label, key)
    whole = Window.partitionBy("repeat", "fold")  # one row per class
    return c.select("repeat", "fold", label, (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias(out))


def fold_multiplicities(df: DataFrame, folds: DataFrame, label: str, ratio: float = 1.0, seed: int = 42, key: str = "row_id") -> DataFrame:
    """R8 inside every analysis set: how often each row counts when its class grows to ``floor(ratio * largest)``
    rows by drawing with replacement: ``(key, repeat, fold, copies)``, ``copies >= 1``, held-out rows absent.

    Draw ``j`` of a class takes the analysis row of rank ``1 + hex8(md5(seed|u|repeat|fold|label|j)) mod n_c``, ranks
    by the order key inside (repeat, fold, class). The copies of a class add up to the target exactly, and no
    row is copied: the learner takes them as weights. Draws are made in blocks of 10,000, so no row stands for an
    unbounded number of them; a NULL label is a class of its own.
    """
    counts = fold_class_counts(df, folds, label, key)
    most = F.max("n").over(Window.partitionBy("repeat", "fold"))
    short = counts.withColumn("__m", F.floor(most * F.lit(float(ratio))).cast("long") - F.col("n")).filter("__m > 0")
    blocks = short.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m") - 1) / DRAW_BLOCK))).alias("__b"))
    first = F.col("__b") * DRAW_BLOCK
    draws = blocks.select("repeat", "fold", F.col(label).alias("__l"), "n",
                          F.explode(F.sequence(first, F.least(first + DRAW_BLOCK, F.col("__m")) - 1)).alias("__j"))
    rank = F.lit(1) + F.pmod(hex_to_long(order_key(seed, F.lit("u"), "repeat", "fold", "__l", "__j")), F.col("n"))
    hits = draws.select(F.col("repeat").alias("__r"), F.col("fold").alias("__f"), "__l", rank.alias("__k")).groupBy("__r", "__f", "__l", "__k").agg(
        F.count(F.lit(1)).alias("__hits"))
    ranked = global_rank(in_analysis(df, folds, label, key), order_key(seed, key), strata=["repeat", "fold", label], rank_col="__rank")
    same = ((F.col("repeat") == F.col("__r")) & (F.col("fold") == F.col("__f")) & F.col(label).eqNullSafe(F.col("__l"))
            & (F.col("__rank") == F.col("__k")))
    return ranked.join(hits, same, "left").select(key, "repeat", "fold", (F.lit(1) + F.coalesce("__hits", F.lit(0))).cast("long").alias("copies"))


def column_keep_prob(false_reps: float) -> float:
    return 1.0 / (1.0 + false_reps)


def _hash_unit(seed: int, name: str) -> float:
    h = hashlib.md5(f"{seed}|{name}".encode()).hexdigest()
    return int(h[:8], 16) / 16 ** 8


def sample_columns(cols: Sequence[str], false_reps: float, seed: int = 42) -> list[str]:
    """R9 (wide): keep each column with probability ``1/(1+false_reps)`` by a hash of its name."""
    p = column_keep_prob(false_reps)
    return [c for c in cols if _hash_unit(seed, c) < p]


def sample_variants(df: DataFrame, col: str, false_reps: float, seed: int = 42) -> DataFrame:
    """R9 (long): the same decision as :func:`sample_columns`, as a filter on the variant key."""
    p = column_keep_prob(false_reps)
    u = hex_to_long(order_key(seed, col)).cast("double") / F.lit(float(16 ** 8))
    return df.filter(u < F.lit(p))

"""Evaluation metrics, all grouped: ``metric(preds, ..., by=[...])``.

Rank metrics (AUC, ROC points, DeLong) first collapse rows to one row per
distinct (group, score) with positive/negative counts -- a partial aggregate, so
even a score value shared by a third of all rows is a single row afterwards --
then take bucketed running totals over the scores (no global sort in one task).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from .joins import null_safe_join
from .ranking import running_totals

Z_975 = 1.959964


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def accuracy(preds: DataFrame, truth: str = "label", pred: str = "pred_class", by=()) -> DataFrame:
    """V1."""
    return preds.groupBy(*_by(by)).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def counts(preds: DataFrame, truth: str, pred: str, positive: str, by=()) -> DataFrame:
    t, p = F.col(truth) == positive, F.col(pred) == positive
    return preds.groupBy(*_by(by)).agg(
        F.count_if(t & p).alias("TP"), F.count_if(~t & ~p).alias("TN"),
        F.count_if(~t & p).alias("FP"), F.count_if(t & ~p).alias("FN"))


def _mcc_expr() -> F.Column:
    tp, tn, fp, fn = [F.col(c).cast("double") for c in ("TP", "TN", "FP", "FN")]
    return safe_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def mcc(preds: DataFrame, truth: str = "label", pred: str = "pred_class", positive: str = "Probiotic",
        by=()) -> DataFrame:
    """V3: Matthews correlation, doubles before multiplying; 0/0 -> NULL."""
    return counts(preds, truth, pred, positive, by).select(*_by(by), _mcc_expr().alias("mcc"))


def _kappa_expr() -> F.Column:
    tp, tn, fp, fn = [F.col(c).cast("double") for c in ("TP", "TN", "FP", "FN")]
    n = tp + tn + fp + fn
    po = safe_div(tp + tn, n)
    pe = safe_div((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    return safe_div(po - pe, 1 - pe)


def kappa(preds: DataFrame, truth: str = "label", pred: str = "pred_class", positive: str = "Probiotic",
          by=()) -> DataFrame:
    """V7: Cohen's kappa from the 2x2 marginals."""
    return counts(preds, truth, pred, positive, by).select(*_by(by), _kappa_expr().alias("kappa"))


def brier(preds: DataFrame, truth: str, prob: str, event: str, by=()) -> DataFrame:
    """V4: mean squared difference between the event probability and the event indicator."""
    y = (F.col(truth) == event).cast("double")
    return preds.groupBy(*_by(by)).agg(F.avg(F.pow(F.col(prob) - y, 2)).alias("brier"))


def sens_spec(preds: DataFrame, truth: str, pred: str, event: str, by=()) -> DataFrame:
    """V5: sensitivity and specificity with ``event`` as the positive level."""
    c = counts(preds, truth, pred, event, by)
    return c.select(*_by(by), safe_div(F.col("TP"), F.col("TP") + F.col("FN")).alias("sensitivity"),
                    safe_div(F.col("TN"), F.col("TN") + F.col("FP")).alias("specificity"))


def error_rates(preds: DataFrame, truth: str, pred: str, positive: str, by=()) -> DataFrame:
    """V6: FPR, FNR, total error (percent), long form ``(by..., error, percentage)``."""
    c = counts(preds, truth, pred, positive, by)
    fpr = 100 * safe_div(F.col("FP"), F.col("FP") + F.col("TN"))
    fnr = 100 * safe_div(F.col("FN"), F.col("FN") + F.col("TP"))
    ter = 100 * safe_div(F.col("FP") + F.col("FN"), F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN"))
    arr = F.array(F.struct(F.lit("FPR").alias("error"), fpr.alias("percentage")),
                  F.struct(F.lit("FNR").alias("error"), fnr.alias("percentage")),
                  F.struct(F.lit("TER").alias("error"), ter.alias("percentage")))
    return c.select(*_by(by), F.explode(arr).alias("e")).select(*_by(by), "e.*")


def score_table(preds: DataFrame, truth: str, score: str, event: str, by=()) -> DataFrame:
    """One row per distinct (group, score): ``pos`` (event rows) and ``neg`` counts."""
    e = F.col(truth) == event
    return (preds.filter(F.col(score).isNotNull())
            .groupBy(*_by(by), score).agg(F.count_if(e).alias("pos"), F.count_if(~e).alias("neg")))


def _with_below(st: DataFrame, score: str, by) -> DataFrame:
    return running_totals(st, score, ["pos", "neg"], groups=_by(by), suffix="_below")


def roc_auc(preds: DataFrame, truth: str, score: str, event: str, by=()) -> DataFrame:
    """V2: exact ROC AUC, ties count one half; ``score`` is the event's probability.

    ``AUC = sum(pos * (neg_below + neg / 2)) / (P * N)``, NULL when P or N is 0.
    """
    r = _with_below(score_table(preds, truth, score, event, by), score, by)
    return r.groupBy(*_by(by)).agg(safe_div(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)),
        F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def roc_curve(preds: DataFrame, truth: str, score: str, event: str, by=()) -> DataFrame:
    """V9: one ROC point per distinct threshold: rows with score >= threshold are called events.

    Columns ``(by..., threshold, fpr_pct, tpr_pct)``.
    """
    r = _with_totals(_with_below(score_table(preds, truth, score, event, by), score, by), _by(by))
    return r.select(*_by(by), F.col(score).alias("threshold"),
                    (100 * safe_div(F.col("__N") - F.col("neg_below"), F.col("__N"))).alias("fpr_pct"),
                    (100 * safe_div(F.col("__P") - F.col("pos_below"), F.col("__P"))).alias("tpr_pct"))


def _with_totals(r: DataFrame, b: list[str]) -> DataFrame:
    """Attach the group's event / non-event totals ``__P``, ``__N``: a grouped aggregate
    joined back, or -- ungrouped -- one scalar row attached as literals (never a window
    over all distinct scores in one task)."""
    if b:
        tot = r.groupBy(*b).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
        return null_safe_join(r, tot, b)
    row = r.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return r.withColumns({"__P": F.lit(row["P"] or 0).cast("long"), "__N": F.lit(row["N"] or 0).cast("long")})


def auc_ci(preds: DataFrame, truth: str, score: str, event: str, by=(), z: float = Z_975) -> DataFrame:
    """AUC with a DeLong (1988) standard error and a clipped normal interval.

    Placement values per distinct score: for events ``(neg_below + neg/2)/N``,
    for non-events ``(pos_above + pos/2)/P``; variances are sample variances.
    """
    b = _by(by)
    r = _with_totals(_with_below(score_table(preds, truth, score, event, by), score, by), b)
    v10 = (F.col("neg_below") + F.col("neg") / 2) / F.col("__N")
    pos_above = F.col("__P") - F.col("pos_below") - F.col("pos")
    v01 = (pos_above + F.col("pos") / 2) / F.col("__P")
    s = r.groupBy(*(b or [F.lit(0).alias("__g")])).agg(
        F.first("__P").alias("P"), F.first("__N").alias("N"),
        F.sum(F.col("pos") * v10).alias("s10"), F.sum(F.col("pos") * v10 * v10).alias("q10"),
        F.sum(F.col("neg") * v01).alias("s01"), F.sum(F.col("neg") * v01 * v01).alias("q01"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    auc = safe_div(F.col("s10"), P)
    var10 = safe_div(F.col("q10") - F.col("s10") * F.col("s10") / P, P - 1)
    var01 = safe_div(F.col("q01") - F.col("s01") * F.col("s01") / N, N - 1)
    se = F.sqrt(var10 / P + var01 / N)
    return s.select(*b, auc.alias("roc_auc"), se.alias("se"),
                    F.greatest(F.lit(0.0), auc - z * se).alias("ci_low"),
                    F.least(F.lit(1.0), auc + z * se).alias("ci_high"))


def mse(preds: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """MSE, RMSE and the correlation of truth and prediction (NULL when undefined)."""
    x, y = F.col(truth).cast("double"), F.col(pred).cast("double")
    g = preds.groupBy(*_by(by)).agg(
        F.avg(F.pow(x - y, 2)).alias("mse"), F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.covar_samp(x, y).alias("cxy"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    return g.select(*_by(by), "mse", F.sqrt("mse").alias("rmse"),
                    safe_div(F.col("cxy"), F.sqrt(F.col("vx") * F.col("vy"))).alias("corr"))


def metric_set(preds: DataFrame, truth: str, pred: str, score: str, event: str, positive: str,
               by=()) -> DataFrame:
    """Long metric table ``(by..., metric, estimator, estimate)`` for accuracy, roc_auc, mcc, kappa, brier.

    All but the AUC come from one aggregate, so the predictions are read twice."""
    b = _by(by)
    t, p = F.col(truth) == positive, F.col(pred) == positive
    off = F.col(score) - (F.col(truth) == event).cast("double")
    c = preds.groupBy(*b).agg(F.count_if(t & p).alias("TP"), F.count_if(~t & ~p).alias("TN"), F.count_if(~t & p).alias("FP"),
                              F.count_if(t & ~p).alias("FN"), F.avg(F.pow(off, 2)).alias("__brier"))
    right = F.col("TP") + F.col("TN")
    found = {"accuracy": safe_div(right, right + F.col("FP") + F.col("FN")), "mcc": _mcc_expr(), "kap": _kappa_expr(), "brier_class": F.col("__brier")}
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("estimate")) for k, v in found.items()])
    out = c.select(*b, F.explode(rows).alias("__m")).select(*b, "__m.metric", "__m.estimate")
    auc = roc_auc(preds, truth, score, event, by).select(*b, F.lit("roc_auc").alias("metric"),
                                                         F.col("roc_auc").alias("estimate"))
    return out.unionByName(auc).withColumn("estimator", F.lit("binary"))


# ---------------------------------------------------------------- V8
RATE_COLUMNS = ["accuracy", "kappa", "sensitivity", "specificity", "pos_pred_value", "neg_pred_value",
                "precision", "recall", "f1", "prevalence", "detection_rate", "detection_prevalence",
                "balanced_accuracy"]


def confusion_rates(c: DataFrame, by=()) -> DataFrame:
    """V8 rates from a TP/TN/FP/FN table (pure column arithmetic)."""
    tp, tn, fp, fn = [F.col(x).cast("double") for x in ("TP", "TN", "FP", "FN")]
    n = tp + tn + fp + fn
    sens, spec = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    ppv, npv = safe_div(tp, tp + fp), safe_div(tn, tn + fn)
    return c.select(
        *_by(by), "TP", "TN", "FP", "FN",
        safe_div(tp + tn, n).alias("accuracy"), _kappa_expr().alias("kappa"),
        sens.alias("sensitivity"), spec.alias("specificity"), ppv.alias("pos_pred_value"),
        npv.alias("neg_pred_value"), ppv.alias("precision"), sens.alias("recall"),
        safe_div(2 * ppv * sens, ppv + sens).alias("f1"), safe_div(tp + fn, n).alias("prevalence"),
        safe_div(tp, n).alias("detection_rate"), safe_div(tp + fp, n).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"))


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz steps)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_share(b, a, 1.0 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    d = 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    c, h, k = 1.0, d, 0
    while True:  # about sqrt(max(a, b)) turns
        k += 1
        before = h
        for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)),
                    -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            h *= d * c
        if abs(h - before) <= 1e-15 * abs(h):
            return front * h


def _binom_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial, exact also where it is tiny."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else _beta_share(k, n - k + 1, p)


def _bisect(f, lo=0.0, hi=1.0, it=100):
    for _ in range(it):
        mid = (lo + hi) / 2
        if f(mid):
            hi = mid
        else:
            lo = mid
    return (lo + hi) / 2


def clopper_pearson(x: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval by bisection on the tails."""
    if n == 0:
        return (float("nan"), float("nan"))
    lower = 0.0 if x == 0 else _bisect(lambda p: _binom_tail(x, n, p) >= alpha / 2)
    upper = 1.0 if x == n else _bisect(lambda p: _beta_share(n - x, x + 1, 1 - p) <= alpha / 2)
    return lower, upper


def _tests(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, r in pdf.iterrows():
        tp, tn, fp, fn = int(r["TP"]), int(r["TN"]), int(r["FP"]), int(r["FN"])
        n = tp + tn + fp + fn
        hits = tp + tn
        lo, hi = clopper_pearson(hits, n)
        nir = max(tp + fn, tn + fp) / n if n else float("nan")
        p_nir = _binom_tail(hits, n, nir) if n else float("nan")
        b, c = fp, fn
        mcn = ((abs(b - c) - 1) ** 2 / (b + c)) if (b + c) > 0 else float("nan")
        p_mcn = math.erfc(math.sqrt(mcn / 2)) if mcn == mcn else float("nan")
        out.append({"accuracy_lower": lo, "accuracy_upper": hi, "no_information_rate": nir,
                    "accuracy_p_value": p_nir, "mcnemar_p_value": p_mcn})
    res = pd.DataFrame(out, index=pdf.index)
    return pd.concat([pdf.drop(columns=["TP", "TN", "FP", "FN"]), res], axis=1)


def confusion_stats(preds: DataFrame, truth: str, pred: str, positive: str, by=()) -> DataFrame:
    """V8: rates plus exact accuracy CI, no-information rate and its p-value, McNemar p.

    The tests need only four integers per group: they run in ``applyInPandas`` on the
    (tiny) per-group count table, distributed by group.
    """
    b = _by(by)
    c = counts(preds, truth, pred, positive, by)
    rates = confusion_rates(c, by)
    keyed = c.withColumn("__g", F.lit(0)) if not b else c
    keys = b or ["__g"]
    schema = ", ".join([f"{k} {dict(keyed.dtypes)[k]}" for k in keys] +
                       ["accuracy_lower double", "accuracy_upper double", "no_information_rate double",
                        "accuracy_p_value double", "mcnemar_p_value double"])
    tests = keyed.groupBy(*keys).applyInPandas(_tests, schema)
    if not b:
        return rates.withColumn("__g", F.lit(0)).join(tests, "__g").drop("__g")
    return null_safe_join(rates, tests, b)

"""Hand-computed and brute-force checks (the SELF / INV rows of the inventory)."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademl.operators import aggregate as A
from clademl.operators import genotypes as N
from clademl.operators import grids as G
from clademl.operators import metrics as V
from clademl.operators import ranking as W
from clademl.operators import recipe as E
from clademl.operators import resample as R
from clademl.operators import shape as P
from clademl.functions.exprs import order_key
from clademl.sources import sinks as SK
from clademl.sources import tables as S

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- brute-force metrics on random tables
def _rand_preds(spark, n, seed, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice(["a", "b"])
        s = rng.choice([0.1, 0.2, 0.5, 0.7]) if ties else rng.random()
        p = "b" if s >= 0.5 else "a"
        rows.append((i, y, float(s), p, rng.choice(["g1", "g2"])))
    return rows, spark.createDataFrame(rows, "row_id long, label string, score double, pred string, g string")


def _auc_brute(rows, event):
    pos = [r[2] for r in rows if r[1] == event]
    neg = [r[2] for r in rows if r[1] != event]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed,ties", [(1, True), (2, False), (3, True)])
def test_auc_matches_brute_force(spark, seed, ties):
    rows, df = _rand_preds(spark, 300, seed, ties)
    got = {r["g"]: r["roc_auc"] for r in V.roc_auc(df, "label", "score", "b", by="g").collect()}
    for g in ("g1", "g2"):
        sub = [r for r in rows if r[4] == g]
        assert got[g] == pytest.approx(_auc_brute(sub, "b"), abs=1e-12)


def test_auc_complement(spark):
    rows, df = _rand_preds(spark, 200, 5, False)
    a = V.roc_auc(df, "label", "score", "b").first()["roc_auc"]
    b = V.roc_auc(df.withColumn("score", 1 - F.col("score")), "label", "score", "b").first()["roc_auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)


def test_confusion_metrics_brute_force(spark):
    rows, df = _rand_preds(spark, 400, 7)
    tp = sum(1 for r in rows if r[1] == "b" and r[3] == "b")
    tn = sum(1 for r in rows if r[1] == "a" and r[3] == "a")
    fp = sum(1 for r in rows if r[1] == "a" and r[3] == "b")
    fn = sum(1 for r in rows if r[1] == "b" and r[3] == "a")
    n = tp + tn + fp + fn
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    po = (tp + tn) / n
    pe = ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / n ** 2
    assert V.mcc(df, "label", "pred", "b").first()["mcc"] == pytest.approx(mcc)
    assert V.kappa(df, "label", "pred", "b").first()["kappa"] == pytest.approx((po - pe) / (1 - pe))
    assert V.accuracy(df, "label", "pred").first()["accuracy"] == pytest.approx(po)
    assert -1 <= mcc <= 1
    er = {r["error"]: r["percentage"] for r in V.error_rates(df, "label", "pred", "b").collect()}
    assert er["FPR"] == pytest.approx(100 * fp / (fp + tn))
    assert er["TER"] == pytest.approx(100 * (fp + fn) / n)


def test_mcc_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "a")], "row_id long, label string, pred string")
    assert V.mcc(df, "label", "pred", "b").first()["mcc"] is None


def test_delong_against_numpy(spark):
    rows, df = _rand_preds(spark, 250, 11, True)
    pos = np.array([r[2] for r in rows if r[1] == "b"])
    neg = np.array([r[2] for r in rows if r[1] != "b"])
    v10 = np.array([np.mean((p > neg) + 0.5 * (p == neg)) for p in pos])
    v01 = np.array([np.mean((pos > q) + 0.5 * (pos == q)) for q in neg])
    se = math.sqrt(v10.var(ddof=1) / len(pos) + v01.var(ddof=1) / len(neg))
    r = V.auc_ci(df, "label", "score", "b").first()
    assert r["roc_auc"] == pytest.approx(v10.mean())
    assert r["se"] == pytest.approx(se)


def test_clopper_pearson_known_values():
    lo, hi = V.clopper_pearson(8, 10)
    assert lo == pytest.approx(0.4439045, abs=1e-6)
    assert hi == pytest.approx(0.9747893, abs=1e-6)


# ---------------------------------------------------------------- ranking, quantiles, resampling laws
def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.round(rng.normal(size=500), 2)
    df = spark.createDataFrame([(float(v), "g" if i % 3 else "h") for i, v in enumerate(vals)], "x double, k string")
    got = {(r["k"], r["stat"]): r["q"] for r in A.exact_quantiles(df, ["k"], "x", A.SUMMARY_PROBS).collect()}
    for k, mask in (("g", np.arange(500) % 3 != 0), ("h", np.arange(500) % 3 == 0)):
        for name, p in A.SUMMARY_PROBS.items():
            assert got[(k, name)] == pytest.approx(float(np.quantile(vals[mask], p)), abs=1e-12)


def test_global_rank_equals_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(5000).withColumn("s", (F.col("id") % 3).cast("string"))
    r = W.global_rank(df, order_key(9, "id"), strata=["s"], prefix_len=2)
    w = Window.partitionBy("s").orderBy(order_key(9, "id"))
    assert r.withColumn("rn", F.row_number().over(w)).filter("rank != rn").count() == 0


def test_vfold_partition_laws(spark):
    df = spark.range(103).withColumnRenamed("id", "row_id").withColumn("label", F.when(F.col("row_id") % 4 == 0, "x").otherwise("y"))
    f = R.vfold(df, v=5, repeats=2, seed=1, strata="label").collect()
    for rep in (1, 2):
        rows = [r for r in f if r["repeat"] == rep]
        assert sorted(r["row_id"] for r in rows) == list(range(103))  # each row exactly once per repeat
        for lab in ("x", "y"):
            sizes = [sum(1 for r in rows if r["label"] == lab and r["fold"] == k) for k in range(5)]
            assert max(sizes) - min(sizes) <= 1  # stratified balance


def test_split_sizes(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id").withColumn("label", F.when(F.col("row_id") < 21, "p").otherwise("n"))
    s = R.split_stratified(df, "label", 0.8, seed=3).groupBy("label", "set").count().collect()
    got = {(r["label"], r["set"]): r["count"] for r in s}
    assert got[("p", "train")] == math.ceil(0.8 * 21) and got[("n", "train")] == 64
    f = R.split_fixed(df, "label", {"p": 8, "n": 32}).groupBy("label", "set").count().collect()
    got = {(r["label"], r["set"]): r["count"] for r in f}
    assert got[("p", "test")] == 8 and got[("n", "test")] == 32
    with pytest.raises(ValueError):
        R.split_fixed(df, "label", {"p": 50})


def test_upsample_balances(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id").withColumn("label", F.when(F.col("row_id") < 7, "p").otherwise("n"))
    up = R.upsample(df, "label", 1.0, seed=2)
    c = {r["label"]: r["count"] for r in up.groupBy("label").count().collect()}
    assert c == {"p": 43, "n": 43}
    assert up.filter("copy = 0").count() == 50


def test_thin_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    assert R.thin(df, 0.1).count() == 100


# ---------------------------------------------------------------- grids
def test_grids():
    g = G.grid_log(-5, 0, 20)
    assert len(g) == 20 and g[0]["penalty"] == pytest.approx(1e-5) and g[-1]["penalty"] == pytest.approx(1.0)
    gi = G.grid_int({"mtry": G.RF_MTRY, "min_n": G.RF_MIN_N})
    assert len(gi) == 36 and {x["mtry"] for x in gi} == set(range(3, 9))
    lhs = G.grid_space_filling(G.BOOST_RANGES, 25)
    assert len(lhs) == 25
    for name, (lo, hi, base) in G.BOOST_RANGES.items():
        vals = [math.log10(p[name]) if base else p[name] for p in lhs]
        if isinstance(lo, int):  # whole numbers, both ends reachable
            assert all(isinstance(v, int) for v in vals) and (hi - lo >= 25 * 2 or (min(vals), max(vals)) == (lo, hi))
            continue
        strata = sorted(int((v - lo) / (hi - lo) * 25) for v in vals)
        assert strata == list(range(25))  # each stratum exactly once
    assert len(G.grid_cross({"nu": G.ONECLASS_NU, "sigma": G.ONECLASS_SIGMA})) == 100
    r = G.refine_lambda(2.0)
    assert r[0] == pytest.approx(1.0) and r[-1] == pytest.approx(2.2) and len(r) == 31


# ---------------------------------------------------------------- genotypes
def test_hwe_exact_known():
    assert N.hwe_exact(50, 25, 25) == pytest.approx(1.0, abs=1e-9) or N.hwe_exact(50, 25, 25) > 0.8
    assert N.hwe_exact(100, 0, 0) < 1e-20
    assert N.hwe_exact(0, 50, 50) < 1e-20
    p = N.hwe_exact(57, 14, 29)
    assert 0 < p <= 1


def test_hwe_exact_against_sum():
    def exact(het, a, b):
        n, rare = het + a + b, 2 * min(a, b) + het
        ways = {h: 2**h * math.factorial(n) // (math.factorial(h) * math.factorial((rare - h) // 2) * math.factorial(n - h - (rare - h) // 2))
                for h in range(rare % 2, rare + 1, 2)}
        return sum(w for w in ways.values() if w <= ways[het]) / sum(ways.values())

    for t in [(0, 0, 0), (1, 0, 0), (3, 0, 5), (57, 14, 29), (10, 40, 2), (0, 7, 7), (21, 30, 6)]:
        assert N.hwe_exact(*t) == pytest.approx(exact(*t) if sum(t) else 1.0, rel=1e-9)


def test_same_id_at_two_sites(spark):
    rows = [("F", f"S{i}", 1, p, ".", "A", "C", d) for p, d in ((1, 0), (2, 2)) for i in range(4)]
    g = spark.createDataFrame(rows, "fid string, iid string, chrom int, pos long, variant_id string, a1 string, a2 string, dosage int")
    assert sorted((r["pos"], r["p"]) for r in N.variant_stats(g).collect()) == [(1, 0.0), (2, 1.0)]


def test_exact_interval():
    lo, hi = V.clopper_pearson(7, 20)
    assert (lo, hi) == pytest.approx((0.15390920, 0.59218880), abs=1e-6)
    assert V.clopper_pearson(0, 10)[0] == 0.0 and V.clopper_pearson(10, 10)[1] == 1.0
    tail = sum(math.comb(50, k) * 0.3**k * 0.7 ** (50 - k) for k in range(45, 51))
    assert V._binom_tail(45, 50, 0.3) == pytest.approx(tail, rel=1e-9)


def test_read_ped_alleles(spark, tmpdir_path):
    mp, one, three = (os.path.join(tmpdir_path, x) for x in ("m.map", "one.ped", "three.ped"))
    for path, text in ((mp, "1 rs1 0 100\n"), (one, "F1 S1 0 0 1 -9 A A\nF1 S2 0 0 2 -9 A A\n"),
                       (three, "F1 S1 0 0 1 -9 A C\nF1 S2 0 0 2 -9 G A\n")):
        with open(path, "w") as f:
            f.write(text)
    assert [(r["a1"], r["a2"], r["dosage"]) for r in S.read_ped(spark, one, mp).collect()] == [(None, "A", 0)] * 2
    with pytest.raises(Exception, match="more than two alleles"):
        S.read_ped(spark, three, mp).collect()


def test_filters_with_missing_values(spark):
    rows = [(float(i), 2.0 * i if i % 3 else None, None, 1.0, 0.0 if i % 2 else -0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, bare double, same double, zero double")
    m = {(r["i"], r["j"]): r["r"] for r in E.corr_matrix(df, df.columns).collect()}
    assert m[("a", "b")] == pytest.approx(1.0) and m[("a", "bare")] is None and m[("a", "same")] is None
    sparse = spark.createDataFrame([(float(i), float(i * i % 7), 1.5 * i if i < 2 else None) for i in range(50)], "a double, b double, c double")
    full = {(r["i"], r["j"]): r["r"] for r in E.corr_matrix(sparse, ["a", "b", "c"]).collect()}
    assert full[("a", "b")] == pytest.approx(sparse.stat.corr("a", "b"))
    assert E.NearZeroVar(inputCols=df.columns).fit(df.limit(4)).getDropCols() == ["bare", "same", "zero"]
    lv = spark.createDataFrame([("",), ("x",), (None,)], "k string")
    fit = E.NominalLevels(inputCols=["k"]).fit(lv)
    assert [r["k"] for r in fit.transform(spark.createDataFrame([("",), ("y",), (None,)], "k string")).collect()] == ["", "new", "unknown"]


def test_read_ped(spark, tmpdir_path):
    ped = os.path.join(tmpdir_path, "x.ped")
    mp = os.path.join(tmpdir_path, "x.map")
    with open(ped, "w") as f:
        f.write("F1 S1 0 0 1 -9 A A C G\nF1 S2 0 0 2 -9 A G 0 0\nF2 S3 0 0 1 -9 G G G G\n")
    with open(mp, "w") as f:
        f.write("1 rs1 0 100\n2 rs2 0 200\n")
    g = {(r["iid"], r["variant_id"]): r for r in S.read_ped(spark, ped, mp).collect()}
    assert g[("S1", "rs1")]["dosage"] == 2 - 2 * (g[("S1", "rs1")]["a1"] == "G") + 0  # A/A counts a1 copies
    assert g[("S2", "rs2")]["dosage"] is None
    assert g[("S3", "rs2")]["chrom"] == 2 and g[("S3", "rs2")]["pos"] == 200


def test_kinship_matches_pairwise(spark):
    rows = []
    rng = random.Random(4)
    for s in range(6):
        for v in range(40):
            d = None if rng.random() < 0.05 else rng.choice([0, 1, 1, 2])
            rows.append(("F", f"S{s}", f"rs{v}", 1, v, "A", "C", d))
    g = spark.createDataFrame(rows, "fid string, iid string, variant_id string, chrom int, pos long, a1 string, a2 string, dosage int")
    got = N.kinship(g, variant_block=8, sample_block=4).collect()
    assert len(got) == 36  # every ordered sample pair exactly once
    k = {(r["iid_i"], r["iid_j"]): (r["g"], r["m"]) for r in got}
    # brute force
    by_v = {}
    for _, iid, v, *_rest, d in rows:
        by_v.setdefault(v, {})[iid] = d
    zs = {}
    for v, m in by_v.items():
        obs = [x for x in m.values() if x is not None]
        p = sum(obs) / len(obs) / 2
        if min(p, 1 - p) < 0.01:
            continue
        zs[v] = {i: (x - 2 * p) / math.sqrt(2 * p * (1 - p)) for i, x in m.items() if x is not None}
    for a, b in itertools.product([f"S{i}" for i in range(6)], repeat=2):
        common = [v for v in zs if a in zs[v] and b in zs[v]]
        exp = sum(zs[v][a] * zs[v][b] for v in common) / len(common)
        assert k[(a, b)][0] == pytest.approx(exp, abs=1e-9)
        assert k[(a, b)][1] == len(common)


# ---------------------------------------------------------------- sources and sinks
def test_format_dispatch_and_codes(spark, tmpdir_path):
    assert S.file_format("/a/b/data.train.csv") == "csv"
    assert S.file_format("x.TSV") == "tsv"
    p = os.path.join(tmpdir_path, "t.tsv")
    with open(p, "w") as f:
        f.write("id\tx\tz\n1\t1,5\t.\n2\t-\tNA\n3\t2,25\tok\n")
    d = S.read_table(spark, p, "id int, x string, z string")
    d = S.parse_decimal_comma(S.nullify(d, ["x", "z"]), ["x"])
    got = {r["id"]: (r["x"], r["z"]) for r in d.collect()}
    assert got == {1: (1.5, None), 2: (None, None), 3: (2.25, "ok")}


def test_read_runs_and_combine(spark, tmpdir_path):
    from clademl.operators.discovery import combine_runs

    for run, rows in (("1700000000", ["a,Probiotic,Probiotic", "b,Nonprobiotic,Probiotic"]),
                      ("1700000100", ["c,Probiotic,Nonprobiotic"])):
        os.makedirs(os.path.join(tmpdir_path, run))
        with open(os.path.join(tmpdir_path, run, "predictions.csv"), "w") as f:
            f.write("row_id,label,pred_class\n" + "\n".join(rows) + "\n")
        for kind in ("best_params.csv", "metrics.csv", "errors.csv", "new_positives.csv"):
            with open(os.path.join(tmpdir_path, run, kind), "w") as f:
                f.write("mean,x\n0.5,1\n0.7,2\n" if kind == "best_params.csv" else "x\n1\n")
    out = combine_runs(spark, tmpdir_path, "Probiotic")
    conf = {r["run_ts"]: (r["TP"], r["FP"], r["FN"]) for r in out["confusion"].collect()}
    assert conf == {1700000000: (1, 1, 0), 1700000100: (0, 0, 1)}
    assert out["best"].count() == 2  # one best row per run


def test_writers(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 1.5, "x")], "a int, b double, c string")
    SK.write_csv2(df, os.path.join(tmpdir_path, "eu"), single_file=True)
    txt = "".join(open(os.path.join(tmpdir_path, "eu", f)).read() for f in os.listdir(os.path.join(tmpdir_path, "eu"))
                  if f.endswith(".csv"))
    assert "a;b;c" in txt and "1;1,5;x" in txt
    SK.write_lines(df, "c", os.path.join(tmpdir_path, "lines"))
    back = S.read_lines(spark, os.path.join(tmpdir_path, "lines")).collect()
    assert [r["line"] for r in back] == ["x"]
    SK.write_csv(df, os.path.join(tmpdir_path, "tsv"), sep="\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(os.path.join(tmpdir_path, "tsv")).count() == 1


def test_manifest(spark):
    m = SK.manifest(spark, 1785000000, {"penalty": 0.01, "method": "lasso"}).collect()
    assert {r["name"]: r["value"] for r in m} == {"penalty": "0.01", "method": "lasso"}


def test_set_ops(spark):
    a = spark.createDataFrame([(1, "x")], "row_id long, label string")
    b = spark.createDataFrame([(2,)], "row_id long")
    u = P.union_loose(a, b).collect()
    assert sorted((r["row_id"], r["label"]) for r in u) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        P.union_strict(a, b)


def test_bp_space_greedy(spark):
    rows = [("F", "S1", f"rs{i}", c, p, "A", "C", 1) for i, (c, p) in enumerate(
        [(1, 100), (1, 100), (1, 104), (1, 105), (1, 111), (1, 200), (2, 100), (2, 102)])]
    g = spark.createDataFrame(rows, "fid string, iid string, variant_id string, chrom int, pos long, a1 string, a2 string, dosage int")
    d1 = sorted(r["variant_id"] for r in N.bp_space(g, 1).collect())
    assert d1 == ["rs0", "rs2", "rs3", "rs4", "rs5", "rs6", "rs7"]  # same site -> lowest id
    d5 = sorted(r["variant_id"] for r in N.bp_space(g, 5).collect())
    # chrom 1: 100 kept, 104 (<5) dropped, 105 kept, 111 kept, 200 kept; chrom 2: 100 kept, 102 dropped
    assert d5 == ["rs0", "rs3", "rs4", "rs5", "rs6"]


def test_running_totals_narrow_group(spark):
    """A group whose values sit in a tiny range next to a wide one: per-group bucket
    bounds keep it split, and the running sums equal a plain window."""
    from pyspark.sql import Window

    rng = np.random.default_rng(0)
    rows = [("a", float(round(x, 3)), 1) for x in rng.normal(size=3000)] + \
           [("b", float(1e6 + round(x, 6)), 2) for x in rng.normal(scale=1e-3, size=3000)]
    df = spark.createDataFrame(rows, "g string, x double, c long").groupBy("g", "x").agg(F.sum("c").alias("c"))
    rt = W.running_totals(df, "x", ["c"], groups=["g"])
    w = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    assert rt.withColumn("c2", F.coalesce(F.sum("c").over(w), F.lit(0))).filter("c_below != c2").count() == 0


def test_null_stratum_keeps_its_rows(spark):
    from clademl.operators.ranking import global_rank

    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(30)], "id long, label string")
    got = global_rank(df, "id", strata=["label"])
    new = [c for c in got.columns if c not in df.columns]
    assert got.count() == 30 and got.filter(" or ".join(f"`{c}` is null" for c in new)).count() == 0

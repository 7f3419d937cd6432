"""Line rules, exact clustering and periodic runs: brute force, odd rows, SQL, bounds."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademl.llm import clusters, quality, runs
from clademl.llm.words import pair_numbers, split_words, word_numbers
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank."


# ---------------------------------------------------------------- words
def test_words_split_at_ascii_white_space_only():
    assert split_words("a b\x1cc d\x0be\x0cf\tg\r\nh i") == ["a b\x1cc".encode(), b"d", b"e", b"f", b"g", "h i".encode()]
    assert split_words(None) == split_words("") == split_words(" \n") == []
    numbers, edges = word_numbers([[b"a", b"b"], [], [b"a"]])
    assert numbers.tolist() == [0, 1, 0] and edges.tolist() == [0, 2, 2, 3]
    assert len(pair_numbers(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


# ---------------------------------------------------------------- line rules
def _repeated(ws: list[bytes], k: int = 8) -> int:
    seen: dict = {}
    for i in range(len(ws) - k + 1):
        seen.setdefault(tuple(ws[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_repeated_words_equal_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        texts = [[b"%d" % rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(60))] for _ in range(rng.randrange(1, 5))]
        assert quality.repeated_words(*word_numbers(texts)).tolist() == [_repeated(t) for t in texts]


@pytest.mark.parametrize(("line", "rule"), [
    (PROSE, ""), ("No end of a sentence here", "punctuation"), ("A sentence. And one that is cut", ""), ('He said "go."', ""),
    ("Home | News | Sport | Mail | More.", "navigation"), ("Home > Shop > Shoes > Red. »", "navigation"), ("a#b $c *d %e &f.", "punctuation"),
    ("Either a | or b | is meant by this rather long sentence, which has only two bars.", ""),
    ("Licensed under the Apache License, Version 2.0.", "boilerplate"), ("All Rights RESERVED.", "boilerplate"), ("  padded.\r", ""),
])
def test_line_rules(line, rule):
    assert quality.failed_rule(line, len(split_words(line)), quality.LineRules()) == rule


def test_clean_lines_odd_rows(spark):
    menu, nav = "\n".join(["Home | About | Press | Jobs"] * 6), "Home | About | Press | Jobs | Help"
    rows = [(1, PROSE), (2, None), (3, ""), (None, PROSE), (4, f"{PROSE}\n{nav}\n\n{PROSE} More."), (5, f"{PROSE}\n{menu}"), (6, " \n\t"), (7, "ha " * 40),
            (1, PROSE), (8, PROSE + "\n" + "x" * 300_000 + " end.")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    got = {(r["doc_id"], r["n_words"]): r for r in quality.clean_lines(df).collect()}
    assert len(got) == 9
    assert got[1, 24]["kept"] and got[1, 24]["cleaned"] == PROSE and got[None, 24]["kept"]
    assert got[2, 0]["cleaned"] is None and got[3, 0]["cleaned"] == "" and got[2, 0]["base_failed"] and not got[3, 0]["kept"]
    kept = next(r for k, r in got.items() if k[0] == 4)
    assert kept["cleaned"] == f"{PROSE}\n\n{PROSE} More." and kept["n_lines"] == 3 and kept["cut_navigation"] == 1 and not kept["kept"]  # repeats itself
    lost = next(r for k, r in got.items() if k[0] == 5)
    assert lost["n_dup_lines"] == 5 and lost["n_words_left"] == 24 and not lost["kept"]
    assert got[7, 40]["n_repeat_words"] == 40 and got[7, 40]["base_failed"]
    assert got[8, 26]["kept"] and got[8, 26]["word_chars"] == len((PROSE + "x" * 300_000 + "end.").replace(" ", ""))
    assert quality.clean_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.clean_lines(df, keep=("Kept",))
    assert "lang" in quality.clean_lines(df.withColumn("lang", F.lit("en")), keep=("lang",)).columns
    assert quality.clean_lines(df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).count() == len(rows)


# ---------------------------------------------------------------- clusters
def test_loosening_is_a_bound_below_the_drift():
    rng = np.random.default_rng(0)
    below = 0
    for _ in range(60):
        k, d = int(rng.integers(2, 6)), int(rng.integers(1, 6))
        old = rng.integers(-60, 60, (k, d))
        new = old + rng.integers(-20, 20, (k, d)) * (rng.random((k, 1)) < 0.8)
        reach = rng.random(k) * 40
        bound, drift = clusters.loosening(old, new, reach), np.linalg.norm(new - old, axis=1)
        assert (bound <= drift * (1 + 1e-6)).all() and (bound >= 0).all()
        below += int((bound < 0.9 * drift).sum())
        for i in range(k):
            ways = rng.standard_normal((400, d))
            x = old[i] + ways / np.linalg.norm(ways, axis=1)[:, None] * reach[i] * rng.random((400, 1)) ** (1 / d)
            shrunk = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert (shrunk <= bound[i] + 1e-9).all()
    assert below > 50


def _lloyd(rows, k=8, rounds=10):
    kept = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == 64 and not any(c is None for c in v) and np.isfinite(np.array(v, np.float64)).all()]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept if i is not None)
    cs = [c for _, c in order[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((int(a) - b) ** 2 for a, b in zip(x, c)) for c in cs]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        a = assign()
        for j in range(len(cs)):
            own = [x for (_, x), (c, _) in zip(kept, a) if c == j]
            if own:
                cs[j] = [int(sum(int(x[t]) for x in own)) // len(own) for t in range(64)]
    a = assign()
    inertia = [sum(d for c, d in a if c == j) for j in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (c, d) in zip(kept, a))


def _got(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_equal_plain_rounds_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    spots = rng.standard_normal((6, 64))
    rows = [(i, (spots[i % 6] + 0.3 * rng.standard_normal(64)).tolist()) for i in range(240)]
    rows += [(300 + i, spots[0].tolist()) for i in range(90)] + [rows[5], rows[5]]  # a third alike, repeated rows
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [None] + [1.0] * 63), (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] * 64),
             (506, [0.0] * 64), (507, [1000.0] * 64), (None, [0.5] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    assert _got(clusters.cluster(df)) == _lloyd(rows)
    far = spark.createDataFrame([(1, [200_000.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert [r[0] for r in clusters.cluster(far).collect()] == [2]  # its distances fit no long
    few = spark.createDataFrame([(7, [1.0] * 64), (8, [1.0] * 64), (9, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert {r["cluster"] for r in clusters.cluster(few).collect()} == {0}  # ties: the smaller number
    assert clusters.cluster(df.limit(0)).count() == 0


def test_bounds_spare_scans_and_state_is_dropped(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (8 * rng.standard_normal(64) * 0 + 10 * np.eye(64)[i % 8] + 0.2 * rng.standard_normal(64)).tolist()) for i in range(400)]
    found = clusters.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.rounds[0]["scanned"] == 400 and found.rounds[-1]["scanned"] < 100
    assert _got(found.rows) == _lloyd(rows)


# ---------------------------------------------------------------- runs
def _brute(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, seg = j - i + q, w[i : j + q]
            if j > i and size >= max(least, 2 * q) and not any(seg[p:] == seg[: size - p] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    rng = random.Random(0)
    for _ in range(800):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5, 30])
            t = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                t = t[:a] + [t[a + j % p] for j in range(n - a)]
            texts.append([b"%d" % x for x in (t + [99] + t if rng.random() < 0.3 else t)])
        assert runs.find_runs(*word_numbers(texts)) == [_brute(t) for t in texts]


def test_rare_words_split_segments():
    words = "u v a b a b a b a b a b a b x c d e f c d e f c y".split()
    numbers, edges = word_numbers([[w.encode() for w in words]])
    assert runs.surviving_segments(numbers, edges) == [(2, 14)]


def _report(doc_id, text):
    import zlib

    ws = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(ws)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = _brute(ws)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()),
            sha(b" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_run_report_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "d e"] if i % 3 else ["w%d" % j for j in range(40)]) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "ha " * 30), (203, "ha " * 20_000), (1, rows[1][1]), (1, rows[1][1]), (204, "one two three"),
             (2**60 + 1, "x y " * 9)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = runs.report(runs.periodic_runs(df, prepare=runs.copied_tails)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [_report(i, t) if i != 203 else None for i, t in rows]
    assert sorted((tuple(r) for r in got if r[0] != 203), key=key) == sorted((w for w in want if w), key=key)
    assert next(tuple(r)[1:6] for r in got if r[0] == 203) == (1, 0, 20_000, 1, 20_000_000)
    plain = {r["doc_id"]: r for r in runs.periodic_runs(df).collect()}
    assert plain[None]["collapsed"] == "ha" and [tuple(x) for x in plain[None]["runs"]] == [(0, 30, 1)] and plain[200]["collapsed"] == ""
    assert runs.periodic_runs(df.limit(0)).count() == 0
    assert runs.periodic_runs(df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).schema["doc_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize("name", ["op11_line_rules", "op12_centroid_clusters"])
def test_queries_equal_sql(spark, name):
    from clademl.llm.queries import ORACLES, QUERIES

    r = compare(spark, name, QUERIES[name], ORACLES[name], SF, duck(SF))
    assert r["values"], r["diff"]

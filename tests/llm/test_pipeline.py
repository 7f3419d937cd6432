"""Each stage of the corpus pipeline against brute force written here, one text at a time."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from clademl.llm import decontaminate, minhash, packing, pii, toxicity
from clademl.llm.common import table
from clademl.llm.encoders import ByteBpe
from pyspark.sql import functions as F

import corpus_pipeline as c

SF = "/root/testdata/sf0.001"
STAGES = dict(c.STAGES)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def components(texts, percent):
    """Smallest index reachable over pairs with ``100 * both >= percent * either``, all pairs compared."""
    ws = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ws]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((comp[a], comp[b]))
                comp = [x if k == y else k for k in comp]
    return comp


def edited_pairs():
    """Pairs at 0.849, 0.832, 0.815, 0.806 and 0.798: that many of 196 shingles changed by one run of words."""
    rng, texts = random.Random(8), []
    for n, hit in enumerate([16, 18, 20, 21, 22] * 8):
        ws = [f"w{n}x{rng.randrange(10**6)}" for _ in range(200)]
        at = rng.randrange(10, 150)
        texts += [" ".join(ws), " ".join([*ws[:at], *(f"e{n}x{i}" for i in range(hit - 4)), *ws[at + hit - 4 :]])]
    return texts


def test_near_duplicate_stage_drops_pairs_from_080(spark):
    texts = edited_pairs()
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = components(texts, 80)
    assert sum(k != i for i, k in enumerate(comp)) == 32 and sum(k != i for i, k in enumerate(components(texts, 85))) == 0
    assert sorted(r["doc_id"] for r in c.drop_near_duplicates(spark, made, SF).collect()) == [i for i, k in enumerate(comp) if k == i]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(made).collect()} == dict(enumerate(comp))
    assert minhash.near_duplicates(made, percent=85).filter("not kept").count() == 0


def test_near_duplicate_stage_on_documents(spark, docs, rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    comp = components([r["text"] for r in rows], 80)
    want = [rows[i]["doc_id"] for i, k in enumerate(comp) if k == i]
    assert sorted(r["doc_id"] for r in c.drop_near_duplicates(spark, docs, SF).collect()) == want


def test_near_duplicate_hot_group_at_85(spark):
    rng, texts = random.Random(5), []
    for _ in range(120):
        t = [f"w{i}" for i in range(80)]
        for _ in range(rng.randrange(4)):
            t[rng.randrange(80)] = f"z{rng.randrange(1000)}"
        texts.append(" ".join(t))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (80, 85):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(made, percent=percent, block_docs=16).collect()}
        assert got == dict(enumerate(components(texts, percent)))


def test_signature_misses_080_as_rarely_as_085_before():
    def missed(symbols, errors, share):
        return sum(math.comb(symbols, k) * share**k * (1 - share) ** (symbols - k) for k in range(errors + 1, symbols + 1))

    assert missed(minhash.SYMBOLS, minhash.MOST_ERRORS, 0.2) <= missed(60, 23, 0.15)
    rng = np.random.default_rng(2)
    for errors in (minhash.MOST_ERRORS, 7):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16)
        for _ in range(50):
            b = a.copy()
            b[rng.permutation(minhash.SYMBOLS)[:errors]] ^= 1
            assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any()


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def toxic_score(model, text):
    """Largest window logit, calibrated; one word and one step at a time in double precision."""
    w = {k: v.astype(float) for k, v in model.w.items()}
    h, inputs = toxicity.HIDDEN, []
    for x in (m.group().translate(LOWER).encode() for m in WORD.finditer(text or "")):
        b = b"\x02" + x + b"\x03"
        tri = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(x))]
        k = model.vocab.get(x, 0)
        inputs.append(np.concatenate((w["word"][k], w["char"][tri].mean(axis=0), [model.odds[k]])))
    logits, start = [], 0
    while True:
        part = inputs[start : start + 64]
        sides = []
        for s, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            state, out = np.zeros(h), {}
            for t in order:
                g, x = w[f"u{s}"] @ state, part[t] @ w[f"x{s}"] + w[f"b{s}"]
                z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
                n = np.tanh(x[2 * h :] + r * g[2 * h :])
                out[t] = state = (1 - z) * n + z * state
            sides.append(out)
        states = [np.concatenate((sides[0][t], sides[1][t])) for t in range(len(part))]
        e = np.array([w["att_v"] @ np.tanh(w["att"] @ x + w["att_b"]) for x in states])
        pooled = sum(a * x for a, x in zip(np.exp(e - e.max()) / np.exp(e - e.max()).sum(), states, strict=True)) if states else np.zeros(2 * h)
        logits.append(float(w["out"] @ pooled + w["out_b"][0]))
        if start + 64 >= len(inputs):
            return sigmoid(model.scale[0] * max(logits) + model.scale[1])
        start += 48


def test_toxicity_stage(spark, docs, rows):
    label = {}
    for r in table(spark, SF, "labels").collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            label[r["doc_id"]] = max(r["toxic"], label.get(r["doc_id"], 0))
    known = sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] in label)
    model = toxicity.train([t for _, t in known], np.array([label[i] for i, _ in known], np.int64))
    score = {r["doc_id"]: toxic_score(model, r["text"]) for r in rows}
    clear = {i for i, s in score.items() if abs(s - toxicity.THRESHOLD) > 1e-3}
    got = c.drop_toxic(spark, docs, SF).collect()
    assert len(clear) > len(rows) - 3 and 0 < sum(s >= toxicity.THRESHOLD for s in score.values()) < len(rows)
    assert {r["doc_id"] for r in got} & clear == {i for i in clear if score[i] < toxicity.THRESHOLD}
    assert set(got) <= set(rows)


def without_benchmark(text, phrases):
    found = list(WORD.finditer(text or ""))
    ws = [m.group().translate(LOWER) for m in found]
    hit = [False] * len(ws)
    for width in {len(p) for p in phrases}:
        for i in range(len(ws) - width + 1):
            if tuple(ws[i : i + width]) in phrases:
                hit[i : i + width] = [True] * width
    out, last = [], 0
    for i, m in enumerate(found):
        if hit[i]:
            out.append(text[last : m.start()] if not i or not hit[i - 1] else "")
            last = m.end()
    return "".join(out) + text[last:] if text else text


def test_decontamination_stage(spark, docs, rows):
    phrases = set()
    for r in table(spark, SF, "benchmark").collect():
        ws = [m.group().translate(LOWER) for m in WORD.finditer(r["text"] or "")] if r["item_id"] is not None else []
        phrases |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))} if ws else set()
    want = {r["doc_id"]: without_benchmark(r["text"], phrases) for r in rows}
    got = c.cut_benchmark(spark, docs, SF).collect()
    assert any(want[r["doc_id"]] != r["text"] for r in rows) and len(got) == len(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] not in {x["text"] for x in rows})


def test_personal_data_stage(spark, docs, rows):
    weights, features = pii.train(pii.training_regions(docs)), pii.SpanFeatures()
    got = {r["doc_id"]: r["text"] for r in c.redact_personal_data(spark, docs, SF).collect()}
    assert len(got) == len(rows) and any(got[r["doc_id"]] != r["text"] for r in rows)
    for r in rows:
        text = r["text"] or ""
        base, added = pii.find_spans(r["text"], weights, features)
        assert not set(re.findall(r"[A-Za-z0-9]+@[A-Za-z0-9]+\.[a-z]{2,}", text)) & set(re.findall(r"[A-Za-z0-9@.]+", got[r["doc_id"]] or ""))
        out, end = [], 0
        for k, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
            out += [text[end:s], f"<{k}>"] if s >= end else []
            end = max(end, e)
        assert (got[r["doc_id"]] or "") == "".join(out) + text[end:]


def test_packing_stage(spark, docs, rows):
    bpe, pieces = ByteBpe(packing.default_tokenizer()), {}
    for p in c.pack(spark, docs, SF).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    assert set(pieces) == {r["doc_id"] for r in rows}
    for r in rows:
        ids = np.array([*bpe.whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["offset"] + p["length"] <= 2048
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    place = sorted((p["sequence_id"], p["offset"], p["length"]) for x in pieces.values() for p in x)
    assert all(a[0] * 2048 + a[1] + a[2] == b[0] * 2048 + b[1] for a, b in zip(place, place[1:]))


CLASHING = ["score", "predicted", "held_out", "spans", "n_words", "n_hit", "item_ids", "cleaned", "base", "added", "joined",
            "base_joined", "added_joined", "redacted", "kept", "component_id", "n_shingles", "_document_0", "n"]


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_stages_keep_columns_with_the_operators_names(spark, docs, name):
    extra = docs.select("*", *(F.concat(F.lit(f"{x}/"), F.col("doc_id")).alias(x) for x in CLASHING))
    got, want = STAGES[name](spark, extra, SF), STAGES[name](spark, docs, SF)
    if name == "packing":
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        return
    assert got.columns == extra.columns
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[: len(docs.columns)] for r in rows) == sorted(map(tuple, want.collect()))
    assert all(r[len(docs.columns) :] == tuple(f"{x}/{r[0]}" for x in CLASHING) for r in rows)


def test_operators_refuse_kept_columns_with_their_names(spark, docs):
    own = docs.withColumns({"Score": F.lit(1), "spans": F.lit(1), "base": F.lit(1)})
    with pytest.raises(ValueError, match="score"):
        toxicity.toxicity(own, table(spark, SF, "labels"), keep=("Score",))
    with pytest.raises(ValueError, match="spans"):
        decontaminate.contamination(own, table(spark, SF, "benchmark"), keep=("spans",))
    with pytest.raises(ValueError, match="base"):
        pii.personal_data(own, keep=("base",))


def test_near_duplicate_stage_drops_repeated_and_null_id_rows(spark):
    import corpus_pipeline as c

    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    rows = [(1, text, 5), (1, text, 5), (None, text, 5), (None, text + " tail", 6), (2, other, 7), (2, other, 7), (None, "only here and seen twice", 8),
            (None, "only here and seen twice", 8), (3, None, 0), (4, "", 0), (None, None, 0), (2, "another text under the id of two", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = c.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda r: (r[0] or -1, r[1] or "", r[2])
    want = [rows[0], rows[4], rows[6], rows[8], rows[9], rows[10], rows[11]]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert c.drop_near_duplicates(spark, docs.limit(0), "").count() == 0

import random
import re
import zlib

import numpy as np
import pytest

from tracefold.llm import spans
from tracefold.llm import toxicity as T

MEAN = ["rotten", "vile", "awful"]


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.2
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(MEAN).upper() + ".")
        docs.append((k, " ".join(words), rng.choice(["en", "de"])))
        labels.append((k, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(frames):
    got = {r.doc_id: r for r in T.toxicity(*frames).collect()}
    truth = dict(corpus()[1])
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.flagged == (r.score >= r.threshold) for r in got.values())


def test_held_out_labels_are_not_learned(spark, frames):
    docs, labels = frames
    turned = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(T.fold("doc_id", 4) == 2).union(labels.where(T.fold("doc_id", 4) != 2))
    a = T.toxicity(docs, labels).orderBy("doc_id").collect()
    assert a == T.toxicity(docs, turned).orderBy("doc_id").collect()


def test_odd_and_empty(spark, odd, none, frames):
    model = T.train(*frames)
    got = T.score(odd, model).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] == by[3] and len(by[4]) == 1
    assert T.score(none, model).count() == 0
    assert T.toxicity(odd, frames[1].limit(0)).where("score > 0").count() == 0


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    m = T.Classifier(np.arange(5), np.zeros(5), rng, 4, 3)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64) + rng.normal(0, 0.3, m.p[k].shape)
    x, offsets, y = rng.integers(0, 6, 14), np.array([0, 5, 5, 14]), np.array([1.0, 0.0, 1.0])
    loss = lambda: np.mean(np.logaddexp(0, m.logits(x, offsets)) - y * m.logits(x, offsets))
    g = m.gradient(x, offsets, y)
    dense = np.zeros_like(m.p["e"])
    np.add.at(dense, np.concatenate(g["e"][0]), np.concatenate(g["e"][1]))
    for key, at, found in (("w3", (1, 2, 1), g["w3"]), ("e", (int(x[2]), 1), dense), ("c2", (1,), g["c2"]), ("o", (4,), g["o"])):
        old, eps = m.p[key][at], 1e-6
        m.p[key][at] = old + eps
        high = loss()
        m.p[key][at] = old - eps
        assert abs((high - loss()) / (2 * eps) - found[at]) < 2e-4
        m.p[key][at] = old


def test_tables_give_the_same_logits():
    m = T.Classifier(np.arange(5), np.ones(5), np.random.default_rng(0))
    x, offsets = np.array([1, 2, 3, 5, 0, 4]), np.array([0, 2, 2, 6])
    assert np.allclose(m.logits(x, offsets), m.logits(x, offsets, m.tables()), atol=1e-5)


def plain_score(model, text):
    """The network by plain loops, word by word."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    row = {int(b): k + 1 for k, b in enumerate(model.ids)}
    hashed = [int(spans.hashes(np.frombuffer(w.lower(), np.uint8), np.array([0]), np.array([len(w)]))[0]) % T.BUCKETS for w in words]
    x = [row.get(h, 0) for h in hashed] + [0] * T.PAD
    features = []
    for w in T.WIDTHS:
        for f in range(model.filters):
            best = max((sum(float(model.p["e"][x[i + k]] @ model.p[f"w{w}"][k][:, f]) for k in range(w)) + float(model.p[f"c{w}"][f]) for i in range(len(words))), default=0.0)
            features.append(max(0.0, best))
    logit = sum(a * float(b) for a, b in zip(features, model.p["o"])) + float(model.p["b"][0])
    return 1 / (1 + np.exp(-(model.scale * logit + model.shift)))


def test_scores_equal_plain_loops(spark, frames):
    model = T.train(*frames)
    texts = [None, "", "VILE!", "w1 vile w2é awful, ", *(t for _, t, _ in corpus()[0][:25])]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    for r in T.score(docs, model).collect():
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-4
        assert r.threshold == model.thresholds.get("en", T.GENERAL)


def test_a_second_model_is_scored_with_its_own_tables(spark, frames):
    docs, labels = frames
    turned = labels.withColumn("toxic", (1 - labels.toxic).cast("int"))
    a, b = T.train(docs, labels), T.train(docs, turned)
    for model in (a, b, a):
        for r in T.score(docs.limit(20), model).collect():
            assert abs(r.score - plain_score(model, dict((k, t) for k, t, _ in corpus()[0])[r.doc_id])) < 1e-4


def test_long_texts_are_calibrated_on(spark):
    """Clean texts of many thousand words are scored whole and left alone."""
    docs, labels = corpus()
    rng = random.Random(9)
    long = [(10_000 + k, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)), "en") for k in range(40)]
    df = spark.createDataFrame(docs + long, "doc_id long, text string, lang string")
    got = T.toxicity(df, spark.createDataFrame(labels + [(k, 0) for k, _, _ in long], "doc_id long, toxic int")).where("doc_id >= 10000").collect()
    assert np.mean([r.predicted for r in got]) <= 0.1


def aside(spark, n):
    """Which of the ids 0 to n are left out of the fit."""
    from pyspark.sql import functions as F

    return {r.id for r in spark.range(n).where(F.pmod(F.xxhash64(F.xxhash64(F.col("id").cast("string")), F.lit(2)), F.lit(4)) == 0).collect()}


def test_every_labelled_text_is_learned(spark):
    """Over 4,000 toxic, over 8,000 clean and very long texts: each word that two fitted texts share is known, and all shards' passes come together."""
    rng = random.Random(3)
    n, docs = 16_000, []
    for k in range(n):
        words = [f"pair{k // 2}", *(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(5, 15)))]
        docs.append((k, " ".join(words + ["vile"] * (k % 14 < 5)), "en"))
    labels = [(k, int(k % 14 < 5)) for k in range(n)]
    docs += [(n + k, "word " * 5000 + "endless", "en") for k in range(8)]
    labels += [(n + k, 0) for k in range(8)]
    df, given = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(df.repartition(3), given)
    known, out = set(model.ids.tolist()), aside(spark, n + 8)
    bucket = lambda w: int(spans.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) % T.BUCKETS
    assert all(bucket(f"pair{k // 2}") in known for k in range(0, n, 2) if not {k, k + 1} & out)
    assert bucket("endless") in known
    got = {r.doc_id: r.score for r in T.score(df, model).collect()}
    assert np.mean([(got[k] >= 0.5) == y for k, y in labels]) > 0.99
    again = T.train(df.repartition(7), given)
    assert (again.p["e"] == model.p["e"]).all() and (again.scale, again.shift, again.thresholds) == (model.scale, model.shift, model.thresholds)


def test_cells_choose_the_cut_of_a_plain_search(spark):
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["en", "de"])), int(y), bool(rng.random() < 0.5), int(rng.normal(600 * y, 700)), int(rng.integers(1, 4))) for y in rng.integers(0, 2, 400)]
    cells = spark.createDataFrame(rows, "lang string, toxic int, second boolean, cell int, n long")
    model = T.Classifier(np.arange(5), np.ones(5), np.random.default_rng(0))
    got = T._thresholds(cells, model, 20)
    for lang in ("en", "de"):
        mine = [(c, y, n) for g, y, _, c, n in rows if g == lang]
        f1 = lambda cut: 2 * sum(n for c, y, n in mine if y and c >= cut) / (sum(n for c, _, n in mine if c >= cut) + sum(n for _, y, n in mine if y))
        assert abs(f1(max(f1s := {c for c, _, _ in mine}, key=f1)) - f1(min((c for c in f1s if model.score(np.array(c / T.CELLS)) >= got[lang])))) < 1e-12

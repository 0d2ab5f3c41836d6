import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import near_dedup as N
from tracefold.llm import spans


def bag(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, least=0.8):
    """Row number -> least row number of its class."""
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= least * sum((bags[i] | bags[j]).values()) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(k) for k in range(len(rows))]


def check(df, **options):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = {}
    for (doc_id, _), c in zip(rows, brute(rows)):
        want.setdefault(c, []).append(doc_id)
    got, kept = {}, Counter()
    for r in N.near_duplicates(df, **options).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
        kept[r.class_id] += r.kept
        assert r.class_size >= 1
    whole = lambda groups: sorted(sorted(map(str, g)) for g in groups)
    assert whole(got.values()) == whole(want.values())
    assert set(kept.values()) == {1}
    return want


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(spark, extra=0):
    """Chains of small changes, a large group about one base, one passage in all of many texts."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(15):
        words = fresh(120)
        for _ in range(5):
            texts.append(" ".join(words))
            words = mutated(rng, words, 2).split()
    base = fresh(150)
    texts += [mutated(rng, base, rng.randint(0, 6)) for _ in range(80)]
    passage = fresh(60)
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(120)]
    line = " ".join(fresh(9))
    texts += [" ".join([line] * n) for n in range(1, 12)]
    texts += ["one two", "One  two", "one two three", "a", "b", "a", "", "  "] + ["exactly the same text every time " * 3] * 40
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("options", [{}, {"large": 2, "hot": 1}])
def test_planted_classes(spark, options):
    want = check(corpus(spark), **options)
    assert max(map(len, want.values())) >= 40


def test_sample_table(small):
    want = check(small)
    assert any(len(g) > 1 for g in want.values())


def test_odd_and_empty(odd, none):
    got = N.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert sorted(r.class_size for r in got if r.doc_id == 4) == [2, 2]
    assert N.near_duplicates(none).count() == 0
    assert N.near_duplicates(none.withColumn("sig", F.lit(1))).columns == ["doc_id", "class_id", "class_size", "kept"]


def test_signatures_are_unbiased():
    """Agreement is the weighted Jaccard similarity, also for large weights."""
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 60)
    got = [
        (lambda s: (s[0] == s[1]).mean())(N.signatures(2, row, np.tile(spans.mix(h + np.uint64(k)), 2), np.concatenate((a, b)), 256))
        for k in range(20)
    ]
    assert abs(np.mean(got) - want) < 4 * np.sqrt(want * (1 - want) / (20 * 256))


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 20)).astype(np.uint64) for _ in range(6)]
    want = [[len(np.intersect1d(x, y)) for y in sets[3:]] for x in sets[:3]]
    assert N.overlaps(sets[:3], sets[3:]).tolist() == want

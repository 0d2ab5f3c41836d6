import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracefold.llm import lm_scoring as M

UPPER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), None]


def brute(rows):
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(w for k, t in rows if k is not None and not held(k) for w in words(t))
    n, v = sum(count.values()), len(count)
    out = []
    for k, t in rows:
        w = words(t)
        out.append((k, held(k), len(w), sum(x in count for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"heavy": 40, "most_bits": 1 << 19}])
def test_base_scores(small, odd, options):
    for docs in (small, odd):
        want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
        got = sorted((tuple(r) for r in M.lm_scores(docs, **options).collect()), key=str)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:5] == w[:5]
            assert abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5]))
            assert g[6] < 0


def test_bigrams_help_held_out_texts(spark):
    """Sequences that follow each other: the model's score beats the base on held-out texts."""
    rng = random.Random(3)
    follow = {k: [rng.randrange(50) for _ in range(3)] for k in range(50)}
    docs = []
    for k in range(1500):
        at, text = rng.randrange(50), []
        for _ in range(40):
            text.append(f"w{at}")
            at = rng.choice(follow[at])
        docs.append((k, " ".join(text)))
    got = [r for r in M.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_every_bigram_of_the_corpus_counts(small):
    """What the broadcasts cannot hold is joined: their sizes change no score."""
    got = [{r.doc_id: r for r in M.lm_scores(small, **o).collect()} for o in ({}, {"most_bits": 1 << 19}, {"heavy": 100}, {"heavy": 100, "most_bits": 1 << 19})]
    for other in got[1:]:
        for k, r in got[0].items():
            assert abs(r.score - other[k].score) <= 0.003 * abs(r.score)
            assert r.base_score <= 0 and abs(r.base_score - other[k].base_score) <= 1e-9 * abs(r.base_score)


def test_filter_has_every_count_and_few_false_ones():
    rng = np.random.default_rng(0)
    key, n = rng.integers(0, 1 << 62, 20_000).astype(np.uint64), rng.integers(2, 5000, 20_000)
    f = M.Filter(1 << 23)
    f.add(key, f.block_of(key, f.blocks), n)
    got = f.counts(key)
    assert (got >= f.value(f.level(n)) - 1e-9).all()
    assert (got <= n * 1.5).mean() > 0.995
    assert (f.counts(rng.integers(0, 1 << 62, 50_000).astype(np.uint64)) > 0).mean() < 0.01


def test_pieces_make_the_whole_filter(spark):
    rows = [(k * 7919 + 3, k % 11, 2 + k % 50) for k in range(30_000)]
    h, w, n = np.array(rows).T
    f = M.build_filter(spark.createDataFrame(rows, "h long, w long, n long"), 1 << 20)
    assert len(f.table) * 64 == 1 << 20 and f.least > 1
    kept = f.counts(M.pair_key(h, w)) >= n / 1.5
    assert kept[n >= 2**f.least].all() and not kept.all()  # the most frequent fit
    f = M.build_filter(spark.createDataFrame(rows, "h long, w long, n long"), 1 << 23)
    assert f.least == 1 and (f.counts(M.pair_key(h, w)) >= n / 1.5).all()


def test_scores_against_brute_force(small):
    """The interpolated score of every text, from exact counts and the fitted weights."""
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for k, t in rows:
        if not held(k):
            w = words(t)
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    docs = small.withColumn("doc_id", small["doc_id"])
    _, model = M.learn(docs.where(M.fold("doc_id", 7) != 2), heavy=200)
    assert (model.n, model.v) == (n, v)
    for r in M.score(docs, *M.learn(docs.where(M.fold("doc_id", 7) != 2), heavy=200)).collect():
        w = words(dict(rows)[r.doc_id])
        want = 0.0
        for before, word in zip([None, *w], w):
            a = model.weights[M.bucket_of(np.array([one[before]]))[0]]
            c = two[before, word]
            share = min(1, M.Filter.value(M.Filter.level(np.array([c])))[0] / one[before]) if c > 1 else 0
            want += math.log10(a * share + (1 - a) * (one[word] + 1) / (n + v + 1))
        assert abs(r.score - want) <= 0.003 * abs(want)


def test_empty_table(none):
    assert M.lm_scores(none).count() == 0

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tracefold.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {k for k, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_and_empty(odd, none):
    got = L.language_id(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und"
    assert by[6].lang_pred in ("en", "de")
    assert L.language_id(none).count() == 0
    assert {r.lang_pred for r in L.identify(odd, L.learn(none)).collect()} == {"und"}


def test_ngrams_stay_in_their_row():
    (_, n_rows, row, key), = L.ngrams(pa.array(["ab, C", "", "abc"]))
    text = lambda k: bytes(k >> s & 255 for s in range(8 * ((k.bit_length() - 1) // 8) - 8, -1, -8))
    by = [sorted(text(k) for k in key[row == r].tolist()) for r in range(n_rows)]
    assert by[0] == sorted([b" a", b"ab", b"b ", b" c", b"c ", b" ab", b"ab ", b"b c", b" c ", b" ab ", b"ab c", b"b c "])
    assert by[1] == []
    assert by[2] == sorted([b" a", b"ab", b"bc", b"c ", b" ab", b"abc", b"bc ", b" abc", b"abc "])


def test_filter_holds_many_languages():
    """Every member is found, and the correction takes chance hits away."""
    rng = np.random.default_rng(0)
    members = [(k, rng.integers(0, 1 << 62, 500, dtype=np.uint64)) for k in range(20)]
    model = L.Filter([f"l{k:02}" for k in range(20)], 0, members)
    for k, keys in members:
        assert (model.masks(keys)[:, k // 8] >> (k % 8) & 1).all()
    counts, total = model.counts(1, np.zeros(4000, np.int64), rng.integers(0, 1 << 62, 4000, dtype=np.uint64))
    assert total[0] == 4000 and counts.max() < 20


def plain_ngrams(text):
    """Byte n-grams of lower-cased words, one blank between and around them, none of blanks alone."""
    clean = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", (b" " + text.lower().encode() + b" "))
    return [clean[k : k + n] for n in L.ORDERS for k in range(len(clean) - n + 1) if clean[k : k + n].strip() or False]


def test_predictions_against_brute_force(spark):
    """Exact sets in place of the filter, over whole texts: the same language wherever the counts are apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text]
    count = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            count.setdefault(r.lang, Counter()).update(plain_ngrams(r.text))
    share = {}
    for lang, c in count.items():
        total = Counter()
        for g, n in c.items():
            total[len(g)] += n
        share[lang] = {g: n / total[len(g)] for g, n in c.items() if n > 1 and n / total[len(g)] >= 1e-5}
    most = {}
    for s in share.values():
        for g, v in s.items():
            most[g] = max(most.get(g, 0), v)
    sets = {lang: {g for g, v in s.items() if v >= 0.25 * most[g]} for lang, s in share.items()}
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    same = []
    for r in rows:
        grams = plain_ngrams(r.text)
        hits = {lang: sum(g in s for g in grams) / max(1, len(grams)) for lang, s in sets.items()}
        best = sorted(hits, key=lambda k: (-hits[k], k))
        if got[r.doc_id].lang_pred != L.UNKNOWN and hits[best[0]] - hits[best[1]] > 0.02:
            same.append(got[r.doc_id].lang_pred == best[0])
            assert abs(got[r.doc_id].score - hits[best[0]]) < 0.05
    assert len(same) > 500 and np.mean(same) > 0.995


def test_ties_go_to_the_first_language():
    keys = np.random.default_rng(0).integers(0, 1 << 32, 200, dtype=np.uint64)
    (_, _, _, mine), = L.ngrams(pa.array(["the same words"]))
    model = L.Filter(["aa", "bb"], 1, [(0, np.concatenate((keys, mine))), (1, np.concatenate((keys, mine)))])
    assert model.predict(pa.array(["the same words", "the same words"]))[0] == ["aa", "aa"]

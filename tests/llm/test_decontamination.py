import hashlib
import random
import re

import pytest

from tracefold.llm.decontamination import decontaminate, digest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def brute(docs, items):
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    got |= windows[x]
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def same(docs, items, **options):
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((tuple(r) for r in digest(decontaminate(docs, items, **options)).collect()), key=str) == want
    return want


def test_sample_tables(spark, small):
    want = same(small, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert any(w[2] for w in want)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_planted(spark, odd, hot):
    """Short items, repeated items, shared windows, overlaps, few distinct words."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("Ab c d éa ZZ 9 x-y".split(" ")) for _ in range(n))
    items = [(k, text(rng.randint(0, 30))) for k in range(25)] + [(99, None), (100, ""), (1, "b"), (101, "c d"), (102, "no id")]
    docs = [(k, text(rng.randint(0, 60)) + (" " + (rng.choice(items)[1] or "") if rng.random() < 0.5 else "")) for k in range(60)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = same(spark.createDataFrame(docs, "doc_id long, text string"), items_df, hot=hot)
    assert any(w[5] for w in want)
    same(odd, items_df, hot=hot)


def test_empty_tables(spark, small, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, empty).count() == 0
    got = decontaminate(small, empty)
    assert got.count() == small.count()
    assert got.where("n_hit > 0 or contaminated").count() == 0

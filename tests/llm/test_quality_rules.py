import re
from collections import Counter

from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa

from tracefold.llm import spans
from tracefold.llm.quality_rules import MEASURES, STEPS, _repeats, measures, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measures_equal_brute_force(small, odd):
    for docs in (small, odd):
        want = {}
        rows = docs.select("doc_id", "text").collect()
        for r in rows:
            want[str(r.doc_id)] = brute(r.text)
        got = quality(docs).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[str(r.doc_id)]
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)


def repeats(*texts):
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return [x.tolist() for x in _repeats(np.frombuffer("".join(texts).encode(), np.uint8).astype(np.uint64), row, len(texts))]


def test_overlapping_repeats():
    assert repeats("aaaaaaa", "abcdeXabcdeY", "abcd", "", "abcdeXabcdeYabcdeZ") == [[7, 10, 0, 0, 15], [0, 0, 0, 0, 5]]
    assert repeats("abcde", "abcde") == [[0, 0], [0, 0]]


def test_random_texts_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab \n\t#é日"), rng.integers(0, 200), p=[0.2, 0.15, 0.3, 0.15, 0.05, 0.05, 0.05, 0.05])) for _ in range(300)]
    for _, data, offsets in spans.blocks(pa.array(texts)):
        assert [tuple(c) for c in measures(data, offsets)[:5].T.tolist()] == [brute(t) for t in texts]


def test_thresholds_follow_the_group(spark):
    """The same share of symbols is common in one source and far out in another."""
    plain = "these are some words of a plain text number {} that has no symbols whatever in it"
    rows = [(k, plain.format(k), "en", "plain") for k in range(400)]
    rows += [(1000 + k, f"# {k} % these & are * some words | of $ a text < number {k}", "en", "marked") for k in range(400)]
    rows += [(5000, "# 1 % these & are * some words | of $ a text < number 1", "en", "plain")]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(5000)
    assert all(got.values())


def test_each_measure_rejects_what_passes_the_base_rule(spark):
    """In a source of little spread every measure drops its outlier; one repeated line is no outlier."""
    word = lambda k: "abcdefghijklmnopqrstuvwxyz"[k % 26] + f"{k % 10_000:04d}"
    line = lambda k, n=10: " ".join(word(31 * k + j) for j in range(n))
    lines = lambda k: [line(k * 40 + j) for j in range(20)]
    docs = {k: "\n".join(lines(k)) for k in range(300)}
    passage, short = "one two three four five", [f"ab{j}" for j in range(7)]
    docs[1000] = "\n".join(line(k) + f" {passage}" * (k < 6) for k in range(18))  # 15 % repeated words
    docs[1001] = "\n".join(lines(1) + short + short)  # repeated lines
    docs[1002] = " ".join("abcdefghijklmnopqrstuvwxyz"[k % 26] + str(k % 10) for k in range(130))  # short words
    docs[1003] = " ".join(f"{k:012d}" for k in range(200))  # long words
    docs[1004] = " ".join(f"#{k:03d}%" if k % 3 else f"{k:05d}" for k in range(200))  # symbols
    docs[1005] = "\n".join([*lines(2), lines(2)[0]])
    got = {r.doc_id: r for r in quality(spark.createDataFrame([(k, t, "en", "a") for k, t in docs.items()], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [k for k in sorted(got) if not got[k].kept] == [1000, 1001, 1002, 1003, 1004]


def test_kept_against_brute_force(small):
    """The verdict of every row from exact quartiles; sketches of small tables are nearly exact, so few borderline rows may differ."""
    rows = small.select("doc_id", "text", "lang", "source").collect()
    (found,) = [np.concatenate([measures(d, o) for _, d, o in spans.blocks(pa.array([r.text or "" for r in rows]))], axis=1)]
    words, chars, symbols, dup, repeat, lines, more = found.astype(float)
    values = {"symbol_share": symbols / np.maximum(chars, 1), "word_length": chars / np.maximum(words, 1), "dup_line_share": np.maximum(dup - 1, 0) / np.maximum(lines, 1), "repeat_share": more / np.maximum(words, 1)}
    lang = np.array([str(r.lang) for r in rows])
    group = np.array([f"{r.lang} {r.source}" for r in rows])
    some = words > 0
    want = ~((words < 10) | (100 * repeat > 20 * words))
    for k in np.flatnonzero(some):
        chain = [some & (group == group[k]), some & (lang == lang[k]), some]
        own = next((j for j in range(2) if chain[j].sum() >= 20), 2)
        wider = 1 if own == 0 and chain[1].sum() >= 20 else 2
        middle = {c: max(1.0, np.median(x[chain[own]])) for c, x in (("n_words", words), ("word_chars", chars), ("n_lines", lines))}
        for m, (_, step, both) in MEASURES.items():
            low, high = np.quantile(values[m][chain[own]], (0.25, 0.75))
            other = np.quantile(values[m][chain[wider]], (0.25, 0.75))
            width = max(4 * max(high - low, (other[1] - other[0]) / 2 * both), STEPS * eval(step, {}, middle))
            want[k] &= values[m][k] <= high + width and (not both or values[m][k] >= low - width)
    got = {r.doc_id: r.kept for r in quality(small, least=20).collect()}
    same = np.mean([got[r.doc_id] == w for r, w in zip(rows, want)])
    assert same > 0.98


def test_small_and_broadcast_groups_agree(small):
    a = quality(small, hot=1).orderBy("doc_id").collect()
    b = quality(small, hot=10**9).orderBy("doc_id").collect()
    assert a == b


def test_empty_table(none):
    assert quality(none).count() == 0
    assert quality(none.withColumn("rows", F.lit(1))).columns[-1] == "kept"

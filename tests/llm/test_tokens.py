"""Token counts and packing against the tokenizer library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracefold.llm import packing, pretokens, spans
from tracefold.llm.queries import tokenizer
from tracefold.llm.token_counts import token_counts

BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
ALPHABET = ["a", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "23", "!", "é", "Ž", "$$", "É", "I'M", " '", "¿", "İ", "日本", "<|endoftext|>", "\x0b", "ß", "Ÿ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def test_pre_tokens_equal_the_librarys(texts):
    column = pa.array(texts, pa.large_string())
    safe = pretokens.safe_rows(column)
    assert 0 < safe.sum() < len(safe)
    some = column.filter(pa.array(safe))
    library, at = pretokens.library(BYTE), 0
    for _, data, offsets in spans.blocks(some, 500):
        a, b = pretokens.byte_spans(data, offsets)
        row = spans.rows_of(offsets, a)
        for k in range(len(offsets) - 1):
            assert [data.tobytes()[x:y] for x, y in zip(a[row == k], b[row == k])] == library.pre_tokens(some[at].as_py())
            at += 1
    assert at == len(some)


def test_document_ids_equal_the_librarys(texts):
    found = dict((row, ids.tolist()) for row, ids in packing.document_ids(pa.array(texts), WORD, 1))
    whole = Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)
    assert [found[k] for k in range(len(texts))] == [[*e.ids, 1] for e in whole]


@pytest.mark.parametrize("heavy", [50, 1 << 18])
def test_counts(spark, small, odd, heavy):
    library = Tokenizer.from_file(BYTE)
    for docs in (small, odd):
        rows = docs.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows), key=str)
        got = token_counts(docs, BYTE, heavy=heavy).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_empty_table(none):
    assert token_counts(none, BYTE).count() == 0
    assert packing.pack(none, WORD).count() == 0


@pytest.mark.parametrize("fan_in", [2, 64])
def test_packing(small, odd, fan_in):
    library = Tokenizer.from_file(WORD)
    for docs in (small.repartition(7), odd):
        got = packing.pack(docs, WORD, fan_in=fan_in).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(r.length for r in got)
        assert len(by) <= -(-total // 4096) * 1.1 + 1


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 8)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert bins.put(9) == (3, 0)  # bin 2, the fuller of the open two, was closed
    assert bins.put(4) == (0, 6)
    assert bins.left() == [(3, 9)]


def test_distinct_counts(small):
    """The counts that pick the broadcast pre-tokens."""
    from collections import Counter

    from tracefold.llm import token_counts as M

    library = pretokens.library(BYTE)
    want = Counter(t for r in small.select("text").collect() for t in library.pre_tokens(r.text or ""))
    got = Counter()
    for r in small.select("text").mapInArrow(M._distinct(BYTE), "token binary, n long").collect():
        got[bytes(r.token)] += r.n
    assert got == want

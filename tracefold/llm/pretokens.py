"""The two public tokenizers' pre-tokens, cut without a regular expression where that is safe.

A row is *safe* if it holds only printable ASCII, tab, newline, carriage return
and letters of Latin-1 and Latin Extended-A whose case mapping keeps their
length, and no string of a special token.  All other rows go to the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import spans

_BAD = np.zeros(256, bool)
_BAD[:32] = _BAD[127] = _BAD[0xC0:] = True
_BAD[[9, 10, 13, 0xC3, 0xC4, 0xC5]] = False
# lead and second byte: multiplication and division signs, letters without a plain lower case of their length
_BAD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0xC5, 0x89), (0xC5, 0xBF))

_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[spans.WHITE] = _SPACE
_ONE = np.zeros(256, bool)
_ONE[list(b"stmd")] = True


def safe_rows(column: pa.Array) -> np.ndarray:
    """Which rows of a column of strings are safe."""
    out = ~np.asarray(pc.match_substring(column, "<|"))
    for at, data, offsets in spans.blocks(column):
        bad = _BAD[data]
        if len(data) > 1:
            for lead, second in _BAD_PAIRS:
                bad[:-1] |= (data[:-1] == lead) & (data[1:] == second)
        out[at + np.unique(spans.rows_of(offsets, np.flatnonzero(bad)))] = False
    return out


def _contractions(data: np.ndarray, start: np.ndarray, row_start: np.ndarray) -> None:
    """Cut 's 't 'm 'd 're 've 'll off where an apostrophe begins a match."""
    n = len(data)
    at = np.flatnonzero(start & (data == 39))
    at = at[at + 1 < n]
    at = at[~row_start[at + 1]]
    one = at[_ONE[data[at + 1]]]
    two = at[at + 2 < n]
    two = two[~row_start[two + 2]]
    a, b = data[two + 1], data[two + 2]
    two = two[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]
    for which, length in ((one, 2), (two, 3)):
        start[which + 1] = False
        after = which + length
        start[after[after < n]] = True


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = _CLASS[data]
    row_start = np.zeros(len(data), bool)
    row_start[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = row_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, row_start, start


def byte_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the byte-level tokenizer in safe rows; they cover every byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, row_start, start = _starts(data, offsets)
    # the last white space before a word stands alone, or joins the word if it is a blank
    after = np.flatnonzero(start & ~row_start & (kind != _SPACE))
    after = after[kind[after - 1] == _SPACE]
    start[after - 1] = True
    start[after[data[after - 1] == 32]] = False
    _contractions(data, start, row_start)
    at = np.flatnonzero(start)
    return at, np.append(at[1:], n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the word-end tokenizer in safe rows that are already lower-cased."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, row_start, start = _starts(data, offsets)
    start |= kind == _DIGIT
    _contractions(data, start, row_start)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(data))
    word = kind[at] != _SPACE
    return at[word], ends[word]


def lowered(column: pa.Array) -> pa.Array:
    """Safe rows in lower case; lengths stay."""
    return pc.utf8_lower(column)


class Library:
    """A tokenizer file with what is needed to send it texts or single pre-tokens."""

    def __init__(self, path: str):
        # a worker has one core; the library's threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = set(special)
        self._cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pre_tokens(self, text: str) -> list[bytes]:
        """The pre-tokens of any text, special strings whole."""
        out = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(part.encode())
            elif part:
                out += (part[a:b].encode() for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
        return out

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    """One for each file and worker."""
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]

"""Vectorised cutting and hashing of UTF-8 text straight from Arrow buffers.

A *block* is a run of whole rows: their bytes, end to end, and the row offsets.
All functions work on blocks, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U))
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings without nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    column = strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``keep``, cut at the rows' borders."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    head = offsets[:-1][offsets[:-1] < n]
    tail = offsets[1:][offsets[1:] > 0] - 1
    first[head] = keep[head]
    last[tail] = keep[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same on every machine."""
    n = len(data)
    if len(_powers[0]) <= n:
        for k, p in enumerate((_P, _P_INV)):
            grown = np.full(2 * n + 2, p, _U)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(_U))


def white_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~WHITE[data], offsets)


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ASCII letters, digits and all that is not ASCII."""
    return runs(ALNUM[data], offsets)


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` consecutive spans of one row, and the index of the first of each."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    out = np.zeros(len(at), _U)
    for k in range(n):
        out = (out ^ h[at + k]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return mix(out), at


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in order, with how often each occurs."""
    if not len(h):
        return row[:0], h[:0], np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def lists(row: np.ndarray, n_rows: int, *values: np.ndarray) -> list[pa.Array]:
    """List arrays, one list for each row, of values that are ordered by row."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows)))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def with_text(docs, carried: list[str]):
    """The carried columns as c0, c1, ... with the text among or behind them, once; and the text's place."""
    from pyspark.sql import functions as F

    columns = carried if "text" in carried else [*carried, "text"]
    return docs.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns))), columns.index("text")


def quoted(name: str) -> str:
    """A column's name as it has to be written where it holds dots or other marks."""
    return "`" + name.replace("`", "``") + "`"


def restored(carried: list[str] | None):
    """The carried columns under their names: in a struct ``carried``, so that no name clashes; doc_id alone as it is."""
    from pyspark.sql import functions as F

    if not carried:
        return F.col("c0").alias("doc_id")
    return F.struct(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carried))).alias("carried")


class Lookup:
    """Values by 64-bit key in two sorted arrays; what a broadcast of fixed size holds."""

    def __init__(self, keys, *values):
        keys = np.asarray(keys, np.int64).view(_U)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.values = [np.asarray(v)[order] for v in values]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found) of each key."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

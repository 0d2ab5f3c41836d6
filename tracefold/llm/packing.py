"""Bounded-space online best-fit packing of token sequences.

Each task packs the pieces it meets, in order, into at most ``open_bins`` open
sequences.  The open sequences stand in lists by their free space, and one
large integer has a bit set for every free space that occurs, so the best fit
is the lowest bit at or above the piece's length.  When a new sequence is
needed and all are open, the fullest is closed.

Every task ends with a few sequences that are not full.  They are packed again
as whole items, by the same rule, in rounds that put ``fan_in`` tasks'
leftovers together, until the leftovers of one task remain; a round moves at
most ``open_bins`` items for each task.  Nothing depends on the order in which
shuffled rows arrive, so a repeated task gives the same sequences.

Edge cases: a null or empty text is its end id alone; equal rows are packed
each for itself; a document is cut only if it is longer than a sequence; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, spans
from .shared import in_arrow, stage

#: Pre-tokens a worker keeps the ids of.
HELD = 1_500_000

_BIN_BITS, _ROUND_BIT = 24, 56


class Ids:
    """Token ids by pre-token, the distinct ones sent to the tokenizer once while they are held.

    Hashes of pre-tokens in order, and for each where its ids are: 30 bytes for a pre-token or so.
    """

    def __init__(self, path: str):
        self.library = pretokens.library(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def block(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows, each row's followed by ``end``; and the rows' offsets."""
        a, b = pretokens.word_spans(data, offsets)
        u, where, inverse = np.unique(spans.hashes(data, a, b), return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > HELD:
            self.clear()
        place = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == u[inside]
        at = np.zeros(len(u), np.int32)
        at[known] = self.at[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw, w = data.tobytes(), where[new]
            ids = self.library.ids([raw[x:y].decode() for x, y in zip(a[w].tolist(), b[w].tolist())])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            at[new] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
            self.keys, self.at = np.insert(self.keys, place[new], u[new]), np.insert(self.at, place[new], at[new])
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(size)))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))))
        return self._gather(at[inverse].astype(np.int64), spans.rows_of(offsets, a), len(offsets) - 1, end)

    def _gather(self, at, row, n_rows, end):
        first = self.first[at]
        size = self.first[at + 1] - first
        per_row = np.bincount(row, size, n_rows).astype(np.int64) + 1
        bounds = np.concatenate(([0], np.cumsum(per_row)))
        out = np.full(bounds[-1], end, np.uint32)
        total = int(size.sum())
        before = np.cumsum(size) - size
        step = np.arange(total) - np.repeat(before, size)
        # a row's ids are moved on by one place for each earlier row's end
        out[np.arange(total) + np.repeat(row, size)] = self.flat[np.repeat(first, size) + step]
        return out, bounds


_ids: dict[str, Ids] = {}


def document_ids(column: pa.Array, path: str, end: int):
    """(row, its token ids with ``end`` behind them), in any order of rows."""
    column = spans.strings(column)
    safe = pretokens.safe_rows(column)
    at = np.flatnonzero(safe)
    if path not in _ids:
        _ids[path] = Ids(path)
    for first, data, offsets in spans.blocks(pretokens.lowered(column.filter(pa.array(safe)))):
        ids, bounds = _ids[path].block(data, offsets, end)
        for k in range(len(offsets) - 1):
            yield int(at[first + k]), ids[bounds[k] : bounds[k + 1]]
    for row in np.flatnonzero(~safe):
        (ids,) = _ids[path].library.ids([column[int(row)].as_py()])
        yield int(row), np.array([*ids, end], np.uint32)


class BestFit:
    """Open bins of one task, by free space; the set of occurring spaces is the bits of one integer."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece that is no longer than a bin."""
        if fits := self.bits >> length:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, at = self.size, self.made
            self.made += 1
        if space > length:
            self.by_space[space - length].append(at)
            self.bits |= 1 << (space - length)
            self.open += 1
        return at, self.size - space

    def left(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the open bins."""
        return [(b, self.size - space) for space, bins in enumerate(self.by_space) for b in bins]

    def _take(self, space: int) -> int:
        at = self.by_space[space].pop()
        self.open -= 1
        if not self.by_space[space]:
            self.bits ^= 1 << space
        return at


def _pack(path: str, end: int, size: int, open_bins: int):
    """Rows of pieces; at the task's end, with no document, one row (sequence, tokens in it) for each open bin."""

    def run(batches):
        from pyspark import TaskContext

        task, bins, kind = TaskContext.get().partitionId() << _BIN_BITS, BestFit(size, open_bins), pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            found: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for row, ids in document_ids(batch.column(1), path, end):
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    found[row].append((row, piece, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            rows, piece, start, length, crc = np.array([x for one in found for x in one], np.int64).reshape(-1, 5).T
            place = np.array([bins.put(n) for n in length.tolist()], np.int64).reshape(-1, 2)
            yield _rows(batch.column(0).take(pa.array(rows)), piece, start, length, crc, task + place[:, 0], place[:, 1])
        if left := bins.left():
            at, fill = np.array(left, np.int64).T
            none = np.full(len(at), -1)
            yield _rows(pa.nulls(len(at), kind), none, none, none, none, task + at, fill)

    return run


def _rows(doc_id, piece, *rest):
    return pa.RecordBatch.from_arrays([doc_id, pa.array(piece.astype(np.int32)), *map(pa.array, rest)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence", "offset"])


def _repack(size: int, open_bins: int):
    """Whole leftovers of one group of tasks, in a fixed order, into fewer bins."""

    def run(key, table):
        table = table.sort_by([("fill", "descending"), ("sequence", "ascending")])
        first, bins = key[0].as_py(), BestFit(size, open_bins)
        place = np.array([bins.put(n) for n in table["fill"].to_pylist()], np.int64).reshape(-1, 2)
        left = dict(bins.left())
        return pa.table({"sequence": table["sequence"], "into": first + place[:, 0], "shift": place[:, 1], "fill": pa.array([left.get(b) for b in place[:, 0].tolist()], pa.int64())})

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, open_bins: int = 64, fan_in: int = 64) -> DataFrame:
    """The pieces of all documents with the sequence and the offset that each has.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.transform(in_arrow, _pack(tokenizer, end, size, open_bins), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence long, offset long"), "pieces")
    pieces = rows.where("piece >= 0")
    left = rows.where("piece < 0").select("sequence", F.col("offset").alias("fill"))
    last = left.agg(F.max(F.shiftright("sequence", _BIN_BITS))).first()[0]
    tasks, level, moved = (last or 0) + 1, 0, None
    while True:
        level, groups = level + 1, max(1, -(-tasks // fan_in))
        # sequence ids: round, then task or group, then bin
        group = F.expr(f"{level << _ROUND_BIT}L + ((shiftright(sequence & {(1 << _ROUND_BIT) - 1}L, {_BIN_BITS}) % {groups}) * {1 << _BIN_BITS}L)")
        step = stage(left.groupBy(group.alias("group")).applyInArrow(_repack(size, open_bins), "sequence long, into long, shift long, fill long"), "leftovers")
        if moved is None:
            moved = step.select("sequence", "into", "shift")
        else:
            again = step.select(F.col("sequence").alias("into"), F.col("into").alias("then"), F.col("shift").alias("more"))
            moved = stage(moved.join(again, "into", "left").select("sequence", F.coalesce("then", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moved")
        if groups == 1:
            break
        left, tasks = step.where("fill is not null").select(F.col("into").alias("sequence"), "fill").distinct(), groups
    return pieces.join(moved, "sequence", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "sequence").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )

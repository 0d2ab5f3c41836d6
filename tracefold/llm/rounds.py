"""Networks trained on every row of a table, by tasks, in rounds.

Rows are dealt to shards by a hash, so that a shard has about the same number of
rows however many the table has.  In a round every shard makes its pass from the
common state.  The state is a matrix; each of its rows then moves by the mean of
the moves of those shards that moved it, so what only a few shards know is not
thinned by all others.  Moves are summed as whole multiples of ``UNIT``: neither
the order of the sums nor the tasks' shares of the shards change a result.  The
driver gets one matrix a round, however many shards there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, mark, release, share

UNIT = 2.0**-40


def sharded(rows: DataFrame, shards: int, *order) -> DataFrame:
    """``rows``, which have a column ``shard`` (0 to ``shards``), with each shard in a partition of its own, in this order."""
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", *order)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        yield from ((int(shard[a]), batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a)


def merged(rows: DataFrame, state: np.ndarray, learn: Callable[[np.ndarray, int, int, Iterator[pa.RecordBatch]], np.ndarray], rounds: int) -> np.ndarray:
    """The state after ``rounds`` passes over ``rows``, whose first column is the shard.

    ``learn`` gives a shard's state from the common one, the round, the shard and its rows.
    """
    names = [f"c{k}" for k in range(state.shape[1])]
    for k in range(rounds):
        since = mark()
        given = share(rows.sparkSession, state)

        def run(batches, given=given, k=k):
            common = given.value
            total, n = np.zeros(common.shape, np.int64), np.zeros(len(common), np.int64)
            for shard, own in itertools.groupby(_pieces(batches), key=lambda x: x[0]):
                move = np.rint((learn(common, k, shard, (batch for _, batch in own)).astype(np.float64) - common) / UNIT).astype(np.int64)
                total += move
                n += move.any(1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(total[at, c]) for c in range(total.shape[1]))], ["row", "n", *names])

        found = in_arrow(rows, run, ", ".join(["row int", "n long", *(f"{c} long" for c in names)])).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toArrow()
        at, n = found["row"].to_numpy(), found["n"].to_numpy()
        new = state.astype(np.float64)
        new[at] += np.stack([found[c].to_numpy() for c in names], 1) * UNIT / n[:, None]
        state = new.astype(state.dtype)
        release(since, mark())
    return state


def packed(arrays: list[np.ndarray], width: int, dtype) -> np.ndarray:
    """The arrays end to end in rows of ``width``."""
    flat = np.concatenate([np.ravel(a) for a in arrays]).astype(dtype)
    return np.append(flat, np.zeros(-len(flat) % width, dtype)).reshape(-1, width)


def unpacked(rows: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """What ``packed`` was given, in the shapes and kinds of ``like``."""
    flat, out, at = rows.ravel(), [], 0
    for a in like:
        out.append(flat[at : at + a.size].reshape(a.shape).astype(a.dtype))
        at += a.size
    return out

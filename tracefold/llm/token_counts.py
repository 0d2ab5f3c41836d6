"""Token counts without token ids.

Every distinct pre-token of the corpus is sent to the tokenizer once.  The
piece counts of the most frequent ones, at most ``heavy``, are broadcast (12-byte entries) and summed where the text is; what a document holds of all
other pre-tokens is joined to the table of counts by a hash shuffle and summed.
A pre-token outside the broadcast is rarer than those in it, so no key of
that join can be hot.

Edge cases: null text counts as empty and has 0 tokens; equal rows are counted
each for itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, spans
from .shared import in_arrow, share, stage

#: Pre-tokens whose counts are broadcast.
HEAVY = 1 << 18
#: Distinct pre-tokens a task holds before it hands on its counts.
HELD = 1 << 18


def cut(path: str, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[bytes]]]]:
    """(row, hash, the bytes of chosen spans) of all pre-tokens, block by block."""
    column = spans.strings(column)
    safe = pretokens.safe_rows(column)
    at = np.flatnonzero(safe)
    for first, data, offsets in spans.blocks(column.filter(pa.array(safe))):
        a, b = pretokens.byte_spans(data, offsets)
        raw = data.tobytes()
        yield at[first + spans.rows_of(offsets, a)], spans.hashes(data, a, b), lambda k, raw=raw, a=a, b=b: [raw[x:y] for x, y in zip(a[k].tolist(), b[k].tolist())]
    for row in np.flatnonzero(~safe):
        if tokens := pretokens.library(path).pre_tokens(column[int(row)].as_py()):
            yield np.full(len(tokens), row), *hashed(tokens)


def hashed(tokens: list[bytes]) -> tuple[np.ndarray, Callable[[np.ndarray], list[bytes]]]:
    ends = np.cumsum([len(t) for t in tokens])
    h = spans.hashes(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], ends[:-1])), ends)
    return h, lambda k: [tokens[i] for i in k]


def _distinct(path: str):
    """(token, n) of a task's pre-tokens; hashes in order tell which are held."""

    def run(batches):
        def nothing():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        keys, at, n, tokens = nothing()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(n)], ["token", "n"])

        for batch in batches:
            for _, h, of in cut(path, batch.column(0)):
                u, first, count = np.unique(h, return_index=True, return_counts=True)
                if len(keys) + len(u) > HELD and len(keys):
                    yield batch_of()
                    keys, at, n, tokens = nothing()
                place = np.searchsorted(keys, u)
                known = np.zeros(len(u), bool)
                inside = place < len(keys)
                known[inside] = keys[place[inside]] == u[inside]
                n[at[place[known]]] += count[known]
                new = np.flatnonzero(~known)
                keys, at = np.insert(keys, place[new], u[new]), np.insert(at, place[new], np.arange(len(n), len(n) + len(new)))
                n = np.concatenate((n, count[new]))
                tokens += of(first[new])
        yield batch_of()

    return run


def _pieces(path: str):
    def run(batches):
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            ids = pretokens.library(path).ids([t.decode() for t in tokens])
            h = hashed(tokens)[0] if tokens else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([len(x) for x in ids], pa.int32()), batch.column(1)], ["h", "pieces", "n"])

    return run


def _summed(path: str, heavy):
    """For each row a line with its sum over broadcast pre-tokens, and lists of all others."""

    def run(batches):
        table = heavy.value
        for batch in batches:
            text = spans.strings(batch.column(1))
            known = np.zeros(len(text), np.int64)
            rows, keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, h, _ in cut(path, text):
                at, found = table.find(h)
                if found.any():
                    known += np.bincount(row[found], table.values[0][at[found]], len(text)).astype(np.int64)
                for out, part in zip((rows, keys, counts), spans.counted(row[~found], h[~found])):
                    out.append(part)
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            rest = spans.lists(row[order], len(text), np.concatenate(keys)[order].view(np.int64), np.concatenate(counts)[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes(text)), pa.array(known), *rest], ["doc_id", "n_bytes", "known", "h", "n"])

    return run


def sizes(text: pa.Array) -> np.ndarray:
    """Bytes of each string."""
    if not len(text):
        return np.zeros(0, np.int64)
    return np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])


def most_frequent(counts: DataFrame, most: int, others: bool = False) -> DataFrame:
    """The rows of the largest ``n``, at most ``most`` of them; or all other rows.

    A table of how many rows have an ``n`` of each size gives the least size that
    is taken, so no task sorts the rows of others; sizes grow by a ninth or less.
    """
    size = F.floor(8 * F.log2("n") + 1e-9).cast("int")
    total, least = 0, None
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect():
        if total + r.rows > most:
            break
        total, least = total + r.rows, r["size"]
    if least is None:
        return counts if others else counts.where("false")
    return counts.where(size < least if others else size >= least)


def joined(each: DataFrame, values: DataFrame, carried: list[str], sums: dict) -> DataFrame:
    """Sum the values of every row's listed keys, in one pass over ``each``.

    ``each`` has the ``carried`` columns and the lists h and n.  A row's own line
    goes through the same join under a hash of its own, and its n is null, so the
    texts are cut once and nothing is written twice.  A key has one value at most,
    so should the hash be one of them, the value goes unused.
    """
    numbered = each.withColumn("row", F.monotonically_increasing_id()).withColumn("own", F.struct(*carried))
    none = F.lit(None).cast(numbered.schema["own"].dataType)
    own = F.array(F.struct(F.xxhash64("row").alias("h"), F.lit(None).cast("int").alias("n"), F.col("own").alias("own")))
    listed = F.transform(F.arrays_zip("h", "n"), lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"), none.alias("own")))
    lines = numbered.select("row", F.explode(F.concat(own, listed)).alias("x")).select("row", "x.h", "x.n", "x.own")
    met = lines.join(values, "h", "left")
    return met.groupBy("row").agg(*(F.max(f"own.{c}").alias(c) for c in carried), *(f.alias(n) for n, f in sums.items()))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    distinct = docs.select("text").transform(in_arrow, _distinct(tokenizer), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = stage(distinct.transform(in_arrow, _pieces(tokenizer), "h long, pieces int, n long"), "pieces")
    top = most_frequent(pieces, heavy).select("h", "pieces").toArrow()
    table = share(docs.sparkSession, spans.Lookup(top["h"].to_numpy(), top["pieces"].to_numpy()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.transform(in_arrow, _summed(tokenizer, table), f"doc_id {kind}, n_bytes long, known long, h array<long>, n array<int>")
    found = joined(each, pieces.select("h", "pieces"), ["doc_id", "n_bytes", "known"], {"rest": F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))})
    n = F.col("known") + F.col("rest")
    return found.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))

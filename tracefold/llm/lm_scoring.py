"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words between white space, A-Z lower-cased, and one end behind
each text.  Unigram counts are exact: the most frequent tokens, at most ``heavy``,
are broadcast, all others are joined by a hash shuffle.

All bigrams are counted over all training texts: a task hands on its distinct
pairs of tokens (ranks of frequent ones, hashes of all others) as packed arrays, one
for each *cell* of the hash space, and cells are summed by vectorised code.
Counts of two and more are quantised by factors of two and put into a blocked Bloom
filter that is broadcast, the most frequent first: a bigram of level q is put in once for each level
up to q, and a lookup probes level after level until one is missing, which gives
the largest level that may be there; false hits can only raise a count.  The
filter has at most ``most_bits`` bits and takes whole levels from the top down
while each entry has 16 bits or more; a lookup under its least level says nothing.
It is built in pieces, each from the bigrams whose blocks lie in it.

No bigram of two or more is dropped: those of levels that the filter has no room for are
joined by a shuffle, as are the hits of rare tokens, whose counts only the join knows.
P(w | h) = a(h) c(h, w) / c(h) + (1 - a(h)) (c(w) + 1) / (N + V + 1), so a text's
score is the sum of its tokens' own parts, log (1 - a) (c + 1) / (N + V + 1) (each
token is a history once), and of log (1 + a(h) c(h, w) / c(h) / ((1 - a(h)) P(w)))
for each bigram.  One lookup brings both: a task hands on the keys it cannot tell, packed by cell, and
each cell's keys meet the cell's values in one call; no key can be hot, as the frequent ones are in the broadcasts.
The weight a(h) depends on the size of c(h) and is fitted by expectation
maximisation on one training text in ``ASIDE``, told by a hash of doc_id: for the fit their
bigrams are not counted, afterwards they are.

Edge cases: null text is empty, its end alone; rows without doc_id are scored
but not learned from; with nothing to learn from every token has the same
probability; equal rows get equal scores; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .language_id import fold
from .shared import in_arrow, share, stage
from .token_counts import most_frequent

HEAVY, ASIDE = 1 << 18, 32
MOST_BITS, ENTRY_BITS, BLOCK_BITS, PIECE_BITS, PROBES = 1 << 28, 16, 512, 1 << 19, 8
#: Keys a task holds before it hands on its counts, and tokens whose bigrams make a cell.
HELD, HELD_PAIRS, CELL = 1 << 20, 1 << 20, 1 << 20
#: Texts that are handed on together.
RUN = 1 << 14

_U = np.uint64
SIGN = _U(1 << 63)
END = spans.mix(np.array([0xE0F], _U))[0]
_BUCKETS = 40
#: A level's mean count, in its least one.
MEAN = 1.3


def tokens(column: pa.Array):
    """(first row, offsets of the rows' tokens, hashes), block by block; each row's last token is its end."""
    for first, data, offsets in spans.blocks(column):
        a, b = spans.white_words(data, offsets)
        size = np.bincount(spans.rows_of(offsets, a), minlength=len(offsets) - 1)
        last = np.cumsum(size)
        yield first, np.concatenate(([0], last + np.arange(1, len(last) + 1))), np.insert(spans.hashes(spans.LOWER[data], a, b), last, END)


def _summed(keys_of):
    """(key, n) of a task's keys."""

    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            k = np.concatenate([np.zeros(0, _U), *keys])
            u, inverse = np.unique(k, return_inverse=True)
            return u, np.bincount(inverse, np.concatenate([np.zeros(0, np.int64), *counts]), len(u)).astype(np.int64)

        def batch_of(u, n):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for one in keys_of(batch.column(0)):
                u, n = np.unique(one, return_counts=True)
                keys.append(u), counts.append(n)
                held += len(u)
                if held > HELD:
                    u, n = merged()
                    keys, counts, held = [u], [n], len(u)
                    if held > HELD // 2:
                        yield batch_of(u, n)
                        keys, counts, held = [], [], 0
        yield batch_of(*merged())

    return run


def _unigrams(column):
    return (h for _, _, h in tokens(column))


def identities(known: spans.Lookup, h: np.ndarray) -> np.ndarray:
    """The rank of each known token, a negative number made of its hash for any other."""
    at, found = known.find(h)
    return np.where(found, known.values[1][at] if len(known.keys) else 0, (h | SIGN).view(np.int64))


def histories(of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What stands before each token: the end before the first."""
    before = np.roll(of, 1)
    before[offsets[:-1]] = of[offsets[1:] - 1]
    return before


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return spans.mix(h.view(_U) + spans.mix(w.view(_U)))


def cell_of(key: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key; in the order of the keys."""
    return (((key >> _U(32)) * _U(cells)) >> _U(32)).astype(np.int64)


def _reduced(h: np.ndarray, w: np.ndarray, *counts: np.ndarray):
    """(key, h, w, counts) of the distinct pairs, by key."""
    key = pair_key(h, w)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    first = order[at]
    return key[at], h[first], w[first], *(np.add.reduceat(x[order], at) if len(at) else x for x in counts)


_PACKED = "cell long, known binary, known_n binary, known_m binary, h binary, w binary, n binary, m binary"


def _pairs(shared, cells: int):
    """A task's bigrams by cell, with how often each is in texts that count and in those set aside.

    Pairs of known tokens take eight bytes, those of others sixteen.
    """

    def packed(key, h, w, n, m):
        cell = cell_of(key, cells)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)])) if len(cell) else np.zeros(1, np.int64)
        both = np.minimum(h, w) >= 0
        rank = (h << 32) | w
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k, r = both[a:b], ~both[a:b]
            rows.append([rank[a:b][k], n[a:b][k], m[a:b][k], h[a:b][r], w[a:b][r], n[a:b][r], m[a:b][r]])
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32)
        columns = [pa.array([row[c].astype(kind).tobytes() for row in rows], pa.binary()) for c, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]]), *columns], [x.split()[0] for x in _PACKED.split(", ")])

    def run(batches):
        held, size = [], 0

        def merged():
            h, w, n, m = (np.concatenate(x) for x in zip(*held)) if held else np.zeros((4, 0), np.int64)
            return _reduced(h, w, n, m)

        for batch in batches:
            aside = batch.column(1).to_numpy(zero_copy_only=False)
            for first, offsets, hashes in tokens(batch.column(0)):
                w = identities(shared.value, hashes)
                apart = np.repeat(aside[first : first + len(offsets) - 1], np.diff(offsets)).astype(np.int32)
                held.append((histories(w, offsets), w, 1 - apart, apart))
                size += len(w)
                if size > HELD_PAIRS:
                    key, *held_now = merged()
                    held, size = [tuple(held_now)], len(key)
                    if size > HELD_PAIRS // 2:
                        yield packed(key, *held_now)
                        held, size = [], 0
        yield packed(*merged())

    return run


def _cell(table: pa.Table) -> pa.Table:
    """(h, w, n, m) of a cell's bigrams that occur twice, or in a text set aside."""
    of = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table[c].to_pylist())])
    rank = of("known", np.int64)
    h, w = np.concatenate((rank >> 32, of("h", np.int64))), np.concatenate((rank & 0xFFFFFFFF, of("w", np.int64)))
    n, m = (np.concatenate((of(f"known_{c}", np.int32), of(c, np.int32))).astype(np.int64) for c in ("n", "m"))
    _, h, w, n, m = _reduced(h, w, n, m)
    some = (n + m > 1) | (m > 0)
    return pa.table({c: pa.array(x[some]) for c, x in zip("hwnm", (h, w, n, m))})


class Filter:
    """Quantised counts of keys in blocks of 512 bits."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.blocks = bits // BLOCK_BITS
        self.table = np.zeros(bits // 64, _U) if table is None else table
        self.least = 1  # of the levels that are held

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        """1 for a count of two, 2 from four, and so on; 0 for a single one."""
        return np.floor(np.log2(n) + 1e-9).astype(np.int64)

    @staticmethod
    def value(level: np.ndarray) -> np.ndarray:
        """About the mean of a level's counts, of which small ones are more."""
        return np.where(level > 0, MEAN * 2.0**level, 0)

    @staticmethod
    def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
        return (spans.mix(key) >> _U(20)).astype(np.int64) & (blocks - 1)

    def _words(self, key: np.ndarray, block: np.ndarray, level):
        x = spans.mix(key ^ spans.mix(np.asarray(level, _U) + np.zeros(1, _U)))
        for k in range(PROBES):
            if k == 6:
                x = spans.mix(x)
            bit = (x >> _U(9 * (k % 6))) & _U(511)
            yield block * 8 + (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63))

    def add(self, key: np.ndarray, block: np.ndarray, n: np.ndarray) -> None:
        level = self.level(n)
        for q in range(1, int(level.max(initial=0)) + 1):
            some = level >= q
            for word, bit in self._words(key[some], block[some], q):
                np.bitwise_or.at(self.table, word, bit)

    def counts(self, key: np.ndarray) -> np.ndarray:
        """The quantised count of each key, zero for one that is not there."""
        out, alive, q = np.zeros(len(key), np.int64), np.arange(len(key)), 0
        block = self.block_of(key, self.blocks)
        while len(alive):
            q += 1
            x = spans.mix(key[alive] ^ spans.mix(np.full(1, q, _U)))
            for k in range(PROBES):
                if k == 6:
                    x = spans.mix(x)
                bit = (x >> _U(9 * (k % 6))) & _U(511)
                hit = (self.table[block[alive] * 8 + (bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) > 0
                alive, x = alive[hit], x[hit]
            out[alive] = q
        return self.value(np.where(out >= self.least, out, 0))


def _level(n: str):
    """``Filter.level`` as a column."""
    return F.floor(F.log2(n) + 1e-9).cast("long")


def build_filter(grams: DataFrame, most_bits: int) -> Filter:
    """From (h, w, n), the most frequent first."""
    level = _level("n")
    sizes = grams.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, 10**9
    for r in sizes:
        if r.level < 1 or (total + r.n * r.level) * ENTRY_BITS > most_bits:
            break
        total, least = total + r.n * r.level, r.level
    else:
        least = 1  # all are held
    bits = min(most_bits, max(PIECE_BITS, 1 << int(total * ENTRY_BITS).bit_length()))
    blocks, per_piece = bits // BLOCK_BITS, PIECE_BITS // BLOCK_BITS
    found = Filter(bits)
    found.least = least

    def placed(batches):
        for batch in batches:
            key = pair_key(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2), pa.array((Filter.block_of(key, blocks) // per_piece).astype(np.int32))], ["key", "n", "piece"])

    def piece(key, table):
        at, one = key[0].as_py(), Filter(PIECE_BITS)
        k = table["key"].to_numpy().view(_U)
        one.add(k, Filter.block_of(k, blocks) - at * per_piece, table["n"].to_numpy())
        return pa.table({"piece": pa.array([at], pa.int32()), "bits": pa.array([one.table.tobytes()], pa.binary())})

    for r in grams.where(level >= least).transform(in_arrow, placed, "key long, n long, piece int").groupBy("piece").applyInArrow(piece, "piece int, bits binary").toLocalIterator():
        found.table[r.piece * (PIECE_BITS // 64) : (r.piece + 1) * (PIECE_BITS // 64)] = np.frombuffer(bytes(r.bits), _U)
    return found


class Model:
    """What a worker needs: frequent tokens with count and rank, the filter, sizes and weights."""

    def __init__(self, known: spans.Lookup, bigrams: Filter, n: int, v: int):
        self.known, self.bigrams, self.n, self.v = known, bigrams, n, v
        self.weights = np.zeros(_BUCKETS)
        counts, rank = known.values
        self.by_rank = np.zeros(len(rank) + 1)
        self.by_rank[rank] = counts

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each known token occurs, zero for others."""
        return np.where(of >= 0, self.by_rank[np.maximum(of, 0)], 0)

    def single(self, count):
        return (count + 1) / (self.n + self.v + 1)

    def look(self, h: np.ndarray, offsets: np.ndarray):
        """For each token: known, its own and its bigram's part of the score, the unigram's log; and which bigrams have to be joined, with keys."""
        w = identities(self.known, h)
        before, found = histories(w, offsets), w >= 0
        base = np.where(found, np.log10(self.single(self.counts(w))), 0)
        count = self.counts(before)
        a = self.weights[bucket_of(count)]
        # a rare token's own part is joined later, as is that of its being a history
        logs = base + np.where(before >= 0, np.log10(1 - a), 0)
        key = pair_key(before, w)
        n = self.bigrams.counts(key)
        both = np.minimum(w, before) >= 0
        hit = np.flatnonzero((n > 0) & both)
        share = np.minimum(1, n[hit] / count[hit])
        logs[hit] += np.log10(1 + a[hit] * share / ((1 - a[hit]) * self.single(self.counts(w[hit]))))
        # a known history of weight 0 makes nothing of its bigrams
        rest = np.flatnonzero(np.where(n > 0, ~both, self.bigrams.least > 1) & ((before < 0) | (a > 0)))
        return found, logs, base, rest, key[rest]

    def fit(self, bucket: np.ndarray, share: np.ndarray, single: np.ndarray, times: np.ndarray, rounds: int = 30) -> None:
        """Weights by bucket of the history's count, from lines that occur so many ``times``; bucket 0 is a history that was not seen."""
        self.weights[1:] = 0.3
        n = np.bincount(bucket, times, _BUCKETS)
        for _ in range(rounds):
            a = self.weights[bucket]
            part = a * share / np.maximum(a * share + (1 - a) * single, 1e-300)
            self.weights = np.where(n > 0, np.bincount(bucket, times * part, _BUCKETS) / np.maximum(1, n), self.weights)
        self.weights[n < 20] = 0
        self.weights[0] = 0
        self.weights = np.minimum(self.weights, 0.95)

    def weight(self, count):
        """Column: the weight of a history that occurs so often."""
        return F.element_at(F.array(*(F.lit(float(x)) for x in self.weights)), _bucket(count) + 1)


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(_BUCKETS - 1, np.floor(np.log2(np.maximum(1, count))).astype(np.int64) + (count > 0))


def _bucket(count):
    """``bucket_of`` as a column."""
    return F.least(F.lit(_BUCKETS - 1), (F.floor(F.log2(F.greatest(F.lit(1), count))) + (count > 0).cast("int")).cast("int"))


def _known(counts: DataFrame, heavy: int) -> spans.Lookup:
    """The most frequent tokens with count and rank."""
    top = most_frequent(counts, heavy).select("key", "n").toArrow()
    n = top["n"].to_numpy()
    order = np.lexsort((top["key"].to_numpy(), -n))
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    return spans.Lookup(top["key"].to_numpy(), n, rank)


def learn(docs: DataFrame, heavy: int = HEAVY, most_bits: int = MOST_BITS) -> tuple[DataFrame, Model]:
    """The joined part (h, c of a token, more of a bigram that is joined), and the model, from all of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = stage(docs.select("text").transform(in_arrow, _summed(_unigrams), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "unigrams")
    sizes = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    known = _known(counts, heavy)
    shared = share(spark, known)
    is_aside = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ASIDE)) == 0, F.lit(False))
    cells = max(1, (sizes.n or 0) // CELL)
    each = docs.select("text", is_aside.alias("aside")).transform(in_arrow, _pairs(shared, cells), _PACKED)
    grams = stage(each.groupBy("cell").applyInArrow(_cell, "h long, w long, n long, m long"), "bigrams")

    whole = grams.withColumn("n", F.col("n") + F.col("m")).where("n >= 2")
    held = build_filter(whole.select("h", "w", "n"), most_bits)
    model = Model(known, held, sizes.n or 0, sizes.v)
    part = F.when(F.col("n") >= 2, F.least(F.lit(1.0), MEAN * F.pow(F.lit(2.0), _level("n")) / F.col("ch"))).otherwise(0.0)
    single = (F.col("cw") + 1) / F.lit(float(model.n + model.v + 1))

    # one line for each bucket and pair of probabilities, to one digit of their logs
    lines = [_bucket(F.col("ch")).alias("bucket"), F.round(F.log(F.greatest(part, F.lit(1e-12))), 1).alias("part"), F.round(F.log(single), 1).alias("single")]
    seen = _with_counts(grams.where("m > 0"), counts, shared).groupBy(*lines).agg(F.sum("m").alias("m")).toArrow()
    if len(seen):
        bucket, share_of, one, times = (c.to_numpy() for c in seen.columns)
        model.fit(bucket, np.where(share_of > -27.5, np.exp(share_of), 0), np.exp(one), times)

    a = model.weight(F.col("ch"))
    rest = _with_counts(whole.where((_level("n") < held.least) | (F.least("h", "w") < 0)), counts, shared)
    more = rest.where(a > 0).select(F.col("key").alias("h"), F.lit(None).cast("long").alias("c"), F.log10(1 + a * part / ((1 - a) * single)).alias("more"))
    # the counts of known tokens are in the broadcast
    rare = most_frequent(counts, heavy, others=True)
    return rare.select(F.col("key").alias("h"), F.col("n").alias("c"), F.lit(None).cast("double").alias("more")).unionByName(more), model


def _with_counts(grams: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """Bigrams with their key, and the counts ch and cw of both tokens; those of rare tokens are joined."""

    def run(batches):
        known = shared.value
        by_rank = np.zeros(len(known.keys) + 1, np.int64)
        by_rank[known.values[1]] = known.values[0]
        for batch in batches:
            h, w = (batch.column(k).to_numpy() for k in (0, 1))
            c = [pa.array(by_rank[np.maximum(x, 0)], mask=x < 0) for x in (h, w)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair_key(h, w).view(np.int64)), *c], ["h", "w", "n", "m", "key", "ch", "cw"])

    of = lambda t: t.select("h", "w", "n", "m").transform(in_arrow, run, "h long, w long, n long, m long, key long, ch long, cw long")
    some_rare = F.least("h", "w") < 0
    rare = of(grams.where(some_rare))
    for side in ("h", "w"):
        # a known token's line goes anywhere, under a number that no rare token has
        rare = rare.withColumn("at", F.when(F.col(side) < 0, F.col(side)).otherwise(F.shiftrightunsigned("key", 1)))
        other = counts.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("at"), F.col("n").alias("c"))
        rare = rare.join(other, "at", "left").withColumn(f"c{side}", F.coalesce(f"c{side}", "c")).drop("at", "c")
    return of(grams.where(~some_rare)).unionByName(rare)


_ASKED = ["cell", "run", "row", "doc_id", "n_tokens", "known", "base", "logs", "rows", "keys", "n"]


def _asked(shared, cells: int):
    """A row for each text with its own part of the scores; and by cell, packed, the keys that have to be looked up, with rows and times.

    Texts and keys that are handed on together are a *run*.  Bigrams have negative times.
    """

    def run(batches):
        from pyspark import TaskContext

        name, model = TaskContext.get().partitionId() << 33, shared.value
        texts, held, size = [], [], 0

        def handed_on():
            columns = [pa.concat_arrays([x.cast(t[0].type) if x.type != t[0].type else x for x in t]) for t in zip(*texts)]
            n = len(columns[0])
            at = [pa.array(np.full(n, cell_of(spans.mix(np.array([name], _U)), cells)[0])), pa.array(np.full(n, name)), pa.array(np.arange(n, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*at, *columns, *(pa.nulls(n, pa.binary()) for _ in range(3))], _ASKED)
            if size:
                row, key, times = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(key)
                cell = cell_of(key[order], cells)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)])).tolist()
                m = len(cuts) - 1
                blobs = [pa.array([x[order][i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in (row, key, times)]
                nothing = [pa.nulls(m, t) for t in (pa.int32(), columns[0].type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]]), pa.array(np.full(m, name)), *nothing, *blobs], _ASKED)

        for batch in batches:
            before = sum(len(t[0]) for t in texts)
            counts, sums = np.zeros((2, batch.num_rows), np.int64), np.zeros((2, batch.num_rows))
            for first, offsets, h in tokens(batch.column(1)):
                n_rows = len(offsets) - 1
                row = np.repeat(np.arange(n_rows), np.diff(offsets))
                found, logs, base, rest, pair = model.look(h, offsets)
                at = slice(first, first + n_rows)
                for out, x in ((counts[0], None), (counts[1], found.astype(float)), (sums[0], base), (sums[1], logs)):
                    out[at] = np.bincount(row, x, n_rows)
                for sign, (r, key, n) in ((1, spans.counted(row[~found], h[~found])), (-1, spans.counted(row[rest], pair))):
                    if len(r):
                        held.append(((before + first + r).astype(np.int32), key, (sign * n).astype(np.int32)))
                        size += len(r)
            texts.append([batch.column(0), *map(pa.array, (*counts, *sums))])
            if size > HELD // 2 or before > RUN:
                yield from handed_on()
                name, texts, held, size = name + 1, [], [], 0
        if texts:
            yield from handed_on()

    return run


def _answered(shared):
    """Texts as they are, and for each run with keys in this cell the sums that they make, packed."""

    def run(values, asked):
        model = shared.value
        own = asked.filter(pc.is_null(asked["keys"])).drop_columns(["cell", "keys", "n"])
        asked = asked.filter(pc.is_valid(asked["keys"]))
        zero = lambda c: np.nan_to_num(values[c].to_numpy().astype(float))
        known = spans.Lookup(values["h"].to_numpy(), zero("c"), zero("more"))
        out = []
        for row, key, n in zip(*(asked[c].to_pylist() for c in ("rows", "keys", "n"))):
            n = np.frombuffer(n, np.int32).astype(float)
            at, found = known.find(np.frombuffer(key, _U))
            c, more = (np.where(found, x[at] if len(x) else 0.0, 0.0) for x in known.values)
            word = n > 0
            one = np.log10((c + 1) / (model.n + model.v + 1))
            rows, back = np.unique(np.frombuffer(row, np.int32), return_inverse=True)
            each = (np.where(word & (c > 0), n, 0), np.where(word, n * one, 0), np.where(word, n * (one + np.log10(1 - model.weights[bucket_of(c)])), -n * more))
            out.append([rows.tobytes(), *(np.bincount(back, x, len(rows)).tobytes() for x in each)])
        sums = [pa.array([x[k] for x in out], pa.binary()) for k in range(4)]
        nothing = lambda n: [pa.nulls(n, pa.binary())] * 3
        first = pa.table([*own.combine_chunks().columns, *nothing(len(own))], names=_ANSWERED)
        second = pa.table([asked["run"], *(pa.nulls(len(out), first.schema.field(x).type) for x in _ANSWERED[1:7]), *sums], schema=first.schema)
        return pa.concat_tables([first, second])

    return run


_ANSWERED = ["run", "row", "doc_id", "n_tokens", "known", "base", "logs", "rows", "rest_known", "rest", "more"]


def _scored(table: pa.Table) -> pa.Table:
    """The scores of a run's texts."""
    texts = table.filter(pc.is_valid(table["row"])).sort_by("row")
    sums = np.zeros((3, len(texts)))
    for rows, *parts in zip(*(table[c].to_pylist() for c in _ANSWERED[7:])):
        if rows is not None:
            rows = np.frombuffer(rows, np.int32)
            for total, part in zip(sums, parts):
                total[rows] += np.frombuffer(part, float)
    number = lambda c: texts[c].to_numpy()
    return pa.table({
        "doc_id": texts["doc_id"], "n_tokens": texts["n_tokens"], "n_known": pa.array(number("known") + sums[0].astype(np.int64)),
        "base_score": pa.array(number("base") + sums[1]), "score": pa.array(number("logs") + sums[2]),
    })


def score(docs: DataFrame, values: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    shared = share(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cells = max(1, model.n // (2 * CELL))
    texts = f"row int, doc_id {kind}, n_tokens long, known long, base double, logs double, rows binary"
    asked = docs.select("doc_id", "text").transform(in_arrow, _asked(shared, cells), f"cell long, run long, {texts}, keys binary, n binary")
    cell = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(cells).cast("long"), 32)
    told = values.withColumn("cell", cell).groupBy("cell").cogroup(asked.groupBy("cell"))
    each = told.applyInArrow(_answered(shared), f"run long, {texts}, rest_known binary, rest binary, more binary")
    return each.groupBy("run").applyInArrow(_scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, **options) -> DataFrame:
    """The scores of every row with held_out and train_tokens, learned from the rows that are not held out."""
    held = fold("doc_id", 7) == 2
    values, model = learn(docs.where(~held), **options)
    return score(docs, values, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
    )

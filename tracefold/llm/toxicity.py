"""Convolutional toxicity classifier on hashed word embeddings.

Words are lower-cased runs of letters and digits, hashed into ``BUCKETS``; the
``vocabulary`` buckets that most training texts have get an embedding, all
others share one.  Filters over one, two and three words are max-pooled over
the whole text and feed a logistic output; everything is trained in numpy with
Adam.  One embedding dimension starts as the bucket's log-odds among the
training labels, and some filters start on it, so few labels suffice.

Training takes every labelled row, whatever its text's length.  Their words are
staged once, dealt by a hash of doc_id to shards of about ``SHARD`` texts, and the network
is trained in ``rounds``, each a pass over all of them.  A quarter of the rows is left out of the fit:
on a half of that part the output is calibrated to a probability, and on the other
half a threshold is chosen for each language (``threshold``, used for
``flagged``); a language with fewer than ``enough`` labelled positives there
keeps the general one.  Both count every row in cells of 1/``CELLS`` of a logit.
A score comes from the text alone.

Edge cases: null text is scored as empty; labels that are null are left out and
contradicting labels of one doc_id count as toxic; texts are scored whole; with
labels of one kind only, every score is that kind's; ties and equal rows get
equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import copy
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rounds, spans
from .shared import in_arrow, share, stage
from .language_id import fold

BUCKETS = 1 << 22
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
GENERAL = 0.3

#: Texts of a shard, of a pass's sums; words that a task shuffles at once; places pooled at once.
SHARD = 8192
HELD_WORDS = 1 << 23
SLICE = 1 << 16
#: Bits of the filter of labelled ids: texts that have no label are not shuffled, but for those that meet another's bit.
FILTER = 1 << 26
#: Cells of a logit, and the largest logit told apart.
CELLS, MOST = 1024, 128


def buckets(column: pa.Array):
    """(first row, offsets of the rows' words, bucket of each word), block by block."""
    for first, data, offsets in spans.blocks(column):
        a, b = spans.alnum_words(data, offsets)
        size = np.bincount(spans.rows_of(offsets, a), minlength=len(offsets) - 1)
        yield first, np.concatenate(([0], np.cumsum(size))), (spans.hashes(spans.LOWER[data], a, b) % np.uint64(BUCKETS)).astype(np.int32)


class Classifier:
    """Embeddings, filters, output and calibration."""

    def __init__(self, ids: np.ndarray, log_odds: np.ndarray, rng: np.random.Generator, dim: int = 8, filters: int = 12):
        self.ids = ids
        self.filters = filters
        embed = rng.normal(0, 0.1, (len(ids) + 1, dim)).astype(np.float32)
        embed[0] = 0
        embed[1:, 0] = log_odds
        self.p = {"e": embed, "b": np.zeros(1, np.float32), "o": np.full(filters * len(WIDTHS), 0.05, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.1, (w, dim, filters)).astype(np.float32)
            self.p[f"w{w}"][0, 0, : filters // 3] = 0.5
            self.p[f"c{w}"] = np.zeros(filters, np.float32)
        dense = [k for k in self.p if k != "e"]
        # what Adam keeps, and the sums of squares of the embeddings' steps
        self.m, self.v = ({k: np.zeros_like(self.p[k]) for k in dense} for _ in range(2))
        self.squares = np.full(len(embed), 1e-8, np.float32)
        self.steps = np.zeros(1, np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def _dense(self) -> list[np.ndarray]:
        return [*(part[k] for part in (self.p, self.m, self.v) for k in self.m), self.steps]

    def state(self) -> np.ndarray:
        """All that training changes: an embedding with its sum of squares a row, then the rest."""
        e = np.concatenate((self.p["e"], self.squares[:, None]), axis=1)
        return np.concatenate((e, rounds.packed(self._dense(), e.shape[1], np.float32)))

    def restored(self, state: np.ndarray) -> Classifier:
        """This model in another state."""
        out, n = copy.copy(self), len(self.p["e"])
        parts = rounds.unpacked(state[n:], self._dense())
        names = list(self.m)
        out.p = {"e": state[:n, :-1].copy(), **dict(zip(names, parts))}
        out.m, out.v = dict(zip(names, parts[len(names) :])), {k: np.maximum(x, 0) for k, x in zip(names, parts[2 * len(names) :])}
        out.squares, out.steps = state[:n, -1].copy(), parts[-1]
        return out

    def index(self) -> np.ndarray:
        """Embedding row of each bucket."""
        table = np.zeros(BUCKETS, np.int32)
        table[self.ids] = np.arange(1, len(self.ids) + 1)
        return table

    @staticmethod
    def padded(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with padding behind each text, and where each text begins."""
        start = offsets[:-1] + PAD * np.arange(len(offsets) - 1)
        return np.insert(x, np.repeat(offsets[1:], PAD), 0), start

    def pooled(self, x: np.ndarray, start: np.ndarray, tables: dict | None = None, places: bool = False):
        """For each width each text's largest responses, and their first places if asked for; ``SLICE`` places at once."""
        ends = np.append(start[1:], len(x)) - PAD
        # no filter begins in the padding, from where it would reach the next text
        padding = (ends[:, None] + np.arange(PAD)).ravel()
        out = []
        x = np.append(x, np.zeros(PAD, x.dtype))
        for w in WIDTHS:
            top = np.full((len(start), self.filters), -np.inf, self.p["e"].dtype)
            place = np.zeros(top.shape, np.int64) if places else None
            for a in range(0, len(x) - PAD, SLICE):
                b = min(a + SLICE, len(x) - PAD)
                if tables:
                    y = tables[w][0][x[a:b]]
                    for k in range(1, w):
                        y = y + tables[w][k][x[a + k : b + k]]
                else:
                    y = sum(self.p["e"][x[a + k : b + k]] @ self.p[f"w{w}"][k] for k in range(w))
                y = y + self.p[f"c{w}"]
                y[padding[np.searchsorted(padding, a) : np.searchsorted(padding, b)] - a] = -np.inf
                low, high = np.searchsorted(start, a, "right") - 1, np.searchsorted(start, b)
                begin = np.maximum(start[low:high] - a, 0)
                most = np.maximum.reduceat(y, begin)
                if places:
                    row = np.repeat(np.arange(high - low), np.diff(np.append(begin, b - a)))
                    at, which = np.nonzero((y == most[row]) & (y > 0) & (most > top[low:high])[row])
                    _, first = np.unique(row[at] * self.filters + which, return_index=True)
                    place[low + row[at[first]], which[first]] = a + at[first]
                top[low:high] = np.maximum(top[low:high], most)
            out.append((top, place))
        return out

    def logits(self, x: np.ndarray, offsets: np.ndarray, tables: dict | None = None) -> np.ndarray:
        x, start = self.padded(x, offsets)
        pooled = np.concatenate([np.maximum(m, 0) for m, _ in self.pooled(x, start, tables)], axis=1)
        # summed row by row, so that equal texts get equal scores in any company
        return (pooled.astype(np.float64) * self.p["o"]).sum(1) + self.p["b"][0]

    def tables(self) -> dict:
        """Each filter's response to each embedding, so that scoring only adds."""
        return {w: [self.p["e"] @ self.p[f"w{w}"][k] for k in range(w)] for w in WIDTHS}

    def gradient(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x, start = self.padded(x, offsets)
        pooled = self.pooled(x, start, places=True)
        f = np.concatenate([np.maximum(m, 0) for m, _ in pooled], axis=1)
        d = (1 / (1 + np.exp(-(f @ self.p["o"] + self.p["b"][0]))) - y).astype(np.float32) / len(y)
        g = {"o": f.T @ d + 1e-4 * self.p["o"], "b": np.array([d.sum()], np.float32)}
        g["e"] = ([], [])
        x = np.append(x, np.zeros(PAD, x.dtype))
        for at, (w, (top, places)) in enumerate(zip(WIDTHS, pooled)):
            own = slice(at * self.filters, (at + 1) * self.filters)
            text, which = np.nonzero(top > 0)
            place = places[text, which]
            v = d[text] * self.p["o"][own][which]
            g[f"c{w}"] = np.bincount(which, v, self.filters).astype(np.float32)
            g[f"w{w}"] = np.zeros_like(self.p[f"w{w}"])
            for k in range(w):
                word = x[place + k]
                np.add.at(g[f"w{w}"][k].T, which, v[:, None] * self.p["e"][word])
                g["e"][0].append(word)
                g["e"][1].append(v[:, None] * self.p[f"w{w}"][k][:, which].T)
        return g

    def fit(self, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, batch: int = 32, rate: float = 0.01) -> None:
        """A pass of Adam over shuffled batches; embeddings are stepped where a batch has them."""
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            self.steps += 1
            step = float(self.steps[0])
            g = self.gradient(np.concatenate([texts[k] for k in some]), np.concatenate(([0], np.cumsum([len(texts[k]) for k in some]))), y[some])
            for k in self.m:
                self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
                self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
                self.p[k] -= rate * (self.m[k] / (1 - 0.9**step)) / (np.sqrt(self.v[k] / (1 - 0.999**step)) + 1e-8)
            if g["e"][0]:
                word, step_e = np.concatenate(g["e"][0]), np.concatenate(g["e"][1])
                u, inverse = np.unique(word, return_inverse=True)
                total = np.zeros((len(u), step_e.shape[1]), np.float32)
                np.add.at(total, inverse, step_e)
                self.squares[u] += (total**2).mean(1)
                total *= (rate / np.sqrt(self.squares[u]))[:, None]
                self.p["e"][u[u > 0]] -= total[u > 0]

    def calibrate(self, logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Scale and shift of the logits by weighted logistic regression."""
        for _ in range(200):
            z = np.clip(self.scale * logits + self.shift, -30, 30)
            p = 1 / (1 + np.exp(-z))
            r, s = weight * (p - y), weight * p * (1 - p) + 1e-6
            h = np.array([[(s * logits**2).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-3]])
            move = np.linalg.solve(h, [(r * logits).sum() + 1e-3 * (self.scale - 1), r.sum()])
            self.scale, self.shift = max(0.05, self.scale - 0.5 * move[0]), self.shift - 0.5 * move[1]

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


class Constant:
    """What is learned from labels of one kind, or none."""

    ids = np.zeros(0, np.int64)
    thresholds: dict[str, float] = {}

    def __init__(self, value: float):
        self.value = value


def _bits(labels: DataFrame) -> np.ndarray:
    """A filter of ``FILTER`` bits of the labels' hashes ``h``, in words of 64."""
    place = F.pmod("h", F.lit(FILTER))
    words = labels.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _words(shared):
    """Rows (text, h, ...) that may be labelled, with the text's buckets end to end in a binary column instead."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            place = (batch.column(1).to_numpy() % FILTER).astype(np.uint64)
            batch = batch.filter(pa.array((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1))
            held = []
            for _, o, b in buckets(batch.column(0)):
                held += [b[x:y].tobytes() for x, y in zip(o, o[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), *batch.columns[1:]], ["words", *batch.schema.names[1:]])

    return run


def _labelled(batches):
    """Documents with their label: rows (words, h, id, toxic, ...) are in order of id, a label (with ``toxic``, without words) before its documents."""
    last_id, last = None, 0
    for batch in batches:
        ids, toxic = batch.column(2).cast(pa.large_string()), batch.column(3)
        label = np.asarray(toxic.is_valid())
        at = np.maximum.accumulate(np.where(label, np.arange(1, len(label) + 1), 0))
        # place 0 is the last label of the batches before
        known = pa.concat_arrays([pa.array([last_id], pa.large_string()), ids]).take(pa.array(at))
        value = np.append(last, np.asarray(toxic.fill_null(0)))[at].astype(np.int32)
        keep = np.asarray(pc.fill_null(pc.equal(known, ids), False)) & ~label
        if len(at):
            last_id, last = known[-1].as_py(), value[-1]
        columns = [*batch.columns[:3], pa.array(value), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))


def _held(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w.as_py(), np.int32) for w in column]


def _frequencies(batches):
    """(bucket, texts that have it, toxic ones of them) of a task's texts."""
    n = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for words, toxic in zip(_held(batch.column(0)), batch.column(1).to_numpy()):
            seen = np.unique(words)
            n[0, seen] += 1
            n[1, seen] += toxic
    have = np.flatnonzero(n[0])
    for at in range(0, len(have), 1 << 16):
        some = have[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0, some]), pa.array(n[1, some])], ["bucket", "n", "toxic"])


def _pass(shared, seed: int):
    """A shard's pass over its texts; texts are shuffled as many as ``HELD_WORDS`` at once."""

    def learn(state, k, shard, batches):
        model = shared.value.restored(state)
        index, rng = model.index(), np.random.default_rng((seed, k, shard))
        texts: list[np.ndarray] = []
        y: list[int] = []
        size = 0
        for batch in batches:
            for words, toxic in zip(_held(batch.column(1)), batch.column(2).to_pylist()):
                if texts and size + len(words) > HELD_WORDS:
                    model.fit(texts, np.array(y, np.float64), rng)
                    texts, y, size = [], [], 0
                texts.append(index[words])
                y.append(toxic)
                size += len(words)
        if texts:
            model.fit(texts, np.array(y, np.float64), rng)
        return model.state()

    return learn


def _cells(rows: DataFrame, model: Classifier) -> DataFrame:
    """How many of the rows (words, lang, toxic, second) have a logit in each cell."""
    shared = share(rows.sparkSession, model)

    def run(batches):
        model = shared.value
        index, tables = model.index(), model.tables()
        for batch in batches:
            words = _held(batch.column(0))
            logits = np.concatenate([np.zeros(0), *(model.logits(index[w], np.array([0, len(w)]), tables) for w in words)])
            cell = np.rint(np.clip(logits, -MOST, MOST) * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cell)], ["lang", "toxic", "second", "cell"])

    found = rows.select("words", "lang", "toxic", "second").transform(in_arrow, run, "lang string, toxic int, second boolean, cell int")
    return stage(found.groupBy("lang", "toxic", "second", "cell").agg(F.count("*").alias("n")), "toxicity_cells")


def _halves(cells: DataFrame) -> list[DataFrame] | None:
    """The cells to calibrate on and those to choose thresholds on: of different texts where both halves have both kinds; None without both kinds."""
    have = {(r.second, r.toxic) for r in cells.select("second", "toxic").distinct().collect()}
    if len({toxic for _, toxic in have}) < 2:
        return None
    return [cells.where(F.col("second") == half) if {(half, 0), (half, 1)} <= have else cells for half in (False, True)]


def _thresholds(cells: DataFrame, model: Classifier, enough: int) -> dict[str, float]:
    """For each language the cut with the best F1, midway between the scores of two cells."""
    sums = cells.where("lang is not null").groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("hit"))
    down = Window.partitionBy("lang").orderBy(F.desc("cell"))
    positives = F.sum("hit").over(Window.partitionBy("lang"))
    cuts = sums.select("lang", "cell", F.lead("cell").over(down).alias("next"), positives.alias("positives"), (2 * F.sum("hit").over(down) / (F.sum("n").over(down) + positives)).alias("f1"))
    best = cuts.where(F.col("positives") >= enough).groupBy("lang").agg(F.max(F.struct("f1", "cell", "next")).alias("x")).select("lang", "x.*").collect()
    score = lambda cell: float(model.score(np.array(cell / CELLS)))
    return {r.lang: score(r.cell) if r.next is None else (score(r.cell) + score(r.next)) / 2 for r in best}


def train(docs: DataFrame, labels: DataFrame, vocabulary: int = 50_000, enough: int = 20, seed: int = 11, passes: int = 8) -> Classifier | Constant:
    """Learn from all rows of ``labels`` (doc_id, toxic) that ``docs`` has."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shards = max(1, -(-3 * sum(counts.values()) // (4 * SHARD)))
    key = [F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("doc_id").cast("string").alias("id")]
    given = labels.select(F.lit(None).cast("binary").alias("words"), *key, "toxic", F.lit(None).cast("string").alias("lang"))
    texts = docs.where("doc_id is not null").select("text", *key, F.lit(None).cast("int").alias("toxic"), F.col("lang").cast("string").alias("lang"))
    texts = texts.transform(in_arrow, _words(share(docs.sparkSession, _bits(given))), "words binary, h long, id string, toxic int, lang string")
    part = lambda salt, n: F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(n))
    both = given.unionByName(texts).withColumn("shard", part(3, shards).cast("int"))
    order = ["h", "id", F.col("toxic").asc_nulls_last(), "words"]
    # words without a label and labels without a document end here
    rows = rounds.sharded(both, shards, *order).transform(in_arrow, _labelled, "words binary, h long, id string, toxic int, lang string, shard int")
    staged = stage(rows.select("shard", "words", "toxic", "lang", (part(2, 4) == 0).alias("aside"), (part(4, 2) == 0).alias("second")), "toxicity_words")
    fit = staged.where("not aside")
    of = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        kinds = list(counts) if len(counts) == 1 else list(of)
        return Constant(float(kinds[0]) if kinds else 0.0)
    found = fit.select("words", "toxic").transform(in_arrow, _frequencies, "bucket int, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    top = found.where("n > 1").orderBy(F.desc("n"), "bucket").limit(vocabulary).toArrow()
    n, toxic = top["n"].to_numpy(), top["toxic"].to_numpy()
    odds = np.log((toxic + 1) / (of[1] + 2)) - np.log((n - toxic + 1) / (of[0] + 2))
    model = Classifier(top["bucket"].to_numpy().astype(np.int64), odds, np.random.default_rng(seed))
    model = model.restored(rounds.merged(fit.select("shard", "words", "toxic"), model.state(), _pass(share(docs.sparkSession, model), seed), passes))
    # the texts that were fitted set the calibration only where no others have both kinds
    halves = _halves(_cells(staged.where("aside"), model)) or _halves(_cells(fit.withColumn("second", F.lit(False)), model))
    sums = halves[0].groupBy("toxic", "cell").agg(F.sum("n").alias("n")).orderBy("toxic", "cell").toArrow()
    model.calibrate(sums["cell"].to_numpy() / CELLS, sums["toxic"].to_numpy().astype(np.float64), sums["n"].to_numpy().astype(np.float64))
    model.thresholds = _thresholds(halves[1], model, enough)
    return model


#: The tables of the model that a worker scores with, under the name of that scoring.
_tables: dict[str, tuple] = {}


def _scored(texts: DataFrame, model: Classifier | Constant, calibrated: bool, carried: str) -> DataFrame:
    """The carried columns, which follow the text, and the score: a probability, or before the calibration a logit."""
    shared, name = share(texts.sparkSession, model), uuid.uuid4().hex

    def run(batches):
        model = shared.value
        if not isinstance(model, Constant) and name not in _tables:
            _tables.clear()
            _tables[name] = model.index(), model.tables()
        for batch in batches:
            out = np.full(batch.num_rows, getattr(model, "value", 0.0))
            if not isinstance(model, Constant):
                index, tables = _tables[name]
                for first, offsets, b in buckets(batch.column(0)):
                    logits = model.logits(index[b], offsets, tables)
                    out[first : first + len(offsets) - 1] = model.score(logits) if calibrated else logits
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*batch.schema.names[1:], "score"])

    return texts.transform(in_arrow, run, f"{carried}, score double")


def score(docs: DataFrame, model: Classifier | Constant) -> DataFrame:
    """doc_id, score, threshold of the row's language, and flagged (score >= threshold)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _scored(docs.select("text", "doc_id", F.col("lang").cast("string").alias("lang")), model, calibrated=True, carried=f"doc_id {kind}, lang string")
    limit = F.lit(GENERAL)
    if model.thresholds:
        own = F.create_map(*(F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair))
        limit = F.coalesce(F.try_element_at(own, F.col("lang")), limit)
    return found.select("doc_id", "score", limit.alias("threshold"), (F.col("score") >= limit).alias("flagged"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged of every row; held-out labels are not learned."""
    learned = fold("doc_id", 4) != 2
    model = train(docs.where(learned), labels.where(learned))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GENERAL).cast("int").alias("predicted"), "threshold", "flagged")

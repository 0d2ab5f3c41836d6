"""Secret scans: three fixed rules, and a character convolutional network for the rest.

The rules (``RULES``) give the base spans.  Every other *candidate*, a run of at
least ``SHORTEST`` credential characters with a digit or ``CHANGES`` changes from
lower to upper case in it, is scored with its surrounding context by a small
convolutional network written in numpy; spans that reach the threshold are
added, base spans always stay.

The network learns from labelled findings.  Candidates of the corpus are findings
where a rule or a well-known credential form (``FORMS``) says so, and are not
where their form alone shows it (``plain``: numbers, dates, words joined by
marks); all others have no label and are not learned from, so credentials that
nobody has labelled are never taught as harmless.  Every distinct labelled
candidate is learned from: they are dealt by hash to shards of about ``SHARD``, each with
``made`` generated findings of known forms and look-alikes, and the network is trained in
``rounds``, each a pass over all of them.  A third of the findings is held out of the fit; a half of it
calibrates the output to a probability, on the other half the
threshold is set: the largest probability that keeps ``recall`` of the corpus's positive
findings and of the generated ones, so that neither make up for the others, whatever the negative ones score.
What is kept of ``n`` held-out findings is more than ``recall`` by ``SURE`` standard errors of a share
of ``n``, so that few of them do not leave recall on unseen ones to chance; with many that is ``recall`` itself.  Both count every finding, in cells of 1/``CELLS`` of a logit.

Edge cases: null or empty texts have no spans; texts are scanned whole, however
long; a candidate longer than the network's width is scored in overlapping
pieces and takes the largest score; equal rows get equal rows; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import copy
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds, spans
from .shared import in_arrow, share, stage

# The rules' kinds, patterns, and the least length of what counts in a match.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
ADDED = "model"
_MAY_MATCH = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}"

#: Credentials known by their form alone.
FORMS = re.compile(
    rb"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22}|(?:[sr]k_live_|[sp]k-)[A-Za-z0-9_-]{20}"
    rb"|xox[abeoprs]-[0-9]{9,}-|eyJ[A-Za-z0-9_-]{8,}\.eyJ|AIza[A-Za-z0-9_-]{35}|A[KS]IA[A-Z0-9]{16}"
    rb"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})(?![A-Za-z0-9]))"
)

#: What is no credential by its form: numbers and dates, and words (of letters in one case or capitalised) and short numbers joined by marks.
_NUMBERS = re.compile(rb"[0-9./_=+:-]+")
_WORDS = re.compile(rb"(?:[./_=+-]+|[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|(?<![0-9])[0-9]{1,4}(?![0-9]))+")
_DIGITS = re.compile(rb"[0-9]+")
MOST_NUMBERS = 3

#: Findings of a shard, of a pass's sums; cells of a logit, and the largest logit told apart.
SHARD = 8000
CELLS, MOST = 1024, 128
#: Standard errors of a one-sided 95 % bound.
SURE = 1.645

SHORTEST, CHANGES = 16, 4
BEFORE, AFTER, INSIDE = 24, 8, 64
WIDTH = BEFORE + INSIDE + AFTER

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOW, _HIGH = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
# symbol of a byte: 0 is padding, then printable ASCII, one for white space and one for all else
_SYMBOL = np.full(256, 96, np.uint8)
_SYMBOL[32:127] = np.arange(1, 96)
_SYMBOL[[9, 10, 13]] = 1
_INSIDE = 97  # added to the symbols of the candidate itself
SYMBOLS = 2 * _INSIDE


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the rules' spans, leftmost and non-overlapping for each kind."""
    found = []
    for rank, (_, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of runs that may be credentials."""
    a, b = spans.runs(_RUN[data], offsets)
    long = b - a >= SHORTEST
    a, b = a[long], b[long]
    rises = np.zeros(len(data), np.int64)
    rises[1:] = _LOW[data[:-1]] & _HIGH[data[1:]]
    digits, rises = (np.concatenate(([0], np.cumsum(x))) for x in (_DIGIT[data], rises))
    some = (digits[b] > digits[a]) | (rises[b] - rises[np.minimum(a + 1, b)] >= CHANGES)
    return a[some], b[some]


def windows(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols around each candidate, and which candidate each line belongs to; long ones have several lines."""
    row = spans.rows_of(offsets, a)
    low, high = offsets[row], offsets[row + 1]
    step = INSIDE // 2
    n = np.maximum(1, -(-(b - a - INSIDE) // step) + 1)
    which = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = a[which] + k * step
    at = start[:, None] + np.arange(-BEFORE, INSIDE + AFTER)
    # what follows a short candidate moves up to it, so positions after its end are its context
    ok = (at >= low[which, None]) & (at < high[which, None]) & (at < np.minimum(b[which], start + INSIDE)[:, None] + AFTER)
    symbols = np.where(ok, _SYMBOL[data[np.clip(at, 0, max(0, len(data) - 1))]], 0).astype(np.int64) if len(data) else np.zeros((0, WIDTH), np.int64)
    inside = (at >= a[which, None]) & (at < b[which, None]) & ok
    return symbols + inside * _INSIDE, which


class Network:
    """Symbols embedded, filters of several widths, max pooling over places, one logistic output."""

    def __init__(self, rng: np.random.Generator, dim: int = 12, filters: int = 24, widths: tuple[int, ...] = (1, 3, 5)):
        self.widths = widths
        self.p = {"e": rng.normal(0, 0.3, (SYMBOLS, dim)), "b": np.zeros(1), "o": rng.normal(0, 0.2, 2 * filters * len(widths))}
        for w in widths:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters))
            self.p[f"c{w}"] = np.zeros(filters)
        # what Adam keeps
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.steps = np.zeros(1)

    def _parts(self) -> list[np.ndarray]:
        return [*(part[k] for part in (self.p, self.m, self.v) for k in self.p), self.steps]

    def state(self) -> np.ndarray:
        """All that training changes."""
        return rounds.packed(self._parts(), 8, np.float64)

    def restored(self, state: np.ndarray) -> Network:
        """This network in another state."""
        out, names, parts = copy.copy(self), list(self.p), rounds.unpacked(state, self._parts())
        out.p, out.m = (dict(zip(names, parts[k * len(names) :])) for k in range(2))
        out.v, out.steps = {k: np.maximum(x, 0) for k, x in zip(names, parts[2 * len(names) :])}, parts[-1]
        return out

    def _pool(self, x: np.ndarray):
        """For each width the largest and the mean response, with the largest's place."""
        out = []
        for w in self.widths:
            table = np.einsum("sd,kdf->ksf", self.p["e"], self.p[f"w{w}"])
            y = sum(table[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w)) + self.p[f"c{w}"]
            y = np.maximum(y, 0)
            out.append((y, y.argmax(1)))
        return out

    def _features(self, pooled) -> np.ndarray:
        return np.concatenate([part for y, _ in pooled for part in (y.max(1), y.mean(1))], axis=1)

    def logits(self, x: np.ndarray, size: int = 256) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._features(self._pool(x[k : k + size])) @ self.p["o"] + self.p["b"] for k in range(0, len(x), size))])

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.004) -> None:
        """A pass of Adam over shuffled batches."""
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            self.steps += 1
            step = float(self.steps[0])
            for key, g in self._gradient(x[order[at : at + batch]], y[order[at : at + batch]]).items():
                self.m[key] = 0.9 * self.m[key] + 0.1 * g
                self.v[key] = 0.999 * self.v[key] + 0.001 * g * g
                self.p[key] = self.p[key] - rate * (self.m[key] / (1 - 0.9**step)) / (np.sqrt(self.v[key] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled = self._pool(x)
        f = self._features(pooled)
        d = (1 / (1 + np.exp(-(f @ self.p["o"] + self.p["b"]))) - y) / len(x)
        g = {"o": f.T @ d + 1e-4 * self.p["o"], "b": np.array([d.sum()]), "e": np.zeros_like(self.p["e"])}
        at = 0
        for w, (act, top) in zip(self.widths, pooled):
            n, places, filters = act.shape
            grad = np.broadcast_to((d[:, None] * self.p["o"][at + filters : at + 2 * filters] / places)[:, None], act.shape).copy()
            np.add.at(grad, (np.arange(n)[:, None], top, np.arange(filters)), d[:, None] * self.p["o"][at : at + filters])
            grad *= act > 0
            at += 2 * filters
            g[f"c{w}"] = grad.sum((0, 1))
            g[f"w{w}"] = np.zeros_like(self.p[f"w{w}"])
            for k in range(w):
                seen = x[:, k : k + places]
                by_symbol = np.zeros((SYMBOLS, filters))
                np.add.at(by_symbol, seen.ravel(), grad.reshape(-1, filters))
                g[f"w{w}"][k] = self.p["e"].T @ by_symbol
                g["e"] += by_symbol @ self.p[f"w{w}"][k].T
        return g


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"
_ALL = _LETTERS + _LETTERS.upper() + "0123456789"


def generated(rng: np.random.Generator, n: int) -> list[tuple[str, str, str, int]]:
    """``n`` labelled findings as (before, candidate, after, label): credential forms and look-alikes."""
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    word = lambda: some(_LETTERS, int(rng.integers(2, 10)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda a, b: int(rng.integers(a, b))
    secret = (
        lambda: pick("ghp_", "gho_", "ghs_") + some(_ALL, 36),
        lambda: pick("sk-", "sk_live_", "rk_live_", "pk-") + some(_ALL, num(24, 48)),
        lambda: pick("xoxb-", "xoxp-") + f"{num(10**9, 10**11)}-{some(_ALL, 24)}",
        lambda: "eyJ" + some(_ALL, num(20, 40)) + ".eyJ" + some(_ALL, num(30, 60)) + "." + some(_ALL + "_-", 43),
        lambda: "AIza" + some(_ALL + "_-", 35),
        lambda: some(_ALL + "+/", num(32, 88)) + pick("", "=", "=="),
        lambda: some(_ALL, num(20, 64)),
        lambda: some(_HEX.upper(), pick(32, 40, 64)),
        lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
    )
    plain = (
        lambda: some("0123456789", num(16, 24)),
        lambda: "-".join(some("0123456789", 4) for _ in range(4)),
        lambda: f"{word()}{num(0, 99)}.{word()}.{pick('com', 'org', 'net')}",
        lambda: f"{word()}.{num(1, 99)}{pick('.mail', '')}.example.com",
        lambda: f"{word()}_{word()}_{word()}_{num(0, 9999)}",
        lambda: f"/{word()}/{word()}/{num(1990, 2030)}/{word()}.html",
        lambda: f"{num(1990, 2030)}-{num(10, 13)}-{num(10, 29)}T{num(10, 24)}.{num(10, 60)}",
        lambda: f"{word()}-{word()}-{num(0, 30)}.{num(0, 30)}.{num(0, 30)}",
        lambda: word() + word() + word() + str(num(0, 100)),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(num(0, 1000)),
        lambda: f"{num(1, 256)}.{num(1, 256)}.{num(1, 256)}.{num(1, 256)}-{num(10, 99)}.{num(1, 256)}",
        lambda: "=" * num(8, 30) + str(num(1, 9)) + "-" * num(8, 30),
        lambda: "-".join(some(_HEX, k) for k in (8, 4, 4, 4, 12)),
    )
    out = []
    for k in range(n):
        label = k % 2
        text = pick(*(secret if label else plain))()
        if len(text) < SHORTEST:
            text += some("0123456789", SHORTEST - len(text)) if not label else some(_ALL, SHORTEST)
        lead = pick(f"{word()} {word()} ", f"{word()}: ", f"{word()}.\n", f"{word()} (", "", f'"{word()}": "', f"{word()}://", f"export {word().upper()}=", f"bearer {word()} ") if label else pick(f"{word()} {word()} ", f"{word()}: ", f"{word()}.\n", "https://", "", f"{word()}@", f"{word()} (")
        out.append((lead, text, pick(" ", "\n", '"', ")", ". ", "") + word(), label))
    return out


def _label_windows(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    text = [(lead + text + tail).encode() for lead, text, tail, _ in findings]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in text])))
    data = np.frombuffer(b"".join(text), np.uint8)
    a = offsets[:-1] + [len(f[0].encode()) for f in findings]
    b = a + [len(f[1].encode()) for f in findings]
    x, which = windows(data, offsets, a, b)
    _, one = np.unique(which, return_index=True)
    return x[one], np.array([f[3] for f in findings])


def _findings(batches):
    """(hash, window, label) of the labelled candidates; a repeated finding has one hash."""
    for batch in batches:
        for _, data, offsets in spans.blocks(batch.column(0)):
            a, b = candidates(data, offsets)
            if not len(a):
                continue
            found = _covered(data, offsets, a, b) | _formed(data, a, b)
            known = found | np.array([plain(data[x:y].tobytes()) for x, y in zip(a, b)], bool)
            x, which = windows(data, offsets, a, b)
            one = np.unique(which, return_index=True)[1][known]
            yield pa.RecordBatch.from_arrays([pa.array(spans.hashes(data, a, b)[known].view(np.int64)), pa.array([w.tobytes() for w in x[one].astype(np.uint8)], pa.binary()), pa.array(found[known].astype(np.int32))], ["h", "window", "label"])


def _made(made: int, seed: int):
    """The generated findings of each shard."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                x, y = _label_windows(generated(np.random.default_rng((seed, shard)), made))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), shard, np.int32)), pa.array(shard * made + np.arange(len(y))), pa.array([w.tobytes() for w in x.astype(np.uint8)], pa.binary()), pa.array(y.astype(np.int32))], ["shard", "h", "window", "label"])

    return run


def _seen(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(w.as_py(), np.uint8) for w in column], np.int64).reshape(-1, WIDTH)


def _pass(shared, seed: int):
    """A shard's pass over its findings."""

    def learn(state, k, shard, batches):
        network, got = shared.value.restored(state), list(batches)
        x, y = np.concatenate([_seen(b.column(1)) for b in got]), np.concatenate([b.column(2).to_numpy() for b in got])
        network.fit(x, y.astype(float), np.random.default_rng((seed, k, shard)))
        return network.state()

    return learn


def plain(candidate: bytes) -> bool:
    """Whether the form alone shows that it is no credential."""
    if _NUMBERS.fullmatch(candidate):
        return True
    letters, vowels = (sum(c in some for c in candidate.lower()) for some in (b"abcdefghijklmnopqrstuvwxyz", b"aeiouy"))
    return _WORDS.fullmatch(candidate) is not None and len(_DIGITS.findall(candidate)) <= MOST_NUMBERS and 4 * vowels >= letters


def _covered(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which candidates meet a base span."""
    out = np.zeros(len(a), bool)
    row = spans.rows_of(offsets, a)
    raws = {int(r): data[offsets[r] : offsets[r + 1]].tobytes() for r in np.unique(row)}
    may = np.asarray(pc.match_substring_regex(pa.array([raw.decode() for raw in raws.values()], pa.large_string()), _MAY_MATCH))
    for r, raw in (one for one, some in zip(raws.items(), may) if some):
        base = base_spans(raw.decode())
        if base:
            to_byte = _byte_places(raw)
            begin, end = (to_byte[[s[at] for s in base]] for at in (0, 2))
            # a candidate meets a span if the furthest end of those that begin before its end is behind its begin
            furthest = np.append(-1, np.maximum.accumulate(end))
            own = slice(*np.searchsorted(row, [r, r + 1]))
            out[own] = furthest[np.searchsorted(begin, b[own] - offsets[r])] > a[own] - offsets[r]
    return out


def _formed(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which candidates hold a credential of a known form."""
    return np.array([FORMS.search(data[x:y].tobytes()) is not None for x, y in zip(a, b)], bool)


def _byte_places(raw: bytes) -> np.ndarray:
    """The byte at which each code point starts, and the end."""
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


class Scanner:
    """A trained network with its calibration, its threshold, and the share of held-out positive findings that reach it."""

    def __init__(self, network: Network, scale: float, shift: float, threshold: float, recall: float):
        self.network, self.scale, self.shift, self.threshold, self.recall = network, scale, shift, threshold, recall

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability that each window holds a credential."""
        return self.chance(self.network.logits(x))

    def chance(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Base and added spans of each text as (start, rank of the kind, end), in code points."""
        column = spans.strings(column)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for k in np.flatnonzero(np.asarray(pc.match_substring_regex(column, _MAY_MATCH))):
            out[k] = base_spans(column[int(k)].as_py())
        for first, data, offsets in spans.blocks(column):
            a, b = candidates(data, offsets)
            if not len(a):
                continue
            x, which = windows(data, offsets, a, b)
            score = np.full(len(a), -np.inf)
            np.maximum.at(score, which, self.probability(x))
            hot = np.flatnonzero(score >= self.threshold)
            row = spans.rows_of(offsets, a)
            for r in np.unique(row[hot]):
                points = _byte_places(data[offsets[r] : offsets[r + 1]].tobytes())
                base = out[first + r]
                taken = list(base)
                for k in hot[row[hot] == r]:
                    s, e = (int(np.searchsorted(points, v - offsets[r])) for v in (a[k], b[k]))
                    if not any(s < to and at < e for at, _, to in taken):
                        base.append((s, len(RULES), e))
                base.sort()
        return out


def calibrated(logits: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Scale and shift of the logits, each seen ``n`` times, by logistic regression, with labels drawn in a little so that none is certain."""
    scale, shift = 1.0, 0.0
    positive, negative = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -40, 40)))
        r, s = n * (p - target), n * (p * (1 - p) + 1e-9)
        h = np.array([[(s * logits**2).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-3]])
        move = np.linalg.solve(h, [(r * logits).sum(), r.sum()])
        scale, shift = max(0.01, scale - 0.5 * float(move[0])), shift - 0.5 * float(move[1])
    return scale, shift


def _cells(rows: DataFrame, network: Network) -> pa.Table:
    """How many of the rows (window, label, second, made) have a logit in each cell, named by its least logit."""
    shared = share(rows.sparkSession, network)

    def run(batches):
        for batch in batches:
            cell = np.floor(np.clip(shared.value.logits(_seen(batch.column(0))), -MOST, MOST) * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cell)], ["label", "second", "made", "cell"])

    found = rows.select("window", "label", "second", "made").transform(in_arrow, run, "label int, second boolean, made boolean, cell int")
    return found.groupBy("label", "second", "made", "cell").agg(F.count("*").alias("n")).orderBy("label", "second", "made", "cell").toArrow()


def train(docs: DataFrame, made: int = 4000, recall: float = 0.95, seed: int = 7, passes: int = 6) -> Scanner:
    """Fit the network, calibrate it and set its threshold from all labelled findings."""
    spark = docs.sparkSession
    # of a repeated finding the largest line is taken, so that every run learns the same
    found = docs.select("text").transform(in_arrow, _findings, "h long, window binary, label int")
    found = stage(found.groupBy("h").agg(F.max(F.struct("label", "window")).alias("x")).select("h", "x.*"), "secret_findings")
    shards = max(1, -(-found.count() // SHARD))
    part = lambda salt, n: F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(n))
    own = spark.range(shards).transform(in_arrow, _made(made, seed), "shard int, h long, window binary, label int")
    both = found.withColumns({"shard": part(1, shards).cast("int"), "made": F.lit(False)}).unionByName(own.withColumn("made", F.lit(True)))
    both = both.withColumns({"held": part(2, 3) == 0, "second": part(3, 2) == 0})
    staged = stage(rounds.sharded(both, shards, "h", "window", "label"), "secret_shards")
    network = Network(np.random.default_rng(seed))
    fit = staged.where("not held").select("shard", "window", "label")
    network = network.restored(rounds.merged(fit, network.state(), _pass(share(spark, network), seed), passes))
    scanner = Scanner(network, 1.0, 0.0, 0.5, 1.0)
    cells = _cells(staged.where("held"), network)
    y, second, n = cells["label"].to_numpy(), cells["second"].to_numpy(), cells["n"].to_numpy()
    cell = cells["cell"].to_numpy() / CELLS
    if len(set(y[~second])) == 2:
        scanner.scale, scanner.shift = calibrated(cell[~second], y[~second], n[~second])
    kept = []
    for made_too in (False, True):
        chosen = second & (y == 1) & (cells["made"].to_numpy() == made_too)
        if chosen.any():
            # cells are in order: the last one from which as many positive findings follow as recall asks for
            following = np.cumsum(n[chosen][::-1])[::-1]
            least = min(1.0, recall + SURE * np.sqrt(recall * (1 - recall) / following[0]))
            k = int(np.flatnonzero(following >= least * following[0])[-1])
            kept.append((float(scanner.chance(cell[chosen][k])), float(following[k] / following[0])))
    if kept:
        scanner.threshold, scanner.recall = (min(x) for x in zip(*kept))
    return scanner


def scan(docs: DataFrame, scanner: Scanner, carried: list[str] | None = None) -> DataFrame:
    """doc_id, or the ``carried`` columns in a struct of that name, with ``spans``: structs of kind, start and end, by start."""
    whole, carried = spans.restored(carried), carried or ["doc_id"]
    shared = share(docs.sparkSession, scanner)
    kinds = [*(k for k, *_ in RULES), ADDED]
    table, at = spans.with_text(docs, carried)

    def run(batches):
        for batch in batches:
            found = [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in one] for one in shared.value.scan(batch.column(at))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(found, kind)], [*batch.schema.names[: len(carried)], "spans"])

    found = table.transform(in_arrow, run, ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carried)), "spans array<struct<kind:string,start:int,end:int>>"]))
    return found.select(whole, "spans")


def redacted(text: str, spans_column: str, mark: str = "[secret]"):
    """Column: the text with every span (they may overlap) replaced by ``mark``."""
    merged = F.aggregate(
        F.col(spans_column),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))),
    )
    return F.when(F.size(spans_column) > 0, merged).otherwise(F.col(text))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the SHA-256 of the base spans, and all spans as text."""
    listed = lambda keep: F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k, *_ in RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def span_digest(text: str | None) -> tuple[int, int, int, str]:
    """What ``digest`` gives of the base spans of one text, in plain Python."""
    base = base_spans(text or "")
    counts = [sum(r == k for _, r, _ in base) for k in range(len(RULES))]
    return *counts, hashlib.sha256(",".join(f"{RULES[r][0]}:{s}:{e}" for s, r, e in base).encode()).hexdigest()

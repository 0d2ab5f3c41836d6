"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles (lower-cased words between
white space; a text of one to four words is one shingle), and two texts are
linked if the weighted Jaccard similarity of their multisets is 0.8 or more.
Classes are the connected components of all links.

1. Equal texts (same words) are one node, whatever their number.
2. BagMinHash: every shingle has Poisson processes over the levels of its
   weight, [0,1), [1,2), [2,4), [4,8), ...; a point has a time, a level and one
   of ``slots`` places, and counts if its level lies below the weight.  The
   first point of each place is the signature.  A text's shingles are only
   followed until all places are taken, so few points are made for each, and
   two signatures agree in a place with the weighted Jaccard similarity as
   probability.
3. Bands of ``rows`` places; texts that share a band are bucket mates.  Inside a
   bucket the signatures are compared in blocks of bounded size (a byte for each
   place), which leaves the *likely* mates: those whose sizes allow the
   similarity and whose signatures agree in at least as many places as a pair of
   that similarity does but for one in ten million.  A node goes on with one of
   them, its hub: the one with most bucket mates of all.
4. Nodes are verified against their hubs by exact overlap of the multisets, which
   settles all but few links with one comparison for each node.
5. *Clusters* are the connected components of all likely mates.  Clusters that still
   hold several components are gone through in blocks once more, those of more than ``large``
   nodes bucket by bucket: nodes with a likely mate of another component
   get their multisets, all such pairs are verified exactly, and a task returns a
   link for each two components that it has joined, so at most one for each
   component it has seen.

With 30 bands of 5 places a pair of similarity 0.8 meets in no band once in
150,000 pairs, and higher similarities are missed far less often.  A bucket of more than ``large`` nodes is split by
further places of the signature first (what its nodes share is mostly one
passage); with ``sub_bands`` of ``sub_rows`` places a link of 0.8 is lost there
once in 38,000 buckets, and it meets in ten.  No pair is ever a row: rows are
nodes and lines of a node to its bucket, and comparisons are matrix products.

Edge cases: null texts and texts without words are classes of their own; null
doc_id is carried; equal rows are of one class; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import in_arrow, share, stage

SHINGLE, SIMILAR = 5, 0.8
SLOTS, ROWS = 150, 5
#: Standard deviations by which two signatures may agree in fewer places than they should.
SPREAD = 4.5
#: Guests of a hub in one comparison, nodes of a bucket in one, and lines of buckets in one call.
GUESTS, BLOCK, CELL = 128, 1024, 1 << 14
#: Bits of the filter that picks the texts to verify, and elements in one product.
FILTER_BITS, WIDE = 1 << 24, 1 << 13
_STEP = 8
ELEMENT = np.uint32
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of a block."""
    a, b = spans.white_words(data, offsets)
    row = spans.rows_of(offsets, a)
    h = spans.hashes(spans.LOWER[data], a, b)
    s, at = spans.grams(h, row, n)
    rows, out = [row[at]], [s]
    size = np.bincount(row, minlength=len(offsets) - 1)
    for k in range(1, n):
        few = size[row] == k
        s, at = spans.grams(h[few], row[few], k)
        rows.append(row[few][at])
        out.append(spans.mix(s ^ _U(k)))
    return np.concatenate(rows), np.concatenate(out)


def _points(n_rows: int, row: np.ndarray, h: np.ndarray, w: np.ndarray, until: np.ndarray, slots: int) -> np.ndarray:
    """The first time of each row and place, of all points up to each row's time ``until``."""
    best = np.full(n_rows * slots, np.inf)
    low, width, level = 0, 1, 0
    while True:
        some = w > low
        if not some.any():
            return best
        r, weight, rate = row[some], w[some], float(width)
        seed = spans.mix(h[some] ^ spans.mix(np.full(1, level, _U)))
        t, step = np.zeros(len(r)), 0
        while len(r):
            x = spans.mix(seed[:, None] + np.arange(step * _STEP, (step + 1) * _STEP, dtype=_U) * _U(0x9E3779B97F4A7C15))
            times = t[:, None] + np.cumsum(-np.log(((x >> _U(11)).astype(float) + 0.5) * 2.0**-53), axis=1) / rate
            x = spans.mix(x)
            ok = times <= until[r][:, None]
            if width > 1:
                ok &= low + (((x & _U(0xFFFFFFFF)) * _U(width)) >> _U(32)).astype(np.int64) < weight[:, None]
            place = (r[:, None] * slots + ((x >> _U(32)) % _U(slots)).astype(np.int64))[ok]
            np.minimum.at(best, place, times[ok])
            t = times[:, -1]
            on = t <= until[r]
            r, weight, seed, t, step = r[on], weight[on], seed[on], t[on], step + 1
        low, width, level = low + width, low + width, level + 1


def signatures(n_rows: int, row: np.ndarray, h: np.ndarray, w: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A line of ``slots`` 32-bit values for each row, from its distinct shingles and their weights."""
    total = np.bincount(row, w, n_rows)
    reach = np.log(slots) + 4
    best = _points(n_rows, row, h, w, slots * reach / np.maximum(total, 1), slots)
    open_rows = np.unique(np.flatnonzero(np.isinf(best)) // slots)
    open_rows = open_rows[total[open_rows] > 0]
    while len(open_rows):
        reach *= 2
        at = np.full(n_rows, -1)
        at[open_rows] = np.arange(len(open_rows))
        mine = at[row] >= 0
        again = _points(len(open_rows), at[row[mine]], h[mine], w[mine], slots * reach / total[open_rows], slots).reshape(-1, slots)
        best.reshape(-1, slots)[open_rows] = again
        open_rows = open_rows[np.isinf(again).any(1)]
    return (spans.mix(best.view(_U)) >> _U(32)).astype(np.uint32).reshape(n_rows, slots)


def text_key(text: bytes) -> bytes:
    """16 bytes that equal texts share; empty for a text without words."""
    words = text.lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else b""


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key of each band of each signature."""
    bands = sig.shape[1] // rows
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(sig), bands))
    for k in range(rows):
        out = spans.mix(out ^ spans.mix(sig[:, k : bands * rows : rows].astype(_U)))
    return out


def _signed(slots: int, rows: int):
    """Of each text: its key, its band keys, a byte of each place of its signature, and its size."""

    def run(batches):
        for batch in batches:
            text = spans.strings(batch.column(1))
            key, bands, sig, size = [], [np.zeros(0, np.int64)], [pa.array([], pa.binary())], [np.zeros(0, np.int32)]
            for _, data, offsets in spans.blocks(text):
                row, h, w = spans.counted(*shingles(data, offsets))
                s = signatures(len(offsets) - 1, row, h, w, slots)
                raw = data.tobytes()
                key += [text_key(raw[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                bands.append(band_keys(s, rows).view(np.int64).ravel())
                sig.append(pa.array([x.tobytes() for x in s.astype(np.uint8)], pa.binary()))
                size.append(np.bincount(row, w, len(offsets) - 1).astype(np.int32))
            offsets = pa.array(np.arange(0, (len(text) + 1) * (slots // rows), slots // rows, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), lists, pa.concat_arrays(sig), pa.array(np.concatenate(size))], ["doc_id", "key", "keys", "sig", "size"])

    return run


def _elements(shared):
    """(key, elements) of the texts whose key passes the filter, each once in a task.

    An element is a hash of a shingle with its number among equal ones, so that the
    overlap of multisets is that of sets.
    """

    def run(batches):
        table, seen = shared.value, set()
        for batch in batches:
            text = spans.strings(batch.column(0))
            keys = [text_key(t.as_buffer().to_pybytes() if t.as_buffer() else b"") for t in text]
            wanted = []
            for k, key in enumerate(keys):
                if key and key not in seen:
                    bit = int.from_bytes(key[:8], "little") % FILTER_BITS
                    if table[bit >> 6] >> _U(bit & 63) & _U(1):
                        wanted.append(k)
                        seen.add(key)
            out = []
            for _, data, offsets in spans.blocks(text.take(pa.array(wanted, pa.int64()))):
                row, h, w = spans.counted(*shingles(data, offsets))
                which = np.repeat(np.arange(len(w)), w)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)
                e, r = (spans.mix(h[which] + nth.astype(_U) * _U(0xA24BAED4963EE407)) >> _U(32)).astype(ELEMENT), row[which]
                cut = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(offsets) - 1))))
                out += [np.unique(e[cut[k] : cut[k + 1]]).tobytes() for k in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in wanted], pa.binary()), pa.array(out, pa.binary())], ["key", "elements"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    all_left, all_right = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(all_left, all_right)
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(sets, whole):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, whole), max(0, len(shared) - 1))
        ok = shared[at] == whole
        return owner[ok], at[ok]

    if not len(shared):
        return out
    (lo, la), (ro, ra) = placed(left, all_left), placed(right, all_right)
    for at in range(0, len(shared), WIDE):
        a, b = np.zeros((len(left), WIDE), np.float32), np.zeros((len(right), WIDE), np.float32)
        for table, owner, place in ((a, lo, la), (b, ro, ra)):
            ok = (place >= at) & (place < at + WIDE)
            table[owner[ok], place[ok] - at] = 1
        out += a @ b.T
    return out


def _verified(least: float):
    """A link for each guest that is similar to the hub of its group."""

    def run(table):
        node = table["node"].to_numpy()
        host = table["host"].to_numpy(zero_copy_only=False)
        group = np.unique(np.stack((table["grp"].to_numpy(), table["block"].to_numpy())), axis=1, return_inverse=True)[1]
        sets = table["elements"].combine_chunks()
        of = lambda k: np.frombuffer(sets[k].as_buffer(), ELEMENT)
        hub = dict(zip(group[host].tolist(), np.flatnonzero(host).tolist()))
        found, last = [], (-1, None)
        for k in np.lexsort((node, group)):
            if not host[k] and (at := hub.get(int(group[k]))) is not None:
                last = last if last[0] == at else (at, of(at))
                mine = of(k)
                common = len(np.intersect1d(mine, last[1], assume_unique=True))
                if similar(common, len(mine), len(last[1]), least):
                    found.append((node[k], node[at]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def similar(common, n, m, least: float):
    """Whether sets of n and m elements with so many common ones reach the similarity."""
    return (common > 0) & (common / (n + m - common) >= least - 1e-9)


def compare(guests: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of nodes to their hubs; ``guests`` is (grp, node), the hub is the node that names the group."""
    blocks = guests.groupBy("grp").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("blocks"))
    hosts = blocks.select("grp", F.col("grp").alias("node"), F.lit(True).alias("host"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = guests.join(blocks, "grp").select("grp", "node", F.lit(False).alias("host"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    cells = max(1, guests.count() // CELL * 4)
    met = hosts.unionByName(own).join(elements, "node").withColumn("cell", F.pmod(F.xxhash64("grp", "block"), F.lit(cells)))
    return met.groupBy("cell").applyInArrow(_verified(least), "a long, b long")


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places each line of ``a`` agrees with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        out += x[:, None] == y[None]
    return out


class Cell:
    """The lines of whole blocks, and the likely pairs of different components in them."""

    def __init__(self, table: pa.Table, slots: int, least: float):
        self.node, self.comp, self.size, self.own = (table[c].to_numpy() for c in ("node", "comp", "size", "own"))
        key = [table[c].to_numpy() for c in ("b", "i", "j")]
        order = np.lexsort((self.node, self.own, *key[::-1]))
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, slots)
        self.least = least
        self.enough = slots * least - SPREAD * np.sqrt(slots * least * (1 - least))
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
        starts = np.flatnonzero(new)
        self.groups = np.split(order, starts[1:]) if len(order) else []

    def _fits(self, p, q):
        n, m = self.size[p], self.size[q]
        return (self.comp[p] != self.comp[q]) & (n >= self.least * m - 1e-6) & (m >= self.least * n - 1e-6)

    def likely(self):
        """(p, q) of likely pairs, as arrays of places in the table: those of all small blocks at once, then block by block."""
        by_size: dict[int, list[np.ndarray]] = {}
        for g in self.groups:
            if len(g) <= 32 and self.own[g[0]] == self.own[g[-1]]:
                by_size.setdefault(len(g), []).append(g)
        for n, groups in by_size.items():
            i, j = np.triu_indices(n, 1)
            for at in range(0, len(groups), max(1, 100_000 // max(1, len(i)))):
                some = np.array(groups[at : at + max(1, 100_000 // max(1, len(i)))])
                p, q = some[:, i].ravel(), some[:, j].ravel()
                ok = self._fits(p, q)
                p, q = p[ok], q[ok]
                ok = (self.sig[p] == self.sig[q]).sum(1) >= self.enough
                yield p[ok], q[ok]
        for g in self.groups:
            own = self.own[g]
            if len(g) > 32 or own[0] != own[-1]:
                left, right = (g, g) if own[0] == own[-1] else (g[own == own[0]], g[own != own[0]])
                ok = (agreements(self.sig[left], self.sig[right]) >= self.enough) & self._fits(left[:, None], right[None])
                if left is right:
                    ok = np.triu(ok, 1)
                a, b = np.nonzero(ok)
                yield left[a], right[b]


def _labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least place of each place's connected component."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[p], label[q]), label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _hubs(slots: int, least: float):
    """For each node with a likely mate: the one of them, or itself, that has most mates, with their number; and one node of all it is connected with."""

    def run(table):
        cell, degree = Cell(table, slots, least), table["degree"].to_numpy()
        best, root = np.full(len(degree), -1), np.arange(len(degree))
        place = np.empty(len(degree), np.int64)
        back = np.lexsort((-cell.node, degree))
        place[back] = np.arange(len(degree))
        for p, q in cell.likely():
            for x, y in ((p, p), (q, q), (p, q), (q, p)):
                np.maximum.at(best, x, place[y])
            # the same nodes lead in all buckets, so that few different lines come of them
            lead, at = np.unique(-place[np.concatenate((p, q))], return_inverse=True)
            some = back[-lead]
            root[some] = some[_labels(len(some), at[: len(p)], at[len(p) :])]
        at = np.flatnonzero(best >= 0)
        hub = back[best[at]]
        return pa.table({"node": pa.array(cell.node[at]), "degree": pa.array(degree[hub]), "hub": pa.array(cell.node[hub]), "root": pa.array(cell.node[root[at]])})

    return run


def _likely(slots: int, least: float):
    """The lines of nodes with a likely mate of another component."""

    def run(table):
        some = np.zeros(len(table), bool)
        for p, q in Cell(table, slots, least).likely():
            some[p] = some[q] = True
        return table.filter(pa.array(some))

    return run


def _joined(slots: int, least: float):
    """(a, b): components that exact comparisons of their likely nodes have joined, one link for each joining."""

    def run(table):
        cell, sets = Cell(table, slots, least), table["elements"].combine_chunks()
        found = []
        for p, q in cell.likely():
            up: dict[int, int] = {}

            def root(k):
                while (above := up.get(k, k)) != k:
                    up[k] = k = up.get(above, above)
                return k

            roots = lambda a, b: (root(int(cell.comp[a])), root(int(cell.comp[b])))
            for a, b in pairs_of(p, q, sets, least, lambda a, b: len(set(roots(a, b))) > 1):
                x, y = roots(a, b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    found.append((int(cell.comp[a]), int(cell.comp[b])))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def pairs_of(p: np.ndarray, q: np.ndarray, sets: pa.Array, least: float, apart):
    """Those of the pairs that are similar; one by one while they are ``apart`` where they are few, else in products of bounded size."""
    of = lambda k: np.frombuffer(sets[int(k)].as_buffer(), ELEMENT)
    rows, columns = np.unique(p), np.unique(q)
    if len(p) * 8 < len(rows) * len(columns) or len(p) < 64:
        for a, b in zip(p.tolist(), q.tolist()):
            if not apart(a, b):
                continue
            x, y = of(a), of(b)
            if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least):
                yield a, b
        return
    for i in range(0, len(rows), 256):
        for j in range(0, len(columns), 256):
            some, others = rows[i : i + 256], columns[j : j + 256]
            inside = (p >= some[0]) & (p <= some[-1]) & (q >= others[0]) & (q <= others[-1])
            if inside.any():
                left, right = [of(k) for k in some], [of(k) for k in others]
                common = overlaps(left, right)
                ok = similar(common, np.array([len(x) for x in left])[:, None], np.array([len(x) for x in right])[None], least)
                a, b = p[inside], q[inside]
                hit = ok[np.searchsorted(some, a), np.searchsorted(others, b)]
                yield from zip(a[hit].tolist(), b[hit].tolist())


def mixed_lines(nodes: DataFrame, large: int, sub_bands: int, sub_rows: int, slots: int) -> DataFrame:
    """A line for each node and bucket with several components, once for each pair of blocks the node is in.

    ``nodes`` has node, comp, meets (its buckets), sig and other columns, which are carried.
    """
    kept = [c for c in nodes.columns if c != "meets"]
    lines = nodes.select(*kept, F.explode("meets").alias("b"))

    def sized(t):
        return t.groupBy("b").agg(F.count("*").alias("g"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("b", "g")

    met = lines.join(sized(lines), "b")
    place = lambda s, k: F.pmod(F.col("b") + F.lit(s * sub_rows + k), F.lit(slots)).cast("int") + 1
    sub = F.array(*(F.xxhash64("b", F.lit(s), *(F.substring("sig", place(s, k), F.lit(1)) for k in range(sub_rows))) for s in range(sub_bands)))
    crowded = met.where(F.col("g") > large).select(*kept, F.explode(sub).alias("b"))
    met = met.where(F.col("g") <= large).select(*kept, "b", "g").unionByName(crowded.join(sized(crowded), "b").select(*kept, "b", "g"))
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("g", "other")
    cells = max(1, (nodes.agg(F.sum(F.size("meets"))).first()[0] or 0) // CELL)
    return met.withColumn("cell", F.pmod(F.xxhash64("b", "i", "j"), F.lit(cells)))


def components(links: DataFrame, hot: int = 256) -> DataFrame:
    """(node, comp) of all nodes with a link; comp is a node of the component.

    In rounds every node hooks to the neighbour of most links, if it has fewer itself
    (ties by a hash of the round), and the links between what has come together
    are all that the next round sees.  Nodes with over 1/``hot`` of all links are
    broadcast, so no join has a hot key.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    hooks: list[DataFrame] = []
    while total := edges.count():

        def told(t: DataFrame, end: str, facts: DataFrame) -> DataFrame:
            """``t`` with the facts of the node in its column ``end``."""
            big, small = facts.where(F.col("d") > total / hot), facts.where(F.col("d") <= total / hot)
            named = lambda f, name: f.select(F.col("node").alias(end), F.col("fact").alias(name))
            met = t.join(F.broadcast(named(big, "of_big")), end, "left")
            rest = met.where("of_big is null").drop("of_big").join(named(small, "fact").hint("shuffle_merge"), end)
            return met.where("of_big is not null").withColumnRenamed("of_big", "fact").select(*t.columns, "fact").unionByName(rest.select(*t.columns, "fact"))

        rank = F.struct("d", F.xxhash64("a", F.lit(len(hooks))).alias("h"), F.col("a").alias("node"))
        ranks = edges.groupBy("a").agg(F.count("*").alias("d")).select(F.col("a").alias("node"), "d", rank.alias("fact"))
        best = told(edges, "b", ranks).groupBy("a").agg(F.max("fact").alias("other"))
        higher = F.when(F.col("other") > F.col("fact"), F.col("other.node")).otherwise(F.col("a"))
        hook = stage(best.join(ranks.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("node"), "d", higher.alias("fact")), "hooks")
        hooks.append(hook)
        moved = told(edges, "a", hook).select(F.col("fact").alias("a"), "b")
        moved = told(moved, "b", hook).select("a", F.col("fact").alias("b"))
        edges = stage(moved.where("a != b").distinct(), "links")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    for hook in reversed(hooks):
        then = out.select(F.col("node").alias("fact"), "comp")
        out = hook.join(then, "fact", "left").select("node", F.coalesce("comp", "fact").alias("comp"))
    return stage(out, "components")


def _key_filter(keys: DataFrame) -> np.ndarray:
    """The filter's bits from the first eight bytes of each key, OR-ed over all tasks."""

    def run(batches):
        table = np.zeros(FILTER_BITS // 64, _U)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                bit = int.from_bytes(key[:8], "little") % FILTER_BITS
                table[bit >> 6] |= _U(1) << _U(bit & 63)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["word", "bits"])

    found = keys.transform(in_arrow, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, _U)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return table


def near_duplicates(docs: DataFrame, least: float = SIMILAR, slots: int = SLOTS, rows: int = ROWS, large: int = 1 << 13, sub_bands: int = 20, sub_rows: int = 4, hot: int = 256) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), class_size, and kept: true for one row of each class."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stage(docs.transform(in_arrow, _signed(slots, rows), f"doc_id {kind}, key binary, keys array<long>, sig binary, size int").withColumn("row", F.monotonically_increasing_id()), "signed")
    texts = stage(signed.where(F.length("key") > 0).groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "texts")

    nodes = signed.select(F.col("row").alias("node"), "size", "keys", "sig").join(texts.select("node"), "node", "left_semi")
    bands = nodes.select("node", F.explode("keys").alias("b"))
    shared = bands.groupBy("b").agg(F.count("*").alias("g")).where("g > 1")
    met = bands.join(shared, "b").groupBy("node").agg(F.sum(F.col("g") - 1).alias("degree"), F.collect_list("b").alias("meets"))
    linked = stage(met.join(nodes.select("node", "size", "sig"), "node"), "mates")

    split = (large, sub_bands, sub_rows, slots)
    lines = mixed_lines(linked.withColumn("comp", F.col("node")), *split)
    likely = stage(lines.groupBy("cell").applyInArrow(_hubs(slots, least), "node long, degree long, hub long, root long"), "likely")
    top = F.max(F.struct("degree", (-F.col("hub")).alias("minus")))
    hubs = stage(likely.groupBy("node").agg(top.alias("top")).select("node", (-F.col("top.minus")).alias("hub")), "hubs")

    involved = texts.join(hubs.select("node"), "node", "left_semi").select("key", "node")
    bits = share(docs.sparkSession, _key_filter(involved.select("key")))
    elements = stage(docs.select("text").transform(in_arrow, _elements(bits), "key binary, elements binary").dropDuplicates(["key"]).join(involved, "key").select("node", "elements"), "elements")
    bits.unpersist()

    comps = components(stage(compare(hubs.where("hub != node").select(F.col("hub").alias("grp"), "node"), elements, least), "links"))
    clusters = components(likely.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    small = clusters.groupBy("comp").agg(F.count("*").alias("g")).where(F.col("g") <= large).select(F.col("comp").alias("cluster"))
    clusters = clusters.select("node", F.col("comp").alias("cluster")).join(small, "cluster")
    open_nodes = linked.join(hubs.select("node"), "node", "left_semi").join(comps, "node", "left").join(clusters, "node", "left")
    open_nodes = open_nodes.select("node", "size", "sig", F.coalesce("comp", "node").alias("comp"), F.when(F.col("cluster").isNotNull(), F.array("cluster")).otherwise(F.col("meets")).alias("meets"))
    lines = mixed_lines(stage(open_nodes, "labelled"), *split).select("node", "comp", "size", "sig", "b", "i", "j", "own", "cell")
    # the multisets go only where the signatures leave something to verify
    rest = stage(lines.groupBy("cell").applyInArrow(_likely(slots, least), lines.schema), "rest")
    cells = max(1, rest.count() * 16 // CELL)
    verified = rest.join(elements, "node").withColumn("cell", F.pmod(F.xxhash64("b", "i", "j"), F.lit(cells))).groupBy("cell").applyInArrow(_joined(slots, least), "a long, b long")
    joined = components(stage(verified, "links"))
    of_comp = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("class")), "comp", "left").select("node", F.coalesce("class", "comp").alias("comp"))
    alone = joined.join(comps.select("node"), "node", "left_anti")
    classes = of_comp.unionByName(alone)

    named = stage(texts.join(classes, "node", "left").select("key", "copies", F.coalesce("comp", "node").alias("comp")), "named")
    total = signed.count()
    frequent = named.where(F.col("copies") > total / hot).select("key", F.col("comp").alias("of_many"))
    seldom = named.where(F.col("copies") <= total / hot).select("key", F.col("comp").alias("of_few"))
    met = signed.select("doc_id", "row", "key").join(F.broadcast(frequent), "key", "left")
    alone = met.where(F.length("key") == 0).select("doc_id", "row", F.col("row").alias("comp"))
    many = met.where("of_many is not null").select("doc_id", "row", F.col("of_many").alias("comp"))
    few = met.where((F.length("key") > 0) & F.col("of_many").isNull()).join(seldom.hint("shuffle_merge"), "key").select("doc_id", "row", F.col("of_few").alias("comp"))
    labelled_rows = stage(alone.union(many).union(few), "classes")
    found = stage(labelled_rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("doc_id", "row")["row"]).alias("any_row"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")), "found")
    wide = found.where(F.col("class_size") > total / hot)
    narrow = found.where(F.col("class_size") <= total / hot)
    columns = lambda t, s: t.select("comp", F.struct("class_id", "class_size", F.coalesce("first.row", "any_row").alias("keep")).alias(s))
    a = labelled_rows.join(F.broadcast(columns(wide, "w")), "comp", "left")
    out = a.where("w is not null").select("doc_id", "row", "w").union(a.where("w is null").join(columns(narrow, "n").hint("shuffle_merge"), "comp").select("doc_id", "row", "n"))
    return out.select("doc_id", "w.class_id", "w.class_size", (F.col("row") == F.col("w.keep")).alias("kept"))

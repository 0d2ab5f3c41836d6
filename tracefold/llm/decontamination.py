"""Benchmark decontamination by a prefix-filtered set join.

Words are lower-cased runs of letters, digits and all that is not ASCII; a
*window* is 13 consecutive words of an item, or a shorter item as a whole.  A
window is the ordered set of its shingles (five words, or all of a shorter
window).  Containment asks for every shingle, so the necessary prefix is one
token, and the rarest shingle in the corpus is taken: documents are joined to
windows by that shingle alone.  Its place in both gives the only possible start
(positional bound), which must leave room for the whole window (length bound); candidates
are verified by every shingle of the window at its own place.

A scan of the texts keeps, for each document, the places of shingles that a
Bloom filter of the benchmark lets through; the filter has a fixed size,
whatever the benchmark's.  Shingle frequencies, the prefix join and the
verification work on that far smaller table, by hash shuffles.  A passage in
very many documents makes even its rarest shingle frequent; keys with over
1/``hot`` of all places (so at most ``hot`` keys) are salted, and so are the windows that
have such a prefix.

Edge cases: null or empty texts have no words and no hits; items without words
are no windows; repeated items count one each by item_id; equal documents are
judged each for itself; an empty benchmark leaves every document clean; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import in_arrow, share, stage

WINDOW, SHINGLE = 13, 5
#: Bits of the filter, two probes each.
FILTER_BITS = 1 << 24


def words(column: pa.Array):
    """(first row, rows, row, place, hash) of all words, block by block."""
    for first, data, offsets in spans.blocks(column):
        a, b = spans.alnum_words(data, offsets)
        row = spans.rows_of(offsets, a)
        size = np.bincount(row, minlength=len(offsets) - 1)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        yield first, len(offsets) - 1, row, place, spans.hashes(spans.LOWER[data], a, b)


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words, told apart by n, and where they begin."""
    s, at = spans.grams(h, row, n)
    return spans.mix(s + np.uint64(n)), at


def _probes(s: np.ndarray):
    return (s % np.uint64(FILTER_BITS)).astype(np.int64), (spans.mix(s) % np.uint64(FILTER_BITS)).astype(np.int64)


def _windows(window: int, shingle: int):
    """(item_id, window, size, place, sh): the shingles of each distinct window of an item."""

    def run(batches):
        for batch in batches:
            item, key, size, place, sh = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for first, n_rows, row, _, h in words(batch.column(1)):
                for r in range(n_rows):
                    mine = h[row == r]
                    if not len(mine):
                        continue
                    n = min(window, len(mine))
                    k = min(shingle, n)
                    own, _ = shingles(mine, np.zeros(len(mine), np.int64), k)
                    whole, _ = shingles(mine, np.zeros(len(mine), np.int64), n)
                    for at in np.unique(whole, return_index=True)[1]:
                        for p in range(n - k + 1):
                            item.append(ids[first + r]), key.append(whole[at]), size.append(n), place.append(p), sh.append(own[at + p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, batch.schema.field(0).type), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(np.array(sh, np.uint64).view(np.int64))],
                ["item_id", "window", "size", "place", "sh"],
            )

    return run


def _bits(batches):
    """The filter's set bits as (word, 64 bits), one row for each word that a task touches."""
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in batches:
        for slot in _probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
            np.bitwise_or.at(table, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["word", "bits"])


def _places(sizes: list[int], shared):
    """Each document's number of words and the places of shingles that pass the filter."""

    def run(batches):
        table = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            rows, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, n_rows, row, place, h in words(batch.column(1)):
                n_words[first : first + n_rows] = np.bincount(row, minlength=n_rows)
                for k in sizes:
                    s, at = shingles(h, row, k)
                    one, two = _probes(s)
                    hit = (table[one >> 6] >> (one & 63).astype(np.uint64)) & (table[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1) > 0
                    rows.append(first + row[at[hit]]), places.append(place[at[hit]]), found.append(s[hit])
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            place, sh = np.concatenate(places)[order].astype(np.int32), np.concatenate(found)[order].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), *spans.lists(row[order], batch.num_rows, place, sh)], ["doc_id", "n_words", "place", "sh"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, hot: int = 256, salts: int = 64) -> DataFrame:
    """For each document its words, the words hit, the items with a window in it, and the verdict.

    Returns doc_id, n_words, n_hit, items (sorted item ids as strings) and contaminated.
    """
    spark = docs.sparkSession
    kind = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": benchmark.schema["item_id"].dataType.simpleString()}
    windows = stage(benchmark.select("item_id", "text").transform(in_arrow, _windows(window, shingle), f"item_id {kind['item_id']}, window long, size int, place int, sh long"), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect())
    words_set = windows.select("sh").distinct().transform(in_arrow, _bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words_set["word"].to_numpy()] = words_set["bits"].to_numpy().view(np.uint64)
    scanned = docs.select("doc_id", "text").transform(in_arrow, _places(sizes, share(spark, table)), f"doc_id {kind['doc_id']}, n_words long, place array<int>, sh array<long>")
    each = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "places")
    places = each.where(F.size("sh") > 0).select("row", F.explode(F.arrays_zip("place", "sh")).alias("x")).select("row", "x.place", "x.sh")

    tokens = windows.select("window", "size", F.col("place").alias("p"), "sh").distinct()
    counts = stage(places.groupBy("sh").agg(F.count("*").alias("n")).join(tokens.select("sh").distinct(), "sh", "left_semi"), "frequencies")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = [r.sh for r in counts.where(F.col("n") > total / hot).select("sh").collect()]
    # a window with a shingle that no document has occurs nowhere
    ranked = tokens.join(counts, "sh", "left").groupBy("window", "size").agg(F.min(F.when(F.col("n").isNull(), -1).otherwise(0)).alias("absent"), F.min(F.struct("n", "sh", "p")).alias("prefix"))
    prefix = ranked.where("absent = 0").select("window", "size", "prefix.sh", F.col("prefix.p").alias("p"))
    is_frequent = F.col("sh").isin(frequent) if frequent else F.lit(False)
    dealt = prefix.withColumn("salt", F.explode(F.when(is_frequent, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    salted = places.withColumn("salt", F.when(is_frequent, F.pmod(F.hash("row"), F.lit(salts))).otherwise(0))
    # a candidate brings its window's shingles along, so no join goes by windows, which may be hot
    sets = tokens.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("p", "sh"))).alias("set"))
    candidates = salted.join(dealt.join(sets, "window"), ["sh", "salt"]).select("row", "window", "salt", "size", (F.col("place") - F.col("p")).alias("start"), "set").where("start >= 0")
    key = ["row", "window", "salt", "size", "start"]
    asked = candidates.select(*key, F.explode("set").alias("x")).select(*key, (F.col("start") + F.col("x.p")).alias("place"), F.col("x.sh").alias("sh"))
    verified = asked.join(places, ["row", "place", "sh"]).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") == F.col("size") - F.least("size", F.lit(shingle)) + 1)
    found = stage(verified.select(*key), "verified")

    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(x["end"], s["end"]).alias("end")),
        lambda s: s["n"],
    )
    hits = found.groupBy("row").agg(covered.alias("n_hit"))
    of_items = windows.select("window", F.col("item_id").cast("string").alias("item")).distinct().join(dealt.select("window", "salt"), "window")
    items = found.select("row", "window", "salt").distinct().join(of_items, ["window", "salt"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = each.select("row", "doc_id", "n_words").join(hits, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The items as their number and the SHA-256 of their list."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

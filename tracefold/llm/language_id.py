"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot holds a bit for every
language (bit-sliced, a byte for each eight languages), and the AND of an
n-gram's slots is the set of languages that contain it.  A text's languages
are counted over all its n-grams, and each count is corrected for the hits
that a filter of that fill gives by chance: (hits - N f) / (1 - f).  The
language with the largest corrected count is predicted.

Byte n-grams of lower-cased words, blanks at the words' ends, are learned from
about ``per_lang`` rows of each language, drawn by a hash of doc_id.  An n-gram
is put into a language's filter if its share there is ``least_share`` or more
and a ``ratio`` of its largest share in any language, so a language has at most
3 / ``least_share`` of them.

Edge cases: null text, or text without a letter, is ``und`` with score 0; a
text none of whose n-grams is known gets the commonest learned language and
score 0; without learned languages every row is ``und``; ties go to the
language first in order; equal rows get equal rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import in_arrow, share

UNKNOWN = "und"
ORDERS = (2, 3, 4)
PROBES = 3
#: More labels than this are not languages.
MOST_LANGUAGES = 2048

_CHAR = spans.LOWER.copy()
_CHAR[~spans.ALNUM] = 32
_CHAR[48:58] = 32
_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def ngrams(column: pa.Array):
    """(first row, rows, row, key) of all n-grams, block by block; digits and marks are blanks."""
    # an n-gram takes some hundred bytes while it is counted
    for first, data, offsets in spans.blocks(pc.utf8_lower(spans.strings(column)), spans.BLOCK_BYTES // 4):
        n_rows = len(offsets) - 1
        padded = np.insert(_CHAR[data], offsets, 32)
        row = np.repeat(np.arange(n_rows + 1), np.append(np.diff(offsets), 0) + 1)
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (row[1:] != row[:-1])
        # a row keeps the blank of the next as its end
        padded, row = padded[keep].astype(np.uint64), row[keep]
        rows, keys = [], []
        for n in ORDERS:
            m = len(padded) - n + 1
            if m <= 0:
                continue
            inside = row[n - 2 : n - 2 + m] == row[:m]
            key = np.full(m, n, np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | padded[k : k + m]
            # a row that ends in a blank has its end there
            inside &= (padded[n - 2 : n - 2 + m] != 32) | (padded[n - 1 : n - 1 + m] != 32)
            rows.append(row[:m][inside])
            keys.append(key[inside])
        yield first, n_rows, np.concatenate(rows) if rows else row[:0], np.concatenate(keys) if keys else padded[:0]


def _counts(batches):
    """(lang, key, n): n-grams by language."""
    held: dict[str, Counter] = {}
    for batch in batches:
        lang = batch.column(1)
        for label in pc.unique(lang).to_pylist():
            count = held.setdefault(label, Counter())
            for _, _, _, key in ngrams(batch.column(0).filter(pc.equal(lang, label))):
                u, n = np.unique(key, return_counts=True)
                count.update(dict(zip(u.tolist(), n.tolist())))
    for label, count in held.items():
        keys = np.fromiter(count.keys(), np.uint64, len(count)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys), pa.array(np.fromiter(count.values(), np.int64, len(count)))], ["lang", "key", "n"])


class Filter:
    """The bit-sliced Bloom filter of all languages."""

    def __init__(self, languages: list[str], commonest: int, members: list[tuple[int, np.ndarray]]):
        self.languages, self.commonest = languages, commonest
        total = len(np.unique(np.concatenate([k for _, k in members]))) if members else 0
        self.slots = 1 << max(10, int(8 * total).bit_length())
        self.width = -(-max(1, len(languages)) // 8)
        self.table = np.zeros((self.slots, self.width), np.uint8)
        for at, keys in members:
            for slot in self._probes(keys):
                self.table[slot, at // 8] |= np.uint8(1 << at % 8)
        fill = np.array([(self.table[:, at // 8] >> (at % 8) & 1).mean() for at in range(len(languages))])
        self.chance = fill**PROBES

    def _probes(self, keys: np.ndarray):
        h = spans.mix(keys)
        for k in range(PROBES):
            yield (h >> np.uint64(21 * k)).astype(np.int64) & (self.slots - 1) if self.slots <= 1 << 21 else spans.mix(h + np.uint64(k)).astype(np.int64) & (self.slots - 1)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, as bytes of bits."""
        out = np.full((len(keys), self.width), 255, np.uint8)
        for slot in self._probes(keys):
            out &= self.table[slot]
        return out

    def counts(self, n_rows: int, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts by row and language, and the n-grams of each row."""
        masks = self.masks(keys)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
        hits = np.concatenate([np.bincount(row * 256 + masks[:, w], minlength=n_rows * 256).reshape(n_rows, 256) @ bits for w in range(self.width)], axis=1)
        total = np.bincount(row, minlength=n_rows).astype(float)
        hits = hits[:, : len(self.languages)]
        return np.maximum(0, (hits - total[:, None] * self.chance) / np.maximum(1e-9, 1 - self.chance)), total

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(column)
        best, score = np.full(n, self.commonest), np.zeros(n)
        for first, n_rows, row, key in ngrams(column):
            if len(key) and self.languages:
                counts, total = self.counts(n_rows, row, key)
                top = counts.argmax(1)
                share = counts[np.arange(n_rows), top] / np.maximum(1, total)
                best[first : first + n_rows] = np.where(share > 0, top, self.commonest)
                score[first : first + n_rows] = np.minimum(1, share)
        letters = np.asarray(pc.match_substring_regex(spans.strings(column), "[A-Za-z]")).copy()
        for k in np.flatnonzero(~letters):
            letters[k] = bool(_LETTER.search(column[int(k)].as_py() or ""))
        score[~letters] = 0
        return [self.languages[b] if has and self.languages else UNKNOWN for b, has in zip(best, letters)], score


def learn(docs: DataFrame, per_lang: int = 4000, least_share: float = 1e-5, ratio: float = 0.25) -> Filter:
    """Learn the filter from the text and lang of ``docs``; rows without either are left out."""
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null")
    sizes = dict(docs.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    languages = sorted(sizes)
    if not languages:
        return Filter([], 0, [])
    rate = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_lang / sizes[k]))))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))
    counts = drawn.select("text", "lang").transform(in_arrow, _counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = F.when(F.col("key") >= 4 << 32, 4).when(F.col("key") >= 3 << 24, 3).otherwise(2)
    counts = counts.withColumn("order", order)
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "order"]).withColumn("share", F.col("n") / F.col("total")).where((F.col("share") >= least_share) & (F.col("n") > 1))
    most = shares.groupBy("key").agg(F.max("share").alias("most"))
    kept = shares.join(most, "key").where(F.col("share") >= ratio * F.col("most")).select("lang", "key").toArrow()
    lang, key = np.array(kept["lang"].to_pylist(), object), kept["key"].to_numpy().view(np.uint64)
    return Filter(languages, max(range(len(languages)), key=lambda k: sizes[languages[k]]), [(k, key[lang == name]) for k, name in enumerate(languages)])


def identify(docs: DataFrame, model: Filter, carried: list[str] | None = None) -> DataFrame:
    """doc_id of each row, or the ``carried`` columns in a struct of that name, with lang_pred and score."""
    whole, carried = spans.restored(carried), carried or ["doc_id"]
    shared = share(docs.sparkSession, model)
    table, at = spans.with_text(docs, carried)

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[: len(carried)], "lang_pred", "score"])

    found = table.transform(in_arrow, run, ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carried)), "lang_pred string, score double"]))
    return found.select(whole, "lang_pred", "score")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    held = fold("doc_id", 4) == 2
    model = learn(docs.where(~held))
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

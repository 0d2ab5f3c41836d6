"""Quality rules with thresholds that follow each language and source.

Four measures are taken of every text.  Their quartiles come from mergeable
KLL quantile sketches, one set for each (lang, source), for each lang and for
all rows; a group of fewer than ``least`` rows uses its language's, and a small
language all rows'.  A document is dropped when a measure lies further from its
group's quartiles than ``reach`` times their distance, and than ``STEPS`` of the
measure's own steps in the group: what one more repeated line, one more repeated
window or one more symbol in each line makes in a text of median length, which
the sketches tell as well.  Words have no usual length of zero, so where a group hardly varies in it
(copies of one text, say) half the distance in its language counts.  No threshold is a fixed number.
One repetition is the step in which repeats are
counted, so repeated lines and words are judged beyond one repeated line and one
repeated passage (its two places); the counts and the base rule take all.

Groups with more than 1/``hot`` of all rows (at most ``hot`` of them) have their
thresholds broadcast; the other groups' thresholds are joined by a shuffle, in
which no key can be hot.

Edge cases: null text has no words and fails the base rule; null lang or source
is a group of its own; equal rows are judged each for itself, alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import in_arrow, stage

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
# of a character's bytes the first counts
_FIRST = (np.arange(256) & 0xC0) != 0x80
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_more_repeats")
WINDOW = 5
#: Steps of a measure that are never an outlier.
STEPS = 2

#: Measure, its step in a text of median length, and whether low values are judged too.
MEASURES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", "n_lines / word_chars", False),
    "word_length": ("word_chars / greatest(n_words, 1)", "1 / n_words", True),
    "dup_line_share": ("greatest(n_dup_lines - 1, 0) / greatest(n_lines, 1)", "1 / n_lines", False),
    "repeat_share": ("n_more_repeats / greatest(n_words, 1)", f"{WINDOW} / n_words", False),
}
#: What a text's length is told by.
_LENGTHS = ("n_words", "word_chars", "n_lines")


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A line for each of ``_COUNTS``, the number of lines with a word, and the repeated words beyond one repetition, of a block's texts."""
    n = len(offsets) - 1
    a, b = spans.white_words(data, offsets)
    row = spans.rows_of(offsets, a)
    per_row = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    x, y = spans.runs(data != 10, offsets)
    inked = np.concatenate(([0], np.cumsum(~spans.WHITE[data])))
    some = inked[y] > inked[x]
    x, y = x[some], y[some]
    line_row = spans.rows_of(offsets, x)
    lines = np.bincount(line_row, minlength=n)
    distinct = np.bincount(spans.counted(line_row, spans.hashes(data, x, y))[0], minlength=n)
    repeated, more = _repeats(spans.hashes(data, a, b), row, n)
    return np.stack((np.bincount(row, minlength=n), per_row(~spans.WHITE[data] & _FIRST[data]), per_row(_SYMBOL[data]), lines - distinct, repeated, lines, more))


def _repeats(h: np.ndarray, row: np.ndarray, n: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the words inside a window that occurs twice or more; and without the two longest passages of them."""
    g, at = spans.grams(h, row, window)
    order = np.lexsort((g, row[at]))
    g, at = g[order], at[order]
    twin = (g[1:] == g[:-1]) & (row[at[1:]] == row[at[:-1]])
    hit = at[np.concatenate((twin, [False])) | np.concatenate(([False], twin))] if len(at) else at
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    first, last = spans.runs(np.cumsum(cover)[:-1] > 0, np.searchsorted(row, np.arange(n + 1)))
    size, of = last - first, row[first]
    order = np.lexsort((-size, of))
    size, of = size[order], of[order]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    total, rest = (np.bincount(of, size * keep, n).astype(np.int64) for keep in (1, nth >= 2))
    return total, rest


def _measured(batches):
    for batch in batches:
        found = [np.zeros((len(_COUNTS) + len(_MORE), 0), np.int64), *(measures(data, offsets) for _, data, offsets in spans.blocks(batch.column(1)))]
        columns = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns), batch.column(2), batch.column(3)], ["doc_id", *_COUNTS, *_MORE, "lang", "source"])


def _quartiles(measured: DataFrame, keys: list[str]) -> DataFrame:
    """For each group its rows and, from sketches, the quartiles of each measure and the step of it."""
    sketches = measured.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(m).alias(m) for m in MEASURES), *(F.kll_sketch_agg_bigint(c).alias(c) for c in _LENGTHS)).where("rows > 0")
    quantile = lambda m, q: F.kll_sketch_get_quantile_double(m, F.lit(q))
    told = sketches.select(*keys, "rows", *(quantile(m, q).alias(f"{m}_{name}") for m in MEASURES for name, q in (("low", 0.25), ("high", 0.75))), *(F.greatest(F.lit(1.0), F.kll_sketch_get_quantile_bigint(c, F.lit(0.5))).alias(c) for c in _LENGTHS))
    quartiles = [c for m in MEASURES for c in (f"{m}_low", f"{m}_high")]
    return told.select(*keys, "rows", *quartiles, *((F.expr(step) * STEPS).alias(f"{m}_step") for m, (_, step, _) in MEASURES.items()))


def _bounds(own: str, wider: str, reach: float) -> list:
    """The bounds of each measure from a group's quartiles and those of what it is part of."""
    out = []
    for m, (_, _, both) in MEASURES.items():
        low, high = F.col(f"{own}.{m}_low"), F.col(f"{own}.{m}_high")
        apart = F.greatest(high - low, (F.col(f"{wider}.{m}_high") - F.col(f"{wider}.{m}_low")) / 2) if both else high - low
        width = F.greatest(reach * apart, F.col(f"{own}.{m}_step"))
        out += [(low - width if both else F.lit(float("-inf"))).alias(f"{m}_low"), (high + width).alias(f"{m}_high")]
    return out


def quality(docs: DataFrame, reach: float = 4.0, least: int = 200, hot: int = 256) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of ``docs``."""
    docs = docs.select("doc_id", "text", "lang", "source")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    raw = docs.transform(in_arrow, _measured, f"doc_id {kinds['doc_id']}, {', '.join(f'{c} long' for c in (*_COUNTS, *_MORE))}, lang {kinds['lang']}, source {kinds['source']}")
    measured = stage(raw.withColumns({m: F.expr(e).cast("double") for m, (e, _, _) in MEASURES.items()}), "measured")

    words = measured.where("n_words > 0")
    limits = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    packed = lambda t, name: F.struct(*(c for c in t.columns if c not in ("lang", "source"))).alias(name)
    fine, coarse, overall = (stage(_quartiles(words, keys), "quartiles") for keys in (["lang", "source"], ["lang"], []))
    enough = lambda name: F.col(f"{name}.rows") >= least
    by_lang = coarse.select("lang", packed(coarse, "own")).crossJoin(F.broadcast(overall.select(packed(overall, "whole"))))
    by_lang = by_lang.select(F.col("lang").alias("of"), F.when(enough("own"), F.col("own")).otherwise(F.col("whole")).alias("tongue"), "whole")
    groups = fine.select("lang", "source", packed(fine, "own")).join(by_lang, F.col("lang").eqNullSafe(F.col("of")))
    groups = groups.select("lang", "source", F.col("own.rows").alias("rows"), F.when(enough("own"), F.col("own")).otherwise(F.col("tongue")).alias("own"), F.when(enough("own"), F.col("tongue")).otherwise(F.col("whole")).alias("wider"))
    per_group = stage(groups.select("lang", "source", "rows", *_bounds("own", "wider", reach)), "thresholds")

    share = measured.count() / hot
    large, small = per_group.where(F.col("rows") > share), per_group.where(F.col("rows") <= share)
    same = lambda t: F.col("lang").eqNullSafe(t["t_lang"]) & F.col("source").eqNullSafe(t["t_source"])
    named = lambda t, struct: t.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.struct(*limits).alias(struct))
    a, b = named(large, "of_large"), named(small, "of_small")
    first = measured.join(F.broadcast(a), same(a), "left").drop("t_lang", "t_source")
    found = first.where("of_large is not null or n_words = 0").withColumn("limits", F.col("of_large"))
    rest = first.where("of_large is null and n_words > 0").hint("shuffle_merge").join(b, same(b), "left").withColumn("limits", F.col("of_small"))
    both = found.select("doc_id", *_COUNTS, *MEASURES, "limits").unionByName(rest.select("doc_id", *_COUNTS, *MEASURES, "limits"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"limits.{m}_low"), F.col(f"limits.{m}_high"))
    return both.select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))

"""A corpus pipeline over ``documents``.

Texts without a recognisable language go; of each near-duplicate class one
document stays; documents contaminated by ``benchmark`` go; secrets are
replaced in the texts that stay; what is left is packed into sequences.  All
stages but the last return the columns of ``documents``.

Rows are told apart by doc_id and the hash of their text, so null ids and ids
given twice are handled; rows that are equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontamination, language_id, near_dedup, secrets
from tracefold.llm.packing import pack
from tracefold.llm.queries import table, tokenizer
from tracefold.llm.shared import mark, release, stage
from tracefold.llm.spans import quoted

#: Least share of a text's n-grams that its language must have.
LEAST_SCORE = 0.2


def _columns(of: list[str], within: str = "") -> list[Column]:
    return [F.col(within + quoted(c)) for c in of]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of doc_id and text, under a name that no column has."""
    key = "document_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs, language_id.learn(docs), docs.columns)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*_columns(docs.columns, "carried."))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    kept = near_dedup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key))
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(*_columns(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    found = decontamination.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.where("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(*_columns(docs.columns))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kinds = dict(docs.dtypes)
    found = secrets.scan(docs, secrets.train(docs), docs.columns)
    clean = found.withColumn("text", secrets.redacted("carried.text", "spans"))
    new = {"text": F.col("text")}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(kinds["n_chars"])).otherwise(F.col("carried.n_chars"))
    return clean.select(*(new.get(c, F.col("carried." + quoted(c))).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("word_bpe_49k.json"))


Step = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the stage before has staged and shared.
_before: list[tuple] = []


def _stage(step: Step, first: bool = False) -> Step:
    """``step``, which begins by clearing what the stage before it has staged: its result has been written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            for since, until in _before:
                release(since, until)
        _before.clear()
        since = mark()
        found = step(spark, docs, sf_dir)
        _before.append((since, mark()))
        return found

    return run


STAGES = [
    ("language ID", _stage(identify_language, first=True)),
    ("near-dedup", _stage(drop_near_duplicates)),
    ("decontamination", _stage(drop_contaminated)),
    ("secret scans", _stage(replace_secrets)),
    ("packing", _stage(pack_sequences)),
]

#: Near-duplicate classes, the network and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        found = step(spark, docs, sf_dir)
        since = mark()
        docs = stage(found, name.replace(" ", "_"))
        if written:
            release(*written.pop())
        written.append((since, mark()))
    found = STAGES[-1][1](spark, docs, sf_dir)
    release(*written.pop())  # packing has read its documents once and written their pieces
    return found

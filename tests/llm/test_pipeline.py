"""The pipeline against brute force, stage by stage and as a whole."""

import regex
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as contamination
from test_near_dedup import brute as classes
from tokenizers import Tokenizer

import corpus_pipeline as P
from tracefold.llm import secrets
from tracefold.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(small):
    odd = [(9001, None, "en", "x", 0), (9002, " 12 -- 34 ", "en", "x", 9), (9003, "", None, None, 0), (None, "the text without an id has some words in it", "en", "x", 40)]
    again = small.limit(20).withColumn("doc_id", F.col("doc_id") + 5000)
    extra = small.sparkSession.createDataFrame(odd, small.schema)
    return small.union(again).union(small.limit(3)).union(extra)


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage(spark, docs):
    names = docs.columns
    one = P.identify_language(spark, docs, SF)
    assert one.columns == names
    want = sorted((r for r in rows(docs) if r[1] and regex.search(r"\p{L}", r[1])), key=str)
    assert sorted(rows(one), key=str) == want

    two = P.drop_near_duplicates(spark, one, SF)
    assert two.columns == names
    by = {}
    for r, c in zip(want, classes(want)):
        by.setdefault(c, []).append(r)
    got = rows(two)
    assert len(got) == len(by)
    assert all(sum(r in group for r in got) == 1 for group in by.values())

    three = P.drop_contaminated(spark, two, SF)
    assert three.columns == names
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {w[0] for w in contamination(got, items) if w[5]}
    assert bad and sorted(rows(three), key=str) == sorted((r for r in got if r[0] not in bad), key=str)

    planted = three.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" token = 'abcdef0123456789' end"))).otherwise(F.col("text")))
    four = P.replace_secrets(spark, planted, SF)
    assert four.columns == names and four.count() == planted.count()
    for r in four.select("text", "n_chars").collect():
        assert not secrets.base_spans(r.text)
    assert four.where("text like '%[secret]% end'").count() == planted.where("doc_id % 7 = 0").count()
    assert four.where("n_chars != length(text) and text like '%[secret]%'").count() == 0


def test_whole(spark):
    out = P.run(spark, SF).collect()
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    plain = [k for k in size if not secrets.base_spans(texts[k])]
    assert len(plain) > 50
    assert all(size[k] == len(library.encode(texts[k], add_special_tokens=False).ids) + 1 for k in plain)
    assert [len(n) > 0 and callable(f) for n, f in P.STAGES] == [True] * 5


STEPS = [P.identify_language, P.drop_near_duplicates, P.drop_contaminated, P.replace_secrets]


def test_clashing_names_and_very_long_texts(spark, small):
    """Columns named as the stages' own stay as they are; a text of 300,000 words goes through whole."""
    names = ("score", "lang_pred", "spans", "carried", "document_key", "kept", "class_id", "row", "c0", "contaminated", "a.b", "label", "sequence")
    long = [(9100, " ".join(f"word{k % 977} the other" for k in range(100_000)), "en", "x", 1), (9101, "z" * 200_000, "en", "x", 1)]
    docs = small.limit(60).union(spark.createDataFrame(long, small.schema)).withColumns({c: F.concat(F.lit("clash "), F.col("doc_id")) for c in names})
    for step in STEPS:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert 9100 in got and len(got[9100].text) == len(long[0][1])
        assert all(got[k][c] == f"clash {k}" for k in got for c in names)


def test_empty_table(spark, none):
    for step in STEPS:
        out = step(spark, none, SF)
        assert out.columns == none.columns and out.count() == 0
    assert P.pack_sequences(spark, none, SF).count() == 0


def test_a_stage_clears_what_the_one_before_left(spark, small):
    import os

    from tracefold import staging

    at = staging.mark()
    (_, one), (_, two) = P.STAGES[1:3]
    docs = one(spark, small, SF)
    docs.write.parquet(path := f"{staging.shared_dir(spark)}/written-{at}")
    left = [p.removeprefix("file:") for _, p in staging._staged[at:]]
    assert left and all(map(os.path.isdir, left))
    found = two(spark, spark.read.parquet(path), SF)
    assert not any(map(os.path.isdir, left)) and found.count() > 0

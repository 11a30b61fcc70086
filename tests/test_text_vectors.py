"""Vectors of texts: as of postings, without a shuffle of words, and no more of them than an index is tuned on."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import ivf, lexical, search
from quillspark.plans import queries
from quillspark.sources import records

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "the", "dogs dog dogged ÉTÉ\n\ndon't", "one two three four five six seven eight nine ten", "　 a1\x1c\x85b2   c3  d4\t", "dog " * 8 + "dogs " * 65_536, "cats " * 300, "!!! \U0001F600 x_y"]


def rows(df):
    return sorted((r.doc_id, list(r.vector)) for r in df.collect())


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_vectors_of_words_are_those_of_postings(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_WORDS", most)
    monkeypatch.setattr(search, "MOST_SIGNS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300 if most > 7 else 5)
    try:
        texts = ODD[:-3] + ODD[-2:] if most < 100 else ODD
        docs = records.corpus(spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
        words = lexical.indexed_words(docs)
        want = search.embed_terms(lexical.postings_of_words(words).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")), 70)
        got = rows(search.embed_words(words, 70))
        assert got == rows(want) and len(got) >= 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert search.embed_words(words.where("false")).count() == 0
    with pytest.raises(ValueError):
        search.embed_words(words, 129)


def test_ids_may_be_strings(spark):
    words = lexical.indexed_words(spark.createDataFrame([("b", "red", "fox"), ("a", "red fox", None)], "id string, title string, abstract string"))
    assert [d for d, _ in rows(search.embed_words(words))] == ["a", "b"]


def test_no_words_are_shuffled(spark, monkeypatch):
    made = []
    monkeypatch.setattr(search, "embed_words", lambda words, dims, run=search.embed_words: made.append(run(words, dims)) or made[-1])
    queries.text_embeddings(spark, DATA)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)]
    assert len(shuffled) == 1 and "hashpartitioning(doc_id" in shuffled[0] and "Aggregate" not in plan


def test_only_the_titles_that_an_index_is_tuned_on_are_embedded(spark, monkeypatch):
    monkeypatch.setattr(ivf, "MOST_TUNING", 20)
    assert 0 < queries._text_tuning(spark, DATA).count() < 60  # of 198
    assert queries._text_tuning(spark, DATA).where("query_id % 100 = 0").count() == 0


def test_white_space_is_cleaned_as_by_the_whole_pattern(spark):
    white = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = [a + "x" + b + c + "é" + a + b + "~!" + c for a in white for b in white for c in (" ", "\n", "\u3000", "")] + ["\u180e \u200b\u200b  \x1b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.coalesce(F.trim(F.regexp_replace("t", T.WHITE, " ")), F.lit(""))
    assert df.where(T.clean(F.col("t")) != whole).count() == 0


def test_titles_and_the_rest(spark):
    texts = [None, "", " ", "a", "a b c", "a b c d", " a  b\nc d  e "]
    got = records.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3).orderBy("id").collect()
    assert [(r.title, r.abstract) for r in got] == [("", ""), ("", ""), ("", ""), ("a", ""), ("a b c", ""), ("a b c", "d"), ("a b c", "d e")]

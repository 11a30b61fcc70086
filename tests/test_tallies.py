"""Postings counted in the task that has a text: equal to those of words as rows, on odd texts, and no word is a row."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import lexical, store, vocabulary
from quillspark.sources import records


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_texts():
    r = random.Random(5)
    latin = [chr(i) for i in range(256)]
    more = list("İıΣςσßẞÀéÿµªº²¼×÷中文😀 　 İK \u0085’–ǅ")
    ends = ["classes", "Ponies", "running", "hopped", "bed", "sing", "buzzing", "needed", "the", "The", "of", "ééd", "naïvés", "ggg", "ss", "ies", "sses", "xyzz"]
    out = [None, "", " ", "\t\n", "the", "_", "a" * 9000, " ".join(["word"] * 70_000)]
    for pool in (latin, latin + more, list("abcdeings \n\t"), ends):
        for _ in range(60):
            out.append((" " if pool is ends else "").join(r.choice(pool) for _ in range(r.randint(1, 80))))
    return out + [" ".join(r.choice(ends) for _ in range(30)) for _ in range(20)]


def test_tallies_are_the_postings_of_words(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id % 9 = 0").select((F.col("doc_id") % 50).alias("doc_id"), F.reverse("text").alias("text"))).repartition(3)  # repeated ids
    docs = docs.unionByName(spark.range(700, 701).select("id", F.expr("cast(X'6162FF6320C3282064C3A9' AS string)")).toDF("doc_id", "text"))  # no UTF-8
    words = lexical.indexed_words(records.corpus(docs))
    monkeypatch.setattr(lexical, "MOST_CHARACTERS", 3000)
    counted = lexical.tallies(records.parted(docs)).cache()
    want = lexical.postings_of_words(words)
    assert rows(lexical.postings_of_tallies(counted)) == rows(want) and want.count() > 1000
    assert rows(lexical.lengths_of_tallies(counted)) == rows(lexical.lengths_of_words(words))
    assert rows(lexical.dictionary_of_tallies(counted)) == rows(want.groupBy("term").agg(F.count("*"), F.count_distinct("doc_id")))


def test_stems_of_arrays(spark):
    r = random.Random(7)
    words = ["", "é", "ss", *("".join(r.choice("aeinxsdgé中") for _ in range(r.randint(0, 5))) + r.choice(["", "s", "ss", "sses", "ies", "ing", "ed", "dd", "ll", "éé"]) for _ in range(3000))]
    want = [x[0] for x in spark.createDataFrame([(w,) for w in words], "w string").select(T.stem(F.col("w"))).collect()]
    assert T.stems(pa.array(words)).to_pylist() == want


def test_an_append_makes_no_row_of_a_word(spark, tmp_path, monkeypatch):
    for name in ("indexed_words", "postings_of_words"):
        monkeypatch.setattr(lexical, name, lambda *_: pytest.fail("words became rows"))
    held = store.IndexStore(spark, str(tmp_path))
    held.append(spark.createDataFrame([(1, "Red foxes", "red FOX"), (2, None, "")], "id long, title string, abstract string"))
    assert rows(held.read().term_stats("documents")) == [("fox", 1), ("foxe", 1), ("red", 1)] and rows(held.read().term_stats())[2] == ("red", 2)


def test_one_hot_pairs_are_those_of_sets(spark):
    r = random.Random(3)
    docs = [(f"d{i}", [f"t{r.randint(0, 60)}" for _ in range(r.randint(0, 90))]) for i in range(80)] + [("long", [f"t{i % 70}" for i in range(25_000)])]
    sets = spark.createDataFrame(docs, "doc_id string, terms array<string>").repartition(3)
    pairs = sets.select("doc_id", F.explode("terms").alias("term"))
    known = vocabulary.vocabulary(pairs.select("term")).where("id % 5 <> 0").cache()
    hot = vocabulary.one_hot_pairs(pairs, sets, known)
    assert rows(hot) == rows(vocabulary.one_hot(sets, known)) and hot.count() == 81
    assert "collect_" not in hot._jdf.queryExecution().executedPlan().toString()  # no set of terms or ids is gathered row by row

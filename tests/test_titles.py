"""Titles are split off without cleaning whole texts, and are the corpus's."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans import queries
from quillspark.sources import records

ODD = [None, "", " ", "\n\t", "one", " a  b　c\td e f g h i j", "a b c d e f g h", "a b c d e f g h ", "\u0085é 中 x\x1cy z", "w " * 5000]


def test_titles_are_those_of_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    want = sorted(map(tuple, records.corpus(docs).select("id", "title").collect()))
    monkeypatch.setattr(queries, "_documents", lambda *_: docs)
    monkeypatch.setattr(records, "corpus", None)
    assert sorted(map(tuple, queries._titles(spark, "").collect())) == want
    abstracts = records.parted(docs).select(T.clean(F.col("abstract"))).collect()
    assert [r[0] for r in abstracts if r[0]] == ["i j", " ".join(["w"] * 4992)]

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.vectors import band_keys, cosine, hyperplanes
from quillspark.operators import evaluate, fusion, ivf, lexical, lsh, search
from quillspark.operators.vector import exact_knn
from quillspark.sources import records

STEMS = {"classes": "class", "studies": "studi", "running": "run", "planned": "plan", "hopped": "hop", "falling": "fall", "string": "string", "being": "being", "used": "used", "2000": "200", "1999": "199", "100": "100", "quizzes": "quizze"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_and_stems(spark):
    df = spark.createDataFrame([("a\n\tb  c   d",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clean(F.col("t"))).collect()] == ["a b c d", ""]
    got = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", T.stem(F.col("w"))).collect()
    assert dict(map(tuple, got)) == STEMS
    one = spark.createDataFrame([("Don't stop the e.g. tests, the",)], "t string").select(T.tokens(F.col("t"), ["the", "eg"]))
    assert one.first()[0] == ["dont", "stop", "test"]
    assert sorted(spark.createDataFrame([("abcabc",)], "t string").select(T.shingles(F.col("t"), 3)).first()[0]) == ["abc", "bca", "cab"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "1", "title": " x\\ny ", "abstract": null}\n{bad\n\n{"id": "2"}\n')
    raw = records.read_jsonl(spark, str(tmp_path / "in"))
    clean = records.sanitize(raw)
    assert rows(clean) == [("1", "", "x y", ""), ("2", "", "", "")]
    assert rows(records.embedding_texts(clean)) == [("1", "x y."), ("2", ".")]
    clean.write.json(str(tmp_path / "out"))
    assert rows(records.read_jsonl(spark, str(tmp_path / "out"), records.CLEAN)) == rows(clean)
    (tmp_path / "t.json").write_text(json.dumps({"q": ["a", "b"]}))
    assert rows(records.read_truth(spark, str(tmp_path / "t.json"))) == [("q", 0, "a"), ("q", 1, "b")]


@pytest.fixture
def small(spark):
    return spark.createDataFrame([("d1", "quark", "quark gluon"), ("d2", "lepton", "gluon"), ("", "quark", "")], "id string, title string, abstract string")


def test_bm25_by_hand(spark, small, tmp_path):
    index = lexical.build_index(small)
    q = spark.createDataFrame([(1, "quark gluon"), (2, "quark quark"), (3, "quark"), (4, "the of")], "query_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_search(index, q).collect()}
    assert got[1, "d1"] == 0.590563 and got[1, "d2"] == 0.214496
    assert abs(got[2, "d1"] - 2 * got[3, "d1"]) < 2e-6 and not any(k[0] == 4 for k in got)
    index.save(str(tmp_path / "i"))
    assert {(r.query_id, r.doc_id): r.score for r in search.lexical_search(str(tmp_path / "i"), q).collect()} == got
    assert tuple(index.index_stats().first()) == (2, 3, 5)


def test_rrf_by_hand(spark):
    make = lambda *ids: spark.createDataFrame([(1, i + 1, d) for i, d in enumerate(ids)], "query_id int, rank int, doc_id string")
    got = [(r.doc_id, r.score) for r in fusion.rrf([make("A", "B"), make("B", "C")]).orderBy("rank").collect()]
    assert got == [("B", 0.032522), ("A", 0.016393), ("C", 0.016129)]
    tie = fusion.rrf([make("A"), make("B")]).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == ["A", "B"]
    assert fusion.rrf([make(*"abcdefgh"), make(*"ijklmnop")], limit=5).count() == 5


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(1).standard_normal((200, 16))
    x[7] = 0
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>"), x


def test_exact_knn_and_ivf(spark, vectors):
    df, x = vectors
    q = df.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): r.doc_id for r in exact_knn(df, q, 5).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for i in range(5):
        s = np.round(u @ u[i], 6)
        s[[i, 7]] = -2
        assert [got[i, r] for r in range(1, 6)] == np.lexsort((np.arange(200), -s))[:5].tolist()
    index = ivf.build_ivf(df, 8)
    full = {(r.query_id, r["rank"]): r.doc_id for r in ivf.ivf_search(index, q, 5, nprobe=8, skip_self=True).collect()}
    assert full == got
    coded = ivf.build_ivf(df, 4, m=4, nbits=4)
    assert ivf.ivf_search(coded, q, 5, nprobe=4, coded=True).count() == 25
    with pytest.raises(ValueError):
        search.semantic_search("none", q)


def test_lsh(spark, vectors):
    df, _ = vectors
    sig = spark.createDataFrame([([1, 0, 1, 1, 0, 0, 1, 0],)], "s array<int>")
    assert sig.select(band_keys(F.col("s"), 8, 4)).first()[0] == ["1,0", "1,1", "0,0", "1,0"]
    with pytest.raises(ValueError):
        band_keys(F.col("s"), 8, 3)
    q = df.where("doc_id IN (3, 4)").withColumnRenamed("doc_id", "query_id")
    best = lsh.lsh_search(df, q, hyperplanes(32, 16), 4).where("rank = 1").collect()
    assert {r.query_id: r.doc_id for r in best} == {3: 3, 4: 4}
    assert df.where("doc_id = 7").select(cosine(F.col("vector"), F.col("vector"))).first()[0] is None


def test_summaries(spark):
    pts = spark.createDataFrame([(1, 0.1), (1, 0.3), (2, 0.3), (3, 0.5), (4, 0.4), (5, 0.9)], "x int, y double")
    assert rows(evaluate.pareto(pts, "x", "y")) == [(1, 0.3), (3, 0.5), (5, 0.9)]
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "query_id int, doc_id int")
    found = spark.createDataFrame([(1, 2), (1, 9)], "query_id int, doc_id int")
    assert rows(evaluate.recall(found, truth)) == [(1, 0.5), (2, 0.0)]
    assert rows(evaluate.histogram(spark.range(10).withColumnRenamed("id", "v"), "v", 3)) == [(1, 3), (2, 3), (3, 4)]

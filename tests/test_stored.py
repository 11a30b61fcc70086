"""What is saved is read back, and the paths that only large inputs take give the same rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import stopwords
from quillspark.functions import text as T
from quillspark.functions.vectors import hyperplanes
from quillspark.operators import evaluate, ivf, lexical, lsh, search, vector
from quillspark.sources import records
from quillspark.streaming.index import append_stream, read_appended


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(4).standard_normal((300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(3)
    return df, df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")


def test_lsh_index(spark, vectors, tmp_path):
    df, q = vectors
    planes = hyperplanes(32, 16)
    lsh.build_lsh(df, planes, 8).save(str(tmp_path / "lsh"))
    got = rows(lsh.LshIndex.load(spark, str(tmp_path / "lsh")).search(q, 5))
    assert got and got == rows(lsh.lsh_search(df, q, planes, 8, 5))


def test_ivf_index(spark, vectors, tmp_path):
    df, q = vectors
    index = ivf.build_ivf(df, 6, m=4, nbits=4)
    index.save(str(tmp_path / "ivf"))
    again = ivf.IvfIndex.load(spark, str(tmp_path / "ivf"))
    want = rows(ivf.ivf_search(index, q, 5, nprobe=3))
    assert rows(ivf.ivf_search(again, q, 5, nprobe=3)) == want
    assert "dynamicpruning" in ivf.ivf_search(again, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert rows(ivf.ivf_search(again, q, 5, nprobe=3, most_bytes=0)) == want
    assert (again.nprobe, again.shortlist) == (index.nprobe, index.shortlist)
    few = ivf.ivf_search(index, q.where("query_id = 0"), 1000, nprobe=1)  # fewer neighbours than asked for
    assert 0 < few.count() < 300
    exact = rows(vector.exact_knn(df, q, 5, skip_self=False))
    assert rows(ivf.ivf_search(again, q, 5, nprobe=6)) == exact == rows(ivf.ivf_search(again, q, 5, nprobe=6, coded=True, shortlist=300)) == rows(ivf.ivf_search(again, q, 5, nprobe=6, coded=True, shortlist=300, most_bytes=0))
    assert ivf.ivf_search(again, q, 5, nprobe=6, coded=True, shortlist=0).count() == 150


def test_ivf_of_few_and_odd_vectors(spark):
    schema = "doc_id long, vector array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (4, [1.0, 1.0])], schema)
    q = spark.createDataFrame([(9, [1.0, 0.1]), (8, [0.0, 0.0]), (7, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.doc_id) for r in ivf.ivf_search(ivf.build_ivf(df), q, nprobe=5).orderBy("rank").collect()] == [(9, 1), (9, 4), (9, 4)]
    none = ivf.build_ivf(df.where("false"), m=2)
    assert ivf.ivf_search(none, q.where("query_id = 9"), coded=True).count() == 0


def test_chunks_train_as_well_as_the_whole(spark, monkeypatch):
    """Mini-batches of an eighth of the vectors leave centres that are about as near as whole passes do."""
    r = np.random.default_rng(2)
    x = r.standard_normal((8, 12))[r.integers(0, 8, 1600)] + 0.3 * r.standard_normal((1600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = []
    for chunk in (10**9, 25):  # whole passes; eight chunks
        monkeypatch.setattr(ivf, "CHUNK", chunk)
        c = ivf.build_ivf(df, 8, m=4, nbits=4).centroids
        near.append((u @ c.T).max(1).mean())
    assert near[1] > near[0] - 0.02 and near[0] > 0.85


def test_blocks_of_queries(vectors, monkeypatch):
    df, q = vectors
    want = rows(vector.exact_knn(df, q, 7))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "MOST_BROADCAST", 0)
    assert rows(vector.exact_knn(df, q, 7)) == want and len(want) == 210
    assert vector.exact_knn(df, q.where("false"), 7).count() == 0 == vector.exact_knn(df.where("false"), q, 7).count()


def test_appended_index(spark, tmp_path):
    schema = "id string, title string, abstract string"
    source = str(tmp_path / "in")
    for batch in ([("a", "red fox", "den"), ("b", "blue bird", "nest")], [("a", "green fox", "den den")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        append_stream(stream, str(tmp_path / "index"), str(tmp_path / "log")).awaitTermination()
    got = read_appended(spark, str(tmp_path / "index"))
    want = lexical.build_index(spark.createDataFrame([("a", "green fox", "den den"), ("b", "blue bird", "nest")], schema))
    assert rows(got.postings) == rows(want.postings) and rows(got.lengths) == rows(want.lengths)


def test_repeated_ids_and_stop_list(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red fox", ""), ("a", "red fox", "den"), ("b", "fox den", "")], "id string, title string, abstract string")
    index = lexical.build_index(docs)
    assert index.lengths.count() == 2 and index.postings.where("doc_id = 'a' AND term = 'fox'").first().tf == 1
    (tmp_path / "stop").write_text("Fox don't\nred")
    stops = stopwords.load(str(tmp_path / "stop"))
    assert stops == ["fox", "red"]
    assert {r.term for r in lexical.build_index(docs, stops).postings.collect()} == {"den"}


def test_words_of_the_whole_text_are_those_of_each_word(spark):
    texts = ["Don't  STOP, (the) Ödön's ΣΑΣ. x_1 -- ½ 　 e.g. été; quizzes adds add sees as ass", "", None, " . ", "1999-2000 İstanbul"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.filter(F.transform(F.split(T.clean(F.col("t")), " "), lambda w: F.regexp_replace(F.lower(w), T.NOT_WORD, "")), lambda w: w != "")
    for a, b, c in df.select(bare, T.words(F.col("t"), []), T.tokens(F.col("t"), [])).collect():
        assert a == b
        stems = spark.createDataFrame([(w,) for w in a], "w string").select(T.stem(F.col("w"))).collect() if a else []
        assert c == [r[0] for r in stems]


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([[0.5, 1.0, 0.30000001], [0.7, 2.0, 0.4]]))
    recalls = records.read_recalls(spark, str(tmp_path / "r.json"))
    assert rows(recalls) == [(0.5, 1.0, 0.3), (0.7, 2.0, 0.4)]
    assert rows(evaluate.recall_pivot(recalls, "b", "k1", (1.0, 2.0), "k1_").select("b", "k1_1_0", "k1_2_0").fillna(-1)) == [(0.3, 0.5, -1.0), (0.4, -1.0, 0.7)]
    truth = spark.createDataFrame([("q", 1, "b"), ("q", 0, "a")], "query_id string, pos int, neighbor_id string")
    records.write_truth(truth, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first().neighbors == ["a", "b"]
    assert rows(records.read_truth_lines(spark, str(tmp_path / "t"))) == [("q", 0, "a"), ("q", 1, "b")]
    raw = spark.createDataFrame([("q", "text"), ("z", "no")], "id string, abstract string")
    assert rows(records.truth_queries(raw, truth)) == [("q", "text")]
    assert records.random_rows(spark.range(50), 7).distinct().count() == 7 and records.random_rows(spark.range(3), 7).count() == 3
    assert rows(records.first_rows(spark.range(9, -1, -1), 2)) == [(0,), (1,)]


def test_titles(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id": "1", "clean_title": "z"}\n{"id": "1", "clean_title": "a"}\n{"id": "2"}\n')
    assert rows(records.titles(records.read_jsonl(spark, str(tmp_path / "t.json"), records.CLEAN))) == [("1", "a"), ("2", "No Title")]
    tokens = lexical.tokenized(spark.createDataFrame([("1", "red foxes", "den")], "id string, title string, abstract string"))
    records.write_tokenized(tokens, str(tmp_path / "tokens"))
    assert spark.read.json(str(tmp_path / "tokens")).first().title_tokens == ["red", "foxe"]


def test_embedding(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = search.embed(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id int, text string"), load, 1)
    assert rows(got.select("doc_id", F.concat_ws(",", F.col("vector").cast("array<string>")))) == [(1, "3.0,1.0"), (2, "0.0,1.0")]

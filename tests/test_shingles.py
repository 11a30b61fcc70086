"""Shingles by arrays, against plain loops: long and odd texts, repeated keys, and no row for each shingle."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import minhash
from quillspark.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    long = "".join(r.choice("ab c😀é中") for _ in range(2 * minhash.SLICE + 9))
    return [(1, long), (2, "abcdefgh"), (2, "hgfedcba"), (3, "abcdefg"), (4, None), (5, ""), (6, "a" * 700), (None, "some text")]


def test_signatures_of_long_texts_and_repeated_keys(spark, texts):
    p = minhash.Permutations()
    weights, factors, shifts = p.numbers()
    hashes = {}
    for key, t in texts:
        for i in range(len(t or "") - 7):
            hashes.setdefault(key, set()).add(sum(ord(c) * w for c, w in zip(t[i : i + 8], weights)) % minhash.PRIME)
    signed = minhash.signatures(spark.createDataFrame(texts, "doc_id long, clean string"), "doc_id")
    assert "Generate" not in signed._jdf.queryExecution().executedPlan().toString()  # no row for each shingle
    want = {key: [min((x * a + b) % minhash.PRIME for x in h) for a, b in zip(factors, shifts)] for key, h in hashes.items()}
    assert {r.doc_id: r.signature for r in signed.collect()} == want


def test_counts_and_overlaps(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, clean string")
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} if t else set() for _, t in texts]
    for exact in (True, False):
        got = minhash.shingle_counts(df, 8, exact).collect()
        assert sorted((repr(r.doc_id), r.clean or "", r.n_shingles) for r in got) == sorted((repr(k), t or "", len(s)) for (k, t), s in zip(texts, sets))
    pairs = [(i, j, t, u) for i, (_, t) in enumerate(texts) for j, (_, u) in enumerate(texts)]
    found = minhash.overlaps(spark.createDataFrame(pairs, "a long, b long, clean_a string, clean_b string"), 8)
    assert {(r.a, r.b): (r.common, r.total) for r in found.collect()} == {(i, j): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, j, _, _ in pairs}


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(1).select("id", F.expr("cast(X'6162FF63646566676869' AS string)").alias("clean"))
    assert minhash.shingle_counts(df, 8).first().n_shingles == 3 and minhash.signatures(df, "id").count() == 1


def test_sets_are_not_shuffled(spark):
    docs = minhash.text_hashes(spark.read.parquet(f"{DATA}/documents.parquet"))
    sets = minhash._sets(docs, docs.select(F.col("text_hash").alias("node")), 8)
    assert not any(f.dataType.simpleString().startswith("array") for f in sets.schema)


def test_text_vectors_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(queries, "_index", lambda *_: pytest.fail("an index was built"))
    assert queries.text_embeddings(spark, DATA).count() > 0

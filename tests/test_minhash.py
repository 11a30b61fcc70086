"""Signatures, near duplicates, components, vocabulary, text vectors and LSH groups against plain loops."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.vectors import hyperplanes
from quillspark.operators import evaluate, ivf, lsh, minhash, search, vocabulary
from quillspark.operators.components import connected_components
from quillspark.operators.vector import signatures


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklé😀") for _ in range(r.randint(2, 7)))
    out = [None, "", "short", " short ", "exactly8", "exactly8 "]
    for _ in range(12):
        base = [word() for _ in range(40)]
        out.append(" ".join(base))
        for _ in range(3):
            c = list(base)
            for _ in range(r.randint(0, 5)):
                c[r.randrange(40)] = word()
            out.append(" ".join(c).replace(" ", r.choice([" ", "  ", "\n"])))
    return out


def _sets(texts, k):
    clean = [re.sub(r"\s+", " ", t or "").strip() for t in texts]
    return [{c[i : i + k] for i in range(len(c) - k + 1)} for c in clean]


def _classes(ids, sets, percent):
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ids[i] is not None and ids[j] is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    return sorted(((ids[i], min(ids[j] for j in g) if ids[i] is not None else None, len(g)) for g in groups.values() for i in g), key=repr)


@pytest.mark.parametrize("crowd", [1, 500])
def test_near_duplicates_are_those_of_all_pairs(spark, crowd):
    texts = _texts()
    ids = [i if i % 9 else None for i in range(1, len(texts) + 1)]
    ids[10] = ids[12]  # a repeated id with other texts
    docs = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, clean string").repartition(3)
    got = rows(minhash.near_duplicates(docs, crowd=crowd))
    assert got == _classes(ids, _sets(texts, 8), 75) and any(n > 2 for _, _, n in got)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_a_crowd_of_copies_makes_no_pairs(spark):
    """1,000 copies of each of two texts, and 60 near copies of a third, are three classes."""
    r = random.Random(1)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(60)]
    texts = ["first text that is copied often"] * 1000 + ["second text, copied often as well"] * 1000 + near
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs).groupBy("class_id", "n_class").agg(F.count("*").alias("n"))
    assert rows(got) == [(0, 1000, 1000), (1000, 1000, 1000), (2000, 60, 60)]


def test_signatures_by_plain_loops(spark):
    p = minhash.Permutations(7, 3, 1)
    weights, factors, shifts = p.numbers()
    texts = ["abcabcd", "ab", "", "xyz", "😀é a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, clean string")
    want = []
    for i, t in enumerate(texts):
        h = [sum(ord(t[a + j]) * w for j, w in enumerate(weights)) % minhash.PRIME for a in range(len(t) - 2)]
        if h:
            want.append((i, [min((x * a + b) % minhash.PRIME for x in h) for a, b in zip(factors, shifts)]))
    assert rows(minhash.signatures(df, "doc_id", p)) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        minhash.near_duplicates(df.withColumnRenamed("clean", "text"), bands=3, permutations=p)


def test_agreement_estimates_similarity(spark):
    texts = _texts()[6:]
    sets = _sets(texts, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if i // 4 == j // 4]
    got = minhash.compare(docs, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert abs(r.jaccard - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-6
    assert np.mean([abs(r.jaccard - r.agreement) for r in got]) < 0.05


def test_components_by_plain_loops(spark):
    r = random.Random(3)
    for links in ([(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)], [(r.randint(0, 80), r.randint(0, 80)) for _ in range(70)], [(5, 5)], []):
        root = {x: x for pair in links for x in pair}
        for _ in range(len(root)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        df = spark.createDataFrame([*links, *links[:2], (None, 3)], "a long, b long")
        assert rows(connected_components(df)) == sorted(((k, v) for k, v in root.items() if k != v), key=repr)


def test_vocabulary_and_one_hot(spark):
    r = random.Random(2)
    docs = [(i, [r.choice("abcdefghijklmnopqrstuvwxyzéß中Z") * r.randint(1, 3) for _ in range(r.randint(0, 12))]) for i in range(40)] + [(99, None), (3, ["a", "a"])]
    df = spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(5)
    known = vocabulary.vocabulary(df.select(F.explode("terms").alias("term")))
    names = sorted({t for _, ts in docs for t in ts or []}, key=lambda t: t.encode())
    assert rows(known) == sorted(((t, i) for i, t in enumerate(names)), key=repr)
    some = known.where("id % 2 = 0")
    want = sorted(((k, -(-len(names) // 2), sorted({names.index(t) for t in ts or [] if names.index(t) % 2 == 0})) for k, ts in docs), key=repr)
    assert rows(vocabulary.one_hot(df, some)) == want
    assert vocabulary.vocabulary(known.where("false")).count() == 0


def test_text_vectors(spark):
    texts = ["red fox den", "red fox fox fox hole", "blue bird", "", "the"]
    vectors = search.embed_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dims=40)
    sign = lambda t, j: 1 if int(hashlib.md5(t.encode()).hexdigest()[8 * (j // 32) : 8 * (j // 32) + 8], 16) >> (j % 32) & 1 else -1
    want = []
    for i, t in enumerate(texts[:3]):
        tf = {w: t.split().count(w) for w in t.split()}
        want.append((i, [float(sum(n.bit_length() * sign(w, j) for w, n in tf.items())) for j in range(40)]))
    assert rows(vectors) == want
    vectors = search.embed_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    q = spark.createDataFrame([(7, "red foxes"), (8, "bird"), (9, "the")], "query_id long, text string")
    exact = rows(search.semantic_text_search("exact", q, 2, vectors=vectors))
    assert [r[2] for r in exact if r[1] == 1] == [0, 2] or [r[2] for r in exact if r[1] == 1] == [1, 2]
    assert rows(search.semantic_text_search("IVF", q, 2, index=ivf.build_ivf(vectors), nprobe=9)) == exact
    found = rows(search.semantic_text_search("lsh", q, 2, vectors=vectors, planes=hyperplanes(64, 64), bands=64))
    assert found == exact
    with pytest.raises(ValueError):
        search.embed_terms(vectors, 129)


def test_lsh_groups_and_salts(spark, monkeypatch):
    x = np.random.default_rng(1).standard_normal((120, 8))
    x[60:] = x[0]  # half of all rows in one bucket of each band
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(3)
    table = lsh.band_table(signatures(df, hyperplanes(16, 8)), 16, 4)
    buckets = {}
    for d, band, bucket in table.collect():
        buckets.setdefault((band, bucket), []).append(d)
    named = {}
    for key, ids in sorted(buckets.items()):
        if len(ids) > 1:
            named.setdefault(tuple(sorted(ids)), key)
    assert rows(lsh.candidate_groups(table)) == sorted(((*key, d) for ids, key in named.items() for d in ids), key=repr)
    asked = table.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    want = rows(lsh.candidates(table, asked))
    monkeypatch.setattr(lsh, "MOST_ASKED", 0)
    got = lsh.salted_join(table, asked, ["band", "bucket"], 5)
    assert rows(got.select("query_id", "doc_id").distinct()) == want == rows(lsh.candidates(table, asked))
    # the rows of the crowded bucket are dealt by salts
    assert got.count() == table.join(asked, ["band", "bucket"]).count()


def test_pareto_over_many_ranges(spark):
    r = random.Random(6)
    points = [(x, x / 5 + r.randint(0, 30) / 10, i) for i in range(400) for x in [r.randint(0, 40)]] + [(3, None, 1000), (0, 2.0, 1001)]
    best, want = -1.0, []
    for x, y, i in sorted((p for p in points if p[1] is not None), key=lambda p: (p[0], -p[1], p[2])):
        if y > best:
            best = y
            want.append((x, y, i))
    df = spark.createDataFrame(points, "x int, y double, i int").repartition(6)
    assert rows(evaluate.pareto(df, "x", "y", ["i"])) == sorted(want, key=repr) and len(want) > 2
    assert evaluate.pareto(df.where("false"), "x", "y").count() == 0
    plan = evaluate.pareto(df, "x", "y", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_words_of_shingles_match_the_text_functions(spark):
    df = spark.createDataFrame([("abc abc é",)], "t string")
    assert set(df.select(T.shingles(F.col("t"), 4)).first()[0]) == _sets(["abc abc é"], 4)[0]

"""Searches of many queries: equal to those of few, and only a task's best of each query leave it."""

import numpy as np
import pytest

from quillspark.operators import ivf, vector

K, N = 3, 400


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(5).standard_normal((N, 8))
    x[200:260] = x[0]  # a large group of copies
    x[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    return x, df, df.where("doc_id % 10 IN (0, 9)").withColumnRenamed("doc_id", "query_id")


def caught(monkeypatch, module, known):
    """``ranked`` of a module, with the number of rows that it is given."""
    seen, old = [], module.ranked
    monkeypatch.setattr(module, "ranked", lambda df, k, *a: (seen.append((df.count(), df.rdd.getNumPartitions())), old(df, k, *a))[1])
    return seen


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("skip_self", [False, True])
def test_exact_neighbours_by_plain_loops(spark, table, monkeypatch, skip_self):
    x, df, asked = table
    monkeypatch.setattr(vector, "QUERY_BLOCK", 32)
    monkeypatch.setattr(vector, "SCORES", 500)
    seen = caught(monkeypatch, vector, N)
    got = rows(vector.exact_knn(df.coalesce(2), asked, K, skip_self))
    u = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), np.nan)[:, None]
    want = []
    for q in range(N):
        if q % 10 in (0, 9) and q != 9:
            s = np.round(u @ u[q], 6)
            best = sorted((-s[d], d) for d in range(N) if not np.isnan(s[d]) and not (skip_self and d == q))[:K]
            want += [(q, i, d, -v) for i, (v, d) in enumerate(best, 1)]
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    n, parts = seen[0]
    assert n <= parts * asked.count() * K  # and not K for each of the blocks of 32 vectors


@pytest.mark.parametrize("skip_self", [False, True])
def test_cells_meet_blocks_of_queries(spark, table, monkeypatch, skip_self):
    _, df, asked = table
    index = ivf.build_ivf(df, 20, m=4, nbits=3)
    index.cells = index.cells.coalesce(1)
    kinds = {"vectors": {}, "codes": {"coded": True, "shortlist": 0}, "shortlist": {"coded": True, "shortlist": 40}, "all": {"coded": True, "shortlist": 1000}}
    want = {n: rows(ivf.ivf_search(index, asked, K, nprobe=12, skip_self=skip_self, **o)) for n, o in kinds.items()}
    monkeypatch.setattr(ivf, "BLOCK", 64)
    monkeypatch.setattr(vector, "SCORES", 300)
    for n, o in kinds.items():
        seen = caught(monkeypatch, ivf, N)
        assert rows(ivf.ivf_search(index, asked, K, nprobe=12, skip_self=skip_self, most_bytes=0, **o)) == want[n], n
        if n in ("vectors", "codes"):
            assert seen[0][0] <= seen[0][1] * asked.count() * K  # and not K for each cell that a query probes
        monkeypatch.undo()
        monkeypatch.setattr(vector, "SCORES", 300)
    monkeypatch.setattr(ivf, "MOST_SHORTLISTED", 0)
    monkeypatch.setattr(vector, "MOST_HELD", 0)
    monkeypatch.setattr(ivf, "MOST_HELD", 0)
    for n in ("shortlist", "all"):  # blocks are broadcast, and what is held is given up after each batch
        assert rows(ivf.ivf_search(index, asked, K, nprobe=12, skip_self=skip_self, **kinds[n])) == want[n], n

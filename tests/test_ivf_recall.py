"""Recall of the index searches against exact neighbours, the query itself left out, on the tables' vectors."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.vectors import hyperplanes
from quillspark.operators import ivf, lsh
from quillspark.operators.vector import exact_knn
from quillspark.plans import queries


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    data = f"/root/testdata/{sf}"
    vectors = queries._vectors(spark, data)
    own = queries._vector_queries(spark, data)
    # vectors that no index was tuned on, and that aren't in the tables
    noise = F.transform("vector", lambda x, i: x + F.lit(0.02) * F.sin(i * 37 + F.col("query_id")))
    unseen = vectors.where("doc_id % 100 BETWEEN 3 AND 20").withColumnRenamed("doc_id", "query_id").select("query_id", noise.cast("array<float>").alias("vector"))
    for asked in (own, unseen):
        want = pairs(exact_knn(vectors, asked, skip_self=True))
        searches = {
            "ivf": ivf.ivf_search(queries._ivf(spark, data), asked, skip_self=True),
            "pq": ivf.ivf_search(queries._ivf(spark, data, 8), asked, skip_self=True, coded=True),
            "lsh": lsh.lsh_search(vectors, asked, hyperplanes(queries.SEARCH_BITS, queries.DIMS), queries.SEARCH_BANDS, skip_self=True),
        }
        got = {name: len(want & pairs(df)) / len(want) for name, df in searches.items()}
        print(sf, "own" if asked is own else "unseen", got, [queries._ivf(spark, data, m).nprobe for m in (None, 8)], queries._ivf(spark, data, 8).shortlist)
        assert min(got.values()) >= 0.9

"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(rankings: list[DataFrame], k: int = 60, limit: int = 60) -> DataFrame:
    """query_id, rank, doc_id, score of rankings (query_id, rank, doc_id): the sum of 1 / (k + rank).

    Between equal scores the earlier ranking's order counts first, as its rows come first.
    """
    union = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("source"))
        union = part if union is None else union.unionByName(part)
    sums = [F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank")))]
    places = [F.min(F.when(F.col("source") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(rankings))]
    fused = union.groupBy("query_id", "doc_id").agg(F.round(sums[0], 6).alias("score"), *places)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *(F.col(f"r{i}").asc_nulls_last() for i in range(len(rankings))))
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")

"""Connected components of a link table by alternating star contraction, without the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._cluster import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch as a forest of stars: (a, root), root < a.  Memory follows the batch."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            was = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            root = root[root]
            if np.array_equal(root, was):
                break
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def _is_stars(links: DataFrame) -> bool:
    """Has each node one root at most, and has no root a root itself?"""
    sides = links.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return sides.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a smaller one in its component; root is the smallest.

    ``links`` has columns a, b (long).  Self links and repeated links are harmless; nulls are
    dropped; an empty table gives an empty result.  Links first become forests of stars batch by
    batch.  Each round is then a large-star and a small-star step whose minima are checkpointed,
    so a hub's rows can be split by the skew join.
    """
    links = cut(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct())
    for _ in range(most_rounds):
        if _is_stars(links):
            return links.selectExpr("a AS node", "b AS root")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        pairs = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
        links = cut(pairs.select("p.a", "p.b").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

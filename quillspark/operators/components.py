"""Connected components of a link table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.records import cut


def _settled(links: DataFrame) -> bool:
    """Has each node one smaller one, which itself has none?"""
    roots = links.groupBy("a").agg(F.count("*").alias("n")).select("a", "n")
    return links.select(F.col("b").alias("a")).distinct().join(roots, "a", "left_semi").isEmpty() and roots.where("n > 1").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for each node of links (a, b) that has a smaller one in its component; root is the least.

    Self links, repeated links and nulls are harmless; an empty table gives an empty result.  Each round
    hangs every node's larger neighbours, and then its smaller ones, on the least of them; a round's links
    are written to the shared folder, so nothing is computed twice.
    """
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(most_rounds):
        down = cut(down)
        if _settled(down):
            return down.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # larger neighbours hang on the least of a node's neighbours and itself
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        up = down.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = cut(up.join(least, "a", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).where("a <> b").distinct())
        # smaller neighbours, and the node itself, hang on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

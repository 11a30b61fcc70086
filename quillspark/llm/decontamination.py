"""Benchmark decontamination by winnowing, in DataFrame functions only.

A span is ``span`` consecutive words of an item, or all words of an item that has fewer.  For spans of
m words, k-grams of k > m / 2 words are hashed and each window of m - k + 1 k-grams keeps its least
hash: its fingerprint.  Wherever a document has an item's span, both have the same k-grams there and
so the same fingerprint; no span is missed.  Neighbouring windows mostly keep the same hash, so a
document sends one row for each run of windows with one fingerprint, not one for each word.

Fingerprints of documents and items are joined.  A hit is then extended: of the run's windows those
are hits whose first and last k-gram, which overlap or touch and so cover the span, are the item's.
The run carries the k-gram hashes that this needs, so texts are neither shuffled nor joined.
The items' fingerprints are broadcast up to ``most_broadcast`` of them and shuffled beyond, where
Spark's skew join splits a fingerprint that very many rows have.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._cluster import cut

#: What lies between words, after A-Z are lower-cased and before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased.  ``lower`` does that at once where it changes no other letter; ``translate`` is slow."""
    others = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return F.when(F.lower(others) == others, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def _words(c: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(c.cast("string"), F.lit(""))), GAP), "")


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def _hashed(rows: DataFrame, span: int) -> DataFrame:
    """``rows``, which have w, with grams (hashes of all k-grams) and least (the least of each window's).

    Both are empty where there are fewer than ``span`` words.
    """
    k = span // 2 + 1
    wide = span - k + 1
    gram = lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(k)))
    rows = rows.withColumn("grams", F.when(F.size("w") >= span, F.transform(F.sequence(F.lit(0), F.size("w") - k), gram)).otherwise(_empty())).drop("w")
    low = lambda i: F.least(*(F.get("grams", i + j) for j in range(wide))) if wide > 1 else F.get("grams", i)
    return rows.withColumn("least", F.when(F.size("grams") > 0, F.transform(F.sequence(F.lit(0), F.size("grams") - wide), low)).otherwise(_empty()))


def _last(span: int) -> int:
    """How many words after a span's first k-gram its last one begins."""
    return span - (span // 2 + 1)


def _item_windows(items: DataFrame, span: int) -> DataFrame:
    """value, first, final, item_id: fingerprint and outer k-grams of each distinct span."""
    rows = _hashed(items.select("item_id", "w"), span).select("item_id", "grams", F.posexplode_outer("least").alias("i", "value")).where("value IS NOT NULL")
    return rows.select("value", F.get("grams", F.col("i")).alias("first"), F.get("grams", F.col("i") + _last(span)).alias("final"), "item_id").distinct()


def _hits(docs: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """doc_id, text_hash, start, item_id: every place where a document has a span of an item."""
    rows = _hashed(docs.select("doc_id", "text_hash", _words(F.col("text")).alias("w")), span)
    new = lambda i: (i == 0) | (F.get("least", i - 1) != F.get("least", i))
    # runs of windows with one fingerprint; "outer", as otherwise the plan would compute all of this once more for a filter on empty ones
    runs = F.when(F.size("least") > 0, F.filter(F.sequence(F.lit(0), F.size("least") - 1), new)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("runs", runs).select("doc_id", "text_hash", "grams", "least", "runs", F.posexplode_outer("runs").alias("i", "from"))
    upto = F.coalesce(F.get("runs", F.col("i") + 1), F.size("least"))
    # never null, so that no filter on nulls cuts it out of every run: it is only cut out of those that meet an item
    near = F.coalesce(F.slice("grams", F.col("from") + 1, upto - F.col("from") + _last(span)), _empty())
    rows = rows.select("doc_id", "text_hash", F.get("least", F.col("from")).alias("value"), "from", upto.alias("upto"), near.alias("near"))
    found = rows.join(windows, "value").select("doc_id", "text_hash", "item_id", "from", "near", "first", "final", F.explode(F.sequence("from", F.col("upto") - 1)).alias("start"))
    at = F.col("start") - F.col("from")
    found = found.where((F.get("near", at) == F.col("first")) & (F.get("near", at + _last(span)) == F.col("final")))
    return found.select("doc_id", "text_hash", F.struct("start", F.lit(span).alias("length")).alias("hit"), "item_id")


def _covered(hits: Column) -> Column:
    """Words in spans sorted by their start."""

    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(end - F.greatest(x["start"], a["end"]), F.lit(0))
        return F.struct(F.greatest(end, a["end"]).alias("end"), (a["n"] + more).alias("n"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"].cast("long"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, hits of every row of ``docs`` (doc_id, text).

    n_hit is the number of words inside some place of a span of ``benchmark`` (item_id, text), item_ids the
    ids of the items with such a span, as strings and sorted so, and hits the places (start, length),
    by start.  Words are runs of ASCII letters and digits and all other characters; A-Z are
    lower-cased.  A null text has no words, and an item without words no span.  An item with a null id
    marks words but has no name.  Repeated rows of either table change nothing but that each document row
    gives a row.  An empty table of documents gives an empty result, an empty benchmark no hits.  Other
    columns are ignored.  Words are compared by two 64-bit hashes of the overlapping halves of a span.

    Items with fewer than ``span`` words are looked for in one more scan for each such number of words.
    """
    if span < 1:
        raise ValueError("a span has one word at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = cut(benchmark.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0").distinct())
    sizes = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(span))).distinct().collect())  # ``span`` numbers at most
    every = None
    for size in sizes:
        own = items if size == span else items.where(F.size("w") == size)
        windows = cut(_item_windows(own, size))
        hits = _hits(keyed, F.broadcast(windows) if windows.count() <= most_broadcast else windows, size)
        every = hits if every is None else every.unionByName(hits)
    counts = keyed.select("doc_id", "text_hash", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), ANY_GAP), "")).cast("long").alias("n_words"))
    none, nowhere = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,length:int>>")
    if every is None:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"), nowhere.alias("hits"))
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    # one document's places and items: its own words bound the first, and the second is a result column
    found = every.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("hit")).alias("hits"), names.alias("item_ids"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), _covered(F.col("hits")).alias("n_hit"), "item_ids", "hits")
    joined = counts.join(found, counts["doc_id"].eqNullSafe(found["_id"]) & (counts["text_hash"] == found["_hash"]), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("hits", nowhere).alias("hits"))

"""Dense term ids and one-hot rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.records import cut


def vocabulary(terms: DataFrame, column: str = "term") -> DataFrame:
    """term, id: the distinct terms, not null, in the order of their bytes, numbered from 0 without gaps.

    Terms are parted into ranges and sorted in each; a term's id is its place in its range and the number of
    terms in the ranges before.  No task sees more than a range, and the driver one count for each.
    """
    own = terms.select(F.col(column).alias("term")).where("term IS NOT NULL").distinct()
    ranged = own.repartitionByRange("term").sortWithinPartitions("term")
    # written once: ranges are drawn anew each time that they are computed
    placed = cut(ranged.select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    sizes = sorted(map(tuple, placed.groupBy("part").agg(F.min("row"), F.count("*")).collect()))  # a row for each range
    begins = accumulate((n for _, _, n in sizes), initial=0)
    offsets = placed.sparkSession.createDataFrame([(part, begin - first) for (part, first, _), begin in zip(sizes, begins)], "part int, shift long")
    return placed.join(F.broadcast(offsets), "part").select("term", (F.col("row") + F.col("shift")).alias("id"))


def one_hot(rows: DataFrame, known: DataFrame, terms: str = "terms", key: str = "doc_id") -> DataFrame:
    """key, size, indices: the sorted ids of each row's terms in ``known`` (term, id), and the number of known ones.

    A sparse vector of ones.  Unknown terms count for nothing; rows without terms have no indices.  Rows that
    repeat a key and its terms give one row.
    """
    size = known.agg(F.count("*").alias("size"))
    held = rows.select(key, F.xxhash64(terms).alias("_row"), F.explode_outer(F.array_distinct(terms)).alias("term"))
    met = held.join(known, "term", "left").groupBy(key, "_row").agg(F.sort_array(F.collect_list("id")).alias("indices"))  # a row's own terms
    return met.crossJoin(F.broadcast(size)).select(key, "size", "indices")


def one_hot_pairs(pairs: DataFrame, rows: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, size, indices as ``one_hot`` has them, of pairs (key, term), which may repeat, and rows (key, distinct and not null).

    Pairs meet the vocabulary as they are and become numbers; a key's numbers are sorted with those of other keys in
    their task, so no set of terms is made, which costs more than all the rest.
    """
    size = known.agg(F.count("*").alias("size"))
    ids = pairs.select(key, "term").join(known.hint("shuffle_hash"), "term").select(key, "id")
    every = ids.unionByName(rows.select(key, F.lit(None).cast("long").alias("id")))
    kind = rows.schema[key].dataType.simpleString()
    met = every.repartition(key).sortWithinPartitions(key, "id").mapInArrow(_gathered, f"`{key}` {kind}, indices array<long>")
    return met.crossJoin(F.broadcast(size)).select(key, "size", "indices")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct ids of each key, of rows sorted by both; a key's rows may lie in several batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = batch.column(0)
        if keys[0] != keys[-1] or held.column(0)[0] != keys[0]:
            last = int(np.flatnonzero(_new(keys))[-1]) + held.num_rows - batch.num_rows
            yield _lists(held.slice(0, last))
            held = held.slice(last)
    if held is not None:
        yield _lists(held)


def _new(x: pa.Array) -> np.ndarray:
    """Where a value isn't the one before it; the first one is."""
    return np.concatenate(([True], pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)))


def _lists(rows: pa.Table) -> pa.RecordBatch:
    keys, ids = (c.combine_chunks() for c in rows.columns)
    begins = _new(keys)
    kept = ids.is_valid().to_numpy(zero_copy_only=False) & (begins | pc.fill_null(pc.not_equal(ids, pc.array_take(ids, pa.array(np.maximum(np.arange(len(ids)) - 1, 0)))), True).to_numpy(zero_copy_only=False))
    ends = np.append(np.cumsum(kept)[np.flatnonzero(begins)[1:] - 1], kept.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), ids.filter(pa.array(kept)))
    return pa.RecordBatch.from_arrays([keys.filter(pa.array(begins)), lists], names=[rows.column_names[0], "indices"])

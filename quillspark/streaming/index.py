"""Appending to a saved lexical index from a stream of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.stopwords import DEFAULT
from quillspark.operators.store import IndexStore, StoredIndex


def append_stream(docs: DataFrame, path: str, checkpoint: str, stop_words: Sequence[str] = DEFAULT, fan: int = 4) -> StreamingQuery:
    """Adds each batch of a stream (id, title, abstract) to the index at ``path``.

    A batch becomes a segment; ids that the index has are overwritten.  The manifest holds the number of
    the last batch, so one that is repeated after a restart adds nothing.  Segments are merged as
    they gather, so that readers never have many.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = IndexStore(batch.sparkSession, path)
        store.append(batch, stop_words, number)
        store.compact(fan)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, path: str) -> StoredIndex:
    """The index of all batches that ``append_stream`` wrote to ``path``; empty before the first.

    Of an id that several batches have, the latest batch counts.
    """
    return IndexStore(spark, path).read()

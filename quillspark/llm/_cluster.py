"""What the operators need of the session: shared checkpoints, counts of hash ranges, sizes of batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items that a hash range should hold on average at most.
RANGE_ITEMS = 2_500_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one of ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary one, and any other is an error:
    its executors could not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def range_bits(items: int, least: int = 6, most: int = 30) -> int:
    """log2 of the number of hash ranges that hold ``RANGE_ITEMS`` each on average.

    The number follows the items; 2**30 ranges stand for more than 10 PB of text.
    """
    return min(most, max(least, (max(1, items) // RANGE_ITEMS).bit_length()))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by a scan of that column."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def batch_limit(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> str | None:
    """Lowers the session's limit on the bytes of an Arrow batch to ``most_bytes``.

    Batches of 10,000 long texts are tens of MB, held in the JVM's buffers, in Arrow and as Python
    bytes at once for each running task.  Smaller batches change no result.  Returns what
    ``unbound_batches`` needs to put the setting back.
    """
    was = spark.conf.get(_BATCH, None)
    if batch_limit(spark) <= 0 or batch_limit(spark) > most_bytes:
        spark.conf.set(_BATCH, str(most_bytes))
    return was


def unbound_batches(spark: SparkSession, was: str | None) -> None:
    if was is None:
        spark.conf.unset(_BATCH)
    else:
        spark.conf.set(_BATCH, was)


#: What empties this worker's caches, by operator.
held: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Gives back what this worker still holds of other operators' tasks.

    Spark uses a worker again for the next stage's tasks, so caches and freed memory that the allocators
    keep would count beside what the new task needs.
    """
    for empty in held.values():
        empty()
    held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

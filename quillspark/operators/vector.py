"""Exact nearest neighbours and hyperplane signatures by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.records import ranked

QUERY_BLOCK = 2048
#: Bytes of a table that are sent to every executor at most.
MOST_BROADCAST = 64 << 20
#: Bytes of best scores that a task holds at most, and scores that it computes at once.
MOST_HELD, SCORES = 64 << 20, 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows become NaN, which no ranking takes."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


def _packed(batch_ids: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes]:
    return batch_ids.astype("<i8").tobytes(), unit(x).astype("<f8").tobytes()


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ids and unit vectors for each QUERY_BLOCK vectors."""
    for batch in batches:
        for i in range(0, batch.num_rows, QUERY_BLOCK):
            part = batch.slice(i, QUERY_BLOCK)
            row = _packed(part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "vectors"])


def _pack_queries(table: pa.Table) -> pa.Table:
    row = _packed(table.column("query_id").to_numpy(), matrix(table.column("vector").combine_chunks()))
    return pa.table({n: pa.array([x], pa.binary()) for n, x in zip(("asked_ids", "asked"), row)})


class Best:
    """The ``k`` best of each query over all blocks of a task, ties by the smaller id.

    Only scores that reach a query's k-th best so far are sorted, and only the best leave the task, so neither
    sorting nor what is shuffled grows with the number of blocks.
    """

    def __init__(self, k: int, skip_self: bool):
        self.k, self.skip_self, self.held, self.bytes = k, skip_self, {}, 0

    def add(self, key: bytes, ids: np.ndarray, row: np.ndarray, own: np.ndarray, s: np.ndarray) -> None:
        """``s`` has a row for each of the queries ``ids[row]`` of a block, and a column for each of ``own``; what is no number or -inf is left out."""
        if key not in self.held:
            self.held[key] = ids, np.full((len(ids), self.k), -np.inf), np.full((len(ids), self.k), np.iinfo(np.int64).max)
            self.bytes += 16 * len(ids) * self.k + len(key)
        if self.skip_self:
            col = np.flatnonzero(np.isin(own, ids))
            if len(col):
                s[:, col] = np.where(ids[row][:, None] == own[col], -np.inf, s[:, col])
        best, docs = self.held[key][1:]
        least = best[row, -1]
        open_ = np.isneginf(least)
        if open_.any() and s.shape[1] > self.k:
            few = s[open_]
            few[np.isnan(few)] = -np.inf
            least[open_] = np.round(np.partition(few, -self.k, axis=1)[:, -self.k], 6)
        with np.errstate(invalid="ignore"):
            r, c = np.nonzero(s >= (least - 1e-6)[:, None])  # rounding is yet to come
        score, doc = np.round(s[r, c], 6), own[c]
        last = docs[row, -1]
        ok = np.isfinite(score) & ((score > least[r]) | (score == least[r]) & (open_[r] | (doc < last[r])))
        r, score, doc = row[r[ok]], score[ok], doc[ok]
        if not len(r):
            return
        met = np.unique(r)
        r = np.concatenate((r, np.repeat(met, self.k)))
        score, doc = np.concatenate((score, best[met].ravel())), np.concatenate((doc, docs[met].ravel()))
        order = np.lexsort((doc, -score, r))
        r, score, doc = r[order], score[order], doc[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        ok = place < self.k
        best[r[ok], place[ok]], docs[r[ok], place[ok]] = score[ok], doc[ok]

    def rows(self, most_bytes: int = 0) -> Iterator[pa.RecordBatch]:
        """query_id, doc_id, score of what is held, if that is more than ``most_bytes``; it is given up then."""
        if self.bytes > most_bytes:
            for ids, best, docs in self.held.values():
                r, c = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(docs[r, c]), pa.array(best[r, c])], names=["query_id", "doc_id", "score"])
            self.held, self.bytes = {}, 0


def spans(n: int, width: int) -> Iterator[slice]:
    """Rows of a matrix of ``width`` columns in parts of about SCORES numbers."""
    step = max(1, SCORES // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _best(k: int, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(k, skip_self)
        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("ids", "vectors", "asked_ids", "asked"))):
                own, x, ids, q = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, ("<i8", "<f8", "<i8", "<f8")))
                x, q, key = x.reshape(len(own), -1), q.reshape(len(ids), -1), ids.tobytes()
                for part in spans(len(ids), len(own)):
                    kept.add(key, ids, np.arange(len(ids))[part], own, q[part] @ x.T)
            yield from kept.rows(MOST_HELD)
        yield from kept.rows()

    return run


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, skip_self: bool = True) -> DataFrame:
    """query_id, rank, doc_id, score: cosine neighbours of queries (query_id, vector) among
    vectors (doc_id, vector).

    Queries and vectors become rows of about QUERY_BLOCK unit vectors each; every pair of rows is
    one matrix product, and a task sends on its best k for each query.  The work is all pairs; what is held,
    sorted and shuffled is not.  The queries' rows are broadcast up to MOST_BROADCAST bytes of them; beyond,
    executors read them as partitions.
    """
    held = vectors.where("vector IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).first()
    parts = max(1, -(-size.n // QUERY_BLOCK))
    blocks = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("block")).applyInArrow(_pack_queries, "asked_ids binary, asked binary")
    if size.numbers * 8 <= MOST_BROADCAST:
        blocks = F.broadcast(blocks)
    pairs = held.mapInArrow(_pack_vectors, "ids binary, vectors binary").crossJoin(blocks)
    return ranked(pairs.mapInArrow(_best(k, skip_self), "query_id long, doc_id long, score double"), k)


def _signs(planes: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (matrix(batch.column("vector")) @ planes.T > 0).astype(np.int32)
            offsets = np.arange(len(bits) + 1, dtype=np.int32) * planes.shape[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits.ravel()))], names=[*names, "signature"])

    return run


def signatures(vectors: DataFrame, planes: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, vector, signature: on which side of each plane a vector lies, strictly above being 1."""
    held = vectors.where("vector IS NOT NULL").select(key, F.col("vector").cast("array<double>").alias("vector"))
    kind = held.schema[key].dataType.simpleString()
    return held.mapInArrow(_signs(planes, [key, "vector"]), f"{key} {kind}, vector array<double>, signature array<int>")

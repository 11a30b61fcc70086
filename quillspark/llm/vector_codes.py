"""Vector code compression: product codes of integer vectors by exact k-means.

Components become whole numbers, vectors are cut into equal parts, and each part is coded by the
nearest entry of its position's codebook.  Distances are exact integers, so codes are the same on
any number of tasks.  Most distances are never computed: by the means of blocks of a part and the
norm of what is left of it (its residual),

    |x - c|^2  >=  sum over blocks of size * (mean x - mean c)^2  +  (|residual x| - |residual c|)^2,

first with the whole part as one block, then with ever smaller blocks for the entries that are left.
Bounds are taken down by more than their rounding error, so an entry is only left out if it is
farther; what survives gets its exact distance.

A round sums each task's parts by entry in the task and the tasks' sums in Spark; the driver gets
one row for each entry of each codebook, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._cluster import cut

#: Vectors that are compared at once.
BLOCK = 4096


def _levels(size: int) -> list[np.ndarray]:
    """Starts of 1, 2, 4 ... blocks of a part, while blocks have two components at least."""
    out, n = [], 1
    while n == 1 or n * 2 <= size:
        out.append(np.unique(np.arange(n) * size // n))
        n *= 2
    return out


class _Summary:
    """Block means times the root of the block's size, and the norm of the residual, for rows of parts."""

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        size = np.diff(np.append(starts, x.shape[1]))
        means = np.add.reduceat(x, starts, axis=1) / size
        self.means = means * np.sqrt(size)
        self.rest = np.sqrt(((x - np.repeat(means, size, axis=1)) ** 2).sum(1))


def _careful(bound: np.ndarray) -> np.ndarray:
    """A bound below the true one by more than what rounding can have added."""
    return bound * (1 - 1e-9) - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower index) and its exact squared distance, of int64 arrays."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = col = least = None
    for starts in _levels(x.shape[1]):
        a, c = _Summary(x, starts), _Summary(book, starts)
        if row is None:  # coarsest: all entries, and an exact distance to the one that looks nearest
            bound = ((a.means[:, None, :] - c.means[None, :, :]) ** 2).sum(2) + (a.rest[:, None] - c.rest[None, :]) ** 2
            least = ((x - book[bound.argmin(1)]) ** 2).sum(1)
            row, col = np.nonzero(_careful(bound) <= least[:, None])
        else:
            bound = ((a.means[row] - c.means[col]) ** 2).sum(1) + (a.rest[row] - c.rest[col]) ** 2
            keep = _careful(bound) <= least[row]
            row, col = row[keep], col[keep]
    exact = ((x[row] - book[col]) ** 2).sum(1)
    first = np.searchsorted(row, np.arange(len(x)))  # every row keeps its nearest entry, so none is empty
    distance = np.minimum.reduceat(exact, first)
    hit = np.flatnonzero(exact == distance[row])
    return col[hit[np.searchsorted(row[hit], np.arange(len(x)))]], distance


def _whole(scale: int, dims: int):
    """vec_id, label and the components as little-endian 32-bit numbers, of the rows that are kept."""
    most = min(isqrt(((1 << 63) - 1) // (4 * dims)), (1 << 31) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            ok = ~vectors.is_null().to_numpy(zero_copy_only=False)
            held = vectors.take(pa.array(np.flatnonzero(ok)))
            size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
            good = np.bincount(np.repeat(np.arange(len(size)), size)[~np.isfinite(x)], minlength=len(size)) == 0
            if (size[good] != dims).any():
                raise ValueError(f"all vectors must have {dims} components")
            x = np.floor(x[np.repeat(good, size)] * scale).reshape(-1, dims)
            if (np.abs(x) > most).any():
                raise ValueError(f"a component beyond {most / scale:g} has no exact distances in 64 bits")
            at = pa.array(np.flatnonzero(ok)[good])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], names=["vec_id", "label", "data"])

    return run


def _matrices(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    data = batch.column("data")
    for i in range(0, len(data), BLOCK):
        yield i, np.frombuffer(b"".join(data.slice(i, BLOCK).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _sums(books: np.ndarray):
    """part, entry, n, sums of a task's parts; sent once, when the task is through."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            for _, x in _matrices(batch, parts * size):
                for p in range(parts):
                    own = x[:, p * size : (p + 1) * size]
                    entry, _ = nearest(own, books[p])
                    order = np.argsort(entry, kind="stable")
                    used, begin = np.unique(entry[order], return_index=True)
                    n[p, used] += np.diff(np.append(begin, len(order)))
                    total[p, used] += np.add.reduceat(own[order], begin, axis=0)
        part, entry = np.nonzero(n)
        sums = pa.ListArray.from_arrays(pa.array((np.arange(len(part) + 1) * size).astype(np.int32)), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), sums], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    parts, _, size = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _matrices(batch, parts * size):
                found = [nearest(x[:, p * size : (p + 1) * size], books[p]) for p in range(parts)]
                code = ["".join(r) for r in digits[np.stack([e for e, _ in found], 1)].tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(i, len(x)), batch.column("label").slice(i, len(x)), pa.array(code), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    return run


def train_codebooks(whole: DataFrame, dims: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks (parts x entries x components) of the table vec_id, data; entries start as the smallest vec_ids'.

    Between equal vec_ids the smaller bytes come first.  Fewer vectors than ``entries`` give fewer entries.
    """
    rows = whole.where("vec_id IS NOT NULL").orderBy("vec_id", "data").limit(entries).select("data").collect()
    start = np.frombuffer(b"".join(r.data for r in rows), "<i4").astype(np.int64).reshape(len(rows), parts, dims // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    size = dims // parts
    for _ in range(rounds if len(rows) else 0):
        sums = whole.select("data").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        # parts * entries rows
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(size))).alias("sums")).collect():
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of ``vectors`` (vec_id, label, vector), and the codebooks.

    A code has two hex digits for each part; error is the squared distance to the coded vector, of
    components times ``scale`` as whole numbers.  Rows whose vector is null or has a null or
    non-finite component are left out.  All others must have as many components, a multiple of
    ``parts`` (else an error).  Rows that repeat a vec_id are coded each; null vec_ids are coded but
    begin no codebook.  Where no vec_id is left there are no codes.  An empty table gives an empty result.
    Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.where(usable & F.col("vec_id").isNotNull()).select(F.size("vector").alias("n")).first()
    if some is None:
        return rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    dims = some.n
    if not dims or dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    whole = cut(rows.mapInArrow(_whole(scale, dims), "vec_id long, label long, data binary"))
    books = train_codebooks(whole, dims, parts, entries, rounds)
    return whole.mapInArrow(_codes(books), "vec_id long, label long, code string, error long"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (vec_id, label, code, error) with label_error, the sum of error over equal labels, nulls together.

    Sums are made in the tasks first, so a label that very many rows have is one row from each; the join
    back is of few labels, or else one that Spark's skew join splits.
    """
    coded = cut(coded)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left").drop("_label")

"""Inverted-file search: k-means cells, cell pruning, optional product quantisation, re-ranking.

All distances are cosine.  Vectors are kept as packed rows of one cell, so that a row and a packed row
of queries are one matrix product.  A saved index has a folder for each cell; a search of few queries
joins it with their probes, and Spark reads the probed folders only.  Many queries meet the cells in blocks, which
say by a bit for each cell and query whether it is probed; a task keeps the best of each query, so what is
shuffled grows with the queries and tasks and not with the probes.

Cells and code words are trained by mini-batches over all vectors: each round takes another chunk of
them (all of them while they are few), tasks sum their vectors by the nearest centre, and the driver gets
one row for each centre.  nprobe and the length of the coded shortlist are chosen when the index is
built, by the recall of other queries, and are saved with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.vector import MOST_BROADCAST, MOST_HELD, Best, exact_knn, matrix, spans, unit
from quillspark.sources.records import cut, ranked

#: Places of shortlists that are rows at most, and bins of coded scores beyond.
MOST_SHORTLISTED, BINS = 100_000, 2048
#: Vectors or queries in a packed row at most.
BLOCK = 2048
#: Vectors of a chunk for each cell, and chunks at most.
CHUNK, MOST_CHUNKS = 64, 16
#: Queries about whose neighbours nprobe and shortlists are chosen.
MOST_TUNING = 256
#: Cells by default at most: the driver holds their centres.
MOST_CELLS = 16_384


@dataclass
class IvfIndex:
    """cells(cell, ids, vectors[, codes]) of packed vectors, centres, code words, and what was chosen for searches."""

    cells: DataFrame
    centroids: np.ndarray
    codebooks: np.ndarray | None = None
    nprobe: int = 10
    shortlist: int = 0

    def save(self, path: str) -> None:
        self.cells.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        rows = [("centroid", i, 0, c.tolist()) for i, c in enumerate(self.centroids)] + [("chosen", 0, 0, [float(self.nprobe), float(self.shortlist)])]
        if self.codebooks is not None:
            rows += [("code", i, j, c.tolist()) for i, book in enumerate(self.codebooks) for j, c in enumerate(book)]
        self.cells.sparkSession.createDataFrame(rows, "kind string, i int, j int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfIndex:
        rows = spark.read.parquet(f"{path}/model").orderBy("kind", "i", "j").collect()  # nlist + m * 2**nbits rows
        centroids = np.array([r.vector for r in rows if r.kind == "centroid"])
        code = [r for r in rows if r.kind == "code"]
        books = np.array([[r.vector for r in code if r.i == i] for i in range(code[-1].i + 1)]) if code else None
        nprobe, shortlist = (int(x) for x in next(r.vector for r in rows if r.kind == "chosen"))
        schema = "ids binary, vectors binary" + ", codes binary" * (books is not None) + ", cell int"
        return IvfIndex(spark.read.schema(schema).parquet(f"{path}/cells"), centroids, books, nprobe, shortlist)


def _doubles(x: bytes, n: int) -> np.ndarray:
    """``n`` vectors of a packed value, in 4 or 8 bytes a number."""
    return np.frombuffer(x, np.float64).reshape(n, -1)


def _longs(x) -> np.ndarray:
    return np.frombuffer(x, "<i8")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows ids, vectors of unit vectors; those without a direction are left out."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            x = unit(matrix(part.column(1)))
            ok = ~np.isnan(x).any(1)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (part.column(0).to_numpy(zero_copy_only=False)[ok], x[ok])], names=["ids", "vectors"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("vectors")):
            own = _longs(ids.as_buffer())
            yield own, _doubles(x.as_buffer(), len(own))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread 62-bit numbers."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(2) ^ x >> np.uint64(33)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * x @ centres.T - (centres * centres).sum(1)).argmax(1)


def _starts(share: float):
    least = int(share * (1 << 62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            h = _mixed(ids)
            ok = h < np.uint64(least)
            yield pa.RecordBatch.from_arrays([pa.array(h[ok].astype(np.int64)), pa.array(ids[ok]), pa.array([v.tobytes() for v in x[ok]], pa.binary())], names=["h", "id", "vector"])

    return run


def _sums(books: list[tuple[int, np.ndarray]], chunk: int, chunks: int):
    """book, entry, n, sums of a task's vectors of one chunk; ``books`` are (first component, centres)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [np.zeros(len(c), np.int64) for _, c in books], [np.zeros_like(c) for _, c in books]
        for ids, x in _blocks(batches):
            x = x[_mixed(ids) % np.uint64(chunks) == chunk]
            for b, (at, c) in enumerate(books):
                own = x[:, at : at + c.shape[1]]
                entry = _nearest(own, c)
                n[b] += np.bincount(entry, minlength=len(c))
                np.add.at(total[b], entry, own)
        for b, (k, s) in enumerate(zip(n, total)):
            used = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), b, np.int32)), pa.array(used.astype(np.int32)), pa.array(k[used]), pa.array(list(s[used]), pa.list_(pa.float64()))], names=["book", "entry", "n", "sums"])

    return run


def _train(packed: DataFrame, n: int, start: np.ndarray, m: int | None, entries: int, rounds: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Centres of the cells, on the unit sphere, and code words of ``m`` parts, trained in the same passes."""
    dims = start.shape[1]
    books = [(0, start.copy())]
    if m:
        d = dims // m
        books += [(i * d, start[:entries, i * d : (i + 1) * d].copy()) for i in range(m)]
    chunks = int(np.clip(n // (CHUNK * max(len(c) for _, c in books)), 1, MOST_CHUNKS))
    seen = [np.zeros(len(c)) for _, c in books]
    for t in range(rounds):
        if t % chunks == 0:  # each pass over all chunks begins anew; with one chunk this is the whole mean
            seen = [np.zeros(len(c)) for _, c in books]
        rows = packed.mapInArrow(_sums(books, t % chunks, chunks), "book int, entry int, n long, sums array<double>")
        sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dims)))
        for r in rows.groupBy("book", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # one row for each centre
            c = books[r.book][1]
            seen[r.book][r.entry] += r.n
            c[r.entry] += (np.array(r.sums[: c.shape[1]]) - r.n * c[r.entry]) / seen[r.book][r.entry]
        length = np.sqrt((books[0][1] ** 2).sum(1, keepdims=True))
        np.divide(books[0][1], length, out=books[0][1], where=length > 0)
    return books[0][1], np.array([c for _, c in books[1:]]) if m else None


def _codes(x: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    return np.stack([_nearest(p, c) for p, c in zip(np.split(x, len(codebooks), axis=1), codebooks)], 1).astype(np.uint8)


def _assign(centroids: np.ndarray, codebooks: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            cols = [pa.array(_nearest(x, centroids).astype(np.int32)), pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())]
            if codebooks is not None:
                cols.append(pa.array([c.tobytes() for c in _codes(x, codebooks)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["cell", "ids", "vectors", "codes"][: len(cols)])

    return run


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of cell, packed: one row for each run of a cell of at most BLOCK rows."""
    for batch in batches:
        cell = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(cell):
            continue
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        cuts = sorted({c for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(cell)]) for c in range(a, b, BLOCK)})
        spans = list(zip(cuts, [*cuts[1:], len(cell)]))
        cols = [pa.array(cell[cuts].astype(np.int32))]
        for c in batch.columns[1:]:
            if pa.types.is_integer(c.type):
                x = c.to_numpy(zero_copy_only=False).astype("<i8")
                cols.append(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()))
            else:
                x = c.to_pylist()
                cols.append(pa.array([b"".join(x[a:b]) for a, b in spans], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _pack_cells(rows: DataFrame) -> DataFrame:
    """Rows (cell, long or binary columns) as packed rows; a large cell is split, small ones share a task."""
    kinds = ", ".join(["cell int", *(f"{f} binary" for f in rows.columns[1:])])
    return rows.hint("rebalance", "cell").sortWithinPartitions("cell").mapInArrow(_by_cell, kinds)


def build_ivf(vectors: DataFrame, nlist: int | None = None, *, m: int | None = None, nbits: int = 8, rounds: int = 16, tuning: DataFrame | None = None, k: int = 10, recall: float = 0.95, most_tuning: int = MOST_TUNING) -> IvfIndex:
    """An index of vectors (doc_id, vector): ``nlist`` cells (by default the root of their number) and,
    with ``m``, codes of m bytes.

    Every vector is indexed but zero vectors, which have no direction.  Centres start as the vectors
    with the least hashes of their id.  nprobe, and with ``m`` the shortlist, are the least that find the share
    ``recall`` of the exact neighbours, themselves left out, of at most about ``most_tuning`` rows of
    ``tuning`` (query_id, vector; by default of the vectors).
    """
    spark = vectors.sparkSession
    held = vectors.where("vector IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    packed = cut(held.mapInArrow(_packed, "ids binary, vectors binary"))
    n = packed.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 8
    if not n:
        return IvfIndex(spark.createDataFrame([], "cell int, ids binary, vectors binary" + ", codes binary" * bool(m)), np.zeros((0, 0)), np.zeros((m, 1, 1)) if m else None, 1, k)
    nlist = min(nlist or min(max(1, round(n**0.5)), MOST_CELLS), n)
    wanted = max(nlist, (1 << nbits) if m else 0)
    some = packed.mapInArrow(_starts(min(1.0, (wanted + 6 * wanted**0.5 + 10) / n)), "h long, id long, vector binary")
    start = np.array([np.frombuffer(r.vector) for r in some.orderBy("h", "id").limit(wanted).collect()])
    if m and start.shape[1] % m:
        raise ValueError(f"{start.shape[1]} dimensions can't be cut into {m} equal parts")
    centroids, books = _train(packed, n, start[:nlist], m, 1 << nbits, rounds) if not m or nlist >= 1 << nbits else _train_apart(packed, n, start, nlist, m, 1 << nbits, rounds)
    rows = packed.mapInArrow(_assign(centroids, books), "cell int, ids long, vectors binary" + ", codes binary" * bool(m))
    index = IvfIndex(cut(_pack_cells(rows)), centroids, books)
    asked = _some(tuning if tuning is not None else vectors.withColumnRenamed("doc_id", "query_id"), most_tuning)
    index.nprobe, index.shortlist = _choose(index, vectors, cut(asked), k, recall)
    return index


def _train_apart(packed: DataFrame, n: int, start: np.ndarray, nlist: int, m: int, entries: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells, and then codes, where there are fewer cells than code words to start from."""
    return _train(packed, n, start[:nlist], None, 0, rounds)[0], _train(packed, n, start[:entries], m, entries, rounds)[1]


def _some(queries: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` queries with a vector, by a hash of their id."""
    held = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    return some(held, "query_id", most)


def some(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, by a hash of a key."""
    share = min(1.0, most / max(rows.count(), 1))
    return rows.where(F.shiftrightunsigned(F.xxhash64(key), 2) < int(share * (1 << 62))) if share < 1 else rows


def _counted_above(codebooks: np.ndarray, asked: dict[int, tuple[np.ndarray, np.ndarray]]):
    """query_id, place, n: coded scores of a task above each of a query's own (``asked``: vector, scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = {q: np.zeros(len(s), np.int64) for q, (_, s) in asked.items()}
        for _, own, code, _, queries, x, row in _meetings(batches, codebooks):
            for q, scores in zip(queries[row].tolist(), _coded_scores(x[row], code, codebooks)):
                scores = np.sort(scores[own != q])
                above[q] += len(scores) - np.searchsorted(scores, asked[q][1], "right")
        rows = [(q, i, int(n)) for q, a in above.items() for i, n in enumerate(a)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, names=["query_id", "place", "n"])

    return run


def _choose(index: IvfIndex, vectors: DataFrame, asked: DataFrame, k: int, recall: float) -> tuple[int, int]:
    """nprobe and shortlist (k without codes).  Collected are the queries and their neighbours: at most about 256 and k each."""
    queries = {r.query_id: unit(np.array([r.vector]))[0] for r in asked.collect()}
    truth = cut(exact_knn(vectors, asked, k, skip_self=True).select("query_id", "doc_id"))
    near = {r.doc_id for r in truth.collect()}
    if not near:
        return len(index.centroids), k

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(sorted(near))
        for batch in batches:
            codes = batch.column("codes") if "codes" in batch.schema.names else [None] * batch.num_rows
            for cell, ids, code in zip(batch.column("cell").to_pylist(), batch.column("ids"), codes):
                own = _longs(ids.as_buffer())
                at = np.flatnonzero(np.isin(own, wanted))
                c = [None] * len(at) if code is None else [x.tobytes() for x in np.frombuffer(code.as_buffer(), np.uint8).reshape(len(own), -1)[at]]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.full(len(at), cell, np.int32)), pa.array(c, pa.binary())], names=["doc_id", "cell", "code"])

    rows = truth.join(index.cells.mapInArrow(found, "doc_id long, cell int, code binary"), "doc_id").collect()
    order = {q: np.argsort(-(x @ index.centroids.T), kind="stable") for q, x in queries.items()}
    place = sorted(int(np.flatnonzero(order[r.query_id] == r.cell)[0]) for r in rows)
    nprobe = place[int(np.ceil(recall * len(place))) - 1] + 1
    if index.codebooks is None:
        return nprobe, k
    own: dict[int, list[bytes]] = {}
    for r in rows:
        if np.flatnonzero(order[r.query_id] == r.cell)[0] < nprobe:
            own.setdefault(r.query_id, []).append(r.code)
    scores = {q: (queries[q], _coded_scores(queries[q][None], np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1), index.codebooks)[0]) for q, c in own.items()}
    met = _asked(index.cells.select("cell", "ids", "codes"), asked.where(F.col("query_id").isin(list(own))), index.centroids, nprobe)
    ranks = met.mapInArrow(_counted_above(index.codebooks, scores), "query_id long, place long, n long").groupBy("query_id", "place").agg(F.sum("n").alias("n"))
    n = sorted(r.n for r in ranks.collect())
    if not n:
        return nprobe, k
    # recall is over all neighbours, of which the cells have some share already
    return nprobe, max(k, n[min(len(n), int(np.ceil((recall - 0.03) * len(place)))) - 1] + 1)


def _probe(centroids: np.ndarray, nprobe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, best, _ = _nearest_cells(batch, centroids, nprobe)
            row = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), pa.array(ids[row]), pa.array([x[i].tobytes() for i in row], pa.binary())], names=["cell", "asked_ids", "asked"])

    return run


def _nearest_cells(batch: pa.RecordBatch, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, ...]:
    """Ids, unit vectors, ``nprobe`` nearest cells and borders (if there) of the queries that have a direction."""
    x = unit(matrix(batch.column("vector")))
    ok = ~np.isnan(x).any(1)
    ids, x = batch.column("query_id").to_numpy(zero_copy_only=False)[ok], x[ok]
    border = batch.column("border").to_numpy(zero_copy_only=False)[ok] if "border" in batch.schema.names else np.empty(0)
    return ids, x, np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :nprobe] if len(x) else np.empty((0, 1), int), border


def _probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """cell, asked_ids, asked: the queries' packed unit vectors by the ``nprobe`` nearest cells of each."""
    return _pack_cells(queries.select("query_id", "vector").mapInArrow(_probe(centroids, nprobe), "cell int, asked_ids long, asked binary"))


def _met(cells: DataFrame, probes: DataFrame) -> DataFrame:
    """Packed rows of cells with the packed rows that ask for them, which are broadcast: only the folders of probed cells are read."""
    return cells.join(F.broadcast(cut(probes).where("cell >= 0")), "cell")  # always true; Spark prunes by a side that has a filter only


def _block(centroids: np.ndarray, nprobe: int):
    """Packed queries with a bit for each cell and query that says whether it is probed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                ids, x, best, border = _nearest_cells(batch.slice(i, BLOCK), centroids, nprobe)
                probed = np.zeros((len(centroids), len(ids)), bool)
                if len(ids):
                    probed[best.ravel(), np.repeat(np.arange(len(ids)), best.shape[1])] = True
                    cols = ids.astype("<i8"), x, np.packbits(probed, axis=1), border.astype("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["asked_ids", "asked", "probed", "borders"])

    return run


def _asked(cells: DataFrame, queries: DataFrame, centroids: np.ndarray, nprobe: int, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """Packed rows of cells with each block of queries: a query is sent once, and not once for each cell that it probes.

    The blocks are broadcast up to ``most_bytes``, beyond which executors read them as partitions.
    """
    rows = queries.select("query_id", "vector", *(c for c in queries.columns if c == "border"))
    n = rows.count()
    blocks = rows.repartition(max(1, -(-n // BLOCK)), "query_id").mapInArrow(_block(centroids, nprobe), "asked_ids binary, asked binary, probed binary, borders binary")
    return cells.crossJoin(F.broadcast(blocks) if n * (8 + 8 * centroids.shape[1] + len(centroids) // 8) <= most_bytes else cut(blocks))


def _meetings(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray | None = None) -> Iterator[tuple]:
    """Ids, vectors and codes (None if not there) of a packed row, a block's ids and unit vectors, and the places in it of those that probe the cell, in parts."""
    for batch in batches:
        held = [batch.column(c) if c in batch.schema.names else [None] * batch.num_rows for c in ("vectors", "codes")]
        for cell, ids, vectors, codes, queries, asked, probed in zip(batch.column("cell").to_pylist(), batch.column("ids"), *held, *(batch.column(c) for c in ("asked_ids", "asked", "probed"))):
            own, q = _longs(ids.as_buffer()), _longs(queries.as_buffer())
            width = -(-len(q) // 8)
            row = np.flatnonzero(np.unpackbits(np.frombuffer(probed.as_buffer(), np.uint8, width, cell * width), count=len(q)))
            x = None if vectors is None else _doubles(vectors.as_buffer(), len(own))
            code = None if codes is None or codebooks is None else np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(own), -1)
            a = _doubles(asked.as_buffer(), len(q))
            for part in spans(len(row), len(own)):
                yield queries.as_buffer(), own, code, x, q, a, row[part]


def _best_met(k: int, skip_self: bool, codebooks: np.ndarray | None):
    """query_id, doc_id, score: a task's ``k`` best of each query, by vectors or codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(k, skip_self)
        for key, own, code, x, q, a, row in _meetings(batches, codebooks):
            kept.add(bytes(key), q, row, own, a[row] @ x.T if codebooks is None else _coded_scores(a[row], code, codebooks))
            yield from kept.rows(MOST_HELD)
        yield from kept.rows()

    return run


def _bins(scores: np.ndarray) -> np.ndarray:
    """The bin of each coded score; a larger score never has a smaller bin."""
    return np.clip((scores + 1) * (BINS / 2), 0, BINS - 1).astype(np.int64)


def _histograms(skip_self: bool, codebooks: np.ndarray):
    """query_id, counts: a task's coded scores of each query by bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for key, own, code, _, q, a, row in _meetings(batches, codebooks):
            _, counts = held.setdefault(bytes(key), (q, np.zeros((len(q), BINS), np.int32)))
            bins = _bins(np.round(_coded_scores(a[row], code, codebooks), 6))
            flat = (np.arange(len(row))[:, None] * BINS + bins).ravel()
            if skip_self:
                flat = flat[(q[row][:, None] != own).ravel()]
            counts[row] += np.bincount(flat, minlength=len(row) * BINS).reshape(-1, BINS).astype(np.int32)
            if 4 * BINS * sum(len(x) for x, _ in held.values()) > MOST_HELD:
                yield from _counted(held)
        yield from _counted(held)

    return run


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    for q, counts in held.values():
        for i in range(0, len(q), 256):
            yield pa.RecordBatch.from_arrays([pa.array(q[i : i + 256]), pa.array([c.tobytes() for c in counts[i : i + 256]], pa.binary())], names=["query_id", "counts"])
    held.clear()


def _borders(most: int):
    """query_id, border, above of a group of queries: the bin that holds the ``most``-th best score, and how many lie in higher bins."""

    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        counts = np.zeros((len(ids), BINS), np.int64)
        for i, c in zip(at.tolist(), (c for chunk in table.column("counts").chunks for c in chunk)):
            counts[i] += np.frombuffer(c.as_buffer(), np.int32)
        reached = counts[:, ::-1].cumsum(1)
        place = (reached < most).sum(1)  # of the highest bin 0
        above = np.where(place > 0, np.take_along_axis(reached, np.maximum(place - 1, 0)[:, None], 1)[:, 0], 0)
        return pa.table({"query_id": ids, "border": BINS - 1 - place, "above": above})

    return run


def _within(k: int, skip_self: bool, codebooks: np.ndarray):
    """query_id, doc_id, score, coded: a task's ``k`` best by exact cosine of what lies above a query's border, and, with ``coded``, all that lies in its bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(k, skip_self)
        whole = lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.float64())], names=[*b.schema.names, "coded"])
        for batch in batches:
            borders = batch.column("borders")
            for i in range(batch.num_rows):
                border = _longs(borders[i].as_buffer())
                for key, own, code, x, q, a, row in _meetings([batch.slice(i, 1)], codebooks):
                    coded = np.round(_coded_scores(a[row], code, codebooks), 6)
                    bins, edge = _bins(coded), border[row][:, None]
                    s = a[row] @ x.T
                    at = bins == edge
                    if skip_self:
                        at &= q[row][:, None] != own
                    r, c = np.nonzero(at)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(q[row][r]), pa.array(own[c]), pa.array(np.round(s[r, c], 6)), pa.array(coded[r, c])], names=["query_id", "doc_id", "score", "coded"])
                    s[bins <= edge] = -np.inf
                    kept.add(bytes(key), q, row, own, s)
            for b in kept.rows(MOST_HELD):
                yield whole(b)
        for b in kept.rows():
            yield whole(b)

    return run


def _shortlisted(index: IvfIndex, held: DataFrame, k: int, nprobe: int, skip_self: bool, most: int, most_bytes: int) -> DataFrame:
    """query_id, doc_id, score of each query's ``most`` best by codes, of which the best ``k`` are among these rows.

    The shortlists are no rows.  Coded scores are counted by bins, which names for each query the bin of its last
    place; a second pass computes exact cosines where the vectors are, and sends on the best ``k`` above that bin
    and what lies in it, of which the best by codes fill the shortlist.
    """
    counts = _asked(index.cells.select("cell", "ids", "codes"), held, index.centroids, nprobe, most_bytes).mapInArrow(_histograms(skip_self, index.codebooks), "query_id long, counts binary")
    groups = max(1, held.count() // 64)
    borders = cut(counts.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).applyInArrow(_borders(most), "query_id long, border long, above long"))
    rows = _asked(index.cells, held.join(borders, "query_id"), index.centroids, nprobe, most_bytes).mapInArrow(_within(k, skip_self, index.codebooks), "query_id long, doc_id long, score double, coded double")
    rows = cut(rows)
    edge = ranked(rows.where("coded IS NOT NULL").select("query_id", F.struct("doc_id", "score").alias("doc_id"), F.col("coded").alias("score")), most)
    edge = edge.join(borders, "query_id").where(F.col("rank") <= most - F.col("above")).select("query_id", "doc_id.doc_id", "doc_id.score")
    return rows.where("coded IS NULL").select("query_id", "doc_id", "score").unionByName(edge)


def _coded_scores(asked: np.ndarray, codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """Products of query parts and code words, summed."""
    return sum((p @ c.T)[:, codes[:, i]] for i, (p, c) in enumerate(zip(np.split(asked, len(codebooks), axis=1), codebooks)))


def _best(k: int, skip_self: bool, codebooks: np.ndarray | None):
    """cell, query_id, doc_id, score: the best ``k`` of each packed row for each query that asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("vectors" if codebooks is None else "codes")
            for cell, ids, x, queries, asked in zip(batch.column("cell").to_pylist(), batch.column("ids"), held, batch.column("asked_ids"), batch.column("asked")):
                own, q = _longs(ids.as_buffer()), _longs(queries.as_buffer())
                a = _doubles(asked.as_buffer(), len(q))
                s = a @ _doubles(x.as_buffer(), len(own)).T if codebooks is None else _coded_scores(a, np.frombuffer(x.as_buffer(), np.uint8).reshape(len(own), -1), codebooks)
                s = np.round(s, 6)
                if skip_self:
                    s[q[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                r, col = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
                ok = np.isfinite(s[r, col])
                r, col = r[ok], col[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), cell, np.int32)), pa.array(q[r]), pa.array(own[col]), pa.array(s[r, col])], names=["cell", "query_id", "doc_id", "score"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, doc_id, score of the packed pairs whose vector a packed row of the cell has."""
    for batch in batches:
        for ids, x, queries, docs, asked in zip(*(batch.column(c) for c in ("ids", "vectors", "asked_ids", "doc_ids", "asked"))):
            own, q, d = (_longs(c.as_buffer()) for c in (ids, queries, docs))
            order = np.argsort(own, kind="stable")
            at = np.minimum(np.searchsorted(own[order], d), len(own) - 1)
            ok = own[order][at] == d
            score = (_doubles(asked.as_buffer(), len(q))[ok] * _doubles(x.as_buffer(), len(own))[order][at[ok]]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(d[ok]), pa.array(np.round(score, 6))], names=["query_id", "doc_id", "score"])


def _unit_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = unit(matrix(batch.column("vector")))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([v.tobytes() for v in x], pa.binary())], names=["query_id", "asked"])


def ivf_search(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int | None = None, skip_self: bool = False, coded: bool = False, shortlist: int | None = None, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """query_id, rank, doc_id, score from the ``nprobe`` nearest cells of each query (by default those chosen at build).

    Scores are exact cosines.  With ``coded``, codes choose a ``shortlist`` for each query (by default as
    chosen at build), and only those vectors are read and ranked by exact cosine; a shortlist of 0 leaves it
    at the products of query parts and code words.
    """
    if coded and index.codebooks is None:
        raise ValueError("the index has no codes")
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], "query_id long, rank long, doc_id long, score double")
    held = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    nprobe = min(nprobe or index.nprobe, len(index.centroids))
    shortlist = index.shortlist if shortlist is None else shortlist
    most, n = max(k, shortlist), held.count()
    cells = index.cells.select("cell", "ids", "codes" if coded else "vectors")
    # few queries read the folders of their cells only
    many = n * nprobe * 8 * (1 + index.centroids.shape[1]) > most_bytes
    if coded and shortlist and (many or n * most > MOST_SHORTLISTED):
        return ranked(_shortlisted(index, held, k, nprobe, skip_self, most, most_bytes), k)
    if many:
        met = _asked(cells, held, index.centroids, nprobe, most_bytes)
        return ranked(met.mapInArrow(_best_met(k, skip_self, index.codebooks if coded else None), "query_id long, doc_id long, score double"), k)
    kinds = "cell int, query_id long, doc_id long, score double"
    met = _met(cells, _probes(held, index.centroids, nprobe))
    if not coded:
        return ranked(met.mapInArrow(_best(k, skip_self, None), kinds), k)
    scores = met.mapInArrow(_best(most, skip_self, index.codebooks), kinds)
    if not shortlist:
        return ranked(scores, k)
    best = ranked(scores.select("query_id", F.struct("doc_id", "cell").alias("doc_id"), "score"), most)
    asked = held.mapInArrow(_unit_bytes, "query_id long, asked binary")
    pairs = best.select("query_id", "doc_id.doc_id", "doc_id.cell").join(asked, "query_id")
    wanted = _pack_cells(pairs.select("cell", F.col("query_id").alias("asked_ids"), F.col("doc_id").alias("doc_ids"), "asked"))
    return ranked(_met(index.cells.select("cell", "ids", "vectors"), wanted).mapInArrow(_exact, "query_id long, doc_id long, score double"), k)

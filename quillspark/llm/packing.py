"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are whole numbers up to the capacity, so what fits with what is decided on the histogram
of lengths alone: at most ``capacity`` counts, whatever the number of documents.  From the
longest length down, gaps are filled exactly by a single length, a pair or a triple of lengths,
looked up in the index of single, pair and triple sums and used as often as the counts allow.
What has no exact complement is packed best-fit, the longest first.

Every decision is a pattern (some lengths, so many times).  Pieces then take places by their rank
within their length.  Ranks come from a window within (length, salt) after the salts' counts are
summed, so a length that a third of all pieces share is still spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import _ranges
from quillspark.llm._cluster import cut
from quillspark.llm._words import blocks

Pattern = tuple[int, list[tuple[int, int]]]


class _Sums:
    """The lengths in stock, and which sums of one, two or three of them exist, as bit sets."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.refresh()

    def refresh(self) -> None:
        lengths = np.flatnonzero(self.counts)
        self.single = sum(1 << int(x) for x in lengths)
        self.lengths = lengths.tolist()
        room = (1 << len(self.counts)) - 1
        self.pair = self.triple = 0
        for x in self.lengths:
            self.pair |= self.single << x & room
        for x in self.lengths:
            self.triple |= self.pair << x & room

    def enough(self, parts: list[int]) -> int:
        """How often the stock has these parts."""
        return min(int(self.counts[x]) // parts.count(x) for x in set(parts))

    def exact(self, used: list[int], gap: int, parts: int) -> list[int] | None:
        """So many lengths (one, two or three) with sum ``gap`` that are in stock beside ``used``."""
        ok = lambda more: self.enough(used + more) > 0
        if parts == 1 and self.single >> gap & 1 and ok([gap]):
            return [gap]
        if parts == 2 and self.pair >> gap & 1:
            for a in reversed(self.lengths):
                if 2 * a >= gap > a and self.single >> gap - a & 1 and ok([a, gap - a]):
                    return [a, gap - a]
        if parts == 3 and self.triple >> gap & 1:
            for a in reversed(self.lengths):
                rest = gap - a
                if 3 * a < gap:
                    break
                if rest > 0 and self.pair >> rest & 1:
                    for b in reversed(self.lengths):
                        if 2 * b < rest:
                            break
                        if b < rest and self.single >> rest - b & 1 and ok([a, b, rest - b]):
                            return [a, b, rest - b]
        return None


def _complemented(counts: np.ndarray, most: int) -> list[Pattern]:
    """Patterns that fill sequences exactly by a length and up to ``most`` more; takes them off ``counts``.

    First every length from the longest down gets a single complement, then what is left a pair,
    then a triple, so the small lengths last until they are needed.
    """
    stock, out, capacity = _Sums(counts), [], len(counts) - 1

    def take(parts: list[int]) -> None:
        times = stock.enough(parts)
        for x in parts:
            counts[x] -= times
        out.append((times, sorted(((x, parts.count(x)) for x in set(parts)), reverse=True)))
        if any(not counts[x] for x in parts):
            stock.refresh()

    if counts[capacity]:
        take([capacity])
    for depth in range(1, most + 1):
        for length in range(capacity - 1, 0, -1):
            while counts[length] and (more := stock.exact([length], capacity - length, depth)):
                take([length, *more])
    return out


def _best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing on a histogram: groups of equally filled sequences take a length together."""
    capacity = len(counts) - 1
    groups: list[list[Pattern]] = [[] for _ in counts]  # by free room
    roomy = 0  # bit set of the rooms that have a group
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = roomy >> length
            room = length + ((fits & -fits).bit_length() - 1) if fits else capacity
            many, parts = groups[room].pop() if fits else (left, [])
            if fits and not groups[room]:
                roomy &= ~(1 << room)
            each = room // length
            full = min(many, left // each)
            last = min(left - full * each, each - 1) if full < many else 0
            new = [(full, [*parts, (length, each)], room - each * length), (1, [*parts, (length, last)], room - last * length)]
            rest = many - full - (last > 0)
            for times, own, free in [*(x for x in new if x[0] and x[1][-1][1]), *([(rest, parts, room)] if fits else [])]:
                if times:
                    groups[free].append((times, own))
                    roomy |= (1 << free) if free else 0
            left -= full * each + last
    return [x for g in groups for x in g]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (times, [(length, copies), ...]) that use every piece once.

    Exact complements of one, two and three lengths are used up in turn, and best fit takes the
    residuals.  On histograms without many equal lengths, triples can spend the small ones that best
    fit needs; so the residuals are also packed after pairs, after singles and at once, and the plan
    with the fewest sequences counts, the one with most exact complements between equals.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if counts[0]:
        raise ValueError("a piece has at least one token")
    plans = []
    for most in (3, 2, 1, 0):
        own = counts.copy()
        exact = _complemented(own, most)
        plans.append(exact + _best_fit(own))
    return min(plans, key=lambda p: sum(times for times, _ in p))


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of ranks of each length: those from ``rank`` on go to sequences ``first`` + i, i < times.

    A pattern with several copies of a length has them at ``offset``, ``offset`` + length, ...
    """
    rows, have, sequence = [], {}, 0
    for times, parts in patterns:
        offset = 0
        for length, copies in parts:
            rank = have.get(length, 0)
            rows.append((length, rank, times, sequence, offset))
            have[length] = rank + times * copies
            offset += length * copies
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "first", "offset"), table.T))


def _placed(runs: dict[str, np.ndarray], names: list[str]):
    wide = int(runs["rank"].max() + 1) if len(runs["rank"]) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ranks are below 2**48 and lengths below 2**15, so both fit one sortable number
        key = (runs["length"] << 48) + runs["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            copy, turn = np.divmod(rank - runs["rank"][at], runs["times"][at])
            more = [pa.array(runs["first"][at] + turn), pa.array(runs["offset"][at] + copy * length)]
            own = [_unpacked(batch) if n == "ids" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, *more], names=[*names, "sequence_id", "offset"])

    assert wide < 1 << 48
    return run


def _unpacked(batch: pa.RecordBatch) -> pa.Array:
    """The column ids as lists of numbers; each row has ``length`` of them in 2 or 4 bytes."""
    n = batch.column("length").to_numpy(zero_copy_only=False)
    flat = [np.frombuffer(x, f"<u{len(x) // k}").astype(np.int32) for x, k in zip(_ranges.values(batch.column("ids")), n.tolist())]
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))


def _pieces(path: str, capacity: int, end: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.bpe import encoder

        bpe = encoder(path)
        width = "<u2" if bpe.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts, 1 << 18, 2000):
                flat, size = bpe.encode(texts[i:j])
                at, out = 0, []
                for doc, n in zip(doc_ids[i:j], size.tolist()):
                    own = np.append(flat[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    head = (n + 1) % capacity
                    for piece, start in enumerate([*([0] if head else []), *range(head, n + 1, capacity)]):
                        part = own[start : head if head and not start else start + capacity]
                        out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(width).tobytes() if ids else None))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids) of each text's tokens and the end token.

    Texts of more than ``capacity`` tokens are cut; the first piece takes what is over.  Null and empty
    texts are the end token alone; rows that repeat a doc_id have pieces each.  ids are little-endian
    numbers of 2 bytes, or of 4 where the vocabulary needs them.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, capacity, end, ids), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with the sequence and offset that each is packed at.

    Null and empty texts are the end token alone.  Rows that repeat a doc_id are packed each for
    itself, null doc_ids too.  An empty table gives an empty result.  Other columns are ignored.
    Offsets in a sequence are gapless from 0; sequence_id counts from 0.  With ``ids`` each piece has
    its token ids, so a sequence is its pieces' ids in the order of offset.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end, ids))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = places(plan(histogram, capacity))
    salts = max(64, sum(histogram.values()) // 100_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(own)).join(base, ["length", "salt"])
    names = pieces.columns
    kinds = ", ".join(f"{f.name} {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, (F.col("base") + F.col("r") - 1).alias("rank")).mapInArrow(_placed(runs, names), f"{kinds}, sequence_id long, offset long")

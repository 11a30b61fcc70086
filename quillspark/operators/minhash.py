"""MinHash of character shingles: signatures, and near duplicates found by bands and verified exactly.

A text's shingles are its substrings of ``k`` characters.  A shingle's hash is a weighted sum of its code
points modulo a prime, and a permutation is a linear function of that, so everything is arithmetic that
any SQL engine can repeat.  The task that reads a text takes all its minima, by arrays of shingles; no row
is made of a shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.components import connected_components
from quillspark.sources.records import cut

#: The prime 2**31 - 1: products of two remainders fit 63 bits.
PRIME = (1 << 31) - 1
#: Shingles whose minima are taken at once: they and all permutations of them fit a core's cache.
SLICE = 512
#: Factors of the 64-bit hashes of characters.
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a bucket that one task pairs with the others at most; larger buckets are parted by salts.
CROWD = 500
#: Digests of texts whose minima a task keeps.
MOST_HELD = 20_000


@dataclass(frozen=True)
class Permutations:
    """``n`` linear permutations and the weights of a shingle's ``k`` characters, all from one seed."""

    n: int = 100
    k: int = 8
    seed: int = 42

    def numbers(self) -> tuple[list[int], list[int], list[int]]:
        """Weights of characters, factors and shifts."""
        r = np.random.default_rng(self.seed)
        return tuple(r.integers(1, PRIME, m).tolist() for m in (self.k, self.n, self.n))


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Texts of a column; bytes that are no UTF-8 become U+FFFD."""
    return (None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist())


def _codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _sums(text: str, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the code points of each shingle, modulo 2**64; empty for a shorter text."""
    c, n = _codes(text), len(text) - len(weights) + 1
    return sum((c[j : j + n] * w for j, w in enumerate(weights)), np.zeros(n, np.uint64)) if n > 0 else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    x = _sums(text or "", _ODD[:k])
    x ^= x >> np.uint64(32)
    return np.unique(x * np.uint64(0x9E3779B97F4A7C15))


def _signer(permutations: Permutations):
    """Makes a text's minima, or None for one without shingles."""
    weights, factors, shifts = (np.array(x, np.uint64) for x in permutations.numbers())
    factors, shifts, prime, bits = factors[:, None], shifts[:, None], np.uint64(PRIME), np.uint64(31)

    def signature(text: str) -> np.ndarray | None:
        h = _sums(text, weights) % prime
        best = None
        for i in range(0, len(h), SLICE):
            x = h[i : i + SLICE] * factors
            x += shifts
            # the remainder of a number below 2**62: 2**31 is 1 modulo the prime, so the sum is below twice the
            # prime, and what is below the prime wraps around when that is taken off
            y = x >> bits
            x &= prime
            x += y
            z = x.astype(np.uint32)
            m = z.min(1)
            z -= np.uint32(PRIME)
            m = np.minimum(m, z.min(1))
            best = m if best is None else np.minimum(best, m)
        return best

    return signature


def _minima(permutations: Permutations):
    signature = _signer(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, m) for i, m in ((i, signature(t)) for i, t in enumerate(_texts(batch.column(1))) if t is not None) if m is not None]
            values = pa.array(np.concatenate([m for _, m in found]).astype(np.int64) if found else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * permutations.n), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), lists], names=[batch.schema.names[0], "signature"])

    return run


def _counted(k: int, exact: bool):
    """The batch with the number of distinct shingles, of the substrings themselves or of their 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = (lambda t: len({t[i : i + k] for i in range(len(t) - k + 1)})) if exact else (lambda t: len(shingle_set(t, k)))
            n = pa.array([count(t or "") for t in _texts(batch.column("clean"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "n_shingles"])

    return run


def shingle_counts(texts: DataFrame, k: int = 8, exact: bool = True) -> DataFrame:
    """``texts`` (any columns, clean) with n_shingles: how many distinct substrings of ``k`` characters each has."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(_counted(k, exact), f"{kinds}, n_shingles long")


def _sizes(left: Iterable[str | None], right: Iterable[str | None], k: int) -> tuple[pa.Array, pa.Array]:
    """Sizes of the intersections and unions of the texts' shingle sets."""
    common, total = [], []
    for a, b in zip(left, right):
        x, y = shingle_set(a, k), shingle_set(b, k)
        common.append(len(np.intersect1d(x, y, assume_unique=True)))
        total.append(len(x) + len(y) - common[-1])
    return pa.array(common, pa.int64()), pa.array(total, pa.int64())


def _overlaps(k: int):
    """The columns before clean_a, clean_b of pairs of texts, and common, total: sizes of their shingle sets' intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = _sizes(_texts(batch.column("clean_a")), _texts(batch.column("clean_b")), k)
            own = [i for i, n in enumerate(batch.schema.names) if n not in ("clean_a", "clean_b")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), common, total], names=[*(batch.schema.names[i] for i in own), "common", "total"])

    return run


def overlaps(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (any columns, clean_a, clean_b) with common, total in place of the texts."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("clean_a", "clean_b"))
    return pairs.mapInArrow(_overlaps(k), f"{kinds}, common long, total long")


def _signed_texts(permutations: Permutations):
    """doc_id, text_hash, shingled, minima of batches doc_id, text: raw texts are cleaned, hashed and signed in their task.

    Of equal texts that follow in a task only one is signed.
    """
    signature = _signer(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes | None] = {}
        for batch in batches:
            hashes, minima = [], []
            for text in _texts(batch.column(1)):
                clean, digest = _cleaned(text)
                if digest not in held:
                    if len(held) >= MOST_HELD:
                        held.clear()
                    m = signature(clean)
                    held[digest] = None if m is None else m.astype("<u4").tobytes()
                hashes.append(_hash(digest))
                minima.append(held[digest])
            columns = [pa.array(hashes, pa.int64()), pa.array([m is not None for m in minima]), pa.array(minima, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "text_hash", "shingled", "minima"])

    return run


def _cleaned(text: str | None) -> tuple[str, bytes]:
    """A text as ``T.clean`` gives it, and its digest."""
    clean = " ".join((text or "").split())
    return clean, hashlib.blake2b(clean.encode(), digest_size=16).digest()


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_hash, clean of batches doc_id, text."""
    for batch in batches:
        found = [_cleaned(t) for t in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array([_hash(d) for _, d in found], pa.int64()), pa.array([t for t, _ in found], pa.string())], names=["text_hash", "clean"])


def signed_texts(docs: DataFrame, permutations: Permutations = Permutations(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, shingled, minima (4 bytes each; null for texts without shingles) of every row, in one pass over the texts."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_signed_texts(permutations), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, shingled boolean, minima binary")


def text_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, clean: equal clean texts have one hash, under which all their rows count."""
    clean = T.clean(F.col(text).cast("string"))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(clean).alias("text_hash"), clean.alias("clean"))


def signatures(texts: DataFrame, key: str, permutations: Permutations = Permutations()) -> DataFrame:
    """key, signature (an array of minima) of texts (key, clean) that have a shingle; equal keys' texts are one."""
    rows = texts.select(key, F.col("clean").cast("string").alias("clean"))
    signed = rows.mapInArrow(_minima(permutations), f"`{key}` {rows.schema[key].dataType.simpleString()}, signature array<long>")
    minima = [F.min(F.get("signature", F.lit(i))).alias(f"m{i}") for i in range(permutations.n)]
    return signed.groupBy(key).agg(*minima).select(key, F.array(*(F.col(f"m{i}") for i in range(permutations.n))).alias("signature"))


def _bands(signed: DataFrame, bands: int, n: int) -> DataFrame:
    """bucket, node: in which bucket of each band a signature lies."""
    if n % bands:
        raise ValueError(f"{n} minima can't be cut into {bands} equal bands")
    r = n // bands
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("minima", 4 * i * r + 1, 4 * r)) for i in range(bands)))
    return signed.select(F.explode(keys).alias("bucket"), F.col("text_hash").alias("node"))


def _owners(held: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """text_hash, clean of a row of each of the ``nodes``: only their rows' texts are shuffled, and the rows are found by their ids.

    A repeated id may bring other rows' texts along, which are left out by their hash.
    """
    own = cut(held.join(nodes.select(F.col("node").alias("text_hash")), "text_hash", "left_semi").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.mapInArrow(_hashed, "text_hash long, clean string").join(own.select("text_hash"), "text_hash", "left_semi")


def _sets(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, clean, n_shingles of the ``nodes``' texts, each once.  Sets are made where they are compared, as they are larger than their texts."""
    own = texts.join(nodes.select(F.col("node").alias("text_hash")), "text_hash", "left_semi").groupBy("text_hash").agg(F.max("clean").alias("clean"))
    return shingle_counts(own.select(F.col("text_hash").alias("node"), "clean"), k, exact=False)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs a, b whose shingle sets have a Jaccard similarity of ``percent`` or more."""
    side = lambda n, *c: sets.select(F.col("node").alias(n), *(F.col(x).alias(f"{x}_{n}") for x in c))
    near = pairs.join(side("a", "n_shingles"), "a").join(side("b", "n_shingles"), "b")
    near = near.where(f"100 * least(n_shingles_a, n_shingles_b) >= {percent} * greatest(n_shingles_a, n_shingles_b)").select("a", "b")
    both = near.join(side("b", "clean"), "b").join(side("a", "clean"), "a").select("a", "b", "clean_a", "clean_b")
    return cut(overlaps(both, k).where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b"))


def _led(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's least one."""
    leaders = members.groupBy("bucket").agg(F.min("node").alias("a"))
    return members.join(leaders, "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _across(members: DataFrame, roots: DataFrame, crowd: int) -> DataFrame:
    """Pairs of members of one bucket that are in different components so far; crowded buckets by salts.

    One side of a bucket of n members is parted by n / ``crowd`` salts and the other repeated for each.
    """
    named = cut(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp")))
    mixed = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    salted = cut(named.join(mixed.select("bucket", F.ceil(F.col("n") / F.lit(crowd)).cast("int").alias("salts")), "bucket"))
    left = salted.select("bucket", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    right = salted.select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    return left.join(right, ["bucket", "salt"]).where("comp_a < comp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = 20, permutations: Permutations = Permutations(), key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id, n_class of every row: the least doc_id that links reach, and the class's rows.

    Two texts link if their signatures share a band and their shingle sets have a Jaccard similarity of
    ``percent`` or more, which is verified exactly; two such texts share no band with the chance
    (1 - s**r)**bands, for r minima a band (0.005 at 0.75 with the defaults).  Equal clean texts are one
    node, so copies make no pairs.  A bucket's members are first compared with one of them, and only
    those in different components then with each other; so near copies cost pairs in
    proportion to their number.

    Texts with fewer than k characters have no shingles and are classes of their own, as are rows
    with a null id, whose class is null.  Rows that repeat an id stay, each with its own text's class.
    """
    # texts are read twice: here, and those that share a band with another to be compared
    held = cut(signed_texts(docs, permutations, key, text))
    return _classes(held, docs, percent, bands, permutations, key, text, crowd)


def _classes(held: DataFrame, docs: DataFrame, percent: int, bands: int, permutations: Permutations, key: str, text: str, crowd: int) -> DataFrame:
    """``near_duplicates`` of rows that are signed."""
    signed = held.where("doc_id IS NOT NULL AND shingled").groupBy("text_hash").agg(F.first("minima").alias("minima"))
    table = cut(_bands(signed, bands, permutations.n))
    shared = table.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut(table.join(shared, "bucket", "left_semi"))
    nodes = members.select("node").distinct()
    sets = cut(_sets(_owners(held.where("doc_id IS NOT NULL"), nodes, docs, key, text), nodes, permutations.k))
    first = _similar(_led(members), sets, percent, permutations.k)
    rest = _similar(_across(members, connected_components(first), crowd), sets, percent, permutations.k)
    roots = connected_components(first.unionByName(rest))
    named = held.where("shingled AND doc_id IS NOT NULL").groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = cut(named.join(roots, named["text_hash"] == roots["node"], "left").select("text_hash", "least", "n", F.coalesce("root", "text_hash").alias("root")))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"))
    of_text = named.select("text_hash", "root").join(classes, "root").select("text_hash", "class_id", "n_class")
    out = held.join(of_text, "text_hash", "left")
    own = F.col("shingled") & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("n_class")).otherwise(F.lit(1)).cast("long").alias("n_class"))


def compare(docs: DataFrame, pairs: DataFrame, permutations: Permutations = Permutations(), key: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> DataFrame:
    """a, b, jaccard, agreement of pairs a, b of doc_ids: exact similarity, and its estimate by signatures.

    Pairs of which a text is missing or has no shingle are left out.  ``held`` are the rows as ``signed_texts`` has them, if
    they are there already.  Only texts of the pairs are shuffled; a repeated id has the least minima of its texts.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    signed = signed_texts(own, permutations) if held is None else held.join(ids, "doc_id", "left_semi")
    minima = signed.where("shingled").groupBy("doc_id").agg(F.collect_list("minima").alias("minima"))  # one of each row with the id
    found = cut(own.join(minima, "doc_id"))
    side = lambda n: found.select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}"), F.col("minima").alias(f"m_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    rows = both.mapInArrow(_compared(permutations.k), f"{kinds}, common long, total long, agreement double")
    return rows.select("a", "b", F.round(F.col("common") / F.col("total"), 6).alias("jaccard"), F.round("agreement", 6).alias("agreement"))


def _compared(k: int):
    """a, b, common, total, agreement of batches with a, b and the texts and minima of both."""
    least = lambda lists: np.min([np.frombuffer(m, "<u4") for m in lists], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [[_cleaned(t)[0] for t in _texts(batch.column(f"text_{n}"))] for n in "ab"]
            common, total = _sizes(clean[0], clean[1], k)
            agreed = [float(np.count_nonzero((a := least(x)) == least(y))) / len(a) for x, y in zip(batch.column("m_a").to_pylist(), batch.column("m_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), common, total, pa.array(agreed, pa.float64())], names=["a", "b", "common", "total", "agreement"])

    return run


def agreement_in_classes(docs: DataFrame, percent: int = 75, bands: int = 20, permutations: Permutations = Permutations(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``compare`` of each near duplicate with the first document of its class; texts are signed once for both."""
    held = cut(signed_texts(docs, permutations, key, text))
    classes = _classes(held, docs, percent, bands, permutations, key, text, CROWD).where("doc_id <> class_id")
    return compare(docs, classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")), permutations, key, text, held)

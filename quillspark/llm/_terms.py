"""Hashed terms of whole texts for the trained scorers, and bounded samples of labelled rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._cluster import release
from quillspark.llm._words import _BYTE, _R_BYTE, Words, blocks, mix, powers, utf8

U64 = np.uint64
_PUNCTUATION = np.array([not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
#: Bytes by kind: letters, capitals and digits become one sign each; the others stay.
_SHAPE = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)

#: texts -> (text of each term, term hash, value), by text
Terms = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash), sorted by text, and how often each occurs."""
    order = np.argsort(h, kind="stable")
    doc, h = doc[order].astype(np.uint16), h[order]
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at].astype(np.int64), h[at], np.diff(np.concatenate((at, [len(h)])))


def word_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words and their first 5 and 6 bytes, as presence; beginnings that come 2, 4 or
    8 times have further terms.  So inflected forms share terms, and repetition counts."""
    words = Words(texts, lower=True, space=_PUNCTUATION)
    doc, h = words.doc_of_word(), words.hashes()
    p, inv = powers(_R_BYTE, len(words.buf) + 1)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE[words.buf] * p[: len(words.buf)])))
    docs, hashes = [], []
    d, x, _ = counted(doc, h)
    docs.append(d)
    hashes.append(x)
    for size in (5, 6):
        long = words.end - words.start >= size
        a = words.start[long]
        begin = mix((total[a + size] - total[a]) * inv[a] + U64(1000 + size))
        d, x, n = counted(doc[long], begin)
        for k, least in enumerate((1, 2, 4, 8)):
            often = n >= least
            docs.append(d[often])
            hashes.append(mix(x[often] + U64(k)))
    d, x = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(d.astype(np.uint16), kind="stable")
    return d[order], x[order], np.ones(len(d))


def style_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and word shapes with the root of their share of the text, and repetition and length.

    A shape has one sign for each run of letters, capitals or digits: ``Ends.***`` is ``Aa.***``.
    """
    words = Words(texts)
    doc, h, n = words.doc_of_word(), words.hashes(), np.maximum(words.count, 1)
    shape = _SHAPE[words.buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 32)
    short = Words([shape[keep].tobytes()]) if len(shape) else words
    parts = []
    for kind, x in ((1, h), (2, short.hashes())):
        d, x, k = counted(doc, mix(x + U64(kind)))
        parts.append((d, x, np.sqrt(k / n[d])))
    repeats = np.zeros(len(texts))
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        np.add.at(repeats, doc[1:][same], 1)
    every = np.arange(len(texts))
    for kind, v in ((3, np.sqrt(repeats / n)), (4, (words.count < 50) * 1.0), (5, (words.count < 20) * 1.0)):
        parts.append((every, np.full(len(texts), mix(np.array([kind], U64))[0]), v))
    d, x, v = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(d.astype(np.uint16), kind="stable")
    return d[order], x[order], v[order]


def collect_terms(docs: DataFrame, terms: Terms, bits: int) -> dict[str, np.ndarray]:
    """(row, bucket, value) triples and labels of a bounded sample with columns text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(0))]
            for i, j in blocks(texts):
                d, h, v = terms(texts[i:j])
                b = (h >> U64(64 - bits)).astype("<i4")
                at = np.searchsorted(d, np.arange(j - i + 1))
                rows = [(b[x:y].tobytes(), v[x:y].astype("<f4").tobytes()) for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["label", "b", "v"])

    got = docs.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, b binary, v binary").toArrow()
    b = [np.frombuffer(x, "<i4") for x in got.column("b").to_pylist()]
    v = [np.frombuffer(x, "<f4") for x in got.column("v").to_pylist()]
    labels = got.column("label").to_numpy()
    del got
    size = np.fromiter(map(len, b), np.int64, len(b))
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    # Rows come in any order; sorting them by content makes the fit the same each time.
    order = sorted(range(len(b)), key=lambda i: hashlib.blake2b(b[i].tobytes() + v[i].tobytes(), digest_size=16).digest())
    return {"label": labels[order] if len(order) else labels, "row": np.repeat(np.arange(len(b), dtype=np.int32), size[order] if len(order) else size), "bucket": join([b[i] for i in order], "<i4"), "value": join([v[i] for i in order], "<f4")}


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def hash_share(share: float, *columns):
    """True for about ``share`` of the rows, by a hash of the columns; for all if it is 1 or more."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2) < int(share * (1 << 62)) if share < 1 else F.lit(True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label, most_rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """text, label of about ``most_rows`` labelled rows that aren't held out, chosen by a hash of the id.

    ``label`` is a column expression on ``labels``; rows where it is null don't count.  The chosen
    ids are broadcast: there are ``most_rows`` of them, give or take a few hundredths.  Rows that repeat
    an id and its text count once.  If the texts are more than ``most_rows`` by a tenth or have more
    than ``most_bytes``, those with the least hashes are taken that are about as many.  All shares are
    of 62 bits of a hash, so they hold for any number of rows and give the same rows each time.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, most_rows / max(n, 1))
    chosen = known.where(hash_share(share, "doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    found = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(most_bytes / max(found.bytes or 0, 1), 1.1 * most_rows / max(found.n, 1))
    return rows.where(hash_share(share, "doc_id", "text", F.lit(7))).select("text", "label")


def scored(docs: DataFrame, terms: Terms, bits: int, model: Callable[[np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]], names: list[str], kept: list[str]) -> DataFrame:
    """The ``kept`` columns of ``docs``, which has text too, and the model's columns of doubles."""
    clash = {n.lower() for n in names} & {c.lower() for c in kept}
    if clash:
        raise ValueError(f"columns of these names can't be kept beside the model's: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            for i, j in blocks(texts):
                d, h, v = terms(texts[i:j])
                out = model(d, (h >> U64(64 - bits)).astype(np.int64), v, j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in held), *(pa.array(x, pa.float64()) for x in out)], names=[*held, *names])

    # mapInArrow takes a dot in a name for a field, so the kept columns have names of their own meanwhile
    held = [f"kept{i}" for i in range(len(kept))]
    rows = docs.select(*(docs[f"`{c.replace('`', '``')}`"].alias(h) for c, h in zip(kept, held)), docs["text"].alias("text"))
    kinds = T.StructType([*(rows.schema[h] for h in held), *(T.StructField(n, T.DoubleType()) for n in names)])
    return rows.mapInArrow(run, kinds).toDF(*kept, *names)


class Adam:
    """Adam steps on a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, s in zip(self.params, grads, self.m, self.s):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

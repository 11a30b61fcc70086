"""Search entry points: semantic by method, hybrid, and text embedding by a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.stopwords import DEFAULT
from quillspark.operators import fusion, ivf, lexical, lsh
from quillspark.operators.vector import exact_knn
from quillspark.sources.records import cut, report

#: Takes a list of texts and gives a list of vectors.
Encoder = Callable[[list[str]], list[list[float]]]
#: Words that a task embeds at once (and the rest of a document), terms whose signs it sums at once, and digests that it keeps.
MOST_WORDS, MOST_SIGNS, MOST_DIGESTS = 100_000, 1 << 15, 1 << 17


def embed(texts: DataFrame, load: Callable[[], Encoder], batch: int = 256) -> DataFrame:
    """doc_id, vector of texts (doc_id, text); ``load`` makes the encoder once in each task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            t = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(t), batch) for v in encode(t[i : i + batch])])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.select("doc_id", F.pandas_udf(run, "array<float>")("text").alias("vector"))


def embed_terms(terms: DataFrame, dims: int = 64) -> DataFrame:
    """doc_id, vector of terms (doc_id, term, tf): a signed random projection of hashed terms.

    Each term adds its weight, the number of binary digits of tf, with a sign by dimension that comes
    from the bits of its MD5 digest; so ``dims`` is 128 at most.  All of it is compiled sums of whole
    numbers, equal on any number of tasks.  Texts that share terms point the same way.
    """
    if not 0 < dims <= 128:
        raise ValueError("a digest has signs for 1 to 128 dimensions")
    words = [F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(-(-dims // 32))]
    rows = terms.select("doc_id", F.length(F.bin("tf")).alias("w"), F.md5("term").alias("d")).select("doc_id", "w", *(x.alias(f"h{i}") for i, x in enumerate(words)))
    sums = [F.sum(F.when(F.shiftright(f"h{j // 32}", j % 32).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"v{j}") for j in range(dims)]
    return rows.groupBy("doc_id").agg(*sums).select("doc_id", F.array(*(F.col(f"v{j}").cast("float") for j in range(dims))).alias("vector"))


def embed_words(words: DataFrame, dims: int = 64) -> DataFrame:
    """doc_id, vector of words (doc_id, title_words, abstract_words; one row of each id): what ``embed_terms`` makes of their postings.

    Words are stemmed as rows, and those of a row stay together in their task, which sends on one vector for them: no
    word is shuffled.
    """
    if not 0 < dims <= 128:
        raise ValueError("a digest has signs for 1 to 128 dimensions")
    fields = F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"{f}_words").alias("words")) for i, f in enumerate(lexical.WEIGHTS)))
    rows = words.select("doc_id", F.inline(fields)).select("doc_id", "field", F.explode("words").alias("word"))
    kind = words.schema["doc_id"].dataType.simpleString()
    return T.with_stems(rows).select("doc_id", "field", "term").mapInArrow(_embedded(dims), f"doc_id {kind}, vector array<float>")


def _embedded(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, digest = [], 0, lru_cache(MOST_DIGESTS)(lambda term: hashlib.md5(term).digest())
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= MOST_WORDS:
                first = np.flatnonzero(_begins(batch.column(0)))
                if len(held) > 1 and held[-2].column(0)[-1] == batch.column(0)[0]:
                    first = first[1:]  # the batch goes on with a document
                if len(first) and n - batch.num_rows + first[-1]:
                    yield _vectors([*held[:-1], batch.slice(0, first[-1])], dims, digest)
                    held = [batch.slice(first[-1])]
                    n = held[0].num_rows
        if held:
            yield _vectors(held, dims, digest)

    return run


def _begins(x: pa.Array) -> np.ndarray:
    """Where a value isn't the one before it."""
    return np.concatenate(([True], pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)))


def _changes(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _vectors(batches: list[pa.RecordBatch], dims: int, digest: Callable[[bytes], bytes]) -> pa.RecordBatch:
    """doc_id, vector of whole documents' rows doc_id, field, term."""
    ids, field, term = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    begin = _begins(ids)
    term = term.dictionary_encode()
    digests = np.frombuffer(b"".join(map(digest, term.dictionary.cast(pa.binary()).to_pylist())), ">u4").astype("<u4")
    bits = np.unpackbits(digests.view(np.uint8).reshape(-1, 16), axis=1, count=dims, bitorder="little")
    known, fields = len(bits), len(lexical.WEIGHTS)
    keys = ((begin.cumsum() - 1) * known + term.indices.to_numpy()) * fields + field.to_numpy()
    keys, tf = np.unique(keys, return_counts=True)
    first = _changes(keys // fields)
    doc, code = np.divmod(keys[first] // fields, known)
    weight = np.frexp(np.add.reduceat(np.minimum(tf, lexical.MOST_TF), first))[1]  # binary digits
    sums = np.zeros((int(begin.sum()), dims), np.int64)
    for i in range(0, len(doc), MOST_SIGNS):
        d, c, w = (x[i : i + MOST_SIGNS] for x in (doc, code, weight))
        at = _changes(d)
        sums[d[at]] += 2 * np.add.reduceat(bits[c] * w[:, None], at) - np.add.reduceat(w, at)[:, None]
    offsets = np.arange(len(sums) + 1, dtype=np.int32) * dims
    return pa.RecordBatch.from_arrays([ids.filter(pa.array(begin)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel().astype(np.float32)))], names=["doc_id", "vector"])


def embed_texts(texts: DataFrame, stop_words: Sequence[str] = DEFAULT, dims: int = 64) -> DataFrame:
    """doc_id, vector of texts (doc_id, text) by ``embed_terms``; texts without terms have none."""
    rows = texts.select("doc_id", F.explode(T.words(F.col("text"), stop_words)).alias("word"))
    return embed_terms(T.with_stems(rows).groupBy("doc_id", "term").agg(F.count("*").alias("tf")), dims)


def semantic_text_search(method: str, queries: DataFrame, k: int = 10, stop_words: Sequence[str] = DEFAULT, dims: int = 64, **options) -> DataFrame:
    """``semantic_search`` of queries (query_id, text), which ``embed_texts`` makes vectors of."""
    asked = embed_texts(queries.select(F.col("query_id").alias("doc_id"), "text"), stop_words, dims).withColumnRenamed("doc_id", "query_id")
    return semantic_search(method, cut(asked), k, **options)


def semantic_search(method: str, queries: DataFrame, k: int = 10, *, vectors: DataFrame | None = None, index: ivf.IvfIndex | None = None, planes=None, bands: int = 10, nprobe: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score by ``exact``, ``ivf`` or ``lsh``; other methods are refused."""
    method = method.lower()
    if method == "exact":
        return exact_knn(vectors, queries, k, skip_self=False)
    if method == "ivf":
        return ivf.ivf_search(index, queries, k, nprobe)
    if method == "lsh":
        return lsh.lsh_search(vectors, queries, planes, bands, k)
    raise ValueError(f"no such method: {method}")


def lexical_search(path: str, queries: DataFrame, top_k: int = 10, **options) -> DataFrame:
    """BM25 over a saved index."""
    return lexical.bm25_search(lexical.LexicalIndex.load(queries.sparkSession, path), queries, top_k, **options)


def hybrid_search(semantic: DataFrame, words: DataFrame, names: DataFrame, k: int = 60, limit: int = 60) -> DataFrame:
    """query_id, rank, doc_id, score, title of the fused rankings; unknown ids get a stand-in title."""
    fused = fusion.rrf([semantic, words], k, limit)
    return fused.join(names, "doc_id", "left").select("query_id", "rank", "doc_id", "score", F.coalesce("title", F.lit("Title not found.")).alias("title"))


__all__ = ["embed", "embed_terms", "embed_texts", "embed_words", "hybrid_search", "lexical_search", "report", "semantic_search", "semantic_text_search"]

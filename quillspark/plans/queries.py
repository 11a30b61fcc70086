"""The registered queries of the retrieval engine.

``documents`` stands for the corpus (title: the first 8 words), ``embeddings`` for its vectors
with vec_id = doc_id.  Queries are the rows whose id is divisible by 100, over all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.vectors import cosine, hyperplanes
from quillspark.operators import evaluate, fusion, ivf, lexical, lsh, minhash, search, store, vocabulary as vocab
from quillspark.operators.vector import exact_knn, signatures
from quillspark.sources import records

BITS, BANDS, DIMS = 64, 16, 64
#: Of searches: more bands of as many bits find more neighbours.
SEARCH_BITS, SEARCH_BANDS = 96, 24
K1 = (0.5, 1.0, 1.5, 2.0)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.corpus(_documents(spark, sf_dir))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


_saved: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Path, length and time of change of the files of a table, so that a changed table is seen."""
    jvm, found = spark._jvm, []
    for name in sorted(spark.read.parquet(path).inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        s = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p)
        found.append((name, s.getLen(), s.getModificationTime()))
    return tuple(found)


def _once(spark: SparkSession, table: str, kind: str, write: Callable[[str], None]) -> str:
    """Where an index of a table is saved, which ``write`` does once in an application."""
    key = (kind, spark.sparkContext.applicationId, _state(spark, table))
    if key not in _saved:
        path = f"{records.shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        write(path)
        _saved[key] = path
    return _saved[key]


def _index(spark: SparkSession, sf_dir: str) -> store.StoredIndex:
    """The lexical index of the corpus."""
    return store.load(spark, _once(spark, f"{sf_dir}/documents.parquet", "lexical", lambda path: store.IndexStore(spark, path).append(records.parted(_documents(spark, sf_dir)))))


def _ivf(spark: SparkSession, sf_dir: str, m: int | None = None) -> ivf.IvfIndex:
    """The cells of the vectors, tuned on vectors that are not asked for."""
    vectors = _vectors(spark, sf_dir)
    tuning = vectors.where("doc_id % 100 <> 0").withColumnRenamed("doc_id", "query_id")
    path = _once(spark, f"{sf_dir}/embeddings.parquet", f"ivf{m or ''}", lambda path: ivf.build_ivf(vectors, m=m, nbits=6, tuning=tuning).save(path))
    return ivf.IvfIndex.load(spark, path)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("id", "title", "abstract", F.lit("").alias("categories"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parted(_documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), T.clean(F.col("title")).alias("title"))


def sanitize(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("clean"))


def embedding_texts(spark, sf_dir):
    return records.embedding_texts(records.sanitize(_raw(spark, sf_dir)))


def tokenize(spark, sf_dir):
    t = lexical.tokenized(_corpus(spark, sf_dir))
    return t.select("doc_id", F.array_join("title_tokens", " ").alias("title_tokens"), F.array_join("abstract_tokens", " ").alias("abstract_tokens"))


def stem_vocab(spark, sf_dir):
    words = _documents(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return T.with_stems(words, name="stem")


def term_frequencies(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("term", "doc_id", "field", "tf")


def doc_lengths(spark, sf_dir):
    return _index(spark, sf_dir).lengths


def term_stats(spark, sf_dir):
    return _index(spark, sf_dir).term_stats()


def index_stats(spark, sf_dir):
    return _index(spark, sf_dir).index_stats()


def bm25_top10(spark, sf_dir):
    return lexical.bm25_search(_index(spark, sf_dir), _queries(spark, sf_dir))


def bm25_top100(spark, sf_dir):
    return lexical.bm25_search(_index(spark, sf_dir), _queries(spark, sf_dir), 100, k1=1.2, b=0.5)


def bm25_grid_recall(spark, sf_dir):
    return evaluate.bm25_grid_recall(_index(spark, sf_dir), _queries(spark, sf_dir), _knn(spark, sf_dir))


def bm25_grid_pivot(spark, sf_dir):
    return evaluate.recall_pivot(bm25_grid_recall(spark, sf_dir), "b", "k1", K1, "k1_")


def titles(spark, sf_dir):
    rows = records.sanitize(_raw(spark, sf_dir))
    return records.titles(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "title")


def truth_query_texts(spark, sf_dir):
    raw = _corpus(spark, sf_dir).select("id", "abstract")
    return records.truth_queries(raw, _vector_queries(spark, sf_dir))


def prefix_sample(spark, sf_dir):
    return records.first_rows(_corpus(spark, sf_dir), 100).select("id", "title")


def _knn(spark, sf_dir):
    return exact_knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))


def exact_knn_top10(spark, sf_dir):
    return _knn(spark, sf_dir)


def cosine_pairs(spark, sf_dir):
    """Each vector with the one of the next id."""
    v = _vectors(spark, sf_dir)
    after = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("next"))
    return v.join(after, "doc_id").select("doc_id", F.round(cosine(F.col("vector"), F.col("next")), 6).alias("cosine"))


def rrf_fusion(spark, sf_dir):
    semantic = exact_knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 30, skip_self=False)
    return fusion.rrf([semantic, lexical.bm25_search(_index(spark, sf_dir), _queries(spark, sf_dir), 30)])


def hybrid_search(spark, sf_dir):
    semantic = exact_knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 30, skip_self=False)
    words = lexical.bm25_search(_index(spark, sf_dir), _queries(spark, sf_dir), 30)
    return search.hybrid_search(semantic, words, _titles(spark, sf_dir))


def report_lines(spark, sf_dir):
    return records.report(_knn(spark, sf_dir), _titles(spark, sf_dir))


def lsh_signatures(spark, sf_dir):
    s = signatures(_vectors(spark, sf_dir), hyperplanes(BITS, DIMS))
    return s.select("doc_id", F.array_join("signature", "").alias("signature"))


def _bands(spark, sf_dir):
    return lsh.band_table(signatures(_vectors(spark, sf_dir), hyperplanes(BITS, DIMS)), BITS, BANDS)


def lsh_bands(spark, sf_dir):
    return _bands(spark, sf_dir)


def lsh_candidate_groups(spark, sf_dir):
    return lsh.candidate_groups(_bands(spark, sf_dir))


def lsh_search(spark, sf_dir):
    return lsh.lsh_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), hyperplanes(SEARCH_BITS, DIMS), SEARCH_BANDS)


def _grid(spark, sf_dir):
    return evaluate.lsh_grid(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), _knn(spark, sf_dir), hyperplanes(256, DIMS))


def lsh_grid(spark, sf_dir):
    return evaluate.grid_summary(_grid(spark, sf_dir), _vectors(spark, sf_dir).agg(F.count("*").alias("n")))


def recall_pivot(spark, sf_dir):
    means = _grid(spark, sf_dir).groupBy("num_bits").pivot("b", [4, 8, 16, 32]).agg(F.round(F.avg("recall"), 6))
    return means.select("num_bits", *(F.col(str(b)).alias(f"b{b}") for b in (4, 8, 16, 32)))


def pareto_frontier(spark, sf_dir):
    return evaluate.pareto(lsh_grid(spark, sf_dir), "avg_candidates", "avg_recall", ["num_bits", "b"])


def lsh_s_curve(spark, sf_dir):
    """The S-curve at the cosines of each vector and the one of the next id, beside the bands they do share."""
    pairs = cosine_pairs(spark, sf_dir).select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), "cosine")
    return evaluate.collision_curve(pairs, _bands(spark, sf_dir), BITS // BANDS, BANDS)


def candidate_histogram(spark, sf_dir):
    return evaluate.histogram(_grid(spark, sf_dir), "n_candidates")


def shingle_counts(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("clean"))
    return minhash.shingle_counts(docs, 8).select("doc_id", "n_shingles")


def minhash_signatures(spark, sf_dir):
    """100 minima for each distinct text of a document, of its shingles of 8 characters."""
    docs = _documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("clean"))
    return minhash.signatures(docs, "doc_id").select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


def near_duplicate_classes(spark, sf_dir):
    """The class of each document by shingles of 8 characters, 20 bands of 5 minima, and similarity 0.75."""
    return minhash.near_duplicates(_documents(spark, sf_dir))


def minhash_agreement(spark, sf_dir):
    """Each near duplicate with the first document of its class: exact similarity, and the signatures' estimate."""
    return minhash.agreement_in_classes(_documents(spark, sf_dir))


def vocabulary(spark, sf_dir):
    return vocab.vocabulary(_index(spark, sf_dir).term_stats())


def one_hot_rows(spark, sf_dir):
    index = _index(spark, sf_dir)
    hot = vocab.one_hot_pairs(index.postings, index.lengths, vocab.vocabulary(index.term_stats()))
    return hot.select("doc_id", "size", F.size("indices").cast("long").alias("n"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def ivf_search(spark, sf_dir):
    return ivf.ivf_search(_ivf(spark, sf_dir), _vector_queries(spark, sf_dir))


def ivf_pq_search(spark, sf_dir):
    return ivf.ivf_search(_ivf(spark, sf_dir, 8), _vector_queries(spark, sf_dir), coded=True)


def text_embeddings(spark, sf_dir):
    """Vectors of the documents' own terms, as text."""
    return _embedded(spark, sf_dir).select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the terms of an index over both fields, but without building one; texts are shuffled once, so that all tasks have some."""
    docs = records.corpus(_documents(spark, sf_dir).select("doc_id", "text").repartition("doc_id"))
    return search.embed_words(lexical.indexed_words(docs), DIMS)


def _text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _once(spark, f"{sf_dir}/documents.parquet", "vectors", lambda path: _embedded(spark, sf_dir).write.parquet(path))
    return spark.read.parquet(path)


def semantic_text_exact(spark, sf_dir):
    return search.semantic_text_search("exact", _queries(spark, sf_dir), vectors=_text_vectors(spark, sf_dir))


def semantic_text_ivf(spark, sf_dir):
    vectors = _text_vectors(spark, sf_dir)
    path = _once(spark, f"{sf_dir}/documents.parquet", "textivf", lambda path: ivf.build_ivf(vectors, tuning=_text_tuning(spark, sf_dir)).save(path))
    return search.semantic_text_search("ivf", _queries(spark, sf_dir), index=ivf.IvfIndex.load(spark, path))


def _text_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are not asked for, as vectors; the few that the index is tuned on are chosen before they are cleaned and embedded."""
    docs = _documents(spark, sf_dir).where("doc_id % 100 <> 0").where(F.col("text").rlike(r"[\p{L}\p{N}_]"))
    titles = records.corpus(ivf.some(docs, "doc_id", ivf.MOST_TUNING)).select(F.col("id").alias("doc_id"), F.col("title").alias("text"))
    return search.embed_texts(titles, dims=DIMS).withColumnRenamed("doc_id", "query_id")


def semantic_text_lsh(spark, sf_dir):
    """Titles lie at wide angles to their documents, so bands are short."""
    return search.semantic_text_search("lsh", _queries(spark, sf_dir), vectors=_text_vectors(spark, sf_dir), planes=hyperplanes(SEARCH_BITS, DIMS), bands=SEARCH_BITS // 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [sanitize, embedding_texts, tokenize, stem_vocab, term_frequencies, doc_lengths, term_stats, index_stats, bm25_top10, bm25_top100, bm25_grid_recall, bm25_grid_pivot, titles, truth_query_texts, prefix_sample]
    own += [exact_knn_top10, cosine_pairs, rrf_fusion, hybrid_search, report_lines, lsh_signatures, lsh_bands, lsh_candidate_groups, lsh_search, lsh_grid]
    own += [recall_pivot, pareto_frontier, lsh_s_curve, candidate_histogram, shingle_counts, minhash_signatures, near_duplicate_classes, minhash_agreement, vocabulary, one_hot_rows, ivf_search, ivf_pq_search]
    own += [text_embeddings, semantic_text_exact, semantic_text_ivf, semantic_text_lsh]
    return {f.__name__: f for f in own}

"""Fielded inverted index and BM25 over many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.stopwords import DEFAULT
from quillspark.operators import scoring
from quillspark.sources.records import cut, ranked

#: Fields and their weights.
WEIGHTS = {"title": 1.5, "abstract": 1.0}
MOST_TF = 65535
#: Terms of all queries that are broadcast at most.
MOST_TERMS = 500_000
#: Characters that a task counts at once (and the rest of a row).
MOST_CHARACTERS = 4_000_000


@dataclass
class LexicalIndex:
    """postings(term, doc_id, field, tf, len), lengths(doc_id, title_len, abstract_len).

    len is the length of the posting's field, so a search needs no lengths.  What is saved is read
    back as ``store.StoredIndex``, which has the same methods and reads its terms' files only.
    """

    postings: DataFrame
    lengths: DataFrame

    def term_stats(self, df_mode: str = "postings") -> DataFrame:
        """term, n: postings of the term, or with ``documents`` the documents that have it."""
        return _counted(self.postings, df_mode)

    def corpus_stats(self) -> DataFrame:
        """One row: n_docs, avg_title, avg_abstract over all documents, those without tokens too."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("title_len").alias("avg_title"), F.avg("abstract_len").alias("avg_abstract"))

    def index_stats(self) -> DataFrame:
        """One row: n_docs, n_terms, n_postings."""
        docs = self.lengths.agg(F.count("*").alias("n_docs"))
        return docs.crossJoin(self.term_stats().agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_postings")))

    def lookup(self, terms: DataFrame, df_mode: str = "postings") -> tuple[DataFrame, DataFrame]:
        """The postings of ``terms`` (term, distinct), and term, n of those that the index has."""
        found = self.postings.join(terms, "term", "left_semi")
        return found, cut(_counted(found, df_mode))

    def postings_of(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def save(self, path: str) -> None:
        """Makes it the content of the saved index at ``path``; readers see the old one until all is written."""
        from quillspark.operators.store import IndexStore

        IndexStore(self.postings.sparkSession, path).replace(self)

    @staticmethod
    def load(spark: SparkSession, path: str):
        from quillspark.operators.store import load

        return load(spark, path)


def _counted(postings: DataFrame, df_mode: str) -> DataFrame:
    n = F.count("*") if df_mode == "postings" else F.count_distinct("doc_id")
    return postings.groupBy("term").agg(n.alias("n"))


def tokenized(docs: DataFrame, stop_words: Sequence[str] = DEFAULT) -> DataFrame:
    """doc_id, title_tokens, abstract_tokens of docs (id, title, abstract) whose id isn't empty."""
    kept = docs.where("id IS NOT NULL AND cast(id AS string) <> ''")
    return kept.select(F.col("id").alias("doc_id"), T.tokens(F.col("title"), stop_words).alias("title_tokens"), T.tokens(F.col("abstract"), stop_words).alias("abstract_tokens"))


def _one_row_each(docs: DataFrame) -> DataFrame:
    """Of rows with one id the one whose texts have the least hash.

    Only ids are counted; no text is shuffled unless its id is repeated.
    """
    repeated = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        return docs
    repeated = cut(repeated)
    texts = F.struct("title", "abstract")
    # by the clean texts, which are the same whether or not the white space was collapsed before
    order = F.struct(F.xxhash64(T.clean(F.col("title")), T.clean(F.col("abstract"))), texts)
    one = docs.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by(texts, order).alias("t")).select("id", "t.*")
    return docs.join(repeated, "id", "left_anti").unionByName(one)


def indexed_words(docs: DataFrame, stop_words: Sequence[str] = DEFAULT) -> DataFrame:
    """doc_id, title_words, abstract_words of each id of docs (id, title, abstract), which isn't empty.

    Stop words are left out.  Of a repeated id one row is taken, the same each time.
    """
    kept = docs.where("id IS NOT NULL AND cast(id AS string) <> ''").select("id", "title", "abstract")
    return _one_row_each(kept).select(F.col("id").alias("doc_id"), T.words(F.col("title"), stop_words).alias("title_words"), T.words(F.col("abstract"), stop_words).alias("abstract_words"))


def postings_of_words(words: DataFrame) -> DataFrame:
    """term, doc_id, field, tf, len.  Words are stemmed as rows, in compiled code, and not inside arrays."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.size(f"{f}_words").cast("long").alias("len"), F.col(f"{f}_words").alias("words")) for f in WEIGHTS))
    rows = words.select("doc_id", F.inline(fields)).select("doc_id", "field", "len", F.explode("words").alias("word"))
    terms = T.with_stems(rows)
    return terms.groupBy("term", "doc_id", "field", "len").agg(F.least(F.count("*"), F.lit(MOST_TF)).alias("tf")).select("term", "doc_id", "field", "tf", "len")


def lengths_of_words(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.size("title_words").cast("long").alias("title_len"), F.size("abstract_words").cast("long").alias("abstract_len"))


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def _tally(texts: list[list[str | None]], stop_words: pa.Array) -> list[pa.Array]:
    """Of texts by field: ``_TALLIES``."""
    n, fields = len(texts[0]), len(texts)
    split = pc.split_pattern(pa.array([T.plain(t or "") for one in texts for t in one], pa.string()), " ")
    words = split.flatten().dictionary_encode()
    kept = pc.invert(pc.is_in(words.dictionary, stop_words))
    stems = pc.if_else(kept, T.stems(words.dictionary), None).dictionary_encode()
    terms, code = stems.dictionary, stems.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[words.indices.to_numpy()]
    text = np.repeat(np.arange(n * fields), np.diff(split.offsets.to_numpy()))[code >= 0]
    code, known = code[code >= 0], max(1, len(terms))
    lengths = np.bincount(text, minlength=n * fields)
    keys, tf = np.unique(text * known + code, return_counts=True)
    text, code = np.divmod(keys, known)
    named, tfs, ends = terms.take(pa.array(code)), pa.array(np.minimum(tf, MOST_TF).astype(np.int32)), np.searchsorted(text, np.arange(n * fields) + 1)
    out = []
    for f in range(fields):
        a, z = (ends[f * n - 1] if f else 0), ends[f * n + n - 1]
        own = ends[f * n : f * n + n] - a
        out += [pa.array(lengths[f * n : f * n + n]), _lists(own, named.slice(a, z - a)), _lists(own, tfs.slice(a, z - a))]
    documents = np.unique(text % n * known + code) % known
    first = np.full(n, len(terms))  # all in the first row
    counts = [pa.array(np.bincount(x, minlength=known)[: len(terms)]) for x in (code, documents)]
    return [*out, *(_lists(first, x) for x in (terms, *counts))]


def _tallied(stop_words: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.array(["", *stop_words], pa.string())
        for batch in batches:
            texts, at = [batch.column(f).to_pylist() for f in WEIGHTS], 0
            while at < batch.num_rows:
                end, n = at, 0
                while end < batch.num_rows and n < MOST_CHARACTERS:
                    n += sum(len(t[end] or "") for t in texts)
                    end += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *_tally([t[at:end] for t in texts], out)], names=["doc_id", *_TALLIES])
                at = end

    return run


_TALLIES = {f"{f}_{name}": kind for f in WEIGHTS for name, kind in (("len", "long"), ("terms", "array<string>"), ("tfs", "array<int>"))}
#: Of the rows that were counted at once, all in the first one.
_TALLIES |= {"all_terms": "array<string>", "all_n": "array<long>", "all_docs": "array<long>"}


def tallies(docs: DataFrame, stop_words: Sequence[str] = DEFAULT) -> DataFrame:
    """doc_id and, of title and abstract, len, terms, tfs of each id of docs (id, title, abstract): its postings in one row.

    The task that reads a text counts its terms; a word is no row and isn't shuffled.  Of a repeated id one row is taken.
    Rows that were counted at once have in the first of them all_terms, all_n, all_docs, which sum up to the dictionary.
    """
    kept = _one_row_each(docs.where("id IS NOT NULL AND cast(id AS string) <> ''").select("id", "title", "abstract"))
    rows = kept.select(F.col("id").alias("doc_id"), *(T.prepared(F.col(f)).alias(f) for f in WEIGHTS))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_tallied(tuple(stop_words)), ", ".join([f"doc_id {kind}", *(f"{c} {t}" for c, t in _TALLIES.items())]))


def postings_of_tallies(rows: DataFrame) -> DataFrame:
    """term, doc_id, field, tf, len."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_len").alias("len"), F.arrays_zip(F.col(f"{f}_terms").alias("term"), F.col(f"{f}_tfs").alias("tf")).alias("own")) for f in WEIGHTS))
    flat = rows.select("doc_id", F.inline(fields)).select("doc_id", "field", "len", F.inline("own").alias("term", "tf"))
    return flat.select("term", "doc_id", "field", F.col("tf").cast("long").alias("tf"), "len")


def lengths_of_tallies(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", *(f"{f}_len" for f in WEIGHTS))


def dictionary_of_tallies(rows: DataFrame) -> DataFrame:
    """term, n, n_docs: the postings of each term, and the documents that have it."""
    parts = rows.select(F.inline(F.arrays_zip(F.col("all_terms").alias("term"), F.col("all_n").alias("n"), F.col("all_docs").alias("docs"))).alias("term", "n", "docs"))
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("n_docs"))


def build_index(docs: DataFrame, stop_words: Sequence[str] = DEFAULT) -> LexicalIndex:
    """An index of docs (id, title, abstract), not saved: each use of it tokenises again.

    Of a repeated id one row is taken, the same each time.
    """
    rows = tallies(docs, stop_words)
    return LexicalIndex(postings_of_tallies(rows), lengths_of_tallies(rows))


def query_terms(queries: DataFrame, stop_words: Sequence[str] = DEFAULT) -> DataFrame:
    """query_id, term, qtf of queries (query_id, text); repeated words count each time."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"), stop_words)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Asked:
    """What queries ask of an index: their terms, and the index's postings of these.

    terms(query_id, key, qtf), postings(key, gain, doc_id, tf, share); a key is a term and a field, gain its idf
    by the field's weight, share the field's length by the mean one.
    """

    terms: DataFrame
    postings: DataFrame
    n_queries: int
    n_postings: int

    def pairs(self) -> DataFrame:
        return scoring.block_pairs(self.postings, self.terms, self.n_postings, self.n_queries)


def ask(index, queries: DataFrame, stop_words: Sequence[str] = DEFAULT, df_mode: str = "postings") -> Asked:
    """``index`` is a ``LexicalIndex`` or a ``StoredIndex``.  Postings of other terms are neither counted nor joined;
    the terms are broadcast up to MOST_TERMS rows.  No posting is joined with a query."""
    asked = cut(query_terms(queries, stop_words))
    # written once, as the numbers are drawn anew each time that they are computed; of terms that the index lacks too
    named = cut(asked.select("term").distinct().select("term", (F.monotonically_increasing_id() * len(WEIGHTS)).alias("word")))
    found, n = index.lookup(named.select("term"), df_mode)
    size = n.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).first()
    terms = n.join(named, "term").crossJoin(F.broadcast(index.corpus_stats()))  # one row
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    terms = terms.select("term", "word", idf.alias("idf"), "avg_title", "avg_abstract")
    if size.terms <= MOST_TERMS:
        terms = F.broadcast(terms)
    weight, field, mean = F.lit(1.0), F.lit(0), F.col("avg_abstract")
    for i, (f, w) in enumerate(WEIGHTS.items()):
        own = F.col("field") == f
        weight, field, mean = F.when(own, F.lit(w)).otherwise(weight), F.when(own, F.lit(i)).otherwise(field), F.when(own, F.col(f"avg_{f}")).otherwise(mean)
    postings = found.join(terms, "term").select((F.col("word") + field).alias("key"), (F.col("idf") * weight).alias("gain"), "doc_id", "tf", (F.col("len") / mean).alias("share"))
    keys = asked.join(named, "term").select("query_id", F.explode(F.array(*(F.col("word") + i for i in range(len(WEIGHTS))))).alias("key"), "qtf")
    return Asked(keys, postings, asked.select("query_id").distinct().count(), size.postings)


def tf_component(k1, b):
    k1, b = (x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in (k1, b))
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("share")))


def bm25_search(index, queries: DataFrame, top_k: int = 10, *, k1: float = 1.5, b: float = 0.75, stop_words: Sequence[str] = DEFAULT, df_mode: str = "postings") -> DataFrame:
    """query_id, rank, doc_id, score: each query's best documents with a positive score.

    Saturation is by field and weighted afterwards.  Scores are rounded to 6 decimals and ranked
    as such, ties by doc_id.  Documents are scored by blocks, which send on what can be among the best.
    """
    asked = ask(index, queries, stop_words, df_mode)
    return ranked(scoring.best(asked.pairs(), asked.postings, asked.terms, top_k, k1, b), top_k)

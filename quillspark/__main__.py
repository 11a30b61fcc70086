"""Command line: ``python -m quillspark COMMAND ...``, each stage a Spark job from files to files.

    sanitize RAW OUT                 JSON lines of records to clean records
    tokenize CLEAN OUT               clean records to token lists
    index CLEAN INDEX                adds clean records to the saved index, overwriting known ids
    delete IDS INDEX                 removes the ids of a text file, one to a line
    compact INDEX                    merges the index's segments
    vectors CLEAN VECTORS            vectors of clean records by their hashed terms
    cells VECTORS CELLS              inverted file of the vectors
    search INDEX [--vectors V | --cells C] [--titles CLEAN] [-k N] [QUERY ...]

``search`` answers the queries given, or those read from standard input until ``:q``: by words, and with
vectors or cells by both, fused.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import fusion, ivf, lexical, search, store
from quillspark.sources import records


def _documents(clean: DataFrame) -> DataFrame:
    return clean.select("id", F.col("clean_title").alias("title"), F.col("clean_abstract").alias("abstract"))


def vectors_of(clean: DataFrame) -> DataFrame:
    """doc_id, vector of clean records; the terms of both fields count."""
    return search.embed_texts(records.embedding_texts(clean).select(F.col("id").alias("doc_id"), "text"))


def answer(spark: SparkSession, texts: list[str], index: str, k: int = 10, vectors: str | None = None, cells: str | None = None, titles: str | None = None) -> DataFrame:
    """query_id, rank, line: the results of each text, by words or fused with a search by vectors."""
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    found = lexical.bm25_search(store.load(spark, index), queries, k)
    if vectors or cells:
        if vectors:
            near = search.semantic_text_search("exact", queries, k, vectors=spark.read.parquet(vectors))
        else:
            near = search.semantic_text_search("ivf", queries, k, index=ivf.IvfIndex.load(spark, cells))
        found = fusion.rrf([near.withColumn("doc_id", F.col("doc_id").cast("string")), found.withColumn("doc_id", F.col("doc_id").cast("string"))], limit=k)
    names = records.titles(records.read_jsonl(spark, titles, records.CLEAN)) if titles else spark.createDataFrame([], "doc_id string, title string")
    return records.report(found.withColumn("doc_id", F.col("doc_id").cast("string")), names)


def asked(lines: Iterable[str]) -> Iterator[str]:
    """Queries of lines until ``:q``; empty ones are left out."""
    for line in lines:
        text = line.strip()
        if text.lower() == ":q":
            return
        if text:
            yield text


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["sanitize", "tokenize", "index", "delete", "compact", "vectors", "cells", "search"])
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--vectors")
    parser.add_argument("--cells")
    parser.add_argument("--titles")
    parser.add_argument("-k", type=int, default=10)
    given = parser.parse_intermixed_args(args)
    paths = given.paths
    wanted = {"compact": 1, "search": 1}.get(given.command, 2)
    if len(paths) < wanted or given.command != "search" and len(paths) > wanted:
        parser.error(f"{given.command} takes {wanted} path{'s' * (wanted > 1)}")
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if given.command == "sanitize":
        records.sanitize(records.read_jsonl(spark, paths[0])).write.mode("overwrite").json(paths[1])
    elif given.command == "tokenize":
        records.write_tokenized(records.tokenize(records.read_jsonl(spark, paths[0], records.CLEAN)), paths[1])
    elif given.command == "index":
        store.IndexStore(spark, paths[1]).append(_documents(records.read_jsonl(spark, paths[0], records.CLEAN)))
    elif given.command == "delete":
        store.IndexStore(spark, paths[1]).delete(spark.read.text(paths[0]).select(F.trim("value").alias("doc_id")))
    elif given.command == "compact":
        store.IndexStore(spark, paths[0]).compact(whole=True)
    elif given.command == "vectors":
        vectors_of(records.read_jsonl(spark, paths[0], records.CLEAN)).write.mode("overwrite").parquet(paths[1])
    elif given.command == "cells":
        ivf.build_ivf(spark.read.parquet(paths[0])).save(paths[1])
    else:
        texts = asked(paths[1:] or sys.stdin)
        for text in texts:
            lines = answer(spark, [text], paths[0], given.k, given.vectors, given.cells, given.titles).orderBy("rank").collect()  # k rows at most
            print("\n".join(r.line for r in lines) or "No results found.")
    return 0


if __name__ == "__main__":
    sys.exit(main())

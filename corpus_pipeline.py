"""From documents to packed training sequences: filter, filter, de-duplicate, de-duplicate, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, packing, quality_rules, substring_dedup, toxicity
from quillspark.llm._cluster import bound_batches, checkpoint_dir, unbound_batches

#: Documents with this toxicity score or more go.
MOST_TOXIC = 0.7


def _named(docs: DataFrame, names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [docs[f"`{c.replace('`', '``')}`"] for c in names]


def _packed(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, Column]]:
    """The columns ``own`` and a struct ``others`` of the other ones, and how each column is got back."""
    others = [c for c in docs.columns if c not in own]
    rows = docs.select(*_named(docs, list(own)), F.struct(F.lit(None).cast("int").alias("_"), *_named(docs, others)).alias("others"))
    return rows, {c: (F.col(c) if c in own else F.col("others").getField(c)).alias(c) for c in docs.columns}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  Null texts are rejected as too short."""
    return quality_rules.passed(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by a model of their labelled part is below ``MOST_TOXIC``.

    All other columns travel in one struct, so their names cannot clash.
    """
    bound_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, columns = _packed(docs, "text")
    return toxicity.score_toxicity(rows, model, ["text", "others"]).where(F.col("score") < MOST_TOXIC).select(*columns.values())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Documents without words are no group, so they stay; so do those with a null doc_id.  Equal rows
    with one doc_id stay together; of a repeated doc_id with other texts each text is judged for itself.
    """
    bound_batches(spark)
    groups = jaccard_join.near_duplicates(docs, hashed=True)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"]), "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has too.

    A text that loses nothing stays as it is; of others the kept words are joined by spaces.
    Other columns travel in one struct, so their names cannot clash; a column n_chars follows the text.
    Null and empty texts stay; rows that repeat a doc_id take nothing from each other.
    """
    bound_batches(spark)
    rows, columns = _packed(docs, "doc_id", "text")
    out = substring_dedup.remove_repeats(rows, carry=["text", "others"])
    changed = F.col("n_removed") > 0
    columns["text"] = F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(columns["n_chars"]).alias("n_chars")
    return out.select(*columns.values())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and the sequence and offset that each is packed at.

    Null and empty texts are the end token alone; rows that repeat a doc_id are packed each for
    itself; an empty table gives no pieces.  A sequence is its pieces' ids in the order of offset.
    """
    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: Token ids and trained scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are in Parquet in the shared folder.

    The folder is needed for as long as the result is read; it lies beside the checkpoints, which the
    owner of ``spark.checkpoint.dir`` clears.  The session's batch limit is put back.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    was = bound_batches(spark)
    try:
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs.write.parquet(f"{folder}/{i}")
                docs = spark.read.parquet(f"{folder}/{i}")
    finally:
        unbound_batches(spark, was)
    return docs

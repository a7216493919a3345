"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again for the next one. All but the last return the columns of the
documents they got, in their order. Documents without an id are kept by the copies stage;
of rows that repeat an id, only those go there whose own text is a copy of an earlier document's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard_join, packing, quality_cascade, suffix_dedup, toxicity
from colloquy.session import materialize


def _with_rest(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that their names never clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(0).alias("none")]).alias("rest"))


def _like(docs: DataFrame, found: DataFrame, **changed) -> DataFrame:
    """``found`` (doc_id, text, rest, ...) with the columns of ``docs``."""
    return found.select(*[
        changed[c].alias(c) if c in changed else F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c)
        for c in docs.columns
    ])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets pass."""
    judged = quality_cascade.judge(_with_rest(docs), carry=("text", "rest"))
    return _like(docs, judged.where("kept"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    net = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(_with_rest(docs), net, carry=("text", "rest"))
    return _like(docs, scored.where("predicted = 0"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id. A row goes by its own
    text: another row of its id, with a text that is no copy, stays."""
    found = jaccard_join.similar_components(docs.select("doc_id", "text"), with_digest=True)
    gone = found.where("component_id <> doc_id").select(
        F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")
    ).distinct()
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_digest"))
    return docs.join(gone, same, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes that repeat earlier ones; what is left of a character
    that was cut goes too. Null texts become empty."""
    found = suffix_dedup.dedup_passages(_with_rest(docs), with_text=True, carry=("rest",))
    return _like(docs, found, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packing_stage),
]

#: The network's verdicts are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

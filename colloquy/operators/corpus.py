"""The retrieval corpus: one record per training conversation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import text as X
from colloquy.operators.conversations import conversation_parts


def retrieval_corpus(turns: DataFrame, headers: DataFrame, key: str = "idx") -> DataFrame:
    """Records of all items that have both a user and an assistant text.

    ``headers`` holds one row per item: ``key`` (its 0-based position), ``id`` and
    ``source``. The record id is ``source::id``, with the position where the id
    and ``unknown`` where the source is missing. ``orderBy("id", "index")`` is
    the total order of an export.
    """
    parts = conversation_parts(turns, [key]).filter(
        (F.col("user") != "") & (F.col("assistant") != "")
    )
    position = F.col(key)
    return parts.join(headers.select(key, "id", "source"), key).select(
        F.concat_ws(
            "::",
            F.coalesce("source", F.lit("unknown")),
            F.coalesce("id", position.cast("string")),
        ).alias("id"),
        position.cast("long").alias("index"),
        F.col("user").alias("text"),
        "user",
        F.col("assistant").alias("workflow"),
        "source",
    )


def retrieval_corpus_plain_ids(
    turns: DataFrame, headers: DataFrame, key: str = "idx"
) -> DataFrame:
    """The other record layout: plain id or position as the record id, the task
    type (else the source) kept, and the stripped question deciding emptiness."""
    parts = conversation_parts(turns, [key]).filter(
        (X.example_text(["query"], F.col("user"), F.lit("")) != "")
        & (F.col("assistant") != "")
    )

    def given(name: str):
        return F.when(F.col(name) != "", F.col(name))

    return parts.join(headers.select(key, "id", "source", "task_type"), key).select(
        F.coalesce("id", F.col(key).cast("string")).alias("id"),
        F.col(key).cast("long").alias("index"),
        F.col("user").alias("user"),
        F.col("assistant").alias("workflow"),
        F.coalesce(given("task_type"), given("source")).alias("task_type"),
    )


def example_texts(
    parts: DataFrame, keys: Sequence[str], fields: list[str]
) -> DataFrame:
    return parts.select(
        *keys, X.example_text(fields, F.col("user"), F.col("assistant")).alias("text")
    )

"""Few-shot blocks and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import text as X
from colloquy.operators.conversations import hand_down, turn_span
from colloquy.operators.retrieved import with_records


def few_shot_blocks(
    hits: DataFrame, corpus: DataFrame, query_keys: Sequence[str], separator: str = "\n"
) -> DataFrame:
    """The retrieved records of each query as one text, numbered by rank.

    ``hits`` has ``query_keys``, ``rank`` and ``record_id``: at most k rows per
    query, which bounds what is gathered. With the records' ``index`` beside the id, ids
    need not be unique.
    """
    example = X.few_shot_example(F.col("rank"), F.col("user"), F.col("workflow"))
    return (
        with_records(hits, corpus, ["user", "workflow"])
        .select(*query_keys, F.struct("rank", example.alias("text")).alias("ex"))
        .groupBy(*query_keys)
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list("ex")), lambda e: e["text"]),
                separator,
            ).alias("block"),
            F.count("*").alias("n_examples"),
        )
    )


def prompt_messages(system: Column, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def build_prompts(
    parts: DataFrame,
    keys: Sequence[str],
    *,
    use_rag: bool = False,
    blocks: DataFrame | None = None,
    layout: str = "appended",
) -> DataFrame:
    """``[system, user]`` prompts; with retrieval the block goes into the system
    text, after a header (``appended``) or in the ``joined`` layout."""
    system, user = F.col("system"), F.col("user")
    if not use_rag:
        return parts.select(*keys, prompt_messages(system, user).alias("messages"))
    if blocks is None:
        raise ValueError("use_rag needs the few-shot blocks of a retrieval")
    if layout == "appended":
        header = f"\n\n{X.RAG_HEADER}\n\n"
    elif layout == "joined":
        header = f"\n\n{X.JOINED_HEADER}\n"
    else:
        raise ValueError(f"unknown layout {layout!r}")
    block = F.coalesce("block", F.lit(""))
    rich = F.concat(system, F.lit(header), block)
    return parts.join(blocks.select(*keys, "block"), list(keys), "left").select(
        *keys, prompt_messages(rich, user).alias("messages")
    )


def inject_block(
    turns: DataFrame, blocks: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """All turns of each conversation with one more system turn in front of the
    first user turn; a conversation without a user turn stays as it is."""
    at = F.min(F.when(X.is_user(F.col("role")), F.col("turn")))
    first_user = turns.groupBy(*keys).agg(at.alias("_at"), *turn_span())
    moved = hand_down(turns, first_user, keys).select(
        *keys,
        F.when(F.col("turn") >= F.col("_at"), F.col("turn") + 1)
        .otherwise(F.col("turn"))
        .alias("turn"),
        "role",
        "content",
    )
    added = (
        first_user.filter(F.col("_at").isNotNull())
        .join(blocks.select(*keys, "block"), list(keys), "left")
        .select(
            *keys,
            F.col("_at").alias("turn"),
            F.lit(X.SYSTEM_ROLE).alias("role"),
            F.concat(
                F.lit(f"{X.INJECT_HEADER}\n\n"), F.coalesce("block", F.lit(""))
            ).alias("content"),
        )
    )
    return moved.unionByName(added)

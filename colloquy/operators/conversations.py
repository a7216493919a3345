"""Conversations as a long table of turns: keys, ``turn``, ``role``, ``content``.

``turn`` is the position in the conversation, from 0.

Keeping one row per turn means that no step has to hold a whole conversation:
what a conversation-level step needs is aggregated (with map-side partials) and
handed back to the turns through blocks of bounded size, so one conversation
with a third of all turns is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import text as X

# Turns of one conversation that share a task.
BLOCK_TURNS = 65_536
_BLOCK = "_block"


def explode_items(items: DataFrame, keys: Sequence[str], *, prefer: str = "conversations") -> DataFrame:
    """Nested items to turns, taking ``prefer`` and else the other message field."""
    other = "messages" if prefer == "conversations" else "conversations"
    picked = X.first_non_empty(F.col(prefer), F.col(other))
    return items.select(*keys, F.posexplode(picked).alias("turn", "_m")).select(
        *keys,
        F.col("turn").cast("long").alias("turn"),
        F.col("_m.role").alias("role"),
        F.col("_m.content").alias("content"),
    )


def select_field(turns: DataFrame, keys: Sequence[str], *, prefer: str) -> DataFrame:
    """Turns tagged with the ``field`` they stood in: those of ``prefer`` where an
    item has any, else those of its other field."""
    seen = turns.groupBy(*keys).agg(
        F.max(F.col("field") == prefer).alias("_has_preferred"), *turn_span()
    )
    tagged = hand_down(turns, seen, keys)
    return tagged.filter((F.col("field") == prefer) == F.col("_has_preferred")).drop(
        "_has_preferred", "field"
    )


def normalize_roles(turns: DataFrame) -> DataFrame:
    return turns.withColumn("role", X.normalize_role(F.col("role"))).withColumn(
        "content", F.coalesce("content", F.lit(""))
    )


def conversation_parts(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per conversation: its last user and assistant texts, first system
    text and last text of all, each ``""`` where there is none."""
    role, turn, content = F.col("role"), F.col("turn"), F.col("content")

    def pick(how, cond: Column) -> Column:
        return F.coalesce(how(F.when(cond, content), F.when(cond, turn)), F.lit(""))

    return turns.groupBy(*keys).agg(
        pick(F.min_by, role == X.SYSTEM_ROLE).alias("system"),
        pick(F.max_by, X.is_user(role)).alias("user"),
        pick(F.max_by, X.is_assistant(role)).alias("assistant"),
        F.coalesce(F.max_by(content, turn), F.lit("")).alias("gold_workflow"),
        F.count("*").alias("n_turns"),
    )


def limit_per_task(gold: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` items of each task by position; 0 or None keeps all."""
    return gold.filter(F.col("idx") < limit) if limit else gold


def block_of(turn: Column) -> Column:
    return F.floor(turn / BLOCK_TURNS)


def turn_span() -> list[Column]:
    """Aggregates that give ``hand_down`` the turns of a conversation."""
    return [F.min("turn").alias("_lo"), F.max("turn").alias("_hi")]


def hand_down(
    turns: DataFrame, info: DataFrame, keys: Sequence[str], blocks: Column | None = None
) -> DataFrame:
    """Attach one row of ``info`` per conversation to its turns.

    ``info`` is repeated once per block of turns, all between its ``turn_span()``
    or those in ``blocks``, and joined on (keys, block): the turns of one
    conversation do not have to meet in one task.
    """
    span = F.sequence(block_of(F.col("_lo")), block_of(F.col("_hi")))
    spread = info.withColumn(_BLOCK, F.explode(span if blocks is None else blocks))
    return (
        turns.withColumn(_BLOCK, block_of(F.col("turn")))
        .join(spread, [*keys, _BLOCK])
        .drop(_BLOCK, "_lo", "_hi")
    )


def with_running(turns: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Add to each turn its 0-based ``rank`` in the conversation and the sum of
    ``measure`` over the turns before it (``before``), with the conversation's
    ``n_turns``, ``total``, and whether its first turn is a system turn
    (``has_system``) of which measure (``first_measure``).

    Two levels: sums per block first, then offsets over the blocks, then a
    window inside each block.
    """
    blocked = turns.withColumn(_BLOCK, block_of(F.col("turn")))
    # Fixed-width values only, so that these are hash aggregates.
    sums = blocked.groupBy(*keys, _BLOCK).agg(
        F.count("*").alias("_n"),
        F.sum(measure).alias("_sum"),
        F.min_by(F.coalesce(F.col("role") == X.SYSTEM_ROLE, F.lit(False)), "turn").alias("_sys"),
        F.min_by(measure, "turn").alias("_first"),
    )
    over_keys = Window.partitionBy(*keys).orderBy(_BLOCK)
    earlier = over_keys.rowsBetween(Window.unboundedPreceding, -1)
    whole = over_keys.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        *keys,
        _BLOCK,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before0"),
        F.sum("_n").over(whole).alias("n_turns"),
        F.sum("_sum").over(whole).alias("total"),
        F.first("_sys").over(whole).alias("has_system"),
        F.first("_first").over(whole).alias("first_measure"),
    )
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocked.join(offsets, [*keys, _BLOCK])
        .withColumn("rank", F.col("_rank0") + F.count("*").over(inside))
        .withColumn(
            "before",
            F.col("_before0") + F.coalesce(F.sum(measure).over(inside), F.lit(0)),
        )
        .drop(_BLOCK, "_rank0", "_before0")
    )


def plain_lines(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The plain text of each conversation as its lines: each turn's
    ``role: content`` with the character offset at which it starts."""
    lines = turns.withColumn("line", X.plain_line(F.col("role"), F.col("content")))
    sized = lines.withColumn("_len", F.length("line") + 1)
    return with_running(sized, keys, "_len").select(
        *keys,
        F.col("rank").alias("turn"),
        F.col("before").alias("start"),
        "line",
    )


def plain_chars(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Character count of each conversation's plain text, no text built."""
    line = X.plain_line(F.col("role"), F.col("content"))
    return turns.groupBy(*keys).agg(
        (F.sum(F.length(line) + 1) - 1).alias("n_chars"), F.count("*").alias("n_turns")
    )

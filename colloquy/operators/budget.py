"""Fitting conversations into a token budget by dropping their oldest demos.

A conversation is an optional system turn, demo pairs (user, assistant) and the
final pair. The rule: keep it whole if it fits (``full``); otherwise a body that
is short or odd is ``malformed``; otherwise drop the oldest 1, 2, ... demo pairs
until the rest fits (``drop_<k>_demo``); otherwise it is ``dropped``.

The tag needs lengths only, so no text is built or gathered to find it. Turns
are gathered into arrays only after the fit, when the budget bounds their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import text as X
from colloquy.functions.token_counts import LineCounts
from colloquy.operators.conversations import (
    block_of,
    hand_down,
    normalize_roles,
    with_running,
)

DEFAULT_MAX_TOKENS = 2048
CHARS_PER_TOKEN = 4


def _measured(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns with running plain-text sizes; ``_chars`` counts the line and its
    newline, ``left`` the characters after dropping everything up to this turn
    but the system turn, ``pair`` the demo pair a turn completes."""
    line = X.plain_line(F.col("role"), F.col("content"))
    run = with_running(
        normalize_roles(turns).withColumn("_chars", (F.length(line) + 1).cast("long")),
        keys,
        "_chars",
    )
    return (
        run.withColumn("_sys", F.when(F.col("has_system"), 1).otherwise(0))
        .withColumn("_sys_chars", F.when(F.col("has_system"), F.col("first_measure")).otherwise(0))
        .withColumn("_body", F.col("n_turns") - F.col("_sys"))
        .withColumn("_pos", F.col("rank") - F.col("_sys") + 1)
        .withColumn("pair", F.when((F.col("_pos") > 0) & (F.col("_pos") % 2 == 0), F.floor(F.col("_pos") / 2)))
        .withColumn(
            "left",
            F.col("_sys_chars") + F.col("total") - F.col("before") - F.col("_chars") - 1,
        )
    )


def fit_budget(
    turns: DataFrame,
    keys: Sequence[str],
    max_tokens: int = DEFAULT_MAX_TOKENS,
    *,
    items: DataFrame | None = None,
) -> DataFrame:
    """One row per conversation: ``tag``, ``n_dropped`` demo pairs, the estimated
    tokens before and after, and ``cut_turn``, the last turn dropped. ``items`` (keys of all items) adds those
    without a turn, which count as ``full``."""
    m = _measured(turns, keys)
    is_demo_end = (
        F.col("pair").isNotNull()
        & (F.col("_body") % 2 == 0)
        & (F.col("pair") <= F.floor((F.col("_body") - 2) / 2))
    )
    fits = is_demo_end & (X.estimate_tokens(F.col("left")) <= max_tokens)
    fit_pair = F.when(fits, F.col("pair"))
    per = m.groupBy(*keys).agg(
        F.max("n_turns").alias("n_turns"),
        F.max("_body").alias("_body"),
        F.max("total").alias("_total"),
        F.min(fit_pair).alias("_k"),
        F.min_by("left", fit_pair).alias("_left"),
        F.max("has_system").alias("has_system"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.min_by("turn", fit_pair).alias("_cut"),
    )
    before = X.estimate_tokens(F.col("_total") - 1)
    full = before <= max_tokens
    malformed = (F.col("_body") < 2) | (F.col("_body") % 2 != 0)
    tag = (
        F.when(full, "full")
        .when(malformed, "malformed")
        .when(F.col("_k").isNotNull(), F.concat(F.lit("drop_"), F.col("_k").cast("string"), F.lit("_demo")))
        .otherwise("dropped")
    )
    out = per.select(
        *keys,
        "n_turns",
        tag.alias("tag"),
        F.when(full | malformed, 0).otherwise(F.coalesce("_k", F.lit(0))).cast("long").alias("n_dropped"),
        before.alias("tokens_before"),
        F.when(full, before)
        .when(~malformed & F.col("_k").isNotNull(), X.estimate_tokens(F.col("_left")))
        .alias("tokens_after"),
        "has_system",
        "first_turn",
        "last_turn",
        F.when(~full & ~malformed, F.col("_cut")).alias("cut_turn"),
    )
    if items is None:
        return out
    return items.select(*keys).join(out, list(keys), "left").select(
        *keys,
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
        F.coalesce("tag", F.lit("full")).alias("tag"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce("tokens_before", F.lit(1)).alias("tokens_before"),
        F.when(F.col("tag").isNull(), F.lit(1)).otherwise(F.col("tokens_after")).alias("tokens_after"),
        "has_system",
        "first_turn",
        "last_turn",
        "cut_turn",
    )


def is_kept(tag: Column) -> Column:
    return ~tag.isin("dropped", "malformed")


def kept_turns(turns: DataFrame, keys: Sequence[str], fitted: DataFrame) -> DataFrame:
    """The turns each fitted conversation keeps, at their new positions.

    The fit says from which turn on a conversation is kept, so only the blocks
    of turns from there, and the one of the system turn, are looked at.
    """
    kept = fitted.filter(is_kept(F.col("tag"))).select(
        *keys, "tag", "n_dropped", "has_system", "first_turn", "last_turn", "cut_turn"
    )
    start = F.coalesce(F.col("cut_turn"), F.col("first_turn"))
    blocks = F.array_union(
        F.array(block_of(F.col("first_turn"))),
        F.sequence(block_of(start), block_of(F.col("last_turn"))),
    )
    own = hand_down(normalize_roles(turns), kept.filter("last_turn IS NOT NULL"), keys, blocks)
    place = F.col("turn") - F.col("first_turn")
    is_system_turn = F.col("has_system") & (place == 0)
    after_cut = F.col("cut_turn").isNull() | (F.col("turn") > F.col("cut_turn"))
    return own.filter(is_system_turn | after_cut).select(
        *keys,
        "tag",
        F.when(is_system_turn, place).otherwise(place - F.col("n_dropped") * 2).alias("turn"),
        "role",
        "content",
    )


def sft_dataset(
    turns: DataFrame,
    keys: Sequence[str],
    max_tokens: int = DEFAULT_MAX_TOKENS,
    *,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """Fitted conversations as ``messages`` arrays, each bounded by the budget.
    ``fitted``: a fit made before, by a tokenizer for instance."""
    if fitted is None:
        fitted = fit_budget(turns, keys, max_tokens)
    kept = kept_turns(turns, keys, fitted)
    return gather_messages(kept, keys)


def gather_messages(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns of budget-bounded conversations to one ``messages`` array each."""
    return turns.groupBy(*keys, "tag").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )


def outcomes(fitted: DataFrame) -> DataFrame:
    return fitted.groupBy("tag").agg(F.count("*").alias("n"))


def budget_stats(fitted: DataFrame, max_tokens: int, tokenizer: str = "chars/4") -> DataFrame:
    """One row: totals and the outcome histogram as a map. ``tokenizer`` says how tokens were
    counted: ``chars/4``, or ``tokenizers`` where a real one was loaded."""
    n = F.col("n")

    def total(cond: Column):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).alias

    tag = F.col("tag")
    lost = tag.isin("dropped", "malformed")
    cut = tag.startswith("drop_") | (tag == "demos_all_dropped")
    return (
        outcomes(fitted)
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("total"),
            total(~lost)("kept"),
            total(lost)("dropped"),
            total(cut)("truncated"),
            total(tag == "full")("full"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("outcomes"),
        )
        .withColumn("max_tokens", F.lit(max_tokens))
        .withColumn("tokenizer", F.lit(tokenizer))
        .withColumn(
            "drop_pct", F.col("dropped") * 100.0 / F.greatest(F.col("total"), F.lit(1))
        )
    )


def fit_budget_with_tokenizer(
    turns: DataFrame,
    keys: Sequence[str],
    max_tokens: int,
    load_tokenizer: Callable[[], Callable[[str], int]],
) -> DataFrame:
    """``fit_budget`` with a real tokenizer, in the same columns: ``load_tokenizer()``
    gives, once per Python worker and once here, a function from text to token count.

    If that function has an attribute ``max_chars_per_token``, the longest text one
    token of its vocabulary stands for, a suffix with more characters than that times
    the budget cannot fit: only turns inside that bound are gathered and tokenised, and
    ``tokens_before`` is null where the whole is beyond it. Without the attribute,
    conversations are gathered and tokenised in full.

    With an attribute ``joins`` (see ``token_counts``) each line is tokenised once and the
    chosen cut once more, as a check; without it every candidate is tokenised anew.
    """
    longest = getattr(load_tokenizer(), "max_chars_per_token", None)
    most = float("inf") if longest is None else max_tokens * longest
    m = _measured(turns, keys)
    # ``left`` of the turn before: what remains if the cut falls right before it.
    start_left = F.col("left") + F.col("_chars")
    near = (start_left <= most) | ((F.col("rank") == 0) & (F.col("_sys") == 1) & (F.col("_chars") - 1 <= most))
    per = m.groupBy(*keys).agg(
        F.max("n_turns").alias("n_turns"),
        F.max("_body").alias("_body"),
        F.max("_sys").alias("_sys"),
        F.max("total").alias("_total"),
        F.max("has_system").alias("has_system"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.array_sort(
            F.collect_list(F.when(near, F.struct("rank", X.plain_line(F.col("role"), F.col("content")).alias("line"))))
        ).alias("_near"),
    )

    @F.pandas_udf("k long, before long, after long")
    def first_fit(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        count = load_tokenizer()

        def fit(n, sys, body, total, near) -> tuple[int, int | None, int | None]:
            lines = {r["rank"]: r["line"] for r in near}
            # The body's lines that are there, which are its last ones.
            first = next((r for r in range(sys, n) if r in lines), n)
            body_lines = [lines[r] for r in range(first, n)]
            lead = lines.get(0) if sys else None
            counts = LineCounts(count, body_lines, lead)
            before = None
            if total - 1 <= most:
                before = counts.of(0) if body_lines else count(lead)
            if before is not None and before <= max_tokens:
                return 0, before, before
            if body < 2 or body % 2:
                return -2, before, None
            if sys and lead is None:
                return -1, before, None
            for k in range(1, (body - 2) // 2 + 1):
                start = sys + 2 * k - first
                if start >= 0:
                    after = counts.of(start)
                    if after <= max_tokens:
                        kept = "\n".join([*([lead] if sys else []), *body_lines[start:]])
                        if hasattr(count, "joins") and count(kept) != after:
                            raise ValueError("the tokenizer's joins are not what its counts say")
                        return k, before, after
            return -1, before, None

        for batch in rows:
            yield pd.DataFrame(
                [fit(*r) for r in zip(*batch)], columns=["k", "before", "after"]
            ).astype("Int64")

    k = F.col("_fit.k")
    return per.withColumn(
        "_fit", first_fit.asNondeterministic()("n_turns", "_sys", "_body", "_total", "_near")
    ).select(
        *keys,
        "n_turns",
        F.when(k == 0, "full")
        .when(k == -2, "malformed")
        .when(k > 0, F.concat(F.lit("drop_"), k.cast("string"), F.lit("_demo")))
        .otherwise("dropped")
        .alias("tag"),
        F.greatest(k, F.lit(0)).alias("n_dropped"),
        F.col("_fit.before").alias("tokens_before"),
        F.col("_fit.after").alias("tokens_after"),
        "has_system",
        "first_turn",
        "last_turn",
        F.when(k > 0, F.col("first_turn") + F.col("_sys") + 2 * k - 1).alias("cut_turn"),
    )

"""Masked training examples: token ids with labels only on the last answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import text as X

IGNORED_LABEL = -100
PAD_MULTIPLE = 8


def render_chat(
    messages: Column,
    *,
    turn: Callable[[Column, Column], Column] = X.chat_turn,
    generation_prompt: str = "",
) -> Column:
    parts = F.transform(messages, lambda m: turn(m["role"], m["content"]))
    return F.concat(F.array_join(parts, ""), F.lit(generation_prompt))


def tokenizer_udf(load: Callable[[], Callable[[str], list[int]]]):
    """A pandas UDF over a tokenizer that ``load()`` makes once per worker."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = load()
        for batch in texts:
            yield batch.map(lambda t: [int(i) for i in tokenize(t)])

    return encode


def masked_examples(
    conversations: DataFrame,
    keys: Sequence[str],
    max_length: int,
    *,
    turn: Callable[[Column, Column], Column] = X.chat_turn,
    generation_prompt: str = X.GENERATION_PROMPT,
    encode: Callable[[Column], Column] = X.code_points,
) -> DataFrame:
    """Every conversation with its ``reason`` (``kept`` or why it is skipped) and,
    when kept, ``input_ids``, ``attention_mask`` and ``labels``.

    The text of all turns and that of all but the last (with the generation
    prompt) are encoded and cut at ``max_length``; the ids both share at the
    front get the ignored label.
    """
    m = F.col("messages")
    n = F.size(m)
    context = F.slice(m, 1, F.greatest(n - 1, F.lit(0)))
    ids = conversations.select(
        *keys,
        F.coalesce(
            (n < 2) | (F.try_element_at(m, F.lit(-1))["role"] != "assistant"), F.lit(True)
        ).alias("_no_answer"),
        F.slice(encode(render_chat(m, turn=turn)), 1, max_length).alias("_full"),
        F.slice(
            encode(render_chat(context, turn=turn, generation_prompt=generation_prompt)),
            1,
            max_length,
        ).alias("_prefix"),
    )
    full, prefix = F.col("_full"), F.col("_prefix")
    n_full, n_prefix = F.size(full), F.size(prefix)
    is_prefix = (n_prefix < n_full) & (F.slice(full, 1, n_prefix) == prefix)
    differs = F.array_position(
        F.zip_with(full, prefix, lambda a, b: F.equal_null(a, b)), False
    )
    shared = F.when(differs > 0, differs - 1).otherwise(F.least(n_full, n_prefix))
    n = F.when(is_prefix, n_prefix).otherwise(shared).cast("int")
    return _labelled(ids.withColumn("_n", n), keys)


def _labelled(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Examples from ``_full`` ids, of which the first ``_n`` are no answer's."""
    full = F.col("_full")
    reason = (
        F.when(F.col("_no_answer"), "no_answer")
        .when(F.size(full) == 0, "empty")
        .when(F.col("_n") >= F.size(full), "no_label")
        .otherwise("kept")
    )
    kept = F.col("reason") == "kept"
    masked = F.transform(
        full, lambda x, i: F.when(i < F.col("_n"), F.lit(IGNORED_LABEL)).otherwise(x)
    )
    return cut.withColumn("reason", reason).select(
        *keys,
        "reason",
        F.when(kept, full).alias("input_ids"),
        F.when(kept, F.transform(full, lambda x: F.lit(1))).alias("attention_mask"),
        F.when(kept, masked).alias("labels"),
    )


def _shared_front(a: Sequence[int], b: Sequence[int]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def masked_examples_encoded_once(
    conversations: DataFrame,
    keys: Sequence[str],
    max_length: int,
    load_encoder: Callable[[], Callable[[str], tuple[list[int], list[int]]]],
    *,
    turn: Callable[[Column, Column], Column] = X.chat_turn,
    generation_prompt: str = X.GENERATION_PROMPT,
) -> DataFrame:
    """``masked_examples`` with a tokenizer that tells where its tokens start.

    ``load_encoder()`` runs once per Python worker and gives ``encode(text) -> (ids,
    starts)``. If ``encode`` has an attribute ``cuts``, ``cuts(left, right)`` says whether the
    ids of ``left + right`` are those of ``left`` and then those of ``right``. Where that holds
    at the start of the answer, the text is encoded once and the ids before the answer are
    counted by their starts; elsewhere, and without the attribute, what stands before the
    answer is encoded as well. Conversations without an answer are not encoded.
    """
    m = F.col("messages")
    n = F.size(m)
    no_answer = F.coalesce(
        (n < 2) | (F.try_element_at(m, F.lit(-1))["role"] != "assistant"), F.lit(True)
    )
    context = F.slice(m, 1, F.greatest(n - 1, F.lit(0)))

    @F.pandas_udf("ids array<int>, n int")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = load_encoder()
        cuts = getattr(encode, "cuts", lambda left, right: False)

        def one(text: str | None, before: int):
            if text is None:
                return None, None
            ids, starts = encode(text)
            left, right = text[:before], text[before:]
            prefix = left + generation_prompt
            if right.startswith(generation_prompt) and cuts(prefix, text[len(prefix) :]):
                first = ids[: sum(s < len(prefix) for s in starts)][:max_length]
            else:
                first = encode(prefix)[0][:max_length]
            ids = ids[:max_length]
            return ids, _shared_front(ids, first)

        for texts, befores in batches:
            yield pd.DataFrame([one(*r) for r in zip(texts, befores)], columns=["ids", "n"]).astype({"n": "Int32"})

    text = F.when(~F.col("_no_answer"), render_chat(m, turn=turn))
    rendered = conversations.select(
        *keys,
        no_answer.alias("_no_answer"),
        "messages",
        F.coalesce(F.length(render_chat(context, turn=turn)), F.lit(0)).alias("_before"),
    ).withColumn("_text", text)
    cut = rendered.withColumn("_e", encoded.asNondeterministic()("_text", "_before"))
    return _labelled(cut.select(*keys, "_no_answer", F.col("_e.ids").alias("_full"), F.col("_e.n").alias("_n")), keys)


def mask_report(examples: DataFrame) -> DataFrame:
    """One row of counts by reason."""

    def n(reason: str) -> Column:
        return F.count_if(F.col("reason") == reason).alias(f"n_{reason}")

    return examples.agg(
        F.count("*").alias("n_total"),
        n("kept"),
        F.count_if(F.col("reason") != "kept").alias("n_skipped"),
        n("no_answer"),
        n("empty"),
        n("no_label"),
    )


def require_examples(examples: DataFrame) -> DataFrame:
    """The kept examples; an error when there is none."""
    kept = examples.filter(F.col("reason") == "kept").drop("reason")
    if kept.isEmpty():
        raise RuntimeError("no usable example is left after masking and truncation")
    return kept


def pad_examples(
    examples: DataFrame, pad_id: int, multiple: int = PAD_MULTIPLE
) -> DataFrame:
    """Pad every example to its own next multiple (batches of one)."""
    missing = F.pmod(-F.size("input_ids"), F.lit(multiple))

    def padded(name: str, value: int) -> Column:
        fill = F.array_repeat(F.lit(value), missing)
        return F.concat(F.col(name), fill)

    return (
        examples.withColumn("labels", padded("labels", IGNORED_LABEL))
        .withColumn("attention_mask", padded("attention_mask", 0))
        .withColumn("input_ids", padded("input_ids", pad_id))
    )

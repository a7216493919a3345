"""Batch prediction with a generator the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.functions import text as X
from colloquy.operators.retrieved import with_records

Generate = Callable[[list[dict[str, str]], str, bool], str]


def batch_predict(
    prompts: DataFrame,
    keys: Sequence[str],
    load_generator: Callable[[], Generate],
    *,
    model: str,
    finetuned: bool,
) -> DataFrame:
    """``keys``, ``workflow``, ``error``: one row per prompt.

    ``load_generator()`` runs once per Python worker and gives
    ``generate(messages, model, finetuned) -> text``. A prompt whose generation
    raises, or gives no text, gets the workflow ``""`` and its error; the others
    go on. The call is not repeated within a plan, also not under a filter; write the
    result before using it twice: a second pass generates anew.
    """

    @F.pandas_udf("workflow string, error string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = load_generator()
        for batch in batches:
            yield pd.DataFrame(
                [_answer(generate, m, model, finetuned) for m in batch],
                columns=["workflow", "error"],
                dtype=object,
            )

    return prompts.select(*keys, predict.asNondeterministic()("messages").alias("_p")).select(
        *keys, "_p.workflow", "_p.error"
    )


def _answer(generate: Generate, messages, model: str, finetuned: bool) -> tuple[str, str | None]:
    try:
        chat = [{"role": m["role"], "content": m["content"]} for m in messages]
        text = (generate(chat, model, finetuned) or "").strip()
        if not text:
            raise RuntimeError("empty answer")
        return text, None
    except Exception as exc:  # one failing prompt must not stop the run
        return "", f"{type(exc).__name__}: {exc}"


def answer_batches(
    load_generator: Callable[[], Generate], model: str, finetuned: bool
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas``: rows of (prompt, messages) to (prompt, workflow, error)."""

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load_generator()
        for batch in batches:
            told = [_answer(generate, m, model, finetuned) for m in batch["messages"]]
            yield pd.DataFrame(told, columns=["workflow", "error"], dtype=object).assign(
                prompt=batch["prompt"].to_numpy()
            )[["prompt", "workflow", "error"]]

    return answers


def copy_nearest(
    hits: DataFrame, corpus: DataFrame, items: DataFrame, query_id: str
) -> DataFrame:
    """The data-only generator: the workflow of the best retrieved record. An
    item nothing was retrieved for, or with a blank workflow, has failed. With the records'
    ``index`` in the hits, record ids need not be unique."""
    best = with_records(hits.filter(F.col("rank") == 1), corpus, ["workflow"])
    text = X.strip(F.coalesce("workflow", F.lit("")))
    return items.select(query_id).join(best, query_id, "left").select(
        query_id,
        text.alias("workflow"),
        F.when(text == "", F.lit("RuntimeError: empty answer")).alias("error"),
    )


def skip_counts(predictions: DataFrame) -> DataFrame:
    """Failed predictions per task, for the tasks that have any."""
    return (
        predictions.groupBy("task")
        .agg(F.count_if(F.col("error").isNotNull()).alias("n_skipped"))
        .filter(F.col("n_skipped") > 0)
    )

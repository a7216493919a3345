"""Scenarios and the model x scenario x task x eval type matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Scenario id, retrieval, fine-tuned checkpoint, few-shot flag. The text is ours.
SCENARIOS = (
    ("i0", False, False, False, "plain prompt, nothing retrieved, model as published"),
    ("rag", True, False, False, "nearest training records in the prompt"),
    ("sft", False, True, False, "fine-tuned model, nothing retrieved"),
    ("sft_rag", True, True, False, "fine-tuned model and nearest training records"),
)
SCENARIO_IDS = tuple(s[0] for s in SCENARIOS)
# The test tasks.
TASKS = ("wikihow", "toolbench", "toolalpaca", "lumos", "alfworld", "webshop", "os")


def scenario_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SCENARIOS,
        "id string, use_rag boolean, use_sft_checkpoint boolean, "
        "few_shot_flag boolean, description string",
    )


def scenario_name(finetuned: Column, rag: Column) -> Column:
    return (
        F.when(finetuned & rag, "sft_rag")
        .when(finetuned, "sft")
        .when(rag, "rag")
        .otherwise("i0")
    )


def matrix_cells(
    models: DataFrame, tasks: Sequence[str], eval_types: Sequence[str]
) -> DataFrame:
    """Every cell to report. ``models`` has ``model`` and ``scenarios``, the list
    a model is limited to, or null for all."""

    def each(values: Sequence[str]) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return (
        models.select(
            "model",
            F.explode(
                F.coalesce("scenarios", F.array(*[F.lit(s) for s in SCENARIO_IDS]))
            ).alias("scenario"),
        )
        .withColumn("task", each(tasks))
        .withColumn("eval_type", each(eval_types))
    )


def evaluation_matrix(cells: DataFrame, results: DataFrame) -> DataFrame:
    """All cells with their metrics; a cell without a result is ``pending`` and
    names the output it waits for."""
    keys = ["model", "scenario", "task", "eval_type"]
    expected = F.concat(
        F.lit("eval_results/"), "model", F.lit("/"), "task", F.lit("/"), "scenario",
        F.lit("_"), "eval_type", F.lit(".json"),
    )
    done = F.col("n_total").isNotNull()
    return cells.join(results, keys, "left").select(
        *keys,
        F.when(done, "done").otherwise("pending").alias("status"),
        F.when(~done, expected).alias("expected_output"),
        "precision",
        "recall",
        "f1_score",
        "n_total",
        "n_evaluated",
        "n_skipped_unparseable",
        "n_skipped_runtime",
    )


def pivot_matrix(matrix: DataFrame, metric: str = "f1_score") -> DataFrame:
    """One row per model, task and eval type with a column per scenario."""
    return (
        matrix.groupBy("model", "task", "eval_type")
        .pivot("scenario", list(SCENARIO_IDS))
        .agg(F.max(metric))
    )

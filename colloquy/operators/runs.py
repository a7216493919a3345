"""Run stamps and the choice of the latest run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the file-name form of a stamped prediction.
STAMPED = r"graph_eval_(i0|rag|sft|sft_rag)_(\d{8}_\d{6})\.json"
PREDICTION_NAME = rf"^{STAMPED}$"
# <model>/<task>/<file>; the file may be a folder of parts, and the folders may be
# named as a partitioned write does.
_FOLDERS = r"(?:^|/)(?:model=)?([^/]+)/(?:task=)?([^/]+)/(?:file=)?"
PREDICTION_PATH = rf"{_FOLDERS}{STAMPED}(?:/[^/]+)*$"
# The same without a stamp: what a run is called that was not given one.
UNSTAMPED_PATH = rf"{_FOLDERS}graph_eval_(i0|rag|sft|sft_rag)\.json(?:/[^/]+)*$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _group(name: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(name, PREDICTION_NAME, i), F.lit(""))


def scenario_of(name: Column) -> Column:
    """Scenario of a stamped prediction file name, else null."""
    return _group(name, 1)


def stamp_of(name: Column) -> Column:
    return _group(name, 2)


def run_of_path(path: Column) -> list[Column]:
    """Model, task, scenario and stamp of a prediction's path, the stamp null where the name
    has none; nulls for other files."""

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))

    named = [
        F.coalesce(part(PREDICTION_PATH, i + 1), part(UNSTAMPED_PATH, i + 1)).alias(n)
        for i, n in enumerate(("model", "task", "scenario"))
    ]
    return [*named, part(PREDICTION_PATH, 4).alias("stamp")]


def run_stamp(at: Column) -> Column:
    """Compact UTC stamp of a time (with the session's zone set to UTC)."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def latest_runs(
    runs: DataFrame,
    keys: Sequence[str] = ("model", "task", "scenario"),
    newest_by: str = "stamp",
) -> DataFrame:
    """The newest run of each key: the greatest stamp, an unstamped run only
    where there is no stamped one. A maximum, not a sort: it is combined before
    the shuffle, so a key with most of the runs costs no more than another."""
    stamped = F.col("stamp").isNotNull()
    order = F.struct(stamped.alias("s"), F.col(newest_by).alias("n"))
    rest = [c for c in runs.columns if c not in keys]
    return (
        runs.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_r"))
        .select(*keys, "_r.*")
    )


def latest_predictions(
    predictions: DataFrame, keys: Sequence[str] = ("model", "task", "scenario"), newest_by: str = "stamp"
) -> DataFrame:
    """The rows of the newest run of each key, a run without a stamp only where there is no
    other; the run keys are found first, from the key columns alone. ``newest_by`` may name
    another column of the rows, a file's time for instance, of which a run has its greatest;
    runs of one time go by stamp."""
    if newest_by == "stamp":
        newest = predictions.groupBy(*keys).agg(F.max("stamp").alias("stamp"))
    else:
        each = predictions.groupBy(*keys, "stamp").agg(F.max(newest_by).alias("_at"))
        order = F.struct(F.col("stamp").isNotNull().alias("s"), "_at", F.col("stamp").alias("t"))
        newest = each.groupBy(*keys).agg(F.max(order).alias("_r")).select(*keys, F.col("_r.t").alias("stamp"))
    same = [predictions[k].eqNullSafe(newest[k]) for k in (*keys, "stamp")]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    # One row per key: the predictions stay where they are.
    return predictions.join(F.broadcast(newest), cond, "left_semi")


def run_metadata(
    predictions: DataFrame, started_at: str, finished_at: str, limit: int | None = None
) -> DataFrame:
    """One row per run (model, scenario, stamp) with its tasks, where their
    predictions lie, and the failures per task that had any."""
    run = ["stamp", "model", "scenario"]
    per_task = predictions.groupBy(*run, "task").agg(
        F.count_if(F.col("error").isNotNull()).alias("n_failed")
    )
    where = F.concat_ws("/", F.lit("predictions"), "model", "scenario", "task", "stamp")
    failed = F.when(F.col("n_failed") > 0, F.struct("task", "n_failed"))
    # At most one row per task is left to gather.
    return per_task.groupBy(*run).agg(
        F.array_sort(F.collect_list("task")).alias("tasks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", where.alias("p"))))).alias("predictions"),
        F.map_from_entries(F.array_sort(F.collect_list(failed))).alias("skipped_errors"),
    ).select(
        "stamp",
        F.lit(started_at).alias("started_at"),
        F.lit(finished_at).alias("finished_at"),
        "model",
        F.col("scenario").isin("sft", "sft_rag").alias("finetuned"),
        F.col("scenario").isin("rag", "sft_rag").alias("rag"),
        F.lit(limit).cast("long").alias("limit"),
        "tasks",
        "predictions",
        "skipped_errors",
    )

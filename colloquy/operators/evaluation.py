"""Pairing predictions with gold, checking them, and averaging their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators import runs, scoring, workflows

Match = Callable[[DataFrame], DataFrame]

EVAL_TYPES = ("node", "graph")
RUN_KEYS = ("model", "scenario", "task")


def validate_inputs(
    gold: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("idx",),
    run_keys: Sequence[str] = RUN_KEYS,
    expected: DataFrame | None = None,
) -> DataFrame:
    """One row per run with its counts and a ``status``: ``ok``, ``missing_gold``,
    ``missing_run``, ``missing_workflow``, ``count_mismatch`` or ``duplicates``.

    ``gold`` is keyed by (task, keys). Every run is held against all the gold of its
    task, by distinct positions: a prediction without a gold partner is ``extra``, a
    position given twice, in gold or predictions, a duplicate. ``expected`` (run_keys)
    names runs that must be there; one without any prediction is a ``missing_run``.
    """
    places = gold.groupBy("task", *keys).agg(F.count("*").alias("_times"))
    per_task = places.groupBy("task").agg(
        F.count("*").alias("n_gold"), F.sum(F.col("_times") - 1).alias("duplicate_gold")
    )
    # The texts themselves stay out of the join, and each position comes once.
    given = pred.groupBy(*run_keys, *keys).agg(
        F.count("*").alias("_n"), F.count_if(F.col("workflow").isNull()).alias("_null")
    )
    marked = given.join(
        places.select("task", *keys, F.lit(1).alias("_has_gold")), ["task", *keys], "left"
    )
    found = F.count_if(F.col("_has_gold").isNotNull())
    runs = marked.groupBy(*run_keys).agg(
        F.sum("_n").alias("n_pred"),
        F.sum("_null").alias("null_workflow"),
        found.alias("_found"),
        F.count_if(F.col("_has_gold").isNull()).alias("extra_pred"),
        F.sum(F.col("_n") - 1).alias("duplicate_pred"),
    )
    if expected is not None:
        runs = runs.join(expected.select(*run_keys).distinct(), list(run_keys), "full")
    counts = ("n_gold", "n_pred", "null_workflow", "_found", "extra_pred", "duplicate_gold", "duplicate_pred")
    counted = runs.join(per_task, "task", "left").fillna(0, counts).withColumn(
        "missing_pred", F.col("n_gold") - F.col("_found")
    )
    return counted.select(
        *run_keys,
        "n_gold",
        "n_pred",
        "missing_pred",
        "extra_pred",
        "duplicate_gold",
        "duplicate_pred",
        "null_workflow",
        F.when(F.col("n_gold") == 0, "missing_gold")
        .when(F.col("n_pred") == 0, "missing_run")
        .when(F.col("null_workflow") > 0, "missing_workflow")
        .when((F.col("missing_pred") > 0) | (F.col("extra_pred") > 0), "count_mismatch")
        .when((F.col("duplicate_gold") > 0) | (F.col("duplicate_pred") > 0), "duplicates")
        .otherwise("ok")
        .alias("status"),
    )


def require_valid(report: DataFrame) -> DataFrame:
    """The report itself, or an error with the number of runs that fail it and the
    first of them by run."""
    bad = report.filter(F.col("status") != "ok")
    n = bad.count()
    if n:
        first = bad.orderBy(*report.columns).limit(5).collect()
        raise ValueError(
            f"invalid evaluation input, {n} runs: " + "; ".join(str(r.asDict()) for r in first)
        )
    return report


def pair_gold_pred(
    gold: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("idx",),
    *,
    on_mismatch: str = "report",
) -> DataFrame:
    """Predictions with the gold workflow of the same task and position. ``strict``
    raises unless every run covers its gold exactly."""
    if on_mismatch == "strict":
        require_valid(validate_inputs(gold, pred, keys))
    elif on_mismatch != "report":
        raise ValueError(f"unknown on_mismatch {on_mismatch!r}")
    return gold.select(
        "task", *keys, F.col("workflow").alias("gold_workflow")
    ).join(
        pred.withColumnRenamed("workflow", "pred_workflow"), ["task", *keys]
    )


def prepare(pairs: DataFrame, match: Match = workflows.match_by_label) -> DataFrame:
    """Parsed, aligned and classified pairs, ready for a score. ``match`` adds the
    ``matched`` column: by label, or a ``match_by_similarity`` with its encoder."""
    parsed = workflows.with_graph(
        workflows.with_graph(pairs, "gold_workflow", "gold"), "pred_workflow", "pred"
    )
    return scoring.with_status(match(parsed))


def evaluate(
    pairs: DataFrame,
    keys: Sequence[str],
    eval_types: Sequence[str] = EVAL_TYPES,
    *,
    match: Match = workflows.match_by_label,
    order: str = "listed",
    max_steps: int | None = None,
) -> DataFrame:
    """Scores of every pair, one row per eval type; all come from one pass.
    ``node`` is the chain score in the given ``order``, ``graph`` the graph score,
    exact unless ``max_steps`` bounds its search."""
    for t in eval_types:
        if t not in EVAL_TYPES:
            raise ValueError(f"unknown eval_type {t!r}")
    cols = ["status", "precision", "recall", "f1_score"]
    out = prepare(pairs, match)
    for t in eval_types:
        scored = scoring.chain_score(out, order) if t == "node" else scoring.graph_score(out, max_steps=max_steps)
        out = scored.withColumn(f"_{t}", F.struct(*cols)).drop(*cols[1:]).withColumn(
            "status",
            F.when(F.col("status") == "runtime", "evaluated").otherwise(F.col("status")),
        )
    per_type = F.array(
        *[F.struct(F.lit(t).alias("eval_type"), F.col(f"_{t}").alias("s")) for t in eval_types]
    )
    return out.select(*keys, F.explode(per_type).alias("e")).select(
        *keys, "e.eval_type", "e.s.*"
    )


def evaluate_latest(
    gold: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str] = ("idx",),
    *,
    on_mismatch: str = "strict",
    **options,
) -> DataFrame:
    """Mean scores of the newest stored run of each model, scenario and task, with its
    stamp. ``options`` are those of ``evaluate``."""
    newest = runs.latest_predictions(predictions)
    pairs = pair_gold_pred(gold, newest, keys, on_mismatch=on_mismatch)
    run = (*RUN_KEYS, "stamp")
    return aggregate(evaluate(pairs, run, **options), (*run, "eval_type"))


def aggregate(
    scores: DataFrame, keys: Sequence[str] = (*RUN_KEYS, "eval_type")
) -> DataFrame:
    """Means over all examples, skipped ones counting as 0."""

    def mean(name: str) -> Column:
        total = F.sum(F.coalesce(name, F.lit(0.0)))
        return F.try_divide(total, F.count("*")).alias(name)

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return scores.groupBy(*keys).agg(
        mean("precision"),
        mean("recall"),
        mean("f1_score"),
        F.count("*").alias("n_total"),
        n("evaluated").alias("n_evaluated"),
        n("unparseable").alias("n_skipped_unparseable"),
        n("runtime").alias("n_skipped_runtime"),
    )

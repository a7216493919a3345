"""Explicit schemas of the data model; nothing is inferred from files."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

# One train or gold item as it stands in a JSON file.
ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("conversations", MESSAGES),
        T.StructField("messages", MESSAGES),
    ]
)

# One prediction as it stands in an exported JSON file.
PREDICTION_ITEM = T.StructType(
    [T.StructField("query", ITEM), T.StructField("workflow", T.StringType())]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("stamp", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("workflow", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("stamp", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("finetuned", T.BooleanType()),
        T.StructField("rag", T.BooleanType()),
        T.StructField("limit", T.LongType()),
        T.StructField("tasks", T.ArrayType(T.StringType())),
        T.StructField("predictions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("skipped_errors", T.MapType(T.StringType(), T.LongType())),
    ]
)

RESULTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("model", "scenario", "task", "eval_type", "stamp")]
    + [T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1_score")]
    + [
        T.StructField(c, T.LongType())
        for c in ("n_total", "n_evaluated", "n_skipped_unparseable", "n_skipped_runtime")
    ]
)

INDEX_META = T.StructType(
    [
        T.StructField("embedding_model", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("top_k", T.LongType()),
        T.StructField("chunk_fields", T.ArrayType(T.StringType())),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("num_vectors", T.LongType()),
    ]
)

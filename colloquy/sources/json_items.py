"""Train, gold and prediction JSON files.

A file holds one JSON array, or (``lines=True``) one object per line. An array is read by
ranges (``json_arrays``), so one file may be large; a position inside it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.operators import runs
from colloquy.schemas import ITEM, PREDICTION_ITEM
from colloquy.sources.json_arrays import read_elements, with_offsets

GOLD_NAME = "graph_eval.json"


def _array_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return (
        spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )


def _items(elements: DataFrame, files: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """``keys``, ``idx`` and the fields of each element; ``files`` has the keys of each file
    (rows of other files are left out), and positions run over the files of the same keys in
    name order."""
    offsets = with_offsets(files.select(*keys, "file", "n"), ["file"], keys).drop("n")
    item = F.from_json("text", schema, {"mode": "FAILFAST"})
    # One row per file: the texts stay where they are.
    return elements.join(F.broadcast(offsets), "file").select(
        *keys, (F.col("offset") + F.col("pos")).cast("long").alias("idx"), item.alias("item")
    ).select(*keys, "idx", "item.*")


def read_train(spark: SparkSession, path: str, schema: T.StructType = ITEM) -> DataFrame:
    """Items of all array files under ``path`` with ``idx``, the 0-based position
    over the files in name order. A file that is no list fails the read."""
    return _items(*read_elements(spark, path), schema, [])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = ITEM) -> DataFrame:
    """Items of splittable JSON-lines files; they carry their own ids."""
    return spark.read.schema(schema).json(path)


def count_train(spark: SparkSession, path: str) -> int:
    """Number of items; fails unless every file is a list."""
    return read_train(spark, path).count()


def _gold_paths(root: str) -> str:
    return f"{root.rstrip('/')}/*/*{GOLD_NAME}"


def _with_task(files: DataFrame) -> DataFrame:
    name = GOLD_NAME.replace(".", r"\.")
    task = F.regexp_extract("file", rf"/(?:task=)?([^/]+)/(?:file=)?{name}(?:/.*)?$", 1)
    return files.withColumn("task", task).filter(F.col("task") != "")


def _gold_files(spark: SparkSession, root: str) -> DataFrame:
    return _with_task(_array_files(spark, _gold_paths(root)))


def read_gold(spark: SparkSession, root: str, schema: T.StructType = ITEM) -> DataFrame:
    """Gold items under ``<root>/<task>/graph_eval.json`` (a file, or a folder of
    files) with ``task`` and ``idx``, the position within the task. The folder
    names ``task=<task>/file=graph_eval.json`` of a partitioned write do as well."""
    elements, files = read_elements(spark, _gold_paths(root))
    return _items(elements, _with_task(files), schema, ["task"])


def read_prediction_files(spark: SparkSession, root: str) -> DataFrame:
    """Predictions under ``<root>/<model>/<task>/graph_eval_<scenario>_<stamp>.json``:
    model, scenario, task, stamp, ``idx`` (the position in the run), ``query`` (the gold
    item), ``workflow`` and ``modified``, the time of the run's newest file. A run whose files
    have no stamp in their names has none. Such a file is an array of ``{query, workflow}``, or a folder
    of such files, in name order. Files of other names are left alone."""
    run = ["model", "task", "scenario", "stamp"]
    elements, files = read_elements(spark, root)
    named = files.select("*", *runs.run_of_path(F.col("file"))).filter(F.col("scenario").isNotNull())
    # Names and times only: the content is never asked for.
    times = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(*runs.run_of_path(F.col("_metadata.file_path")), F.col("_metadata.file_modification_time").alias("at"))
        .filter(F.col("scenario").isNotNull()).groupBy(*run).agg(F.max("at").alias("modified"))
        .select(*[F.col(c).alias(f"_{c}") for c in run], "modified")
    )
    # Nulls are keys here as well: a run may be without a stamp.
    items = _items(elements, named.withColumn("stamp", F.coalesce("stamp", F.lit(""))), PREDICTION_ITEM, run)
    same = [F.col(c) == F.coalesce(f"_{c}", F.lit("")) for c in run]
    return items.join(F.broadcast(times), same, "left").select(
        "model", "scenario", "task", F.nullif("stamp", F.lit("")).alias("stamp"), "idx", "query", "workflow", "modified"
    )


def list_tasks(spark: SparkSession, root: str) -> DataFrame:
    return _gold_files(spark, root).select("task").distinct()


def task_counts(spark: SparkSession, root: str) -> DataFrame:
    """Items per task; 0 for an empty file or one that holds no list."""
    return (
        _gold_files(spark, root)
        .groupBy("task")
        .agg(F.sum(F.coalesce(F.json_array_length("value"), F.lit(0))).alias("n_items"))
    )

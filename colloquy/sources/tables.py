"""Parquet and JSON tables: predictions, runs, the retrieval index, the SFT set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colloquy import schemas
from colloquy.operators.embedding import HASH_ENCODER_NAME
from colloquy.operators.runs import latest_runs
from colloquy.session import FREE_SHUFFLES, settings
from colloquy.sources.json_arrays import read_elements, write_arrays

PREDICTION_PARTITIONS = ["model", "scenario", "task", "stamp"]
CHUNK_FIELDS = ["query"]
#: An export joins predictions with their gold items in so many slices, to hold less on disk.
EXPORT_SLICES = 4


def _read(spark: SparkSession, path: str, schema: T.StructType, what: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"no {what} at {path}") from exc
        raise


# --- predictions and runs ---------------------------------------------------


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write runs, one folder each; a run that is there already is replaced, so writing it
    twice, after a failure for instance, gives its rows once. The rebalance brings the rows
    of a run together, for few files, but splits a run that is large."""
    dealt = predictions.select(*schemas.PREDICTIONS.fieldNames()).hint("rebalance", *PREDICTION_PARTITIONS)
    with settings(predictions.sparkSession, FREE_SHUFFLES):
        (
            dealt.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PREDICTION_PARTITIONS)
            .parquet(path)
        )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.PREDICTIONS, "predictions").select(
        *schemas.PREDICTIONS.fieldNames()
    )


def export_predictions(
    predictions: DataFrame, gold_items: DataFrame, path: str, per_file: int = 65_536
) -> None:
    """JSON arrays of ``{query, workflow}``, the gold item as the query, in the order of
    positions, under ``<path>/model=<m>/task=<t>/file=graph_eval_<scenario>_<stamp>.json``
    (no stamp: without it), as ``json_items.read_prediction_files`` reads them. A run that is
    exported again replaces its files."""
    item = gold_items.select("task", "idx", F.struct(*schemas.ITEM.fieldNames()).alias("query"))
    name = F.concat(F.lit("graph_eval_"), F.concat_ws("_", "scenario", "stamp"), F.lit(".json"))
    pair = F.struct("query", F.coalesce("workflow", F.lit("")).alias("workflow")).alias("pair")

    def joined(answers: DataFrame, items: DataFrame) -> DataFrame:
        return answers.join(items, ["task", "idx"]).select("model", "task", name.alias("file"), "idx", pair)

    dealt = F.pmod(F.xxhash64("task", "idx"), F.lit(EXPORT_SLICES))
    slices = [joined(predictions.where(dealt == i), item.where(dealt == i)) for i in range(EXPORT_SLICES)]
    write_arrays(
        joined(predictions, item), F.to_json("pair"), path, ["model", "task", "file"], ["idx"], per_file, slices
    )


def append_runs(runs: DataFrame, path: str) -> None:
    runs.select(*schemas.RUNS.fieldNames()).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.RUNS, "runs")


def append_results(results: DataFrame, path: str) -> None:
    """Metrics per run and eval type, columns of ``schemas.RESULTS``; ``stamp`` is the run's."""
    with settings(results.sparkSession, FREE_SHUFFLES):
        results.write.mode("append").partitionBy("model", "scenario").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of the newest run of each model, scenario, task and eval type."""
    stored = _read(spark, path, schemas.RESULTS, "results")
    newest = latest_runs(stored, ("model", "scenario", "task", "eval_type"))
    return newest.select(*schemas.RESULTS.fieldNames())


# The fields of a result file.
RESULT_FIELDS = (
    "precision", "recall", "f1_score", "n_total", "n_evaluated", "n_skipped_unparseable", "n_skipped_runtime", "eval_device",
)


def write_result_files(results: DataFrame, path: str, device: str = "cpu") -> None:
    """One JSON object per model, task, scenario and eval type, under
    ``<path>/model=<m>/task=<t>/file=<scenario>_<type>.json``; what is there already is replaced."""
    known = results.withColumn("eval_device", F.lit(device))
    name = F.concat(F.col("scenario"), F.lit("_"), F.col("eval_type"), F.lit(".json"))
    (
        known.select("model", "task", name.alias("file"), F.to_json(F.struct(*RESULT_FIELDS)).alias("value"))
        .repartition("model", "task", "file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "task", "file").text(path)
    )


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """The results under ``<path>/<model>/<task>/<scenario>_<type>.json`` (folder names of a
    partitioned write do as well); other files are left alone."""
    pattern = r"/(?:model=)?([^/]+)/(?:task=)?([^/]+)/(?:file=)?(i0|rag|sft_rag|sft)_([^/_]+)\.json(?:/[^/]+)*$"
    fields = T.StructType(
        [f for f in schemas.RESULTS.fields if f.name in RESULT_FIELDS] + [T.StructField("eval_device", T.StringType())]
    )
    # A file is one small object, over several lines or not.
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    named = texts.select(
        *[F.regexp_extract("file", pattern, i + 1).alias(n) for i, n in enumerate(("model", "task", "scenario", "eval_type"))],
        F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r"),
    )
    return named.where("scenario <> ''").select("model", "scenario", "task", "eval_type", "r.*")


def summary_json(matrix: DataFrame) -> DataFrame:
    """The matrix as one nested JSON text (``summary``): models, scenarios, tasks and eval
    types, with the metrics of done cells, and of others their status and expected output.
    A matrix has as many cells as were asked for, not as there are predictions."""
    result = F.to_json(F.struct(*[c for c in RESULT_FIELDS if c in matrix.columns]))
    wait = F.to_json(F.struct("status", "expected_output"))
    value = F.when(F.col("status") == "done", result).otherwise(wait)

    def entry(key: str) -> Column:
        return F.struct(F.to_json(F.struct(F.col(key).alias("k"))).alias("k"), "v")

    rows = matrix.select("model", "scenario", "task", "eval_type", value.alias("v"))
    keys = ["model", "scenario", "task", "eval_type"]
    while keys:
        *keys, key = keys
        # {"k":"name"} less its frame is the name as JSON has it.
        listed = F.array_sort(F.collect_list(entry(key)))
        texts = F.transform(listed, lambda e: F.concat(F.regexp_extract(e["k"], r'^\{"k":(.*)\}$', 1), F.lit(":"), e["v"]))
        body = F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))
        rows = rows.groupBy(*keys).agg(body.alias("v"))
    return rows.select(F.concat(F.lit('{"models":'), "v", F.lit("}")).alias("summary"))


# --- fingerprints and the retrieval index -----------------------------------


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under ``path`` (each under 2 GB)."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256")
    )


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: every field with its length before it, null as ``n``."""
    marked = [
        F.coalesce(
            F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")
        )
        for c in columns
    ]
    return F.sha2(F.concat(*marked), 256)


def corpus_fingerprint(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One fingerprint of a whole table, whatever the order of its rows: xor and sum of
    every slice of the row digests, hashed, and the row count."""
    digest = table.select(row_digest([F.col(c) for c in columns]).alias("d"))
    slices = [F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    told = [
        F.coalesce(f, F.lit(0)).cast("string")
        for s in slices
        for f in (F.bit_xor(s), F.sum(s.cast("decimal(20,0)")))
    ]
    return digest.agg(
        F.sha2(F.concat_ws(",", *told), 256).alias("fingerprint"), F.count("*").alias("n_rows")
    )


def write_index(
    records: DataFrame,
    path: str,
    fingerprint: str,
    *,
    embedding_model: str = HASH_ENCODER_NAME,
    seed: int = 42,
    top_k: int = 2,
) -> None:
    """Records with their vectors, each file in id order, and one row of metadata."""
    spark = records.sparkSession
    norm = F.sqrt(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )
    (
        records.withColumn("embedding", F.col("embedding").cast("array<float>"))
        .withColumn("norm", norm)
        .sortWithinPartitions("id", "index")
        .write.mode("overwrite")
        .parquet(f"{path}/records")
    )
    count = spark.read.parquet(f"{path}/records").count()
    meta = (embedding_model, seed, top_k, CHUNK_FIELDS, fingerprint, count)
    spark.createDataFrame([meta], schemas.INDEX_META).write.mode("overwrite").parquet(
        f"{path}/meta"
    )


INDEX_RECORDS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("workflow", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("norm", T.DoubleType()),
    ]
)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, metadata); an error when the index was never built."""
    records = _read(spark, f"{path}/records", INDEX_RECORDS, "retrieval index")
    return records, _read(spark, f"{path}/meta", schemas.INDEX_META, "index metadata")


def index_staleness(
    current: DataFrame,
    meta: DataFrame | None,
    *,
    embedding_model: str = HASH_ENCODER_NAME,
    force: bool = False,
) -> DataFrame:
    """Whether the index has to be built anew, and why. Only the question is ever
    embedded, so an index over other fields is stale."""
    fields = F.array(*[F.lit(f) for f in CHUNK_FIELDS])
    if meta is None:
        stored = current.select(
            "fingerprint", F.lit(None).cast("string").alias("_old"),
            F.lit(None).cast("string").alias("embedding_model"),
            F.lit(None).cast("array<string>").alias("chunk_fields"),
        )
    else:
        # Both sides are one row.
        old = meta.select(
            F.lit(1).alias("_one"), F.col("fingerprint").alias("_old"),
            "embedding_model", "chunk_fields",
        )
        stored = current.withColumn("_one", F.lit(1)).join(old, "_one", "left")
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("_old").isNull(), "absent")
        .when(F.col("_old") != F.col("fingerprint"), "train set changed")
        .when(F.col("embedding_model") != embedding_model, "embedding model changed")
        .when(F.col("chunk_fields") != fields, "fields changed")
    )
    return stored.select(
        reason.isNotNull().alias("is_stale"),
        F.coalesce(reason, F.lit("fresh")).alias("reason"),
        "fingerprint",
    )


# --- the fine-tuning set ----------------------------------------------------


def write_sft(
    dataset: DataFrame, stats: DataFrame, path: str, format: str = "json", order: Sequence[str] = ()
) -> None:
    """The conversation set (``messages`` only) and its statistics. ``format="array"`` writes
    JSON array files, in the order of the columns ``order``."""
    if format == "array":
        item = F.to_json(F.struct("messages"))
        write_arrays(dataset, item, f"{path}/set", [], list(order))
    else:
        dataset.select("messages").write.mode("overwrite").format(format).save(f"{path}/set")
    stats.write.mode("overwrite").json(f"{path}/stats")


def read_sft(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Records with messages, role and content only, a missing content as ``""``."""
    schema = T.StructType([T.StructField("messages", schemas.MESSAGES)])
    if format == "array":
        elements, _ = read_elements(spark, f"{path}/set")
        item = F.from_json("text", schema, {"mode": "FAILFAST"})
        records = elements.select(item.alias("item")).select("item.*")
    else:
        records = spark.read.schema(schema).format(format).load(f"{path}/set")
    return reload_messages(records)


def reload_messages(records: DataFrame) -> DataFrame:
    return records.filter(F.size("messages") > 0).withColumn(
        "messages",
        F.transform(
            "messages",
            lambda m: F.struct(
                m["role"].alias("role"),
                F.coalesce(m["content"], F.lit("")).alias("content"),
            ),
        ),
    )

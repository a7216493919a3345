"""Answers of generators, kept by prompt digest, so that a stopped run can go on.

Under one path lie folders ``part-<run>-<slice>-<id>`` of answers (``prompt``, ``workflow``,
``error``, ``run``). A part is committed by Spark's own writer: its ``_SUCCESS`` file is
written last, and readers take only parts that have one. A run generates only prompts no
committed part answers, equal prompts once, slice by slice; a run that dies loses the slice
it was at, and one that lost an executor repeats that executor's tasks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colloquy.operators.prediction import Generate, answer_batches
from colloquy.session import materialize

SLICES = 16

ANSWERS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("prompt", "workflow", "error", "run")]
)


def prompt_digest(messages: Column, model: str, finetuned: bool) -> Column:
    """SHA-256 of all a generator is given. JSON keeps roles, texts and their bounds apart;
    null fields are left out, so a null text differs from an empty one."""
    told = F.to_json(messages.cast("array<struct<role:string,content:string>>"))
    given = F.struct(F.lit(model).alias("model"), F.lit(finetuned).alias("tuned"), told.alias("told"))
    return F.sha2(F.to_json(given), 256)


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Committed parts. Their number follows the runs and slices, not the prompts."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-*/_SUCCESS"))
    return sorted(f.getPath().getParent().toString() for f in found or [])


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """One answer per prompt: one without an error where there is one, else that of the
    greatest run; of several such the greatest text. Combined before the shuffle."""
    parts = _parts(spark, path)
    if not parts:
        return spark.createDataFrame([], ANSWERS)
    best = F.max(
        F.struct(F.col("error").isNull().alias("good"), "run", "workflow", "error")
    ).alias("_a")
    every = spark.read.schema(ANSWERS).parquet(*parts)
    return every.groupBy("prompt").agg(best).select("prompt", "_a.workflow", "_a.error", "_a.run")


def predict_rest(
    prompts: DataFrame,
    keys: Sequence[str],
    path: str,
    load_generator: Callable[[], Generate],
    *,
    model: str,
    finetuned: bool,
    run: str,
    slices: int = SLICES,
    retry_failed: bool = True,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``keys``, ``workflow``, ``error``, ``run``: one row per prompt, like ``batch_predict``;
    ``run`` names the run that made the answer.

    Prompts that ``path`` holds an answer for are not generated again; with ``retry_failed``
    those whose answer is an error are. Equal prompts of one model are generated once.
    ``profile`` asks for resources of the generating stage, accelerators for instance.
    A run name may be used again: a run goes on under its name.
    """
    spark = prompts.sparkSession
    asked = materialize(
        prompts.select(*keys, "messages", prompt_digest(F.col("messages"), model, finetuned).alias("prompt")),
        "asked",
    )
    known = read_answers(spark, path)
    if retry_failed:
        known = known.where(F.col("error").isNull())
    # Digests are compared without the texts; only what is still to be done is moved.
    open_ = asked.select("prompt").distinct().join(known.select("prompt"), "prompt", "left_anti")
    slice_of = F.pmod(F.xxhash64("prompt"), F.lit(slices)).cast("int").alias("slice")
    todo = (
        asked.join(open_, "prompt", "left_semi")
        .dropDuplicates(["prompt"])
        .select("prompt", "messages", slice_of)
    )
    left = materialize(todo, "to-generate")
    sizes = {r["slice"]: r["n"] for r in left.groupBy("slice").agg(F.count("*").alias("n")).collect()}
    answer = answer_batches(load_generator, model, finetuned)
    for i in sorted(sizes):
        # Rows are dealt out evenly: the cost is the generator's, not the reading.
        part = left.where(F.col("slice") == i).select("prompt", "messages").repartition("prompt")
        done = part.mapInPandas(answer, "prompt string, workflow string, error string", profile=profile)
        done.withColumn("run", F.lit(run)).write.parquet(f"{path}/part-{run}-{i}-{uuid.uuid4().hex}")
    answers = read_answers(spark, path)
    return asked.select(*keys, "prompt").join(answers, "prompt").select(*keys, "workflow", "error", "run")

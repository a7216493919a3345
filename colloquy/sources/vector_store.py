"""A retrieval index that is brought up to date instead of built anew.

Under one path lie

* ``records-<run>``: the records of one version with the digest of their text,
* ``vectors-<run>``: vectors by (digest, encoder), added by one run,
* ``manifest/version=<n>``: one row per version, written last: the folder of its records,
  those of its vectors, and the metadata of the index.

Readers go by a manifest row, so they see a whole version or the one before, also while a
run is under way or after one has failed. A run embeds only texts that no earlier run with the
same encoder has embedded, and equal texts once. Two runs at a time want the same version
number: the second to finish fails and leaves the first's version alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from colloquy import schemas
from colloquy.operators.embedding import HASH_ENCODER_NAME
from colloquy.sources.tables import CHUNK_FIELDS, row_digest

MOST_BATCHES = 32

MANIFEST = T.StructType(
    [
        *schemas.INDEX_META.fields,
        T.StructField("n_texts", T.LongType()),
        T.StructField("n_embedded", T.LongType()),
        T.StructField("records", T.StringType()),
        T.StructField("batches", T.ArrayType(T.StringType())),
    ]
)

VECTORS = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions, or None where there is no index yet."""
    schema = T.StructType([*MANIFEST.fields, T.StructField("version", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _newest(found: DataFrame | None, where: Column | None = None) -> Row | None:
    if found is None:
        return None
    return (found if where is None else found.where(where)).orderBy(F.desc("version")).head()


def _commit(row: DataFrame, path: str, version: int) -> None:
    """Write a version's row. A folder without a row was left by a run that died here."""
    place = f"{path}/manifest/version={version}"
    try:
        row.write.parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        past = manifests(row.sparkSession, path)
        if past is not None and _newest(past, F.col("version") == version):
            raise RuntimeError(f"version {version} of {path} was written by another run") from e
        row.write.mode("overwrite").parquet(place)


def _vectors(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], VECTORS)
    return spark.read.schema(VECTORS).parquet(*[f"{path}/{b}" for b in batches])


def refresh(
    records: DataFrame,
    path: str,
    fingerprint: str,
    encode: Callable[[DataFrame], DataFrame],
    *,
    embedding_model: str = HASH_ENCODER_NAME,
    seed: int = 42,
    top_k: int = 2,
    most_batches: int = MOST_BATCHES,
) -> DataFrame:
    """A new version that holds ``records`` (``text`` and any columns but ``digest`` and
    ``embedding``); its manifest row.

    ``encode`` adds ``embedding`` to rows of (digest, text). Vectors of texts that left the
    records are kept for later versions until there are ``most_batches`` folders of them; then
    those in use become one. Old versions stay readable.
    """
    spark = records.sparkSession
    past = manifests(spark, path)
    last, like = _newest(past), _newest(past, F.col("embedding_model") == embedding_model)
    batches = list(like["batches"]) if like else []

    run = uuid.uuid4().hex
    records.withColumn("digest", row_digest([F.col("text")])).write.parquet(f"{path}/records-{run}")
    held = spark.read.parquet(f"{path}/records-{run}")
    digests = held.select("digest").distinct()
    known = _vectors(spark, path, batches)
    # Digests alone are compared; texts are fetched for the new ones, which are few.
    missing = digests.join(known.select("digest"), "digest", "left_anti")
    texts = held.select("digest", "text").join(missing, "digest", "left_semi").dropDuplicates(["digest"])
    new = encode(texts).select("digest", F.col("embedding").cast("array<float>").alias("embedding"))
    new.write.parquet(f"{path}/vectors-{run}")
    n_embedded = _vectors(spark, path, [f"vectors-{run}"]).count()
    if n_embedded:
        batches.append(f"vectors-{run}")
    if len(batches) > most_batches:
        used = _vectors(spark, path, batches).join(digests, "digest", "left_semi")
        used.write.parquet(f"{path}/vectors-{run}-all")
        batches = [f"vectors-{run}-all"]

    version = last["version"] + 1 if last else 1
    row = (
        embedding_model, seed, top_k, list(CHUNK_FIELDS), fingerprint, held.count(),
        digests.count(), n_embedded, f"records-{run}", batches,
    )
    _commit(spark.createDataFrame([row], MANIFEST).coalesce(1), path, version)
    return manifests(spark, path).where(F.col("version") == version)


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with ``embedding``, manifest row) of the newest version or the given one."""
    found = manifests(spark, path)
    row = _newest(found, None if version is None else F.col("version") == version)
    if row is None:
        raise FileNotFoundError(f"no retrieval index{'' if version is None else f' of version {version}'} at {path}")
    records = spark.read.parquet(f"{path}/{row['records']}")
    stored = records.join(_vectors(spark, path, row["batches"]), "digest")
    return stored.drop("digest"), found.where(F.col("version") == row["version"])

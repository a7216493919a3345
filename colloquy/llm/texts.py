"""Whole texts in Arrow batches, cut into slices of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes a Python task works on at a time (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20

#: White space as the word rule has it: space and U+0009 to U+000D.
SPACES = b" \t\n\r\x0b\x0c"


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, a few at a time, so that no slice holds many long texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(part)]):
            yield batch.slice(int(lo), int(hi - lo))


def map_slices(
    df: DataFrame, column: str, make: Callable[[pa.RecordBatch], dict | None], schema: str
) -> DataFrame:
    """``make`` turns a slice into columns of ``schema`` (None: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = StructType.fromDDL(schema)
    arrow = to_arrow_schema(ddl)

    def run(batches):
        for part in slices(batches, column):
            made = make(part)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, ddl)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        *(columns or ("doc_id", "text"))
    )


@contextmanager
def bloom_join(spark):
    """Joins in here may filter their larger side by a Bloom filter of the smaller one
    before it is shuffled, whatever its size; Spark bounds the filter's bits."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)

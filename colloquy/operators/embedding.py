"""Text to vectors: a deterministic hashing encoder, and a hook for a real
encoder that runs batch-wise in the Python workers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

HASH_DIM = 64
BATCH_TEXTS = 64
HASH_ENCODER_NAME = "hashing-md5-64"


def bucket_of(word: str, dim: int = HASH_DIM) -> int:
    """The bucket of a word: the first 16 bits of its md5, modulo ``dim``."""
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim


def unit_counts(texts: pa.Array, dim: int = HASH_DIM) -> pa.Array:
    """Word counts per bucket of every text, each row scaled to length one (all
    zero without words). A batch is handled as a whole; of its words only the
    different ones are hashed."""
    n = len(texts)
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    split = pc.split_pattern_regex(lower, r"[^\p{L}\p{N}]+")
    row = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    coded = split.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    bucket = np.array([bucket_of(w, dim) if w else -1 for w in vocabulary], dtype=np.int64)
    at = bucket[coded.indices.to_numpy()] if vocabulary else np.zeros(0, np.int64)
    cell = (row * dim + at)[at >= 0]
    counts = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(unit.ravel())
    )


def with_hash_embedding(
    df: DataFrame, text_col: str, out: str = "embedding", dim: int = HASH_DIM
) -> DataFrame:
    """Vectors of the deterministic hashing encoder.

    The function is declared non-deterministic so that no filter on its result
    makes it run twice.
    """

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        return unit_counts(texts, dim)

    return df.withColumn(out, embed.asNondeterministic()(F.col(text_col)))


def with_encoder(
    df: DataFrame,
    text_col: str,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    out: str = "embedding",
    batch: int = BATCH_TEXTS,
) -> DataFrame:
    """Encode with a model that ``load_encoder()`` makes once per Python worker;
    it is given at most ``batch`` texts at a time. Vectors are float32."""

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for s in texts:
            values = s.tolist()
            vectors: list[np.ndarray] = []
            for i in range(0, len(values), batch):
                vectors.extend(np.asarray(encoder(values[i : i + batch]), dtype=np.float32))
            yield pd.Series(vectors)

    return df.withColumn(out, encode(F.col(text_col)))

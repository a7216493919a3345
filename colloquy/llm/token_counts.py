"""Operator 8: token counts through a cache keyed by digests.

The cache is a Parquet table of (content digest, tokenizer digest, count). Rows of
the input join it on the digest of their normalised content and on the digest of the
tokenizer's file; only different contents that it lacks are encoded, and appended.
Normalisation may not change a count: it turns null into the empty text and
otherwise leaves the text to the tokenizer's own normaliser.
Repeated rows and ties share one cache entry; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import texts
from colloquy.llm.chunks import cuts_at_spaces, file_digest, tokenizer_cache
from colloquy.session import scratch_dir

CACHE = "digest string, tokenizer string, n_tokens bigint"


def count_tokens(df: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """(digest, n_tokens) of rows (digest, text), by tokenizers or sentencepiece."""
    by_piece = path.endswith(".json") and cuts_at_spaces(path)

    def make(batch: pa.RecordBatch) -> dict:
        given = texts.strings(batch, text_column)
        if by_piece:
            counts = [len(x) >> 2 for x in tokenizer_cache(path).ids(given)]
        else:
            counts = [len(x) for x in whole_texts(path, given)]
        return {"digest": batch.column("digest"), "n_tokens": counts}

    return texts.map_slices(df.select("digest", text_column), text_column, make, "digest string, n_tokens bigint")


_loaded: dict[str, object] = {}


def whole_texts(path: str, given: list[str]) -> list[list[int]]:
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = tok
    tool = _loaded[path]
    if path.endswith(".model"):
        return tool.encode(given, num_threads=1, add_bos=False, add_eos=False)
    return [e.ids for e in tool.encode_batch_fast(given, add_special_tokens=False)]


def cached_counts(df: DataFrame, tokenizer_path: str, cache_path: str, limit: int,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit; the cache gets what it lacked."""
    spark = df.sparkSession
    version = file_digest(tokenizer_path)
    content = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(
        id_column, F.octet_length(content).cast("long").alias("n_bytes"),
        F.sha2(content.cast("binary"), 256).alias("digest"),
    )
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    stored = (
        spark.read.schema(CACHE).parquet(cache_path)
        .where(F.col("tokenizer") == version).select("digest", "n_tokens")
    )
    # One text per missing digest: combined in the map tasks, so copies move once per task.
    missing = (
        df.select(F.sha2(content.cast("binary"), 256).alias("digest"), content.alias("text"))
        .join(stored.select("digest"), "digest", "left_anti")
        .groupBy("digest").agg(F.first("text").alias("text"))
    )
    (
        count_tokens(missing, tokenizer_path)
        .select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
        .write.mode("append").parquet(cache_path)
    )
    # Read anew: the appended files belong to it now. Two jobs may have added the same digest.
    known = (
        spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return rows.join(known, "digest", "left").select(
        id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cached_counts(
        texts.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
        scratch_dir(spark, "token-counts"), 512,
    )

"""Operator 6: best-fit packing by exact complements.

Texts become pieces of at most ``capacity`` tokens. Which pieces share a sequence is
decided on the histogram of lengths alone (at most ``capacity`` numbers, whatever the
input): lengths are taken from the longest down, and the gap that a length leaves is
filled exactly by one, two or three lengths, as many times as the counts allow. One
length is looked up in the counts; sums of two and three are not indexed but searched
anew for each gap among the lengths still there. What finds no exact complement is
placed best-fit, longest first. The plan is a list of (lengths, how often). Pieces then get a rank within
their length, and the rank says sequence and offset.

Null texts count as empty: one piece with the end id. Repeated rows are pieces of
their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import texts
from colloquy.llm.chunks import cuts_at_spaces, tokenizer_cache
from colloquy.session import materialize

#: Pieces of one length that a task numbers at a time, on average.
RANKED_TOGETHER = 50_000


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    if not cuts_at_spaces(tokenizer_path):
        raise ValueError("packing needs a byte-level tokenizers file")
    id_type = df.schema[id_column].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def make(batch: pa.RecordBatch) -> dict:
        ids = tokenizer_cache(tokenizer_path).ids(texts.strings(batch, text_column))
        rows, piece, start, length, crc = [], [], [], [], []
        for row, x in enumerate(ids):
            x += end
            n = len(x) >> 2
            first = n % capacity or capacity
            cuts = [0, *range(first, n + 1, capacity)]
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                rows.append(row)
                piece.append(k)
                start.append(lo)
                length.append(hi - lo)
                crc.append(zlib.crc32(x[4 * lo : 4 * hi]))
        return {
            id_column: batch.column(id_column).take(pa.array(rows, pa.int64())),
            "piece": piece, "start": start, "length": length, "ids_crc32": crc,
        }

    return texts.map_slices(
        df.select(id_column, text_column), text_column, make,
        f"`{id_column}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint",
    )


def exact_complement(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three lengths still there that fill ``gap``, longest first."""
    if left[gap]:
        return (gap,)
    there = np.flatnonzero(left[:gap])
    pair = there[left[gap - there] > 0]
    for a in pair[::-1]:
        if 2 * a != gap or left[a] > 1:
            return tuple(int(x) for x in sorted((a, gap - a), reverse=True))
    for a in there[::-1]:
        rest = int(gap - a)
        if 3 * a < gap:
            break
        two = there[(there < rest) & (there <= a)]
        for b in two[left[rest - two] > 0][::-1]:
            c = rest - int(b)
            need = defaultdict(int)
            for x in (int(a), int(b), c):
                need[x] += 1
            if all(left[x] >= k for x, k in need.items()):
                return (int(a), int(b), c)
    return None


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how often)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # the one whose gap is filled
            found = exact_complement(capacity - length, left)
            left[length] += 1
            if found is None:
                break
            need = defaultdict(int)
            for x in (length, *found):
                need[x] += 1
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * times
            plan.append(((length, *found), times))
    # Residuals: best fit, longest first, on bins grouped by their contents.
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g, b in bins.items() if b and g >= length), default=None)
            if gap is None:
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    bins[capacity - each * length].append(((length,) * each, full))
                if rest:
                    bins[capacity - rest * length].append(((length,) * rest, 1))
                break
            held, times = bins[gap].pop()
            take = min(n, times)
            if times > take:
                bins[gap].append((held, times - take))
            bins[gap - length].append(((*held, length), take))
            n -= take
    return plan + [x for group in bins.values() for x in group]


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, which must not change between scans
    (materialize what is computed)."""
    spark = pieces.sparkSession
    buckets = 64 + pieces.count() // RANKED_TOGETHER
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = materialize(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "length-counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    used: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for lengths, times in pack_lengths(histogram, capacity):
        at = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + times, sequence, at))
            used[length] += times
            at += length
        sequence += times
    # A plan has at most some rows per length, however many pieces there are.
    places = spark.createDataFrame(
        slots, "length bigint, lo bigint, hi bigint, sequence bigint, offset bigint"
    )
    within = Window.partitionBy("length", "bucket").orderBy(*keys)
    ranked = dealt.withColumn("in_bucket", F.row_number().over(within) - 1).join(
        firsts, ["length", "bucket"]
    ).withColumn("rank", F.col("first") + F.col("in_bucket"))
    return ranked.join(
        F.broadcast(places.withColumnRenamed("length", "slot_length")),
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    ).select(
        *pieces.columns, (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    pieces = materialize(token_pieces(df, tokenizer_path, end_id, capacity, id_column, text_column), "pieces")
    return pack(pieces, capacity, (id_column, "piece"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(texts.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

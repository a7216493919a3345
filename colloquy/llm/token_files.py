"""Operator 13: token ids in binary files, by frequency ranks and byte-aligned codes.

Texts are encoded once. The ids are counted over all documents and ranked, the most
frequent first, so that frequent ids are small numbers. A rank takes one to four bytes;
how many stands in two bits of a control byte, four ranks to each, and the control bytes
of a block lie apart from its data bytes. So a reader needs no bit-by-bit loop: a control
byte picks a row of a table that says where the sixteen bytes of its four numbers come
from, and a block is decoded by a few numpy look-ups.

A set of files is a folder with two Parquet tables. ``ranks`` is (rank, id, n), a row per
id that occurs. ``blocks`` has documents in ascending id order; a file is a range of ids,
a row a block of whole documents: shard, block, before (ids of the shard before the
block), n_tokens, keys, lengths, control, data. Parquet is the container because Spark then
commits the files, wherever they lie, and a lost executor leaves no half of one.

Null ids come first, null texts count as empty (the end id alone). Rows that repeat an id
are documents of their own, ordered by a digest of their ids; equal rows are
interchangeable. No text is cut, however long; a document is one task's row. Extra columns
are ignored. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colloquy.llm import texts
from colloquy.llm.word_ids import drops_white_space, encoder, vocabulary_size
from colloquy.session import materialize, scratch_dir

#: A block is closed when it holds this many ids; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 18
#: Text bytes encoded at a time: the more, the fewer words are looked up twice.
ENCODED_TOGETHER = 8 << 20
#: Control bytes decoded at a time, so that the look-ups stay small.
DECODED_TOGETHER = 1 << 16
#: Shards whose totals one window row group sums.
SHARDS_TOGETHER = 1024

# By control byte: the bytes of each of its four numbers, and of all; where each of the
# sixteen bytes of the four numbers comes from, and whether it comes from anywhere.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)
TAKEN = LENGTHS.sum(1)
_begin = np.cumsum(LENGTHS, 1) - LENGTHS
SOURCE = (_begin[:, :, None] + np.arange(4)).reshape(256, 16)
PRESENT = (np.arange(4) < LENGTHS[:, :, None]).reshape(256, 16).astype(np.uint8)
SOURCE *= PRESENT


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers; the last four are filled up
    with zeros."""
    filled = np.zeros(-(-len(numbers) // 4) * 4, "<u4")
    filled[: len(numbers)] = numbers
    extra = (filled > 0xFF).astype(np.uint8) + (filled > 0xFFFF) + (filled > 0xFFFFFF)
    four = extra.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), filled.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    codes = np.frombuffer(control, np.uint8)
    given = np.frombuffer(data, np.uint8)
    taken = TAKEN[codes]
    starts = np.cumsum(taken) - taken
    out = np.empty((len(codes), 16), np.uint8)
    for lo in range(0, len(codes), DECODED_TOGETHER):
        part = codes[lo : lo + DECODED_TOGETHER]
        where = starts[lo : lo + DECODED_TOGETHER, None] + SOURCE[part]
        out[lo : lo + DECODED_TOGETHER] = given[where] * PRESENT[part]
    return out.view("<u4").reshape(-1)[:n]


def _map(df: DataFrame, run, schema: str) -> DataFrame:
    return df.mapInArrow(run, StructType.fromDDL(schema))


def encode(df: DataFrame, tokenizer_path: str, end_id: int,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, ids): the ids of each text with the end id, little-endian, of two bytes each if
    the vocabulary allows it, else of four."""
    if not drops_white_space(tokenizer_path):
        raise ValueError("token files need a tokenizers file that splits at white space and drops it")
    schema = f"key {df.schema[id_column].dataType.simpleString()}, ids binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.array([end_id], words.width).tobytes()
        for part in texts.slices(batches, "text", ENCODED_TOGETHER):
            ids, starts = words.ids(part.column("text"))
            raw, at = ids.tobytes(), (starts * words.width.itemsize).tolist()
            rows = [raw[a:b] + end for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").cast(arrow.field(0).type), pa.array(rows, pa.binary())], schema=arrow
            )

    return _map(df.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")), run, schema)


def id_ranks(encoded: DataFrame, width: str, size: int) -> DataFrame:
    """(rank, id, n) of every id that occurs: the most frequent first, ties by id. Each task
    gives its counts once, and there are no more rows than the vocabulary has."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column("ids")
            offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
            if len(column):
                raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                total += np.bincount(raw.view(width), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": found, "n": total[found]})

    counts = _map(encoded.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has ids, whatever the input: one partition ranks them.
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id", "n")


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
          id_column: str = "doc_id", text_column: str = "text") -> None:
    spark = df.sparkSession
    size = max(vocabulary_size(tokenizer_path), end_id + 1)
    encoded = materialize(encode(df, tokenizer_path, end_id, id_column, text_column), "token-ids")
    width = "<u2" if vocabulary_size(tokenizer_path) <= 1 << 16 else "<u4"
    id_ranks(encoded, width, size).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(size, np.uint32)
    for row in spark.read.parquet(f"{path}/ranks").select("rank", "id").collect():
        rank_of[row["id"]] = row["rank"]
    key = encoded.schema["key"].dataType.simpleString()
    schema = (
        f"shard int, block int, before bigint, n_tokens bigint, keys array<{key}>, lengths array<bigint>,"
        " control binary, data binary"
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block = before = n = 0
        keys, rows = [], []

        def close() -> pa.RecordBatch:
            control, data = pack_numbers(rank_of[np.frombuffer(b"".join(rows), width)])
            made = [shard, block, before, n, keys, [len(x) // int(width[2]) for x in rows], control, data]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(made, arrow)], schema=arrow
            )

        for batch in batches:
            for one, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                keys.append(one)
                rows.append(ids)
                n += len(ids) // int(width[2])
                if n >= BLOCK_TOKENS:
                    yield close()
                    block, before, n, keys, rows = block + 1, before + n, 0, [], []
        if rows:
            yield close()

    # The place, last, lets even rows that are all alike be dealt to several tasks.
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc(), F.col("place").asc()]
    dealt = (
        encoded.select("key", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ids")
    )
    _map(dealt, run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, first): ids in all shards before. Shards are summed in groups, then the
    groups; a shard is a task of the job that wrote it, so there are few groups."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn(
        "together", F.floor(F.col("shard") / SHARDS_TOGETHER)
    )
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("together").orderBy("shard").rowsBetween(*earlier)
    groups = totals.groupBy("together").agg(F.sum("n").alias("n")).select(
        "together", F.coalesce(F.sum("n").over(Window.orderBy("together").rowsBetween(*earlier)), F.lit(0)).alias("base")
    )
    return totals.join(groups, "together").select(
        F.col("shard").alias("of"), (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first")
    )


def read(spark: SparkSession, path: str, key_name: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document: its key, start, n_tokens, ids_crc32; ``with_ids`` also the ids, as
    little-endian unsigned 32-bit bytes."""
    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()
    id_of = np.zeros(max(len(ranks), 1), "<u4")
    for row in ranks:
        id_of[row["rank"]] = row["id"]
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"`{key_name}` {key}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    placed = blocks.join(_shard_starts(blocks), F.col("shard") == F.col("of")).select(
        (F.col("first") + F.col("before")).alias("start"), "n_tokens", "keys", "lengths", "control", "data"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name)[i] for name in batch.schema.names}
                ranked = unpack_numbers(one["control"].as_py(), one["data"].as_py(), one["n_tokens"].as_py())
                raw = memoryview(id_of[ranked].tobytes())
                lengths = one["lengths"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                cuts = [0, *(4 * ends).tolist()]
                made = [
                    one["keys"].values.cast(arrow.field(0).type), one["start"].as_py() + ends - lengths, lengths,
                    [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])],
                ]
                if with_ids:
                    made.append([bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow)], schema=arrow
                )

    return _map(placed, run, schema)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark, "token-files")
    write(texts.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)

"""JSON array files read by ranges: one array may be as large as a table.

Spark's text reader splits files at any separator; with a closing brace as the separator
it gives fragments of the array, range by range, through whatever file system it knows.
A range by itself doesn't say where elements start: it may begin in a string or deep inside
an element. So it is read in three steps:

1. Fragments are joined to chunks, written once. A chunk carries what its range did before
   it under both assumptions, that the range starts in a string or outside: quotes, depth,
   and commas by depth, all relative to the start of the range.
2. These compose. A prefix pass over one row per range gives each range its real start:
   in a string or not, the depth, and the number of the element.
3. Every chunk is cut at the commas of depth one. Elements inside a chunk are done; the
   pieces at its ends, two for a chunk, are joined by element.

An escape never spans two chunks, as no JSON escape holds a brace.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.operators.running import running_total
from colloquy.session import FREE_SHUFFLES, PACKED, materialize, passing_dir, settings

SEPARATOR = "}"
#: Bytes at which a chunk is closed.
CHUNK_BYTES = 4 << 20
#: Files are written in so many turns at most, as old and new files lie side by side during one.
TURNS = 8

_QUOTE, _OPEN, _CLOSE, _COMMA = 1, 2, 3, 4
_KINDS = np.zeros(256, np.int8)
for _signs, _kind in ((b'"', _QUOTE), (b"[{", _OPEN), (b"]}", _CLOSE), (b",", _COMMA)):
    _KINDS[list(_signs)] = _kind
_STEPS = np.array([0, 0, 1, -1, 0])
_escape = re.compile(rb"\\.", re.DOTALL)

_RANGE = ["file", "start"]
_BY_DEPTH = "map<int,bigint>"
_CHUNK = (
    "file string, start bigint, seq bigint, text string, quotes bigint, brackets bigint, other boolean, starts_as string,"
    f" odd boolean, depth0 bigint, depth1 bigint, commas0 {_BY_DEPTH}, commas1 {_BY_DEPTH},"
    f" odd_after boolean, depth0_after bigint, depth1_after bigint, commas0_after {_BY_DEPTH}, commas1_after {_BY_DEPTH}"
)


def marks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of the signs that structure JSON, escaped ones left out."""
    if b"\\" in raw:
        raw = _escape.sub(b"  ", raw)
    kinds = _KINDS[np.frombuffer(raw, np.uint8)]
    at = np.flatnonzero(kinds)
    return at, kinds[at]


def levels(kinds: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """(which marks stand outside of strings, the depth after each mark) from depth 0."""
    quote = kinds == _QUOTE
    live = ((np.cumsum(quote) + in_string) % 2 == 0) & ~quote
    return live, np.cumsum(_STEPS[kinds] * live)


class _Range:
    """What a range did so far, if it starts outside (0) or inside (1) of a string."""

    def __init__(self):
        self.odd = False
        self.depth = [0, 0]
        self.commas: list[dict[int, int]] = [{}, {}]

    def state(self) -> list:
        return [self.odd, *self.depth, *(sorted(c.items()) for c in self.commas)]

    def add(self, raw: bytes) -> int:
        _, kinds = marks(raw)
        quotes = int((kinds == _QUOTE).sum())
        for h in (0, 1):
            live, depth = levels(kinds, bool(h) != self.odd)
            for d, n in zip(*np.unique(depth[live & (kinds == _COMMA)] + self.depth[h], return_counts=True)):
                self.commas[h][int(d)] = self.commas[h].get(int(d), 0) + int(n)
            self.depth[h] += int(depth[-1]) if len(depth) else 0
        self.odd ^= bool(quotes % 2)
        return quotes


def _chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    fragments = spark.read.text(paths, lineSep=SEPARATOR, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    schema = T._parse_datatype_string(_CHUNK)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, size, so_far = None, 0, [], 0, None

        def close() -> pa.RecordBatch:
            raw = "".join(held).encode()
            before = so_far.state()
            quotes = so_far.add(raw)
            rest = raw.translate(None, b" \t\r\n")
            row = [*key, seq, raw.decode(), quotes, raw.count(b"["), bool(rest.strip(b"[]")), rest[:1].decode("latin-1"),
                   *before, *so_far.state()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                if (file, start) != key:
                    if held:
                        yield close()
                    key, seq, held, size, so_far = (file, start), 0, [], 0, _Range()
                    first = start == 0
                elif size >= CHUNK_BYTES:
                    yield close()
                    seq, held, size = seq + 1, [], 0
                # A fragment follows a brace unless the file begins with it.
                held.append(value if first else SEPARATOR + value)
                first = False
                size += len(value)
        if held:
            yield close()

    return fragments.mapInArrow(run, schema)


def _choose(inside: Column, outside_name: str, inside_name: str) -> Column:
    return F.when(inside, F.col(inside_name)).otherwise(F.col(outside_name))


def _at(by_depth: Column, depth: Column) -> Column:
    return F.coalesce(F.try_element_at(by_depth, depth.cast("int")), F.lit(0).cast("long"))


def _range_starts(chunks: DataFrame) -> DataFrame:
    """Per range: in_string, depth and element where it starts; one row per range."""
    last = chunks.groupBy(*_RANGE).agg(
        F.max_by(F.struct("odd_after", "depth0_after", "depth1_after", "commas0_after", "commas1_after"), "seq").alias("z"),
        F.sum("brackets").alias("brackets"), F.bool_or("other").alias("other"), F.min_by("starts_as", "seq").alias("starts_as"),
    ).select(*_RANGE, "z.*", "brackets", "other", "starts_as")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    inside = before(F.col("odd_after").cast("long")) % 2 == 1
    found = last.withColumn("in_string", inside)
    found = found.withColumn("by", _choose(F.col("in_string"), "depth0_after", "depth1_after")).withColumn("depth", before("by"))
    commas = _at(_choose(F.col("in_string"), "commas0_after", "commas1_after"), 1 - F.col("depth"))
    return found.withColumn("commas", commas).withColumn("element", before("commas"))


def _pieces(placed: DataFrame, whole: bool) -> DataFrame:
    """(file, pos, start, seq, text) of the elements inside chunks, or of the pieces at the
    ends of chunks. What stands outside of the array must be blank."""
    schema = T._parse_datatype_string("file string, pos bigint, start bigint, seq bigint, text string")
    arrow = to_arrow_schema(schema)
    names = ["file", "start", "seq", "text", "inside", "from_depth", "from_element"]

    def cut(file: str, raw: bytes, over: bool, inside: bool, depth: int, element: int) -> Iterator[tuple[int, bytes]]:
        at, kinds = marks(raw)
        live, after = levels(kinds, inside)
        after = after + depth
        bar = live & (
            ((kinds == _COMMA) & (after == 1)) | ((kinds == _OPEN) & (after == 1)) | ((kinds == _CLOSE) & (after == 0))
        )
        places, what = at[bar].tolist(), kinds[bar].tolist()
        in_array, lo, left = depth > 0, 0, False
        for place, kind in zip([*places, len(raw)], [*what, 0]):
            piece = raw[lo:place]
            if in_array:
                if (left and kind != 0) == whole:
                    yield element, piece
            elif piece.strip(b" \t\r\n") or (over and kind):
                raise ValueError(f"not a JSON list: {file}")
            element += kind == _COMMA
            in_array = in_array if not kind else kind != _CLOSE
            over |= kind == _CLOSE
            lo, left = place + 1, True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, start, seq, text, *state = (batch.column(n)[row].as_py() for n in names)
                # The array starts in a file's first chunk: later ones that lie outside come after it.
                over = state[1] == 0 and (start, seq) != (0, 0)
                found = list(cut(file, text.encode(), over, *state))
                n = len(found)
                made = [[file] * n, [x for x, _ in found], [start] * n, [seq] * n, [x.decode() for _, x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow)], schema=arrow)

    return placed.select(*names).mapInArrow(run, schema)


def read_elements(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """((file, pos, text) of every element of the array files under ``paths``, (file, n) of
    every file that is not empty). A file that is no JSON list fails the read."""
    with settings(spark, PACKED):
        chunks = materialize(_chunks(spark, paths), "array-chunks")
    ranges = materialize(_range_starts(chunks), "array-ranges")
    first, end = F.min_by("starts_as", "start"), F.sum("by")
    totals = ranges.groupBy("file").agg(
        F.sum("commas").alias("commas"), first.alias("first"), end.alias("end"), F.bool_or("other").alias("other"),
        F.sum("brackets").alias("brackets"), F.sum(F.col("odd_after").cast("long")).alias("quotes"),
    )
    good = (F.col("first") == "[") & (F.col("end") == 0) & (F.col("quotes") % 2 == 0)
    # Nothing but one pair of brackets.
    empty = ~F.col("other") & (F.col("brackets") == 1)
    files = totals.select(
        "file",
        F.when(~good, F.raise_error(F.concat(F.lit("not a JSON list: "), "file")).cast("long"))
        .when(empty, F.lit(0).cast("long")).otherwise(F.col("commas") + 1).alias("n"),
    )
    states = ranges.select(*_RANGE, "in_string", F.col("depth").alias("range_depth"), "element")
    inside = F.col("in_string")
    depth = F.col("range_depth") + _choose(inside, "depth0", "depth1")
    # A range is some hundred bytes here: the join needs no shuffle of the texts until there are very many.
    placed = chunks.join(states, _RANGE).select(
        "file", "start", "seq", "text", (inside != F.col("odd")).alias("inside"), depth.alias("from_depth"),
        (F.col("element") + _at(_choose(inside, "commas0", "commas1"), 1 - F.col("range_depth"))).alias("from_element"),
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "seq", "text")))
    # The pieces of one element, from as many chunks as it reaches over.
    joined = _pieces(placed, False).groupBy("file", "pos").agg(F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"))
    rows = _pieces(placed, True).select("file", "pos", "text").union(joined)
    blank = F.regexp_like("text", F.lit(r"^\s*$"))
    gap = F.raise_error(F.concat(F.lit("not a JSON list: "), "file")).cast("string")
    lone = files.where("n = 0").select(F.col("file").alias("bare"))
    kept = rows.join(lone, F.col("file") == F.col("bare"), "left_anti")
    return kept.select("file", "pos", F.when(blank, gap).otherwise(F.col("text")).alias("text")), files


def _file_of(starts: Column, key: Column) -> Column:
    """The ``shard`` of the last of ``starts``, sorted by ``key``, that is not after ``key``."""

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        return F.when(
            F.get(starts, mid)["key"] <= key, F.struct(mid.alias("lo"), at["hi"].alias("hi"))
        ).otherwise(F.struct(at["lo"].alias("lo"), mid.alias("hi")))

    whole = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts))).cast("int"))
    return F.get(starts, F.aggregate(rounds, whole, halve)["lo"])["shard"]


def write_arrays(
    rows: DataFrame, body: Column, path: str, folders: list[str], order: list[str], per_file: int = 65_536,
    slices: Iterable[DataFrame] = (),
) -> None:
    """JSON array files of ``body`` (JSON texts) under one folder per value of ``folders``, in
    ``order``; a folder has one file for every ``per_file`` rows. Folders that are written
    again are replaced, file by file. ``slices`` are the same rows in several frames, for rows
    that are joined: one is joined after the other, so less is on the way at once.

    Where files begin is told by the keys alone, so the texts are written once and dealt out
    once. Files are written in turns, all files of a folder in one of them: old and new ones lie
    side by side for the length of a turn."""
    spark = rows.sparkSession
    keyed = rows.groupBy(*folders, *order).agg(F.count("*").alias("_times"))
    placed = running_total(keyed, order, "_times", "_pos", folders)
    next_file = F.expr(f"(_pos + _times - 1) div {per_file}") > F.col("shard")
    # One row per file. Of its keys one at most has rows in the next file as well.
    files = materialize(
        placed.withColumn("shard", F.expr(f"_pos div {per_file}")).groupBy(*folders, "shard").agg(
            F.min(F.struct(*order)).alias("key"), F.sum("_times").alias("_n"),
            F.max(F.when(next_file, F.struct(*order, "_pos"))).alias("over"),
        ), "array-files",
    )
    n, n_over = files.agg(F.sum("_n"), F.count("over")).first()
    turns = max(1, min(TURNS, (n or 0) // per_file))
    starts = F.sort_array(F.collect_list(F.struct("key", "shard"))).alias("_starts")
    # One row per folder.
    before = F.sum("_n").over(Window.orderBy(*folders).rowsBetween(Window.unboundedPreceding, -1)) if folders else F.lit(0)
    listed = files.groupBy(*folders).agg(starts, F.sum("_n").alias("_n")).select(
        *[F.col(c).alias(f"_of_{c}") for c in folders], "_starts",
        F.floor(F.coalesce(before, F.lit(0)) * turns / F.lit(n or 1)).cast("int").alias("_turn"),
    )

    def of(known: DataFrame, names: list[str], how: str = "inner"):
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names]
        return (F.broadcast(known), same or None, how if same else "cross")

    def dealt(some: DataFrame) -> DataFrame:
        texts = some.select(*folders, *order, body.alias("_body"))
        file = _file_of(F.col("_starts"), F.struct(*order)).alias("_file")
        return texts.join(*of(listed, folders)).select(*texts.columns, file, "_turn")

    schema = dealt(rows).schema
    keys = [*folders, "shard"]
    in_file = Window.partitionBy(*keys).orderBy(*order)
    first, last = F.row_number().over(in_file) == 1, F.lead(F.lit(True)).over(in_file).isNull()
    with settings(spark, FREE_SHUFFLES | PACKED), passing_dir(spark, "array-rows") as held:
        for some in slices or [rows]:
            dealt(some).write.mode("append").partitionBy("_turn").parquet(held)
        kept = spark.read.schema(schema).parquet(held)
        if n_over:
            over = files.where("over IS NOT NULL").select(
                *[F.col(c).alias(f"_of_{c}") for c in folders], *[F.col(f"over.{c}").alias(f"_of_{c}") for c in order], "over._pos"
            )
            known = kept.join(*of(over, [*folders, *order], "left"))
            # Equal keys go by their texts.
            nth = F.row_number().over(Window.partitionBy(*folders, *order).orderBy("_body")) - 1
            split = known.where("_pos IS NOT NULL").withColumn("_nth", nth).withColumn("_file", F.expr(f"(_pos + _nth) div {per_file}"))
            kept = known.where("_pos IS NULL").select(*schema.names).unionByName(split.select(*schema.names))
        for turn in range(turns):
            lines = kept.where(F.col("_turn") == turn).withColumn("shard", F.lpad(F.col("_file").cast("string"), 12, "0")).select(
                *keys, *order, F.concat(F.when(first, "[").otherwise(","), "_body", F.when(last, "]").otherwise("")).alias("value")
            )
            (
                # The window has brought each file's rows into one task already.
                lines.sortWithinPartitions(*keys, *order).drop(*order)
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)
            )


def with_offsets(files: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``files`` with ``offset``, the elements of the files before in ``order`` (of the same
    ``within``)."""
    return running_total(files, order, "n", "offset", within or [])

"""Operator 10: repeated passages by a distributed difference-cover suffix array.

A byte goes if it lies in a ``length``-byte string that starts earlier too (smaller id,
or same text and earlier place). Suffixes are dealt to tasks by content: each string of
``length`` bytes belongs to its anchor, the least-hashed ``GRAM``-gram in it (leftmost of
equals), so equal strings always meet. Consecutive starts with one anchor are a run.

1. Runs are dealt by anchor. An anchor that occurs once cannot repeat. Of runs that are
   equal as a whole, all but the earliest are covered. Anchors with different runs leave
   the earliest of each kind open.
2. The bytes of open runs are dealt by anchor again and their suffixes sorted by the
   difference cover of three: sort the triples at the sampled places, recurse on their
   names, sort the remaining suffixes by byte and rank, merge. Neighbours with the same
   ``length``-byte prefix are equal strings; all but the earliest are covered.

Very large groups are sorted in parts, and the earliest strings of the parts are then
compared by their bytes. Work on text is per run or per slice, so a hot passage is at most
one row per slice of text and anchor. Null texts count as empty. Rows that repeat an id
with the same text are one document; rows without an id, or with one that stands for
different texts, are kept whole and compared with nothing. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import texts
from colloquy.llm.shingles import mix
from colloquy.session import materialize

LENGTH = 100
#: Bytes of an anchor; a power of two below the length.
GRAM = 32
#: Runs a block holds, about.
BLOCK_RUNS = 500_000
#: Open runs of one anchor that are sorted together, at most.
PART_RUNS = 20_000
#: Bytes whose suffixes are sorted at a time, about (and the largest part).
SORT_BYTES = 1_000_000
#: Starts of a text that are cut into runs at a time.
PIECE = 1 << 22

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def text_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of the runs of one text."""
    x = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, max(0, len(x) - length + 1), PIECE):
        anchors, lo, hi = _runs(x[at : at + PIECE + length - 1], length, gram)
        found.append((anchors, lo + at, hi + at))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def _runs(x: np.ndarray, length: int, gram: int):
    h = _BYTES[x]
    width, power = 1, _BASE
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
    h = mix(h)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & _PLACE).astype(np.int64)
    lo = np.flatnonzero(np.diff(place, prepend=-1))
    hi = np.append(lo[1:], len(place)) - 1
    return h[place[lo]], lo, hi


def run_blocks(df: DataFrame, blocks: int, length: int) -> DataFrame:
    """Runs packed by block of anchors; those that a slice shows to be covered go under
    negative blocks."""

    def make(batch: pa.RecordBatch) -> dict | None:
        anchors, kinds, doc, los, his = [], [], [], [], []
        ids = batch.column("id").to_numpy()
        for k, data in enumerate(texts.utf8(batch, "text")):
            a, lo, hi = text_runs(data, length)
            if not len(a):
                continue
            digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
            kinds.append(np.array([
                digest(view[i : j + length]) for i, j in zip(lo.tolist(), hi.tolist())
            ], np.uint64))
            anchors.append(a)
            los.append(lo)
            his.append(hi)
            doc.append(np.full(len(a), ids[k], np.int64))
        if not anchors:
            return None
        anchor, kind, doc, lo, hi = map(np.concatenate, (anchors, kinds, doc, los, his))
        # The extent is part of the kind: equal bytes, and as many starts.
        kind = mix(kind ^ (hi - lo).astype(np.uint64))
        order = np.lexsort((lo, doc, kind, anchor))
        anchor, kind, doc, lo, hi = (v[order] for v in (anchor, kind, doc, lo, hi))
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])
        block = np.where(
            first, (anchor % np.uint64(blocks)).astype(np.int64), -1 - doc % blocks
        )
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
        out: dict[str, list] = {k: [] for k in ("block", "anchor", "kind", "doc", "lo", "span")}
        small, span = (anchor >> np.uint64(32)).astype(np.uint32), (hi - lo).astype(np.uint16)
        where = lo.astype(np.int32) if lo.max() < 1 << 31 else lo
        wide = where.dtype.itemsize
        for i, j in zip(starts, [*starts[1:], len(order)]):
            rows = order[i:j]
            out["block"].append(int(block[rows[0]]))
            out["anchor"].append(small[rows].tobytes())
            out["kind"].append(kind[rows].tobytes())
            out["doc"].append(doc[rows].tobytes())
            out["lo"].append(where[rows].tobytes())
            out["span"].append(span[rows].tobytes())
        out["wide"] = [wide] * len(out["block"])
        return out

    return texts.map_slices(
        df, "text", make,
        "block bigint, anchor binary, kind binary, doc binary, lo binary, span binary, wide int",
    )


def sort_runs(packed: DataFrame, part_runs: int) -> DataFrame:
    """(doc, lo, hi, anchor, part): covered runs have no anchor; open ones have, and a
    part if the anchor's group is sorted in parts (else -1)."""

    def block_runs(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        doc, span = join("doc", np.int64), join("span", np.uint16).astype(np.int64)
        lo = np.concatenate([
            np.frombuffer(x, np.int32 if w == 4 else np.int64).astype(np.int64)
            for x, w in zip(table.column("lo").to_pylist(), table.column("wide").to_pylist())
        ])
        if block < 0:
            anchor, part = np.zeros(len(doc), np.int64), np.full(len(doc), -1)
            is_open = np.zeros(len(doc), bool)
        else:
            small, kind = join("anchor", np.uint32), join("kind", np.uint64)
            order = np.lexsort((lo, doc, kind, small))
            small, kind, doc, lo, span = (v[order] for v in (small, kind, doc, lo, span))
            new_anchor = np.ones(len(doc), bool)
            new_anchor[1:] = small[1:] != small[:-1]
            new_kind = new_anchor.copy()
            new_kind[1:] |= kind[1:] != kind[:-1]
            group = np.cumsum(new_anchor) - 1
            kinds = np.bincount(group, new_kind)[group].astype(np.int64)
            is_open = new_kind & (kinds > 1)
            keep = ~new_kind | is_open
            # The how-manieth open run of its anchor says the part.
            nth = np.cumsum(is_open) - 1
            start = np.maximum.accumulate(np.where(new_anchor, np.cumsum(is_open) - is_open, 0))
            part = np.where(kinds > part_runs, (nth - start) // part_runs, -1)[keep]
            anchor = (block * (1 << 32) + small.astype(np.int64))[keep]
            doc, lo, span, is_open = doc[keep], lo[keep], span[keep], is_open[keep]
        return pa.table({
            "doc": pa.array(doc, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(lo + span, pa.int64()),
            "anchor": pa.array(anchor, pa.int64(), mask=~is_open), "part": pa.array(part.astype(np.int64), pa.int64()),
        })

    return packed.groupBy("block").applyInArrow(
        block_runs, "doc bigint, lo bigint, hi bigint, anchor bigint, part bigint"
    )


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (values from 1 up) in order, by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    base = int(t.max()) + 1
    # With n % 3 == 1 the place n (a triple of zeros) ends the first half of the sample.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    places = np.concatenate([ones, twos])
    # Pairs are named first: keys of two names fit 63 bits at every size.
    pair = np.unique(t[:-1] * base + t[1:], return_inverse=True)[1]
    keys = pair[places] * base + np.append(t, 0)[places + 2]
    names = np.unique(keys, return_inverse=True)[1] + 1
    if names.max() == len(names):
        order = np.argsort(names)
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[places[order]] = np.arange(1, len(places) + 1)
    sampled = places[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    key_one = lambda i: t[i] * (n + 3) + rank[i + 1]
    rest = rest[np.argsort(key_one(rest), kind="stable")]
    in_one = sampled[sampled % 3 == 1]
    in_two = sampled[sampled % 3 == 2]
    key_two = lambda i: pair[i] * (n + 3) + rank[i + 2]
    at = (
        np.arange(len(rest)) + np.searchsorted(key_one(in_one), key_one(rest))
        + np.searchsorted(key_two(in_two), key_two(rest))
    )
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sampled
    return out


def repeated_starts(parts: list[bytes], docs: np.ndarray, los: np.ndarray, length: int):
    """Over segments of texts (each of a run): per start the segment, its offset, and
    whether the same string starts earlier in these segments."""
    sizes = np.array([len(p) for p in parts])
    x = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    order = suffix_array(x.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(x)) - begin[owner]
    starts = order[offset[order] + length <= sizes[owner[order]]]
    same = np.zeros(len(starts), bool)
    reach = np.arange(length)
    for i in range(1, len(starts), 20_000):
        j = min(len(starts), i + 20_000)
        strings = x[starts[i - 1 : j, None] + reach]
        same[i:j] = (strings[1:] == strings[:-1]).all(1)
    own = owner[starts]
    group = np.cumsum(~same) - 1
    by_age = np.lexsort((los[own] + offset[starts], docs[own], group))
    first = np.ones(len(starts), bool)
    first[1:] = group[by_age][1:] != group[by_age][:-1]
    covered = np.empty(len(starts), bool)
    covered[by_age] = ~first
    return own, offset[starts], covered


def sort_open(segments: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi, string) of open runs (anchor, part, doc, lo, bytes): covered starts as
    ranges, and the strings first in a part with their place and no ``hi``."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        parts = [r[4] for r in rows]
        docs, los = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        split = np.array([r[1] >= 0 for r in rows])
        own, offset, covered = repeated_starts(parts, docs, los, length)
        gone = np.flatnonzero(covered)
        gone = gone[np.lexsort((offset[gone], own[gone]))]
        o, f = own[gone], offset[gone]
        new = np.ones(len(gone), bool)
        new[1:] = (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(gone)) - 1 if len(gone) else begin
        doc, lo, hi = docs[o[begin]], los[o[begin]] + f[begin], los[o[begin]] + f[end]
        left = np.flatnonzero(~covered & split[own])
        strings = [parts[a][b : b + length] for a, b in zip(own[left].tolist(), offset[left].tolist())]
        return pa.RecordBatch.from_pydict({
            "doc": pa.array(np.concatenate([doc, docs[own[left]]]), pa.int64()),
            "lo": pa.array(np.concatenate([lo, los[own[left]] + offset[left]]), pa.int64()),
            "hi": pa.array([*hi.tolist(), *[None] * len(left)], pa.int64()),
            "string": pa.array([*[None] * len(doc), *strings], pa.binary()),
        })

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "doc", "lo", "bytes"))):
                if size > SORT_BYTES and row[:2] != last:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[:2]
        if held:
            yield work(held)

    return (
        segments.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
        .mapInArrow(run, "doc bigint, lo bigint, hi bigint, string binary")
    )


def covered_ranges(df: DataFrame, length: int = LENGTH, part_runs: int = PART_RUNS) -> DataFrame:
    """(doc, lo, hi): starts whose string starts earlier too. ``df``: id, text."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total * 2 // (length - GRAM + 1) // BLOCK_RUNS)
    runs = materialize(sort_runs(run_blocks(df, blocks, length), part_runs), "runs")
    opened = runs.where("anchor IS NOT NULL")

    def cut(batches):
        for batch in texts.slices(batches, "text"):
            data = texts.utf8(batch, "text")
            rows, lo, anchor, part, parts = [], [], [], [], []
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    rows.append(k)
                    lo.append(w["lo"])
                    anchor.append(w["anchor"])
                    part.append(w["part"])
                    parts.append(data[k][w["lo"] : w["hi"] + length])
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(anchor, pa.int64()), "part": pa.array(part, pa.int64()),
                "doc": batch.column("id").take(pa.array(rows, pa.int64())), "lo": pa.array(lo, pa.int64()),
                "bytes": pa.array(parts, pa.binary()),
            })

    wanted = materialize(
        opened.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("lo", "hi", "anchor", "part")).alias("wanted")),
        "open-runs",
    )
    segments = df.join(wanted.where(F.size("wanted") > 0), "id").mapInArrow(
        cut, "anchor bigint, part bigint, doc bigint, lo bigint, bytes binary"
    )
    with texts.bloom_join(df.sparkSession):
        found = materialize(sort_open(segments, length), "sorted")
    # Groups sorted in parts: one row per string and part is left to compare.
    left = found.where("hi IS NULL")
    least = left.groupBy("string").agg(F.min(F.struct("doc", "lo")).alias("least"))
    later = left.join(least, "string").where("struct(doc, lo) <> least").select("doc", "lo", F.col("lo").alias("hi"))
    return (
        runs.where("anchor IS NULL").select("doc", "lo", "hi")
        .union(found.where("hi IS NOT NULL").select("doc", "lo", "hi")).union(later)
    )


def spans(ranges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that start in ``ranges`` (lo, hi)."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    begin, end = ranges[:, 0], np.maximum.accumulate(ranges[:, 1] + length)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def _compared(given: DataFrame) -> DataFrame:
    """One row per id that stands for one text."""
    given = given.where("id IS NOT NULL")
    kinds = given.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("text")).alias("kinds"))
    repeated = materialize(kinds.where("n > 1"), "repeated-ids")
    if repeated.isEmpty():
        return given
    # Only repeated rows are brought together; texts are unbounded, so one is taken, not all.
    once = given.join(repeated.where("kinds = 1"), "id").groupBy("id").agg(F.first("text").alias("text"))
    return given.join(repeated.select("id"), "id", "left_anti").union(once)


def dedup_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   length: int = LENGTH, part_runs: int = PART_RUNS, with_text: bool = False,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; the kept text if asked for
    (without what is left of characters that were cut), and the columns of ``carry``."""
    given = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *carry)
    ranges = covered_ranges(_compared(given.select("id", "text")), length, part_runs)
    per_text = materialize(
        ranges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges"
    ).withColumnRenamed("doc", "id")

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for data, found in zip(texts.utf8(batch, "text"), batch.column("ranges")):
            kept, begin = data, ()
            if found.is_valid:
                v = found.values.flatten()
                begin, end = spans(np.stack([c.to_numpy(zero_copy_only=False) for c in v], 1), length)
                cuts = [0, *[x for pair in zip(begin.tolist(), end.tolist()) for x in pair], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(begin))
            out["kept"].append(kept)
        kept = out.pop("kept")
        out |= {id_column: batch.column("id"), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        out |= {c: batch.column(c) for c in carry}
        return out | ({"kept": [x.decode("utf-8", "ignore") for x in kept]} if with_text else {})

    return texts.map_slices(
        given.join(per_text, "id", "left"), "text", make,
        f"`{id_column}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry) + ", kept string" * with_text,
    )


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(texts.documents(spark, sf_dir))

"""Operator 4: n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row per different shingle set and a column per n-gram. Under
one order of the columns (frequent ones last), two sets with a Jaccard similarity of t
share a column among the first ``n - ceil(t n) + 1`` of each, so only these entries are
kept. They are cut into blocks of columns; a task sorts its block and drops columns with
one entry. The product is then taken in three steps:

1. ties: every set has the smallest hash in each of ``MINIMA`` parts of its shingles, and
   meets one set with the same one. Most similar sets share most of these, also
   where all their columns are shared with other texts, so large groups of near copies
   are tied together by a few pairs a set.
2. star: every entry meets the smallest set of its column, and every set some more that
   share a smallest hash; sizes that cannot reach t and sets already connected are
   discarded. That is linear in the entries.
3. rest: overlap counts are accumulated over all columns for pairs whose sets are still
   in different components, and pairs below the bound that their sizes give are
   discarded.

Pairs are verified by signatures first, on whole sets where these leave it open. Steps 2 and 3
know how many shingles of a set come from a column on. The first column that two
similar sets share leaves enough on both sides to reach t, so other columns make no pair.

A pair left out by step 3 is connected already, so components are exact. Equal sets are
one row of the matrix. Shingles are hashes (64 bits for the matrix, 48 where pairs are verified); a collision can
only matter for pairs at the very threshold. Columns that are frequent in a bounded sample of sets are dealt by
set instead of by column, so that none is one task's load.

Null texts and texts without words have an empty set and link with nothing; repeated rows
get one component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import texts
from colloquy.llm.components import components
from colloquy.llm.texts import bloom_join
from colloquy.llm.shingles import shingle_set
from colloquy.session import materialize

#: Entries of the matrix that a block of columns holds, about.
BLOCK_ENTRIES = 400_000
#: Sets whose columns are counted to find frequent ones, and how many of these are known.
SAMPLE_SETS = 6_000
FREQUENT_COLUMNS = 100_000
#: Parts of a set's shingles whose smallest hash it is tied by (a power of two).
MINIMA = 8
#: Sets of such a part that the others meet once the first have connected what they can.
MORE_HUBS = 16


def _prefix(n, num: int, den: int):
    """n - ceil(num/den n) + 1 for arrays or ints."""
    return n - (-(-num * n // den)) + 1


def set_profiles(df: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """(id, digest, n_shingles, cls, bits, minima): cls is equal for equal sets, null for empty
    ones; ``digest`` is the text's ``xxhash64``; signature and minima depend on the set only."""

    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(x, n) for x in texts.utf8(batch, text_column)]
        cls = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None for s in sets]
        return {
            "id": batch.column("id"), "digest": batch.column("digest"), "n_shingles": [len(s) for s in sets],
            "cls": [x if x is None or x < 1 << 63 else x - (1 << 64) for x in cls],
            "bits": [signature(s) if len(s) else None for s in sets], "minima": [minima(s) for s in sets],
        }

    return texts.map_slices(
        df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("digest"), text_column),
        text_column, make, "id bigint, digest bigint, n_shingles bigint, cls bigint, bits binary, minima array<bigint>",
    )


def frequent_columns(df: DataFrame, classes: DataFrame, n: int, id_column: str, text_column: str) -> np.ndarray:
    """Columns of two or more sampled sets, at most ``FREQUENT_COLUMNS``, rarest first."""
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_SETS).select(F.col("id").alias(id_column))

    def make(batch: pa.RecordBatch) -> dict | None:
        cols, counts = np.unique(
            np.concatenate([shingle_set(x, n) for x in texts.utf8(batch, text_column)]), return_counts=True
        )
        return {"col": cols.view(np.int64), "n": counts}

    counted = texts.map_slices(
        df.join(F.broadcast(sample), id_column, "left_semi").select(text_column), text_column, make, "col bigint, n bigint"
    )
    top = (
        counted.groupBy("col").agg(F.sum("n").alias("n")).where("n > 1")
        .orderBy(F.desc("n"), "col").limit(FREQUENT_COLUMNS).collect()
    )
    return np.array([r.col for r in reversed(top)], np.int64).view(np.uint64)


def incidence(df: DataFrame, frequent: np.ndarray, blocks: int, n: int, num: int, den: int,
              text_column: str) -> DataFrame:
    """(col, cls, size, ahead) of the prefix entries, columns with one entry dropped.

    ``ahead``: at least as many as the set's shingles from this column on, itself included
    (places are kept in 256 steps of the prefix, rounded down).
    """
    rank = np.argsort(frequent)
    ordered = frequent[rank]

    def entries(batch: pa.RecordBatch) -> dict | None:
        block, col, doc, step, classes, sizes = [], [], [], [], [], []
        seen = set()
        for data in texts.utf8(batch, text_column):
            s = shingle_set(data, n)
            if not len(s):
                continue
            cls = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))
            if cls in seen:
                continue
            seen.add(cls)
            p = _prefix(len(s), num, den)
            place = np.full(len(s), -1)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                place = np.where(ordered[at] == s, rank[at], -1)
            first = np.argsort(place, kind="stable")[:p]
            t, place = s[first], place[first]
            common = place >= 0
            block.append(np.where(common, -1 - cls % blocks, (t % np.uint64(blocks)).astype(np.int64)))
            col.append(np.where(common, place.astype(np.uint64), t >> np.uint64(32)).astype(np.uint32))
            doc.append(np.full(p, len(classes), np.int32))
            step.append((np.arange(p) * 256 // p).astype(np.uint8))
            classes.append(cls)
            sizes.append(len(s))
        if not classes:
            return None
        block, col, doc, step = map(np.concatenate, (block, col, doc, step))
        order = np.lexsort((doc, block))
        block, col, doc, step = block[order], col[order], doc[order], step[order]
        cls, size = np.array(classes, np.int64), np.array(sizes, np.int32)
        starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        out: dict[str, list] = {k: [] for k in ("block", "cols", "steps", "cls", "sizes", "counts")}
        for lo, hi in zip(starts, [*starts[1:], len(block)]):
            mine, counts = np.unique(doc[lo:hi], return_counts=True)
            out["block"].append(int(block[lo]))
            out["cols"].append(col[lo:hi].tobytes())
            out["steps"].append(step[lo:hi].tobytes())
            out["cls"].append(cls[mine].tobytes())
            out["sizes"].append(size[mine].tobytes())
            out["counts"].append(counts.astype(np.int32).tobytes())
        return out

    packed = texts.map_slices(
        df.select(text_column), text_column, entries,
        "block bigint, cols binary, steps binary, cls binary, sizes binary, counts binary",
    )

    def shared(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        cols, step, counts = join("cols", np.uint32), join("steps", np.uint8), join("counts", np.int32)
        cls, size = np.repeat(join("cls", np.int64), counts), np.repeat(join("sizes", np.int32), counts)
        order = np.lexsort((cls, cols))
        cols, cls, size, step = cols[order], cls[order], size[order].astype(np.int64), step[order].astype(np.int64)
        new_col = np.diff(cols.astype(np.int64), prepend=-1) != 0
        keep = new_col | (np.diff(cls, prepend=cls[0] - 1 if cls[0] > -(1 << 63) else 0) != 0)
        cols, cls, size, step = cols[keep], cls[keep], size[keep], step[keep]
        if block >= 0:
            _, at, n_entries = np.unique(cols, return_inverse=True, return_counts=True)
            many = n_entries[at] > 1
            cols, cls, size, step = cols[many], cls[many], size[many], step[many]
            col = block * (1 << 32) + cols.astype(np.int64)
        else:
            col = -1 - cols.astype(np.int64)
        ahead = size + (-step * _prefix(size, num, den)) // 256
        return pa.table({"col": pa.array(col, pa.int64()), "cls": pa.array(cls, pa.int64()),
                         "size": pa.array(size, pa.int64()), "ahead": pa.array(ahead, pa.int64())})

    return packed.groupBy("block").applyInArrow(shared, "col bigint, cls bigint, size bigint, ahead bigint")


def short_members(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes; sets of millions still collide in none or few."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def members_of(data) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(short), 8), np.uint8)
    whole[:, 2:] = short
    return whole.view("<u8").ravel()


def compatible(a: str, b: str, num: int, den: int):
    """Whether sets of these sizes can be similar enough."""
    return (F.least(a, b) * den >= F.greatest(a, b) * num)


def reachable(ahead, size_a: str, size_b: str, num: int, den: int):
    """Whether an overlap of ``ahead`` makes sets of these sizes similar enough."""
    return ahead * (num + den) >= (F.col(size_a) + F.col(size_b)) * num


def signature(s: np.ndarray) -> bytes:
    """Parities of how many members fall on each of about ``len(s)`` places (a power of two).

    Two of them differ in at most as many places as the sets differ in members."""
    places = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest member of each part; parts are told by the lowest bits, so keys of
    different parts are different."""
    return s[np.unique(s & np.uint64(MINIMA - 1), return_index=True)[1]].view(np.int64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Places in which two signatures differ; the longer one is folded."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def set_table(pairs: DataFrame, df: DataFrame, classes: DataFrame, n: int, id_column: str, text_column: str,
              known: DataFrame | None = None) -> DataFrame:
    """(cls, members) of the sets in ``pairs``; those in ``known`` come from there."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    if known is not None:
        needed = needed.join(known.select("cls"), "cls", "left_anti")
    ids = materialize(
        needed.join(classes, "cls").select(F.col("id").alias("rep"), "cls", "n_shingles"), "needed"
    )

    def sets(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(x, n) for x in texts.utf8(batch, text_column)]
        # A repeated id may stand for other texts as well.
        own = [
            (c, s) for c, s in zip(batch.column("cls").to_pylist(), found)
            if xxhash.xxh3_64_intdigest(s.tobytes()) == c % (1 << 64)
        ]
        return {"cls": [c for c, _ in own], "members": [short_members(s) for _, s in own]}

    whole = df.select(F.col(id_column).cast("long").alias("rep"), text_column).join(
        ids.where("n_shingles > 0"), "rep"
    )
    with bloom_join(df.sparkSession):
        made = materialize(texts.map_slices(
            whole.select("cls", text_column), text_column, sets, "cls bigint, members binary"
        ), "sets")
    return made if known is None else known.union(made)


def with_sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of both sets."""
    for x in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs


def chosen(batch: pa.RecordBatch, keep: list) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays(
        [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
    )


def close_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that can be similar enough by their signatures, which bound the
    overlap from above and are a fiftieth of the sets."""

    def possible(batches):
        for batch in batches:
            keep = []
            sizes = zip(batch.column("n_shingles_a").to_pylist(), batch.column("n_shingles_b").to_pylist())
            for both, x, y in zip(sizes, batch.column("bits_a"), batch.column("bits_b")):
                d = differing(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                keep.append((sum(both) - d) // 2 * (num + den) >= num * sum(both))
            yield chosen(batch, keep)

    both = with_sides(pairs, classes, "n_shingles", "bits")
    return materialize(both.mapInArrow(possible, "a bigint, b bigint"), "close")


def similar_pairs(close: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``close`` (a, b) whose whole sets are similar enough."""

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b")):
                x, y = members_of(x.as_buffer()), members_of(y.as_buffer())
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter = int((y[at] == x).sum())
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield chosen(batch, keep)

    return materialize(with_sides(close, sets, "members").mapInArrow(similar, "a bigint, b bigint"), "similar")


def ties(classes: DataFrame, num: int, den: int, orders: Iterable[int], known: DataFrame | None = None) -> DataFrame:
    """(a, b): every set with the first one, in each of ``orders``, that shares one of its minima
    and is of another component."""
    own = classes.select("cls", F.col("n_shingles").alias("size"), F.explode("minima").alias("least"))
    if known is not None:
        own = own.join(known.withColumnRenamed("id", "cls"), "cls", "left")
    keyed = own.withColumn("component", F.col("cls") if known is None else F.coalesce("component", "cls"))
    mixed = keyed.groupBy("least").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    # Most minima are of one set: they are left out before anything is kept by order.
    shared = materialize(keyed.join(mixed.select("least"), "least", "left_semi"), "minima")
    firsts = [F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("at"), "cls", "size", "component")) for k in orders]
    hubs = shared.groupBy("least").agg(F.array(*firsts).alias("hubs"))
    return (
        shared.join(hubs, "least").select("cls", "size", "component", F.explode("hubs").alias("hub"))
        .where("component <> hub.component").where(compatible("size", "hub.size", num, den))
        .select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")).distinct()
    )


def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of different components."""
    of = lambda x: known.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    return (
        pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")
    )


def similar_components(df: DataFrame, n: int = 5, num: int = 75, den: int = 100,
                       id_column: str = "doc_id", text_column: str = "text", with_digest: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id; ``with_digest`` also the text's
    ``xxhash64``, which tells rows apart that repeat an id."""
    profiles = materialize(set_profiles(df, n, id_column, text_column), "profiles")
    classes = materialize(
        profiles.where("cls IS NOT NULL").groupBy("cls").agg(
            F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"),
            F.first("minima").alias("minima")),
        "classes",
    )
    entries = profiles.agg(F.sum((F.col("n_shingles") * (den - num) / den) + 1)).first()[0] or 0
    blocks = 1 + int(entries // BLOCK_ENTRIES)
    frequent = frequent_columns(df, classes, n, id_column, text_column)
    inc = materialize(incidence(df, frequent, blocks, n, num, den, text_column), "incidence")

    source = (df, classes, n, id_column, text_column)
    close = close_pairs(ties(classes, num, den, [0]), classes, num, den)
    sets = set_table(close, *source)
    links = similar_pairs(close, sets, num, den)
    known = components(links)

    hubs = inc.groupBy("col").agg(F.min(F.struct("cls", "size", "ahead")).alias("hub"))
    star = materialize(
        inc.join(hubs, "col").where("cls <> hub.cls").where(compatible("size", "hub.size", num, den))
        .where(reachable(F.least("ahead", "hub.ahead"), "size", "hub.size", num, den))
        .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct(), "star",
    )
    again = apart(star, known).union(ties(classes, num, den, range(1, 1 + MORE_HUBS), known)).distinct()
    close = close_pairs(again, classes, num, den)
    sets = set_table(close, *source, known=sets)
    links = links.union(similar_pairs(close, sets, num, den))
    known = components(links)

    labelled = inc.join(known.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    mixed = labelled.groupBy("col").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_entries = materialize(labelled.join(mixed.select("col"), "col", "left_semi"), "open")
    side = lambda x: open_entries.select(
        "col", F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col("ahead").alias(f"ahead_{x}"),
        F.col("component").alias(f"component_{x}"))
    # The shared columns that leave enough are the first ones; what two sets share is
    # these, and at most what comes after the last of them.
    rest = (
        side("a").join(side("b"), "col").where("a < b AND component_a <> component_b")
        .where(compatible("size_a", "size_b", num, den))
        .where(reachable(F.least("ahead_a", "ahead_b"), "size_a", "size_b", num, den))
        .groupBy("a", "b").agg(
            F.count("*").alias("shared"), F.min(F.least("ahead_a", "ahead_b")).alias("ahead"),
            F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
        .where(reachable(F.col("shared") - 1 + F.col("ahead"), "size_a", "size_b", num, den))
        .select("a", "b").join(star, ["a", "b"], "left_anti")
    )
    rest = materialize(rest, "rest")
    close = close_pairs(rest, classes, num, den)
    more = similar_pairs(close, set_table(close, *source, known=sets), num, den)

    # Components over sets, named by the smallest document of any of their sets.
    whole = components(links.union(more)).withColumnRenamed("id", "cls")
    named = classes.join(whole, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = named.join(least, "component").select("cls", "component_id")
    return profiles.join(of_class, "cls", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        *(["digest"] if with_digest else []),
    )


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_components(texts.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, CAST(len(w) AS BIGINT) - 4))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * overlap >= 75 * (na.n + nb.n - overlap)
), r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
  SELECT a, min(b) AS least FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = doc_id
"""

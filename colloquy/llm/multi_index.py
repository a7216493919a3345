"""Operator 2: near copies among vectors by an inverted multi-index.

Vectors are scaled to length one and split in two halves, each half with a codebook of
its own (k-means on a bounded sample). The pairs of codewords are the cells of the
product grid, and every vector is indexed in its cell. A vector visits cells in the
multi-sequence order, by growing sum of its half distances, as many as a calibration says
are needed for the target recall: sampled queries are compared with all vectors, and if
that gives too few pairs to tell the recall, also with made-up partners at the threshold.
What a vector meets in its cells is verified by cosine in double precision.

Equal vectors are one class with a count, so copies are never paired. Cells are cut
into chunks, and visitors go to each chunk, so a hot cell is many tasks. Null, zero and
non-finite vectors link with nothing; vectors of different length are not compared. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.components import components
from colloquy.llm import texts
from colloquy.session import materialize

_log = logging.getLogger(__name__)

#: Vectors the codebooks are fitted on and queries are drawn from, at most.
SAMPLE_ROWS = 12_000
#: Queries of that sample which are compared with all vectors.
CALIBRATION_QUERIES = 2_000
#: Cells of a calibration's order; a pair that needs more makes every cell visited.
MOST_CELLS = 64
TARGET_RECALL = 0.999
#: Cells always visited, if there are as many.
LEAST_CELLS = 4
#: Vectors of a cell that one task holds against its visitors.
CHUNK_ROWS = 2_000
LARGEST_CODEBOOK = 256
#: Added to the threshold's safe side in the matrix product; verified exactly after.
SLACK = 1e-9


def unit_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, key, dim, unit): key tells equal vectors apart; null where it cannot link."""

    def make(batches):
        for batch in batches:
            keys, dims, units = [], [], []
            for x in batch.column("vector").to_pylist():
                v = None if x is None or None in x else np.array(x, np.float64) + 0.0
                norm = 0.0 if v is None or not np.isfinite(v).all() else float(np.linalg.norm(v))
                if norm > 0 and not np.isfinite(norm) or norm == 0 and v is not None and len(v) and np.isfinite(v).all():
                    scale = np.abs(v).max()
                    v = v / scale if scale > 0 else v
                    norm = float(np.linalg.norm(v))
                ok = norm > 0
                keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if ok else None)
                dims.append(len(v) if ok else None)
                units.append((v / norm).tobytes() if ok else None)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "key": pa.array(keys, pa.binary()),
                "dim": pa.array(dims, pa.int32()), "unit": pa.array(units, pa.binary()),
            })

    return df.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).mapInArrow(make, "id bigint, key binary, dim int, unit binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids from evenly drawn rows; an empty one takes the farthest row."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = half_distances(x, centers)
        own = d.argmin(1)
        for c in range(k):
            mine = x[own == c]
            centers[c] = mine.mean(0) if len(mine) else x[d.min(1).argmax()]
    return centers


def half_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def nearest_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Per row its ``most`` cells by growing sum of half distances (the multi-sequence).

    The first ``most`` sums only need the first ``most // (i + 1)`` words of the second
    half beside the i-th of the first, so the frontier stays short.
    """
    h = x.shape[1] // 2
    first, second = half_distances(x[:, :h], books[0]), half_distances(x[:, h:], books[1])
    k1, k2 = len(books[0]), len(books[1])
    order1, order2 = first.argsort(1, kind="stable"), second.argsort(1, kind="stable")
    near1, near2 = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
    frontier = [(i, j) for i in range(min(k1, most)) for j in range(min(k2, most // (i + 1)))]
    at = np.array(frontier)
    sums = near1[:, at[:, 0]] + near2[:, at[:, 1]]
    pick = sums.argsort(1, kind="stable")[:, :most]
    return (
        np.take_along_axis(order1, at[:, 0][pick], 1).astype(np.int64) * k2
        + np.take_along_axis(order2, at[:, 1][pick], 1)
    )


def pair_ranks(queries: np.ndarray, x: np.ndarray, same, books, threshold: float, order=None) -> np.ndarray:
    """For the pairs of a query and a row of ``x`` at the threshold or above, the cells to
    visit before they meet, less one. ``same(q, r)`` tells which are a vector and itself."""
    most = min(len(books[0]) * len(books[1]), MOST_CELLS)
    order = nearest_cells(queries, books, most) if order is None else order
    ranks = [np.array([], int)]
    for lo in range(0, len(x), 1024):
        mine, other = np.nonzero(queries @ x[lo : lo + 1024].T >= threshold)
        keep = ~same(mine, lo + other)
        mine, other = mine[keep], other[keep]
        if len(mine):
            rows, at = np.unique(other, return_inverse=True)
            near = nearest_cells(x[lo + rows], books, most)
            ranks += [meeting_ranks(order[mine[i : i + 65_536]], near[at[i : i + 65_536]]) for i in range(0, len(mine), 65_536)]
    return np.concatenate(ranks)


def meeting_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair of cell orders: the place where one first has the other's own cell."""
    there = [np.where(m.any(1), m.argmax(1), m.shape[1]) for m in (a == b[:, :1], b == a[:, :1])]
    return np.minimum(*there)


def drawn_queries(x: np.ndarray) -> np.ndarray:
    return np.arange(len(x))[:: max(1, -(-len(x) // CALIBRATION_QUERIES))]


def made_up_ranks(queries: np.ndarray, books, threshold: float) -> np.ndarray:
    """As ``pair_ranks``, of queries and partners in random directions at the threshold."""
    if queries.shape[1] < 2 or not -1 < threshold < 1:
        return np.array([], int)
    most = min(len(books[0]) * len(books[1]), MOST_CELLS)
    away = np.random.default_rng(0).standard_normal(queries.shape)
    away -= (away * queries).sum(1)[:, None] * queries
    away /= np.linalg.norm(away, axis=1)[:, None]
    partners = threshold * queries + (1 - threshold * threshold) ** 0.5 * away
    return meeting_ranks(nearest_cells(queries, books, most), nearest_cells(partners, books, most))


def cells_for(counts: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Cells of ``k`` to visit for ``recall`` of the pairs, of which ``counts`` has how many
    meet at each rank, and the recall then."""
    upto = np.cumsum(counts)
    if not len(upto) or not upto[-1]:
        return min(k, LEAST_CELLS), float("nan")
    most = min(k, MOST_CELLS)
    need = int(np.searchsorted(upto, np.ceil(recall * upto[-1]))) + 1
    need = min(k, max(LEAST_CELLS, need if need <= most else k))
    return need, 1.0 if need == k else float(upto[min(need, len(upto)) - 1] / upto[-1])


def cells_needed(x: np.ndarray, books, threshold: float, recall: float) -> tuple[int, float]:
    """Cells to visit for ``recall`` of the pairs of drawn queries with rows of ``x``, and
    the recall then."""
    drawn = drawn_queries(x)
    ranks = pair_ranks(x[drawn], x, lambda q, r: drawn[q] == r, books, threshold)
    return cells_for(np.bincount(ranks), len(books[0]) * len(books[1]), recall)


def calibrated_cells(distinct: DataFrame, ids: np.ndarray, x: np.ndarray, books, threshold: float,
                     recall: float) -> tuple[int, float, int]:
    """Cells to visit, the recall then, and the number of pairs it was measured on: those of
    drawn queries with all vectors of ``distinct``."""
    k = len(books[0]) * len(books[1])
    drawn = drawn_queries(x)
    queries, names = x[drawn], ids[drawn]
    order = nearest_cells(queries, books, min(k, MOST_CELLS))

    def compare(batches):
        for batch in batches:
            own = batch.column("id").to_numpy(zero_copy_only=False)
            v = np.array([np.frombuffer(u) for u in batch.column("unit").to_pylist()])
            ranks = pair_ranks(queries, v, lambda q, r: names[q] == own[r], books, threshold, order)
            at, n = np.unique(ranks, return_counts=True)
            yield pa.RecordBatch.from_pydict({"rank": pa.array(at, pa.int32()), "n": pa.array(n, pa.int64())})

    rows = distinct.select("id", "unit").mapInArrow(compare, "rank int, n bigint").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(MOST_CELLS + 1, np.int64)
    for r in rows:
        counts[r.rank] = r.n
    visits, reached = cells_for(counts, k, recall)
    pairs = int(counts.sum())
    # A recall is told by some pairs beyond it.
    if pairs * (1 - recall) < 1:
        visits = max(visits, cells_for(np.bincount(made_up_ranks(queries, books, threshold)), k, recall)[0])
        reached = 1.0 if visits == k else float(counts[:visits].sum() / pairs) if pairs else reached
    return visits, reached, pairs


def near_pairs(distinct: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b) ids of linked vectors of one length; ``distinct`` has id and unit."""
    spark = distinct.sparkSession
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("id", "unit").collect()
    x = np.array([np.frombuffer(r.unit) for r in sample])
    k = int(min(LARGEST_CODEBOOK, max(1, (total / 64) ** 0.5), len(x)))
    h = dim // 2
    books = (kmeans(x[:, :h], k) if h else np.zeros((1, 0)), kmeans(x[:, h:], k))
    ids = np.array([r.id for r in sample], np.int64)
    visits, reached, measured = calibrated_cells(distinct, ids, x, books, threshold, TARGET_RECALL)
    _log.info("%d of %d cells visited: recall %.5f on %d pairs", visits, len(books[0]) * len(books[1]), reached, measured)

    def cells(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array([np.frombuffer(u) for u in batch.column("unit").to_pylist()])
            for lo in range(0, len(v), 1024):
                part = batch.slice(lo, 1024)
                near = nearest_cells(v[lo : lo + 1024], books, visits)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "unit": part.column("unit"),
                    "cells": pa.array(list(near), pa.list_(pa.int64())),
                })

    placed = materialize(distinct.select("id", "unit").mapInArrow(cells, "id bigint, unit binary, cells array<bigint>"), "cells")
    # At most as many rows as cells: LARGEST_CODEBOOK squared.
    chunks = placed.groupBy(F.col("cells")[0].alias("cell")).agg(
        F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")
    )
    homes = placed.select(F.col("cells")[0].alias("cell"), "id", "unit").join(F.broadcast(chunks), "cell").select(
        "cell", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.lit(True).alias("home"), "id", "unit"
    )
    visitors = (
        placed.select(F.explode("cells").alias("cell"), "id", "unit").join(F.broadcast(chunks), "cell")
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                F.lit(False).alias("home"), "id", "unit")
    )

    def meet(batches):
        import itertools

        # Sorted by cell, chunk and residents first: residents are held, visitors stream by.
        held_key, held_ids, held = None, [], []
        matrix = None

        def rows():
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("cell", "chunk", "home", "id", "unit")]
                yield from zip(*cols)

        for key, group in itertools.groupby(rows(), key=lambda r: (r[0], r[1])):
            held_ids, held, matrix = [], [], None
            while block := list(itertools.islice(group, 2048)):
                for r in block:
                    if r[2]:
                        held_ids.append(r[3])
                        held.append(np.frombuffer(r[4]))
                guests = [r for r in block if not r[2]]
                if not guests or not held_ids:
                    continue
                if matrix is None or len(matrix) != len(held):
                    matrix, ids = np.array(held), np.array(held_ids, np.int64)
                g = np.array([np.frombuffer(r[4]) for r in guests])
                gid = np.array([r[3] for r in guests], np.int64)
                for lo in range(0, len(g), 512):
                    at, other = np.nonzero(g[lo : lo + 512] @ matrix.T >= threshold - SLACK)
                    a, b = gid[lo + at], ids[other]
                    exact = np.einsum("ij,ij->i", g[lo + at], matrix[other]) >= threshold
                    keep = (a != b) & exact
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return (
        homes.union(visitors).repartition("cell", "chunk")
        .sortWithinPartitions("cell", "chunk", F.desc("home"))
        .mapInArrow(meet, "a bigint, b bigint").distinct()
    )


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_column: str = "vec_id",
                    vector_column: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = df.sparkSession
    vectors = materialize(unit_vectors(df, id_column, vector_column), "vectors")
    classes = materialize(
        vectors.where("key IS NOT NULL").groupBy("key", "dim").agg(
            F.min("id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit")
        ), "classes",
    )
    pairs = spark.createDataFrame([], "a bigint, b bigint")
    for row in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect():
        pairs = pairs.union(near_pairs(classes.where(F.col("dim") == row.dim), row.dim, threshold))
    pairs = materialize(pairs, "pairs")
    both = pairs.union(pairs.select("b", "a"))
    sizes = classes.select(F.col("id").alias("b"), "n")
    links = both.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    found = components(pairs).withColumnRenamed("id", "class")
    known = (
        classes.select("key", F.col("id").alias("class"), "n").join(links, "class", "left").join(found, "class", "left")
        .select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component", "class").alias("component"))
    )
    component = F.coalesce("component", "id")
    return vectors.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
  SELECT a, min(b) AS least FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN r ON r.a = vec_id
"""

"""Exact top-k cosine join of a query table with a corpus table.

``score = dot / (|m| * |q| + 1e-9)`` in double precision, rounded to 12 digits so
that the last bits of a sum do not order scores that are equal; best first, equal
scores by record id and key. Every physical form gives the same rows:

* ``broadcast_corpus``: a corpus under the size bound goes to every task; the
  queries are mapped without a shuffle.
* ``broadcast_queries``: queries under the bound go to every task; the corpus is
  read once and each task keeps its own best k per query.
* ``blocked``: neither side fits; a tree of balls over the records rules out what a
  query need not see (``ball_index``).

No form emits the pairs: a task multiplies a block of queries with a block of
records and gives out at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.operators import ball_index
from colloquy.operators.vectors import (
    banned_pairs, best_in_block, matrix_of, norms_of, order_of, ranks_within,
)

DEFAULT_TOP_K = 2
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 8_192
_PROBE_ROWS = 4_096


# --- the join ---------------------------------------------------------------


def topk_cosine(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | None = None,
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    record_id: str = "id",
    record_key: str | None = None,
    record_vector: str = "embedding",
    exclude: str | None = None,
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """(``query_id``, ``rank``, ``record_id``, ``score``), ``k`` rows per query or
    as many as the corpus has.

    ``exclude`` names a column of the queries with an array of record ids that
    may not answer that query. Query ids must be unique. So must record ids, unless
    ``record_key`` names a column that tells records of one id apart: it orders them,
    each is a hit of its own, and hits carry it, to be joined with. An excluded id
    excludes all its records. ``pivots`` is for the blocked form, the root of the number
    of records where it is None. ``k`` of 0 or None means the default.
    """
    k = k or DEFAULT_TOP_K
    q = queries.select(
        F.col(query_id).alias("qid"),
        F.col(query_vector).alias("qvec"),
        *([F.coalesce(F.col(exclude), F.array()).alias("excl")] if exclude else []),
    ).filter(F.col("qvec").isNotNull())
    c = corpus.select(
        F.col(record_id).alias("id"),
        (F.col(record_key) if record_key else F.lit(0)).alias("key"),
        F.col(record_vector).alias("vec"),
    ).filter(F.col("vec").isNotNull())

    found = None
    if strategy in ("auto", "broadcast_corpus"):
        records = _small_table(c, "vec", broadcast_bytes)
        if records is not None:
            found = _map_queries(q, records, k, exclude is not None, c)
    if found is None and strategy in ("auto", "broadcast_queries"):
        held = _small_table(q, "qvec", broadcast_bytes)
        if held is not None:
            found = _map_corpus(c, held, k, exclude is not None, q)
    if found is None:
        if strategy not in ("auto", "blocked"):
            raise ValueError(f"{strategy}: the side to broadcast exceeds {broadcast_bytes} bytes")
        found = ball_index.topk(q, c, k, exclude is not None, block_rows, pivots)
    return found.select(
        F.col("qid").alias(query_id),
        "rank",
        F.col("id").alias("record_id"),
        *([F.col("key").alias(record_key)] if record_key else []),
        "score",
    )


def _small_table(df: DataFrame, vector: str, max_bytes: int) -> pa.Table | None:
    """``df`` on the driver if it takes at most ``max_bytes``: its vectors in double
    precision, its texts and lists.

    As many rows are taken as fit by the width of the first vector, but at most some
    thousands; that settles small tables in one job. A larger one is added up before it
    is fetched.
    """
    first = df.select(F.size(vector).alias("n")).head()
    width = 8 * max(1, first["n"] if first else 1)
    probe = min(_PROBE_ROWS, max_bytes // width)
    others = [f for f in df.schema if f.name != vector]
    size = F.lit(width)
    for f in others:
        col = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            each = F.aggregate(col, F.lit(0).cast("long"), lambda n, x: n + _bytes_of(x, f.dataType.elementType))
            size = size + F.coalesce(each, F.lit(0))
        else:
            size = size + _bytes_of(col, f.dataType)
    narrow = df.select(*[f.name for f in others], size.cast("long").alias("_bytes"))
    if any(isinstance(f.dataType, (T.ArrayType, T.StringType)) for f in others):
        # Texts and lists can be of any size: added up first.
        if (narrow.agg(F.sum("_bytes").alias("n")).head()["n"] or 0) > max_bytes:
            return None
    head = df.take(probe + 1)
    if len(head) <= probe:
        schema = to_arrow_schema(df.schema)
        columns = [pa.array([r[f.name] for r in head], f.type) for f in schema]
        return pa.Table.from_arrays(columns, schema=schema)
    if probe < _PROBE_ROWS or df.count() * width > max_bytes:
        return None
    return df.toArrow()


def _bytes_of(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def _result_schema(q: DataFrame, c: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", q.schema["qid"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("id", c.schema["id"].dataType),
            T.StructField("key", c.schema["key"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _rows(q_ids: pa.Array, qi, rank, ids: pa.Array, keys: pa.Array, mi, score) -> pa.RecordBatch:
    def plain(a):
        return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a

    return pa.RecordBatch.from_arrays(
        [
            plain(q_ids.take(pa.array(qi))),
            pa.array(rank, pa.int32()),
            plain(ids.take(pa.array(mi))),
            plain(keys.take(pa.array(mi))),
            pa.array(score, pa.float64()),
        ],
        names=["qid", "rank", "id", "key", "score"],
    )


def _map_queries(q, records: pa.Table, k, has_exclude, c) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(records)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        ids = table.column("id").combine_chunks()
        keys = table.column("key").combine_chunks()
        m = matrix_of(table.column("vec"))
        m_norm, m_order = norms_of(m), order_of(ids.to_pylist(), keys.to_pylist())
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vectors = matrix_of(batch.column("qvec"))
            banned = (
                banned_pairs(batch.column("excl").to_pylist(), ids.to_pylist())
                if has_exclude
                else None
            )
            qi, mi, s = best_in_block(
                vectors, norms_of(vectors), m, m_norm, m_order, k, banned
            )
            yield _rows(batch.column("qid"), qi, ranks_within(qi), ids, keys, mi, s)

    return q.mapInArrow(answer, _result_schema(q, c))


def _map_corpus(c, held: pa.Table, k, has_exclude, q) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        q_ids = table.column("qid").combine_chunks()
        vectors = matrix_of(table.column("qvec"))
        norms = norms_of(vectors)
        excluded = table.column("excl").to_pylist() if has_exclude else None
        best = None  # (query row, score, id, key), k per query
        for batch in batches:
            if not batch.num_rows or not len(q_ids):
                continue
            ids, keys = batch.column("id"), batch.column("key")
            m = matrix_of(batch.column("vec"))
            id_list = ids.to_pylist()
            qi, mi, s = best_in_block(
                vectors,
                norms,
                m,
                norms_of(m),
                order_of(id_list, keys.to_pylist()),
                k,
                banned_pairs(excluded, id_list) if has_exclude else None,
            )
            new_ids, new_keys = ids.take(pa.array(mi)), keys.take(pa.array(mi))
            if best is not None:
                qi = np.concatenate([best[0], qi])
                s = np.concatenate([best[1], s])
                new_ids = pa.concat_arrays([best[2], new_ids])
                new_keys = pa.concat_arrays([best[3], new_keys])
                order = np.lexsort((order_of(new_ids.to_pylist(), new_keys.to_pylist()), -s, qi))
                order = order[ranks_within(qi[order]) <= k]
                qi, s = qi[order], s[order]
                new_ids, new_keys = new_ids.take(pa.array(order)), new_keys.take(pa.array(order))
            best = (qi, s, new_ids, new_keys)
        if best is not None and len(best[0]):
            qi, s, ids, keys = best
            yield _rows(q_ids, qi, ranks_within(qi), ids, keys, np.arange(len(ids)), s)

    # The corpus keeps its partitions: a coalesce would draw its scan and embedding into
    # few tasks. Each task gives out k rows per query.
    local = c.mapInArrow(scan, _result_schema(q, c))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "key")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

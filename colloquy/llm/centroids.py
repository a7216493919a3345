"""Operator 11: centroid clustering over scalar look-up tables, in whole numbers.

Every component x becomes the integer floor(1024 * x). Vectors are kept in blocks of a
bounded number of rows, written once: per dimension the different integers that occur in
the block, and a small code per row. A round then tabulates the squared difference of every
occurring integer of every dimension to every centroid, and a distance is the sum of
64 gathered table cells; no product of a vector and a centroid is worked out. Tables have
at most as many lines as a block has components, so memory is bounded whatever the values.
Per round each task gives one sum and count per centroid (and dimension), which are added
before and after the shuffle; only centroids, k times 64 numbers, reach the driver. All
arithmetic is exact, so neither the order of rows nor a lost executor changes a result.

Kept are vectors with exactly 64 components, none null or non-finite; others give no row.
Repeated rows are vectors of their own. First centroids with the same digest (equal ids)
are ordered by their components; with fewer vectors than centroids each vector is one. A
null id has the digest of an empty one. So that squared distances stay within a long,
integers beyond 2**27 in size count as 2**27 with their sign; an inertia beyond a long is
the greatest long. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colloquy.session import materialize

DIM = 64
SCALE = 1024
LARGEST = 1 << 27
#: Vectors per block.
BLOCK_ROWS = 8192


def integers(vector: Column) -> Column:
    """Components as clipped integers; null unless there are 64, all finite."""
    good = (F.size(vector) == DIM) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    return F.when(good, F.transform(vector, lambda x: whole_number(x)))


def whole_number(x: Column) -> Column:
    # Clipped before it is scaled, where the product could leave the range of a long.
    bound = float(LARGEST // SCALE)
    clipped = F.greatest(F.least(x.cast("double"), F.lit(bound)), F.lit(-bound))
    return F.floor(F.lit(float(SCALE)) * clipped)


def blocks(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows of (ids, begins, values, codes): dimension d of the block has the integers
    ``values[begins[d]:begins[d + 1]]``, and ``codes`` says, dimension by dimension, which of
    all values each row has."""
    key = df.schema[id_column].dataType.simpleString()
    schema = f"ids array<{key}>, begins array<int>, values array<bigint>, codes binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                rows = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
                values, codes, begins = [], np.empty((DIM, len(rows)), "<u4"), [0]
                for d in range(DIM):
                    found, code = np.unique(rows[:, d], return_inverse=True)
                    codes[d] = code + begins[-1]
                    values.append(found)
                    begins.append(begins[-1] + len(found))
                made = [part.column("key").to_pylist(), begins, np.concatenate(values), codes.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow)], schema=arrow)

    given = df.select(F.col(id_column).alias("key"), integers(F.col(vector_column)).alias("v"))
    return given.where("v is not null").mapInArrow(run, StructType.fromDDL(schema))


def nearest(begins: np.ndarray, values: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of every row's nearest centroid; ties: the smaller number."""
    # Line of the table: an occurring integer of one dimension; cell: a centroid.
    dimension = np.repeat(np.arange(DIM), np.diff(begins))
    table = (values[:, None] - centroids.T[dimension]) ** 2
    total = table[codes[0]]
    for d in range(1, DIM):
        total += table[codes[d]]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        begins, values = (batch.column(c)[i].values.to_numpy() for c in ("begins", "values"))
        yield batch.column("ids")[i].values, begins, values, np.frombuffer(batch.column("codes")[i].as_buffer(), "<u4").reshape(DIM, -1)


def _sums(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total, n): sums of the vectors nearest to each centroid."""
    k = len(centroids)

    def run(batches):
        # Python integers where a task's sum might leave a long: block sums can't.
        sums, counts = np.zeros((k, DIM), object), np.zeros(k, np.int64)
        for batch in batches:
            for _, begins, values, codes in _decoded(batch):
                best, _ = nearest(begins, values, codes, centroids)
                counts += np.bincount(best, minlength=k)
                for c in range(k):
                    sums[c] += values[codes[:, best == c]].sum(1)
        cluster, dim = (x.ravel() for x in np.mgrid[:k, :DIM])
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(cluster, pa.int32()), "dim": pa.array(dim, pa.int32()),
            "total": pa.array([str(x) for x in sums.ravel()]), "n": np.repeat(counts, DIM),
        })

    partial = stored.select("ids", "begins", "values", "codes").mapInArrow(run, "cluster int, dim int, total string, n bigint")
    return partial.groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )


def first_centroids(df: DataFrame, k: int, seed: int, id_column: str, vector_column: str) -> np.ndarray:
    """The k kept vectors with the smallest digests of ``<seed>:<id>``."""
    v = integers(F.col(vector_column))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    rows = df.select(digest.alias("digest"), v.alias("v")).where("v is not null").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIM)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3,
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per kept vector: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    stored = materialize(blocks(df, id_column, vector_column), "vector-blocks")
    centroids = first_centroids(df, k, seed, id_column, vector_column)
    key = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {key}, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame(
            [], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(stored, centroids).where("n > 0").collect():
            moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break  # A fixed point: further rounds change nothing.
        centroids = moved
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def assign(batches):
        for batch in batches:
            for ids, begins, values, codes in _decoded(batch):
                best, distance = nearest(begins, values, codes, centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(arrow.field(0).type), pa.array(best, pa.int32()), pa.array(distance)], schema=arrow
                )

    assigned = materialize(stored.mapInArrow(assign, StructType.fromDDL(schema)), "clusters")
    most = (1 << 63) - 1
    # One row per centroid.
    inertia = {
        r["cluster"]: int(r["s"])
        for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    }
    whole = min(sum(inertia.values()), most)
    facts = [
        (c, min(s, most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in inertia.items()
    ]
    told = spark.createDataFrame(facts, "of int, cluster_inertia bigint, centroid_sha256 string")
    # ``told`` has at most k rows.
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col("of")).select(
        f"`{id_column}`", "cluster", "distance", "cluster_inertia", F.lit(whole).alias("inertia"), "centroid_sha256"
    )


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same in SQL, round by round; components as rows (n, d, x)."""
    bound = LARGEST // SCALE
    steps = [f"""kept AS MATERIALIZED (
      SELECT row_number() OVER () AS n, vec_id,
             list_transform(embedding, lambda x: floor({SCALE} * greatest(least(x::DOUBLE, {bound}), -{bound}))::BIGINT) AS v
      FROM embeddings
      WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
    cells AS MATERIALIZED (SELECT n, unnest(range(1, {DIM + 1})) AS d, unnest(v) AS x FROM kept),
    c0 AS MATERIALIZED (
      SELECT c, unnest(range(1, {DIM + 1})) AS d, unnest(v) AS y FROM (
        SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept)
      WHERE c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
      SELECT n, arg_min(c, (s, c)) AS c, min(s) AS s FROM (
        SELECT n, c, sum((x - y) * (x - y))::BIGINT AS s FROM cells JOIN c{i} USING (d) GROUP BY n, c) GROUP BY n)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
      SELECT c, d, coalesce(((s - ((s % m) + m) % m) // m)::BIGINT, y) AS y FROM c{i} LEFT JOIN (
        SELECT c, d, sum(x) AS s, count(*) AS m FROM a{i} JOIN cells USING (n) GROUP BY c, d) USING (c, d))""")
    return f"""WITH {", ".join(steps)},
    told AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INT AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
           (sum(s) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN kept USING (n) JOIN told USING (c)"""


ORACLE = _oracle()

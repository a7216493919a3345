"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b longs): the smallest id reachable.

    Rounds go on until the links are stars around the smallest ids. Each writes its
    links to the shared scratch folder. Minima are combined before the shuffle, and the
    joins are plain equi-joins that adaptive execution may split at hot ids.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), "links",
    )
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        state, last = _state(edges), state
        if state == last:
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest around u."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, F.col("u") == F.col("k"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    tied = edges.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("k", "m")).where("u <> v").distinct()

"""Running totals over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from colloquy.session import materialize


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all earlier rows of the same ``within``.

    Rows are dealt by ranges of their order; each range sums its own, and the totals of the
    ranges before are added. Those are one row for a range and key."""
    keys = list(within)
    ranged = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    earlier = (Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(*earlier)
    parts = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_n"))
    # One row per range: there are no more than tasks.
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*earlier)
    before = parts.select(
        *[F.col(c).alias(f"_of_{c}") for c in (*keys, "_part")], F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_part")]
    summed = ranged.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return summed.join(before, same).select(
        *df.columns, (F.col("_before") + F.col("_here")).cast("long").alias(out)
    )

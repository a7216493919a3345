"""What a retrieval found, with the contents of the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.session import materialize

PART_HITS = 50_000


def with_records(
    hits: DataFrame, corpus: DataFrame, columns: Sequence[str], *, record_key: str = "index", part_hits: int = PART_HITS
) -> DataFrame:
    """``hits`` with ``columns`` of their records; a hit on no record goes.

    Hits and records meet by ``record_key`` where the hits carry it (``topk_cosine`` passes it
    on), so that records of one id stay apart, and else by ``record_id``, which must then be
    unique. A record that very many queries found (an empty question scores 0 with all
    and takes the smallest ids) is repeated once for every ``part_hits`` of its hits. Hits are
    written first, as a second pass would retrieve anew.
    """
    by_key = record_key in hits.columns
    key = record_key if by_key else "record_id"
    records = corpus.select(F.col(record_key if by_key else "id").alias(key), *columns)
    found = materialize(hits, "hits")
    popular = (
        found.groupBy(key).agg(F.ceil(F.count("*") / part_hits).cast("long").alias("_parts")).where("_parts > 1")
    )
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = found.join(popular, key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*[c for c in found.columns if c != key]), parts)
    )
    repeated = records.join(popular, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    )
    return dealt.drop("_parts").join(repeated.drop("_parts"), [key, "_part"]).select(*hits.columns, *columns)

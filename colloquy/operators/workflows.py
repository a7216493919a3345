"""Workflows: small graphs written as text, and their node-by-node alignment.

Text form: a line ``<number>: <label>`` per node and pairs ``(a,b)`` for the
edges, with START and END as ends. A workflow is one text in one row, so all of
this works inside the row and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.arrays import once

# The text form and its sentinels.
NODE_PATTERN = r"(?m)^[ \t]*(\d+)[ \t]*:[ \t]*(\S.*)$"
EDGE_PATTERN = r"\(\s*(START|\d+)\s*,\s*(END|\d+)\s*\)"
START, END = "START", "END"


def node_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NODE_PATTERN), F.lit(1))


def node_labels(text: Column) -> Column:
    """Labels as listed, without surrounding blanks, START and END left out."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(NODE_PATTERN), F.lit(2)), lambda x: F.trim(x)
    )


def _unpadded(number: Column) -> Column:
    """Without leading zeros. Few numbers have any, and a search takes long beside a look."""
    return F.when(number.startswith("0"), F.regexp_replace(number, r"^0+(?=\d)", "")).otherwise(number)


def parse_nodes(text: Column) -> Column:
    """Real nodes in the order listed: ``array<struct<no:string,label:string>>``.

    Leading zeros are dropped from numbers; sentinels are not real nodes.
    """
    zipped = F.arrays_zip(
        node_numbers(text).alias("no"), node_labels(text).alias("label")
    )
    named = F.transform(
        zipped,
        lambda n: F.struct(
            _unpadded(n["no"]).alias("no"),
            n["label"].alias("label"),
        ),
    )
    return F.filter(named, lambda n: ~n["label"].isin(START, END))


def parse_edges(text: Column) -> Column:
    """Edges in the order listed: ``array<struct<src:string,dst:string>>``."""

    def end(group: int) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(EDGE_PATTERN), F.lit(group)), _unpadded
        )

    return F.transform(
        F.arrays_zip(end(1).alias("src"), end(2).alias("dst")),
        lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst")),
    )


def with_graph(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Parsed ``<prefix>_nodes`` and ``<prefix>_edges``; null text has neither."""
    text = F.coalesce(text_col, F.lit(""))
    return df.withColumn(f"{prefix}_nodes", parse_nodes(text)).withColumn(
        f"{prefix}_edges", parse_edges(text)
    )


# The outer forms of explode: for the inner one the optimizer adds a test of the
# array's size and pushes it below, which computes the array twice.


def explode_nodes(df: DataFrame, keys: Sequence[str], nodes: str) -> DataFrame:
    """One row per node with its 1-based place in the list."""
    rows = df.select(*keys, F.posexplode_outer(nodes).alias("pos", "n"))
    return rows.filter(F.col("pos").isNotNull()).select(
        *keys,
        (F.col("pos") + 1).alias("pos"),
        F.col("n.no").cast("long").alias("no"),
        F.col("n.label").alias("label"),
    )


def explode_edges(df: DataFrame, keys: Sequence[str], nodes: str, edges: str) -> DataFrame:
    """One row per edge, with flags for self-loops and unknown ends."""
    known = F.concat(
        F.transform(F.col(nodes), lambda n: n["no"]), F.array(F.lit(START), F.lit(END))
    )
    rows = df.select(*keys, known.alias("_known"), F.posexplode_outer(edges).alias("pos", "e"))
    return rows.filter(F.col("pos").isNotNull()).select(
        *keys,
        (F.col("pos") + 1).alias("pos"),
        F.col("e.src").alias("src"),
        F.col("e.dst").alias("dst"),
        (F.col("e.src") == F.col("e.dst")).alias("is_self_loop"),
        (
            F.array_contains("_known", F.col("e.src"))
            & F.array_contains("_known", F.col("e.dst"))
        ).alias("ends_known"),
    )


def _occurrences(labels: Column) -> Column:
    """Per label ``<occurrence>:<label>``: the n-th with that label, found as its distance
    from the first such one in label order."""

    def entry(label: Column, i: Column) -> Column:
        return F.struct(label.alias("label"), (i + 1).alias("pos"))

    def keys(entries: Column, ordered: Column) -> Column:
        def key(label: Column, i: Column) -> Column:
            nth = F.array_position(entries, entry(label, i)) - F.array_position(ordered, label) + 1
            return F.concat_ws(":", nth.cast("string"), label)

        return F.transform(labels, key)

    return once(
        F.sort_array(F.transform(labels, entry)),
        lambda entries: once(
            F.transform(entries, lambda e: e["label"]),
            lambda ordered: keys(entries, ordered),
        ),
    )


def match_by_label(
    df: DataFrame, gold: str = "gold", pred: str = "pred", out: str = "matched"
) -> DataFrame:
    """For each predicted node the place of its gold node, 0 where there is none.

    Nodes match one to one by label (letter case aside) and occurrence: the n-th
    ``mix`` of one side is the n-th ``mix`` of the other. Occurrences are numbered only
    where a side repeats a label.
    """

    def lowered(side: str) -> Column:
        return F.transform(f"{side}_nodes", lambda n: F.lower(n["label"]))

    def places(gold_keys: Column, pred_keys: Column) -> Column:
        # No key is twice in a list. Many are at the same place in both.
        return F.transform(
            pred_keys,
            lambda key, i: F.when(F.get(gold_keys, i) == key, i + 1).otherwise(
                F.array_position(gold_keys, key).cast("int")
            ),
        )

    def different(labels: Column) -> Column:
        return F.size(F.array_distinct(labels)) == F.size(labels)

    def matched(g: Column, p: Column) -> Column:
        numbered = once(_occurrences(g), lambda keys: once(_occurrences(p), lambda own: places(keys, own)))
        return F.when(different(g) & different(p), places(g, p)).otherwise(numbered)

    return df.withColumn(out, once(lowered(gold), lambda g: once(lowered(pred), lambda p: matched(g, p))))


def explode_matches(df: DataFrame, keys: Sequence[str], matched: str = "matched") -> DataFrame:
    return (
        df.select(*keys, F.posexplode_outer(matched).alias("pos", "gold_pos"))
        .filter(F.col("gold_pos") > 0)
        .select(*keys, (F.col("pos") + 1).alias("pred_pos"), "gold_pos")
    )

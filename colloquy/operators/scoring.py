"""Scores of aligned workflows.

* chain: the longest run of matched nodes that both list in the same order;
* any-order chain: the same against every order the gold edges allow;
* edges: shared edges between matched nodes;
* graph: the largest set of matched nodes between which both sides have exactly
  the same edges.

Precision divides by the predicted, recall by the gold count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import graphs
from colloquy.functions.arrays import once
from colloquy.operators.workflows import END, START


def lis_length(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence.

    ``tails[i]`` is the smallest last value of such a run of length i + 1; each
    value replaces the first tail not below it.
    """

    def put(tails: Column, x: Column) -> Column:
        below = F.filter(tails, lambda t: t < x)
        return once(
            below,
            lambda head: F.concat(
                head,
                F.array(x),
                F.slice(tails, F.size(head) + 2, F.greatest(F.size(tails), F.lit(1))),
            ),
        )

    return F.size(F.aggregate(values, F.array().cast("array<int>"), put))


def with_status(df: DataFrame) -> DataFrame:
    """``unparseable`` when either side has no real node, else ``evaluated``."""
    return df.withColumn(
        "status",
        F.when(
            (F.size("pred_nodes") == 0) | (F.size("gold_nodes") == 0), "unparseable"
        ).otherwise("evaluated"),
    )


def prf(hits: Column, n_pred: Column, n_gold: Column) -> list[Column]:
    p, r = F.try_divide(hits, n_pred), F.try_divide(hits, n_gold)
    f1 = F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1_score")]


def _scored(df: DataFrame, hits: Column, n_pred: Column, n_gold: Column) -> DataFrame:
    """Adds precision, recall and f1, null where the example was skipped.
    Null ``hits`` of an evaluated example is a solver that gave up."""
    ran = df.withColumn("_hits", hits).withColumn(
        "status",
        F.when(
            (F.col("status") == "evaluated") & F.col("_hits").isNull(), "runtime"
        ).otherwise(F.col("status")),
    )
    live = F.when(F.col("status") == "evaluated", F.col("_hits").cast("double"))
    p, r, f1 = prf(live, n_pred, n_gold)
    ok = F.col("status") == "evaluated"
    return ran.select(
        *[c for c in df.columns if c != "status"],
        "status",
        F.when(ok, F.coalesce(p, F.lit(0.0))).alias("precision"),
        F.when(ok, F.coalesce(r, F.lit(0.0))).alias("recall"),
        F.when(ok, F.coalesce(f1, F.lit(0.0))).alias("f1_score"),
    )


def chain_score(df: DataFrame, order: str = "listed", matched: str = "matched") -> DataFrame:
    """Node score of ``with_status`` rows. ``order="any"`` allows every order the
    gold edges allow; a gold graph with a cycle is then a ``runtime`` skip."""
    sizes = F.size("pred_nodes"), F.size("gold_nodes")
    if order == "listed":
        hits = lis_length(F.filter(matched, lambda g: g > 0))
        return _scored(df, hits, *sizes)
    if order != "any":
        raise ValueError(f"unknown order {order!r}")

    @F.pandas_udf("int")
    def longest(
        n: pd.Series, matched: pd.Series, m: pd.Series, edges: pd.Series
    ) -> pd.Series:
        return pd.Series(
            [
                graphs.longest_consistent(
                    [int(g) for g in places if g > 0], [(e["a"], e["b"]) for e in es]
                )
                if size
                else 0
                for size, places, es in zip(n, matched, edges)
            ],
            dtype="Int32",
        )

    # Given along with their sizes, the arrays are used twice and so stay columns
    # of their own below the function; put into the call as whole expressions,
    # their nested lambdas would keep Spark from planning the call. The result is
    # not to be copied into every expression using it, hence non-deterministic.
    rows = df.withColumn("_edges", _places(F.col("gold_nodes"), F.col("gold_edges")))
    hits = longest.asNondeterministic()(
        F.size(matched), F.col(matched), F.size("_edges"), F.col("_edges")
    )
    return _scored(rows, hits, *sizes).drop("_edges")


def _with_positions(nodes: Column, then: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``then(position)``, where ``position(number)`` is the place (1-based) of the first node
    of that number, 0 for none. Nodes that are numbered 1, 2, ... as listed need no search."""

    def searched(known: Column) -> Column:
        def position(number: Column) -> Column:
            # Whatever is no number would cost an exception to cast.
            told = F.get(known["places"], F.when(number < ":", number.try_cast("int")))
            return F.when(known["counted"], F.coalesce(told, F.lit(0).cast("long"))).otherwise(
                F.array_position(known["numbers"], number)
            )

        return then(position)

    def known(numbers: Column) -> Column:
        counted = numbers == F.transform(numbers, lambda _, i: (i + 1).cast("string"))
        places = F.sequence(F.lit(0).cast("long"), F.size(numbers).cast("long"))
        return F.struct(numbers.alias("numbers"), counted.alias("counted"), places.alias("places"))

    return once(F.transform(nodes, lambda n: n["no"]), lambda numbers: once(known(numbers), searched))


def _places(nodes: Column, edges: Column) -> Column:
    """Edges between real nodes as places (1-based) in the node list."""
    pairs = _with_positions(
        nodes,
        lambda position: F.transform(
            edges,
            lambda e: F.struct(
                position(e["src"]).cast("int").alias("a"), position(e["dst"]).cast("int").alias("b")
            ),
        ),
    )
    return F.array_distinct(F.filter(pairs, lambda p: (p["a"] > 0) & (p["b"] > 0)))


def with_levels(df: DataFrame, side: str = "gold") -> DataFrame:
    """``<side>_cyclic`` and ``<side>_levels``: for each node the most edges of a path that
    ends there, null for all nodes of a graph with a cycle (a self-loop is one).

    Edges are peeled off in rounds inside the row: a round drops those whose start no edge
    reaches any more; a node's level is the number of rounds in which an edge reached it. No
    round is left to do after as many as there are nodes, unless there is a cycle. Later
    rounds of a shallow graph have no edges to look at.
    """
    nodes, edges = F.col(f"{side}_nodes"), f"_{side}_places"

    def peel(state: Column, _: Column) -> Column:
        ends = F.transform(state["edges"], lambda e: e["b"])
        return once(
            F.array_distinct(ends),
            lambda reached: F.struct(
                F.filter(state["edges"], lambda e: F.array_contains(reached, e["a"])).alias("edges"),
                F.concat(state["seen"], reached).alias("seen"),
            ),
        )

    start = F.struct(F.col(edges).alias("edges"), F.array().cast("array<int>").alias("seen"))
    rounds = F.when(F.size(nodes) > 0, F.sequence(F.lit(1), F.size(nodes))).otherwise(
        F.array().cast("array<int>")
    )
    def outcome(state: Column) -> Column:
        def level(n: Column, i: Column) -> Column:
            rounds_reached = F.size(F.filter(state["seen"], lambda b: b == i + 1))
            return F.when(F.size(state["edges"]) == 0, rounds_reached)

        return F.struct(
            (F.size(state["edges"]) > 0).alias("cyclic"), F.transform(nodes, level).alias("levels")
        )

    placed = df.withColumn(edges, _places(nodes, F.col(f"{side}_edges")))
    peeled = once(rounds, lambda r: once(F.aggregate(r, start, peel), outcome))
    return (
        placed.withColumn("_peeled", peeled)
        .withColumn(f"{side}_cyclic", F.col("_peeled.cyclic"))
        .withColumn(f"{side}_levels", F.col("_peeled.levels"))
        .drop(edges, "_peeled")
    )


def _named_edges(nodes: Column, edges: Column, names: Column) -> Column:
    """Edges as ``a>b`` between sentinels and ``names``, which gives each node's
    name by its place; edges with an unmatched or unknown end drop out."""

    def named(numbers: Column, known: Column) -> Column:
        def end(x: Column) -> Column:
            place = F.array_position(numbers, x)
            return (
                F.when(x.isin(START, END), x)
                .when(place > 0, F.get(known, (place - 1).cast("int")))
                .otherwise(F.lit("0"))
            )

        ends = F.transform(
            edges, lambda e: F.struct(end(e["src"]).alias("a"), end(e["dst"]).alias("b"))
        )
        kept = F.filter(ends, lambda e: (e["a"] != "0") & (e["b"] != "0"))
        return F.transform(kept, lambda e: F.concat_ws(">", e["a"], e["b"]))

    return F.array_distinct(
        once(
            F.transform(nodes, lambda n: n["no"]),
            lambda numbers: once(names, lambda known: named(numbers, known)),
        )
    )


def edge_overlap(df: DataFrame, matched: str = "matched") -> DataFrame:
    """Precision and recall of the edges, START and END edges included."""
    own_places = F.transform("gold_nodes", lambda n, i: (i + 1).cast("string"))
    gold_places = F.transform(matched, lambda g: g.cast("string"))
    gold = _named_edges(F.col("gold_nodes"), F.col("gold_edges"), own_places)
    pred = _named_edges(F.col("pred_nodes"), F.col("pred_edges"), gold_places)
    both = F.size(F.array_intersect(gold, pred))
    return _scored(
        df.withColumn("n_shared_edges", both),
        F.col("n_shared_edges"),
        F.size(F.array_distinct("pred_edges")),
        F.size(F.array_distinct("gold_edges")),
    )


#: A pair of places is one number, the first place in its high half.
_PAIR = 1 << 32


def _conflicts(matched: str) -> Column:
    """Pairs of matched gold places (``a * _PAIR + b``) with an edge on one side only."""

    def coded(nodes: str, edges: str, place: Callable[[Column], Column]) -> Column:
        """Edges as pairs of ``place(position in the node list)``, those without a place left out."""
        pairs = _with_positions(
            F.col(nodes),
            lambda position: F.transform(
                edges, lambda e: place(position(e["src"])) * F.lit(_PAIR) + place(position(e["dst"]))
            ),
        )
        return F.filter(pairs, lambda p: (p > _PAIR) & (p % _PAIR > 0))

    def one_sided(m: Column) -> Column:
        pred = coded("pred_nodes", "pred_edges", lambda at: F.get(m, (at - 1).cast("int")).cast("long"))
        gold = F.filter(
            coded("gold_nodes", "gold_edges", lambda at: at),
            lambda p: F.array_contains(m, F.shiftright(p, 32).cast("int")) & F.array_contains(m, (p % _PAIR).cast("int")),
        )
        return once(
            gold, lambda g: once(pred, lambda p: F.array_union(F.array_except(g, p), F.array_except(p, g)))
        )

    return once(F.col(matched), one_sided)


def graph_score(
    df: DataFrame, matched: str = "matched", max_steps: int | None = None
) -> DataFrame:
    """Graph score of ``with_status`` rows.

    Matched nodes joined by a one-sided edge cannot both stay, so the answer is
    the matched count less the fewest nodes that meet every such pair. Only rows
    with such pairs go to the solver. The answer is exact. Finding the fewest is
    NP-hard; a caller may bound the search by ``max_steps``, and a search beyond it
    counts as a ``runtime`` skip.
    """
    rows = df.withColumn("_conflicts", _conflicts(matched)).withColumn(
        "_n", F.size(F.filter(matched, lambda g: g > 0))
    )

    @F.pandas_udf("int")
    def removed(pairs: pd.Series) -> pd.Series:
        return pd.Series(
            [graphs.min_cover([divmod(int(e), _PAIR) for e in p], max_steps) if len(p) else 0 for p in pairs],
            dtype="Int32",
        )

    pairs = F.when(F.col("status") == "evaluated", F.col("_conflicts"))
    clean = F.coalesce(F.size(pairs) <= 0, F.lit(True))
    needed = F.when(clean, F.array().cast(rows.schema["_conflicts"].dataType)).otherwise(pairs)
    hits = F.col("_n") - removed.asNondeterministic()(needed)
    return _scored(rows, hits, F.size("pred_nodes"), F.size("gold_nodes")).drop("_conflicts", "_n")


def match_by_similarity(
    df: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    *,
    threshold: float,
    gold: str = "gold",
    pred: str = "pred",
    out: str = "matched",
) -> DataFrame:
    """Like ``match_by_label`` but by meaning: the one-to-one alignment with the
    largest sum of cosine similarities, pairs under ``threshold`` left out."""

    @F.pandas_udf("array<int>")
    def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = load_encoder()
        for pred_labels, gold_labels in batches:
            # Each different label of the batch is encoded once.
            known = list(dict.fromkeys(x for s in (pred_labels, gold_labels) for row in s for x in row))
            unit = graphs.unit_vectors(encode, known)
            place = {x: i for i, x in enumerate(known)}
            yield pd.Series(
                [
                    graphs.align(
                        unit[[place[x] for x in p]] @ unit[[place[x] for x in g]].T, threshold
                    )
                    if len(p) and len(g)
                    else [0] * len(p)
                    for p, g in zip(pred_labels, gold_labels)
                ]
            )

    def labels(side: str) -> Column:
        return F.transform(f"{side}_nodes", lambda n: n["label"])

    return df.withColumn(out, align.asNondeterministic()(labels(pred), labels(gold)))

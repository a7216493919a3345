"""What workflow queries cost: plans and steps, beside their results."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import graphs
from colloquy.functions.arrays import once
from colloquy.operators import scoring as S, workflows as W
from colloquy.plans import queries as Q, tables as G


def tables(spark, path, lines, parts):
    line = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_shipdate string"
    )
    spark.createDataFrame(lines, line).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    return str(path)


def plan_of(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_an_order_meet_once(spark, tmp_path):
    rng = random.Random(5)
    days = [None, "1994-01-01", "1994-01-02", "1994-02-01"]
    pick = lambda *xs: rng.choice(xs)
    lines = [
        (pick(None, 1, 2, 3, 4), pick(None, 1, 2, 3, 9), pick(None, 1, 2), pick(None, 1, 2, 3), pick(1.0, 2.0), 5.0, rng.choice(days))
        for _ in range(120)
    ]
    parts = [(1, "b"), (1, "a"), (1, None), (2, "c"), (3, "d"), (3, "d"), (None, "e")]
    found = G.workflow_labels(spark, tables(spark, tmp_path, lines * 2, parts))
    # Lines are dealt by part (unless parts are broadcast) and by order, parts by their key.
    assert plan_of(found).count("Exchange hashpartitioning") <= 3
    key = lambda xs: [(x is not None, x if x is not None else 0) for x in xs]
    want = {}
    for o in (1, 2, 3, 4):
        # By day and the other columns, nulls first.
        own = sorted(
            (x for x in lines * 2 if x[0] == o and x[6] is not None), key=lambda x: (x[6], key((x[3], x[1], x[2], x[4], x[5])))
        )
        names = [sorted((n for p, n in parts if p == x[1] and p is not None), key=lambda n: n or "") for x in own]
        labels = list(itertools.chain(*names))
        if labels:
            want[o] = labels
    assert {r["o"]: r["labels"] for r in found.collect()} == want


def test_a_graph_is_peeled_once(spark, tmp_path):
    lines = [(o, p, 1, p, 1.0, 1.0, "1994-01-01") for o in range(1, 90) for p in (1, 2, 3)]
    path = tables(spark, tmp_path, lines, [(p, f"part {p}") for p in (1, 2, 3)])
    plan = plan_of(Q.branching_levels(spark, path))
    # Numbers and labels of nodes, both ends of edges.
    assert plan.count("regexp_extract_all(") == 4


def test_bound_values_ask_for_no_types(spark):
    df = spark.range(3).select(once(F.col("id") * 2, lambda x: x + x).alias("x"))
    assert "transform(array(" not in plan_of(df)
    assert [r["x"] for r in df.orderBy("x").collect()] == [0, 4, 8]


def test_positions_of_odd_numbers(spark):
    numbers = [["1", "2", "3"], ["1", "1", "2"], ["3", "2", "1"], [], ["2"], ["99999999999"]]
    asked = ["1", "2", "3", "0", "4", "START", "END", "99999999999"]
    df = spark.createDataFrame(
        [([(n, "x") for n in row],) for row in numbers], "nodes array<struct<no:string,label:string>>"
    )
    got = df.select(
        S._with_positions(F.col("nodes"), lambda at: F.transform(F.array(*map(F.lit, asked)), at)).alias("at")
    ).collect()
    assert [r["at"] for r in got] == [[row.index(x) + 1 if x in row else 0 for x in asked] for row in numbers]


def test_clear_alignments_need_no_search(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        sim = rng.choice([0.0, 0.5, 0.7, 0.8, 0.9, 1.0], (n, m))
        got = graphs.align(sim, 0.6)
        kept = np.where(sim >= 0.6, sim, 0.0)
        assert len(set(g for g in got if g)) == sum(g > 0 for g in got)
        assert all(kept[r, g - 1] > 0 for r, g in enumerate(got) if g)
        want = sum(kept[r, c] for r, c in enumerate(graphs.best_assignment(kept)) if c >= 0)
        assert abs(sum(kept[r, g - 1] for r, g in enumerate(got) if g) - want) < 1e-9

    def search(_):
        raise AssertionError("searched")

    monkeypatch.setattr(graphs, "best_assignment", search)
    assert graphs.align(np.array([[0.1, 0.9, 0.0], [0.8, 0.7, 0.2], [0.1, 0.2, 0.3]]), 0.6) == [2, 1, 0]


def test_repeated_labels_still_match_by_occurrence(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        gold, pred = ([rng.choice("aAbcd") for _ in range(rng.randrange(6))] for _ in range(2))
        rows.append((i, *([(str(j), x) for j, x in enumerate(s)] for s in (gold, pred))))
    nodes = "array<struct<no:string,label:string>>"
    got = W.match_by_label(spark.createDataFrame(rows, f"i int, gold_nodes {nodes}, pred_nodes {nodes}")).collect()
    for r in got:
        free = {}
        for j, n in enumerate(r["gold_nodes"]):
            free.setdefault(n["label"].lower(), []).append(j + 1)
        want = [free[k].pop(0) if free.get(k := n["label"].lower()) else 0 for n in r["pred_nodes"]]
        assert r["matched"] == want


def test_files_of_predictions_are_few(spark, tmp_path):
    lines = [(o, 1, 1, 1, 1.0, 1.0, "1994-01-01") for o in range(0, 84 * 3_000, 84)]
    path = G.prediction_files(spark, tables(spark, tmp_path, lines, [(1, "a")]))
    n_runs = G.predictions(spark, str(tmp_path)).select("model", "task", "scenario", "stamp").distinct().count()
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).count() == n_runs


def test_stored_orders_have_the_same_labels_and_are_gathered_once(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    days = [None, "1994-01-01", "1994-01-02", "1994-02-01"]
    pick = lambda *xs: rng.choice(xs)
    lines = [
        (pick(None, *range(1, 40)), pick(None, 1, 2, 3, 9), pick(None, 1, 2), pick(None, 1, 2, 3), pick(1.0, 2.0), 5.0, rng.choice(days))
        for _ in range(300)
    ]
    path = tables(spark, tmp_path, lines * 2, [(1, "b"), (1, "a"), (1, None), (2, "c"), (3, "d"), (3, "d"), (None, "e")])
    want = {r["o"]: r["labels"] for r in G.workflow_labels(spark, path).collect()}
    seen, read = [], G.read
    monkeypatch.setattr(G, "read", lambda s, d, table, *c: seen.append(table) or read(s, d, table, *c))
    assert {r["o"]: r["labels"] for r in G.stored_labels(spark, path).collect()} == want and len(want) > 30
    seen.clear()
    found = Q.eval_latest(spark, path).collect()
    assert seen.count("lineitem") == 1
    gold = G.workflow_pairs(spark, path).select("task", "idx", F.col("gold_workflow").alias("workflow"))
    scores = Q.evaluation.evaluate_latest(gold, G.stored_predictions(spark, path), on_mismatch="report")
    n = {(r["model"], r["scenario"], r["task"], r["eval_type"]): r["n_total"] for r in scores.collect()}
    done = {(r["model"], r["scenario"], r["task"], r["eval_type"]): r["n_total"] for r in found if r["status"] == "done"}
    assert n and n == done

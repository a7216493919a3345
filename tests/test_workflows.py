import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import graphs
from colloquy.operators import evaluation as E, scoring as S, workflows as W

CHAIN = "Node:\n1: a\n2: b\n3: c\nEdge: (START,1) (1,2) (2,3) (3,END)"


def pairs(spark, *texts):
    rows = [(i, g, p) for i, (g, p) in enumerate(texts)]
    return spark.createDataFrame(rows, "idx long, gold_workflow string, pred_workflow string")


def by_idx(df):
    return {r["idx"]: r for r in df.collect()}


def text_of(labels, edges):
    nodes = "\n".join(f"{i + 1}: {x}" for i, x in enumerate(labels))
    return f"Node:\n{nodes}\nEdge: " + " ".join(f"({a},{b})" for a, b in edges)


def random_pairs(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        sides = []
        for _ in range(2):
            size = rng.randint(1, 6)
            labels = [rng.choice("abcdef") for _ in range(size)]
            edges = {(a, b) for a in range(1, size + 1) for b in range(a + 1, size + 1) if rng.random() < 0.4}
            sides.append((labels, sorted(edges)))
        out.append(sides)
    return out


def match(gold, pred):
    seen, places = {}, {}
    for i, x in enumerate(gold, 1):
        seen[x] = seen.get(x, 0) + 1
        places[x, seen[x]] = i
    count, out = {}, []
    for x in pred:
        count[x] = count.get(x, 0) + 1
        out.append(places.get((x, count[x]), 0))
    return out


def test_parse(spark):
    text = "Node:\n 01: Mix it \n2:Bake\nnot a node\n3: END\nEdge: (START,1) (1, 2) (2,2) (2,9) (2,END)"
    df = W.with_graph(pairs(spark, (text, None)), "gold_workflow", "gold")
    nodes = W.explode_nodes(df, ["idx"], "gold_nodes").orderBy("pos").collect()
    assert [(r["no"], r["label"]) for r in nodes] == [(1, "Mix it"), (2, "Bake")]
    edges = W.explode_edges(df, ["idx"], "gold_nodes", "gold_edges").orderBy("pos").collect()
    assert [(r["src"], r["dst"], r["is_self_loop"], r["ends_known"]) for r in edges] == [
        ("START", "1", False, True), ("1", "2", False, True), ("2", "2", True, True),
        ("2", "9", False, False), ("2", "END", False, True)]
    empty = W.with_graph(pairs(spark, (text, None)), "pred_workflow", "pred").first()
    assert empty["pred_nodes"] == [] and empty["pred_edges"] == []


def test_unparseable_predictions_score_zero(spark):
    df = pairs(spark, *[(CHAIN, "sorry, I cannot help with that.")] * 3)
    scores = E.evaluate(df.withColumn("task", F.lit("toy")), ["task"])
    for r in E.aggregate(scores, ["task", "eval_type"]).collect():
        assert (r["n_total"], r["n_skipped_unparseable"], r["n_evaluated"], r["f1_score"]) == (3, 3, 0, 0.0)


def test_equal_workflows_score_one_and_swap_swaps(spark):
    shorter = "Node:\n1: a\n2: c\nEdge: (START,1) (1,2) (2,END)"
    df = E.prepare(pairs(spark, (CHAIN, CHAIN), (CHAIN, shorter), (shorter, CHAIN)))
    for scored in (S.chain_score(df), S.graph_score(df), S.edge_overlap(df), S.chain_score(df, "any")):
        got = by_idx(scored)
        assert got[0]["f1_score"] == got[0]["precision"] == got[0]["recall"] == 1.0
        assert got[1]["precision"] == pytest.approx(got[2]["recall"])
        assert got[1]["recall"] == pytest.approx(got[2]["precision"])


def test_scores_equal_brute_force(spark):
    cases = random_pairs(120, 5)
    df = E.prepare(pairs(spark, *[(text_of(*g), text_of(*p)) for g, p in cases]))
    assert {i: r["matched"] for i, r in by_idx(df).items()} == {
        i: match(g[0], p[0]) for i, (g, p) in enumerate(cases)}
    chain, graph, anyo = (by_idx(x) for x in (S.chain_score(df), S.graph_score(df), S.chain_score(df, "any")))
    for i, ((gl, ge), (pl, pe)) in enumerate(cases):
        m = match(gl, pl)
        places = [g for g in m if g]
        lis = max(
            (len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n)
             if list(c) == sorted(c)), default=0)
        assert chain[i]["precision"] == pytest.approx(lis / len(pl))
        gold_of = {p + 1: g for p, g in enumerate(m) if g}
        mapped = {(gold_of[a], gold_of[b]) for a, b in pe if a in gold_of and b in gold_of}
        best = max(
            n for n in range(len(places) + 1) for c in itertools.combinations(places, n)
            if all(((a, b) in mapped) == ((a, b) in set(ge)) for a in c for b in c))
        assert graph[i]["recall"] == pytest.approx(best / len(gl))
        orders = [
            o for o in itertools.permutations(range(1, len(gl) + 1))
            if all(o.index(a) < o.index(b) for a, b in ge)]
        free = max(
            max(n for n in range(len(places) + 1) for c in itertools.combinations(places, n)
                if [o.index(x) for x in c] == sorted(o.index(x) for x in c))
            for o in orders)
        assert anyo[i]["precision"] == pytest.approx(free / len(pl))


def test_cycle_is_a_runtime_skip(spark):
    loop = "Node:\n1: a\n2: b\nEdge: (1,2) (2,1)"
    got = S.chain_score(E.prepare(pairs(spark, (loop, loop))), "any").first()
    assert (got["status"], got["precision"]) == ("runtime", None)


def test_unknown_types_fail_up_front(spark):
    df = pairs(spark, (CHAIN, CHAIN))
    with pytest.raises(ValueError):
        E.evaluate(df, ["idx"], ["edges"])
    with pytest.raises(ValueError):
        S.chain_score(E.prepare(df), "some")


def test_evaluate_takes_a_matcher(spark):
    def load():
        return lambda labels: np.eye(3)[[("a", "b", "c").index(x) for x in labels]]

    def match(df):
        return S.match_by_similarity(df, load, threshold=0.9)

    texts = (CHAIN, CHAIN), (CHAIN, "Node:\n1: b\n2: a\nEdge: (1,2)")
    got = E.evaluate(pairs(spark, *texts), ["idx"], match=match, order="any").collect()
    want = E.evaluate(pairs(spark, *texts), ["idx"], order="any").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4


def test_min_cover_and_budget():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 8)
        edges = [e for e in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        want = min(
            k for k in range(n + 1) for c in itertools.combinations(range(n), k)
            if all(a in c or b in c for a, b in edges))
        assert graphs.min_cover(edges, None) == want
    dense = [e for e in itertools.combinations(range(30), 2) if rng.random() < 0.5]
    assert graphs.min_cover(dense, 3) is None
    # A long ring or chain takes no search at all.
    assert graphs.min_cover([(i, i + 1) for i in range(900)], 5) == 450
    assert graphs.min_cover([(i, (i + 1) % 901) for i in range(901)], 5) == 451


def test_best_assignment():
    rng = np.random.default_rng(2)
    for _ in range(100):
        r, c = rng.integers(1, 6, 2)
        w = rng.random((r, c))
        got = graphs.best_assignment(w)
        total = sum(w[i, j] for i, j in enumerate(got) if j >= 0)
        small, large = (w, c) if r <= c else (w.T, r)
        want = max(
            sum(small[i, p[i]] for i in range(small.shape[0]))
            for p in itertools.permutations(range(large), small.shape[0]))
        assert total == pytest.approx(want)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) == min(r, c)


def test_match_by_similarity(spark):
    def load():
        table = {"boil water": [1, 0], "heat water": [0.9, 0.1], "serve": [0, 1], "plate": [0.1, 0.9]}
        return lambda labels: np.array([table[x] for x in labels])

    gold = text_of(["boil water", "serve"], [(1, 2)])
    pred = text_of(["plate", "heat water"], [(1, 2)])
    df = W.with_graph(W.with_graph(pairs(spark, (gold, pred)), "gold_workflow", "gold"), "pred_workflow", "pred")
    assert S.match_by_similarity(df, load, threshold=0.6).first()["matched"] == [2, 1]
    assert S.match_by_similarity(df, load, threshold=0.9999).first()["matched"] == [0, 0]


def test_validation_and_pairing(spark):
    gold = spark.createDataFrame([("t", i, CHAIN) for i in range(3)], "task string, idx long, workflow string")
    rows = [("m", "i0", "t", i, CHAIN) for i in range(3)] + [("m", "rag", "t", 0, CHAIN), ("m", "rag", "t", 7, CHAIN)]
    rows += [("m", "sft", "t", i, None if i else CHAIN) for i in range(3)] + [("m", "i0", "u", 0, CHAIN)]
    pred = spark.createDataFrame(rows, "model string, scenario string, task string, idx long, workflow string")
    report = {(r["scenario"], r["task"]): r for r in E.validate_inputs(gold, pred).collect()}
    assert report["i0", "t"]["status"] == "ok"
    assert report["sft", "t"]["status"] == "missing_workflow"
    assert report["i0", "u"]["status"] == "missing_gold"
    rag = report["rag", "t"]
    assert (rag["status"], rag["missing_pred"], rag["extra_pred"]) == ("count_mismatch", 2, 1)
    with pytest.raises(ValueError):
        E.pair_gold_pred(gold, pred, on_mismatch="strict")
    assert E.pair_gold_pred(gold, pred.filter("scenario = 'i0' and task = 't'"), on_mismatch="strict").count() == 3


def test_cover_is_exact_and_not_recursive():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(40):
        n = r.randint(2, 9)
        pairs = [p for p in itertools.combinations(range(n), 2) if r.random() < 0.6]
        best = min(k for k in range(n + 1) for c in itertools.combinations(range(n), k)
                   if all(a in c or b in c for a, b in pairs))
        assert graphs.min_cover(pairs) == best
    long = [(i, i + 1) for i in range(5000)] + [(i, i + 2) for i in range(0, 4000, 2)]
    assert graphs.min_cover(long) is not None
    assert graphs.min_cover(list(itertools.combinations(range(40), 2)), 10) == 39


def test_edges_with_blanks(spark):
    df = spark.createDataFrame([("Edge: (START, 1) (1 ,2) ( 2,END)",)], "t string")
    got = df.select(W.parse_edges(F.col("t")).alias("e")).first()["e"]
    assert [(x["src"], x["dst"]) for x in got] == [("START", "1"), ("1", "2"), ("2", "END")]


def test_validation_sees_duplicates_and_absent_runs(spark):
    gold = spark.createDataFrame([("t", 0, "g"), ("t", 1, "g")], "task string, idx int, workflow string")
    rows = [("m", "twice", "t", 0, "w"), ("m", "twice", "t", 0, "w"), ("m", "good", "t", 0, "w"), ("m", "good", "t", 1, "w"),
            ("m", "again", "t", 0, "w"), ("m", "again", "t", 1, "w"), ("m", "again", "t", 1, "w")]
    pred = spark.createDataFrame(rows, "model string, scenario string, task string, idx int, workflow string")
    absent = spark.createDataFrame([("m", "none", "t")], "model string, scenario string, task string")
    report = {r["scenario"]: r for r in E.validate_inputs(gold, pred, expected=absent).collect()}
    assert {k: r["status"] for k, r in report.items()} == {
        "twice": "count_mismatch", "good": "ok", "again": "duplicates", "none": "missing_run"}
    assert report["twice"]["missing_pred"] == 1 and report["none"]["missing_pred"] == 2


def test_generator_runs_once_under_a_filter(spark):
    from colloquy.operators import prediction

    prompts = spark.createDataFrame([(1, [{"role": "user", "content": "q"}])], "idx int, messages array<struct<role:string,content:string>>")
    out = prediction.batch_predict(prompts, ["idx"], lambda: (lambda m, model, tuned: "a"), model="m", finetuned=False)
    plan = out.filter("error IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_min_cover_of_many_conflicts():
    """200 nodes with 600 conflicts; dense graphs against all subsets."""
    import random

    r = random.Random(0)
    edges = [tuple(r.sample(range(200), 2)) for _ in range(600)]
    assert graphs.min_cover(edges, 20_000) == 118
    for seed in range(60):
        r = random.Random(seed)
        n = r.randrange(3, 10)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(4 * n))]
        best = min(
            k for k in range(n + 1) for c in itertools.combinations(range(n), k) if all(a in c or b in c for a, b in edges)
        )
        assert graphs.min_cover(edges) == best


def test_levels_peel_branching_cyclic_and_empty_graphs(spark):
    def text(n, edges):
        return "Node:\n" + "\n".join(f"{i}: step {i}" for i in range(1, n + 1)) + "\nEdge: " + edges

    rows = [
        (0, text(5, "(START,1) (1,2) (1,3) (2,4) (3,4) (4,5) (1,5) (5,END)")),
        (1, text(3, "(1,2) (2,3) (3,2)")),
        (2, text(2, "(2,2)")),
        (3, text(3, "(3,2) (2,1) (2,9) (8,1)")),
        (4, text(2, "")),
        (5, ""),
        (6, None),
        (7, text(40, " ".join(f"({i},{i + 1})" for i in range(1, 40)))),
        (8, text(2, "(1,2) (1,2)")),
    ]
    parsed = W.with_graph(spark.createDataFrame(rows, "idx long, w string"), "w", "gold")
    got = {r["idx"]: (r["gold_cyclic"], r["gold_levels"]) for r in S.with_levels(parsed).collect()}
    assert got == {
        0: (False, [0, 1, 1, 2, 3]),
        1: (True, [None] * 3),
        2: (True, [None] * 2),
        3: (False, [2, 1, 0]),
        4: (False, [0, 0]),
        5: (False, []),
        6: (False, []),
        7: (False, list(range(40))),
        8: (False, [0, 1]),
    }


def test_branching_queries_tell_their_cases_apart(spark):
    from colloquy.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    chain = Q.branching_chain(spark, sf).collect()
    assert {r["status"] for r in chain} == {"evaluated", "runtime", "unparseable"}
    live = [r for r in chain if r["status"] == "evaluated"]
    assert all(r["f1_score"] >= r["listed_f1"] for r in live)
    assert sum(r["f1_score"] > r["listed_f1"] for r in live) > len(live) // 4
    edges = Q.branching_edges(spark, sf).select("is_self_loop", "ends_known").distinct().collect()
    assert {r["is_self_loop"] for r in edges} == {r["ends_known"] for r in edges} == {True, False}

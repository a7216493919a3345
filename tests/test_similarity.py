import numpy as np
import pytest

from colloquy.operators import ball_index, embedding, prediction, prompts, retrieved, similarity, vectors

STRATEGIES = ["broadcast_corpus", "broadcast_queries", "blocked"]


def frame(spark, ids, vectors, name, extra=None, kind="long"):
    rows = [
        (i if kind == "long" else f"r{i}", [float(x) for x in v], *([extra[n]] if extra else []))
        for n, (i, v) in enumerate(zip(ids, vectors))
    ]
    schema = f"{name} {kind}, embedding array<float>" + (", ex array<long>" if extra else "")
    return spark.createDataFrame(rows, schema)


def brute(q, m, k, excluded):
    q, m = q.astype(np.float32).astype(float), m.astype(np.float32).astype(float)
    out = {}
    for i, v in enumerate(q):
        dot = np.zeros(len(m))
        for j in range(m.shape[1]):
            dot += m[:, j] * v[j]
        s = dot / (np.sqrt((m * m).sum(1)) * np.sqrt((v * v).sum()) + 1e-9)
        order = [x for x in sorted(range(len(m)), key=lambda x: (-round(s[x], 12), x)) if x not in excluded[i]]
        out[i] = [(x, round(s[x], 6)) for x in order[:k]]
    return out


def data(case):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(400, 8))
    q = rng.normal(size=(60, 8))
    if case == "copies":  # a third of both sides is one vector
        m[::3] = m[0]
        q[::3] = m[0]
    if case == "zeros":
        m[::3] = 0
        q[::4] = 0
    if case == "clusters":
        m = rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] + 0.05 * m
        q = m[:60] * 3
    if case == "tiny":  # fewer records than k
        m = m[:3]
    return q, m


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("case", ["random", "copies", "zeros", "clusters", "tiny"])
def test_topk_equals_brute_force(spark, strategy, case):
    q, m = data(case)
    excluded = [[i, i + 1] if i % 2 else [] for i in range(len(q))]
    got = similarity.topk_cosine(
        frame(spark, range(len(q)), q, "qid", excluded),
        frame(spark, range(len(m)), m, "id"),
        5, query_id="qid", record_id="id", exclude="ex", strategy=strategy,
        block_rows=32, pivots=8,
    ).collect()
    found = {i: [] for i in range(len(q))}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        found[r["qid"]].append((r["record_id"], round(r["score"], 6)))
    assert found == brute(q, m, 5, excluded)


def test_orthogonal_pair_and_text_ids(spark):
    corpus = frame(spark, [0, 1], np.eye(2), "id", kind="string")
    queries = frame(spark, [7], np.array([[1.0, 0.0]]), "qid")
    for strategy in STRATEGIES:
        got = similarity.topk_cosine(queries, corpus, 1, query_id="qid", strategy=strategy).collect()
        assert [(r["qid"], r["rank"], r["record_id"]) for r in got] == [(7, 1, "r0")]
    # k of zero means the default of two.
    assert similarity.topk_cosine(queries, corpus, 0, query_id="qid").count() == 2


def test_size_bounds_choose_the_form(spark):
    q, m = data("random")
    args = dict(query_id="qid", record_id="id")
    queries, corpus = frame(spark, range(60), q, "qid"), frame(spark, range(400), m, "id")
    want = {tuple(r) for r in similarity.topk_cosine(queries, corpus, 3, **args).collect()}
    for limit in (8 * 8 * 100, 8 * 8 * 10):  # the queries fit; neither side fits
        got = similarity.topk_cosine(queries, corpus, 3, broadcast_bytes=limit, **args)
        assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError):
        similarity.topk_cosine(
            queries, corpus, 3, broadcast_bytes=64, strategy="broadcast_corpus", **args)


def scored_pairs(spark, q, m, k=5):
    """Pairs of query and record the rounds after the first look at."""
    records = frame(spark, range(len(m)), m, "id").selectExpr("id", "0 AS key", "embedding AS vec")
    tree, blocks = ball_index.build(records, None, 8_192, k)
    at = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    s = np.sort((q / np.linalg.norm(q, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T, axis=1)
    rows = [(i, [float(x) for x in v], float(s[i, -k])) for i, v in enumerate(q)]
    reps = spark.createDataFrame(rows, "rep long, qvec array<double>, tau double")
    return sum(
        at.get(b, 0)
        for scope in ("ball", "rest") for r in ball_index.plan_visits(reps, tree, scope).collect() for b in r["blocks"]
    )


def test_tree_visits_few_cells_on_clustered_vectors(spark):
    """The bounds have to rule cells out, or the join is all pairs; four times the vectors
    on both sides must cost clearly less than sixteen times as much."""
    rng = np.random.default_rng(5)

    def clustered(n):
        return rng.normal(size=(n // 20, 16))[rng.integers(0, n // 20, n)] + 0.05 * rng.normal(size=(n, 16))

    small, large = clustered(600), clustered(2_400)
    few, many = scored_pairs(spark, small, small), scored_pairs(spark, large, large)
    assert few < 0.6 * 600**2 and many < 0.4 * 2_400**2
    assert many < 10 * few


@pytest.mark.parametrize("blocks_per_part", [1, 3])
def test_parts_hold_whole_cells_or_slices_of_one(spark, monkeypatch, blocks_per_part):
    """Small parts, so that balls fall into several and hot cells into more than one."""
    monkeypatch.setattr(ball_index, "PART_BYTES", 8 * 8 * 16 * blocks_per_part)
    q, m = data("clusters")
    m[:100] = 0.001 * m[:100] + m[0]
    records = frame(spark, range(len(m)), m, "id").selectExpr("id", "0 AS key", "embedding AS vec")
    tree, blocks = ball_index.build(records, 8, 16, 5)
    assert tree.part_blocks == blocks_per_part
    per_part = blocks.selectExpr("part", "block").distinct().groupBy("part").count().collect()
    assert max(r["count"] for r in per_part) <= blocks_per_part and len(per_part) > 3
    assert blocks.groupBy("block").agg({"part": "min"}).count() == blocks.select("part", "block").distinct().count()
    excluded = [[i, i + 1] if i % 2 else [] for i in range(len(q))]
    got = similarity.topk_cosine(
        frame(spark, range(len(q)), q, "qid", excluded), frame(spark, range(len(m)), m, "id"),
        5, query_id="qid", record_id="id", exclude="ex", strategy="blocked", block_rows=16, pivots=8).collect()
    found = {i: [] for i in range(len(q))}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        found[r["qid"]].append((r["record_id"], round(r["score"], 6)))
    assert found == brute(q, m, 5, excluded)


@pytest.mark.parametrize("case", ["random", "copies", "short", "wide", "bounded"])
def test_best_equals_all_scores_and_sums_few_of_them(monkeypatch, case):
    """Scores are summed in double precision for candidates only, whatever the vectors."""
    rng = np.random.default_rng(3)
    q, m = rng.normal(size=(600, 16)), rng.normal(size=(2_500, 16))
    if case == "copies":
        m[::5], q[::7], m[1], q[1] = m[0], m[0], 0, 0
    if case == "short":  # the added epsilon matters, and single precision says nothing
        m[::2] *= 1e-5
        q[::3] *= 1e-5
    if case == "wide":
        m *= 10.0 ** rng.integers(-1, 6, 2_500)[:, None]
    q_norm, m_norm, order = vectors.norms_of(q), vectors.norms_of(m), rng.permutation(2_500)
    banned = np.repeat(np.arange(600), 2), rng.integers(0, 2_500, 1_200)
    qi, mi = np.divmod(np.arange(600 * 2_500), 2_500)
    score = vectors._exact(q, q_norm, m, m_norm, qi, mi).reshape(600, 2_500)
    score[banned] = -np.inf
    floor = np.sort(score, axis=1)[:, -3] if case == "bounded" else None
    want = []
    for i, row in enumerate(score):
        best = np.lexsort((order, -row))[:5]
        want += [(i, j, row[j]) for j in best if floor is None or row[j] >= floor[i]]

    summed, exact = [], vectors._exact
    monkeypatch.setattr(vectors, "_exact", lambda *a: summed.append(len(a[-1])) or exact(*a))
    best = vectors.Best(q, q_norm, m, m_norm, order, 5, banned, floor)
    for lo in range(0, 2_500, 1_250):
        best.meet(np.arange(0, 600, 2), lo, lo + 1_250)
    best.meet(np.arange(1, 600, 2), 0, 2_500)
    assert list(zip(*(x.tolist() for x in best.found()))) == want
    assert sum(summed) < 0.02 * score.size or case == "copies"


def test_a_query_travels_with_its_bound_and_two_numbers_for_a_cell(spark):
    """However many blocks a cell has; and what the bound rules out is not given out."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(2_000, 8))
    records = frame(spark, range(2_000), m, "id").selectExpr("id", "0 AS key", "embedding AS vec")
    tree, blocks = ball_index.build(records, 4, 16, 5)
    q = m[:40].astype(np.float32).astype(float)
    s = np.sort((q / vectors.norms_of(q)[:, None]) @ (m / vectors.norms_of(m)[:, None]).T, axis=1)
    rows = [(i, [float(x) for x in v], float(s[i, -2]) - 1e-6) for i, v in enumerate(q)]
    reps = spark.createDataFrame(rows, "rep long, qvec array<double>, tau double")
    hits = []
    for scope in ("ball", "rest"):
        each = ball_index.plan_visits(reps, tree, scope).collect()
        told = ball_index.plan_visits(reps, tree, scope, spans=True)
        pairs = {(r["rep"], r["part"]): r["blocks"] for r in told.collect()}
        assert {k: [b for lo, hi in zip(x[::2], x[1::2]) for b in range(lo, hi + 1)] for k, x in pairs.items()} == {
            (r["rep"], r["part"]): list(r["blocks"]) for r in each}
        assert sum(map(len, pairs.values())) < 0.2 * sum(len(r["blocks"]) for r in each)
        hits += ball_index.meet_parts(told, blocks, None, 5, 16, 64).collect()
    assert hits and all(r["score"] >= rows[r["rep"]][2] for r in hits) and len(hits) <= 80


def test_balls_own_their_centres_and_bounds_hold():
    rng = np.random.default_rng(8)
    m = rng.normal(size=(500, 6))
    m[100:200] = m[0] + 1e-12 * rng.normal(size=(100, 6))  # pivots that nearly coincide
    norm = vectors.norms_of(m)
    tree = ball_index.BallTree(np.unique(m[:150] / norm[:150, None], axis=0))
    assert sorted(np.concatenate(tree.members)) == list(range(len(tree.pivots)))
    assert all(len(x) for x in tree.members)
    ball, cell, ball_angle, angle = tree.place(m, norm)
    rows = [np.flatnonzero(cell == c) for c in np.unique(cell)]
    tree.fill({
        "cell": [cell[r[0]] for r in rows], "ball": [ball[r[0]] for r in rows], "n": [len(r) for r in rows],
        "lo": [angle[r].min() for r in rows], "hi": [angle[r].max() for r in rows],
        "ball_lo": [ball_angle[r].min() for r in rows], "ball_hi": [ball_angle[r].max() for r in rows],
        "min_norm": [norm[r].min() for r in rows],
    }, 50, 3)
    q = np.vstack([rng.normal(size=(40, 6)), m[:20] * 3, -m[:20]])
    q_norm = vectors.norms_of(q)
    score = (q @ m.T) / (np.outer(q_norm, norm) + vectors.EPSILON)
    reach = tree.balls.reach(q, q_norm)
    for b, rings in enumerate(tree.cells):
        if (ball == b).any():
            assert (reach[:, b] >= score[:, ball == b].max(axis=1) - 1e-6).all()
        of_cells = rings.reach(q, q_norm)
        for i, c in enumerate(tree.members[b]):
            if (cell == c).any():
                assert (of_cells[:, i] >= score[:, cell == c].max(axis=1) - 1e-6).all()


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_record_key_tells_records_of_one_id_apart(spark, strategy):
    corpus = spark.createDataFrame(
        [("a", 3, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.1]), ("b", 4, [0.0, 1.0])],
        "id string, index long, embedding array<double>")
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0], []), (2, [1.0, 0.0], ["a"]), (3, [1.0, 0.0], None)],
        "qid long, embedding array<double>, ex array<string>")
    got = similarity.topk_cosine(
        queries, corpus, 3, query_id="qid", record_key="index", exclude="ex", strategy=strategy)
    found = {(r["qid"], r["rank"]): (r["record_id"], r["index"]) for r in got.collect()}
    assert found == {
        (1, 1): ("a", 1), (1, 2): ("a", 3), (1, 3): ("b", 2),
        (2, 1): ("b", 2), (2, 2): ("b", 4),
        (3, 1): ("a", 1), (3, 2): ("a", 3), (3, 3): ("b", 2),
    }


def test_a_long_exclude_list_concerns_its_own_query_only(spark):
    """Copies kept per vector: k, and as many more as one query excludes of that vector."""
    rows = [(i, 0, [1.0, 0.0]) for i in range(300)] + [(300 + i, 0, [0.0, 1.0]) for i in range(300)] + [(600, 0, [1.0, 1.0])]
    held = spark.createDataFrame(rows, "id long, key int, vec array<double>")
    bans = spark.createDataFrame([(1, i) for i in range(120)] + [(2, i) for i in range(60, 180)], "rep long, id long")
    kept = ball_index.without_surplus_copies(held, bans, 4).collect()
    per = {v: sorted(r["id"] for r in kept if tuple(r["vec"]) == v) for v in {tuple(r["vec"]) for r in kept}}
    assert per == {(1.0, 0.0): list(range(124)), (0.0, 1.0): [300, 301, 302, 303], (1.0, 1.0): [600]}

    queries = spark.createDataFrame(
        [(1, [1.0, 0.0], list(range(299))), (2, [1.0, 0.0], []), (3, [0.0, 2.0], [300])],
        "qid long, embedding array<double>, ex array<long>")
    got = similarity.topk_cosine(
        queries, held, 2, query_id="qid", record_vector="vec", exclude="ex", strategy="blocked", block_rows=16)
    assert {(r["qid"], r["rank"]): r["record_id"] for r in got.collect()} == {
        (1, 1): 299, (1, 2): 600, (2, 1): 0, (2, 2): 1, (3, 1): 301, (3, 2): 302}


def test_sizes_count_texts_and_lists(spark):
    q = spark.createDataFrame([(1, [1.0], ["x" * 100] * 50)], "qid long, qvec array<double>, excl array<string>")
    assert similarity._small_table(q, "qvec", 5_000) is None
    assert similarity._small_table(q, "qvec", 6_000).num_rows == 1
    wide = spark.createDataFrame([(i, [0.0] * 50) for i in range(20)], "id long, vec array<double>")
    assert similarity._small_table(wide, "vec", 19 * 8 * 50) is None
    assert similarity._small_table(wide, "vec", 20 * 8 * 50).num_rows == 20


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    for strategy in STRATEGIES:
        for a, b in ((none, some), (some, none), (none, none)):
            assert similarity.topk_cosine(a, b, query_id="id", strategy=strategy).count() == 0


def test_encoder_hook_and_hashing(spark):
    df = spark.createDataFrame([("Ab ab c",), ("",), (None,)], "t string")
    got = [r["embedding"] for r in embedding.with_hash_embedding(df, "t").collect()]
    want = np.zeros(64)
    want[embedding.bucket_of("ab")] += 2
    want[embedding.bucket_of("c")] += 1
    assert np.allclose(got[0], want / np.sqrt((want**2).sum()))
    assert sum(got[1]) == sum(got[2]) == 0

    def load():
        return lambda texts: np.array([[len(t), len(texts)] for t in texts])

    some = spark.createDataFrame([("x" * i,) for i in range(5)], "t string").coalesce(1)
    vectors = [r["e"] for r in embedding.with_encoder(some, "t", load, "e", batch=2).collect()]
    assert [v[0] for v in vectors] == [0, 1, 2, 3, 4] and max(v[1] for v in vectors) == 2


def test_few_shot_block_and_layouts(spark):
    corpus = spark.createDataFrame([("a", "q1", "w1"), ("b", "q2", "w2")], "id string, user string, workflow string")
    hits = spark.createDataFrame([(1, 2, "a"), (1, 1, "b")], "conv_id long, rank int, record_id string")
    blocks = prompts.few_shot_blocks(hits, corpus, ["conv_id"])
    text = "### Example 1\nQuestion:\nq2\n\nWorkflow:\nw2\n\n### Example 2\nQuestion:\nq1\n\nWorkflow:\nw1\n"
    assert blocks.first()["block"] == text
    parts = spark.createDataFrame([(1, "", "u")], "conv_id long, system string, user string")
    got = prompts.build_prompts(parts, ["conv_id"], use_rag=True, blocks=blocks).first()["messages"]
    assert got[0]["content"] == "\n\nRetrieved training examples (use as structural reference):\n\n" + text
    assert (got[1]["role"], got[1]["content"]) == ("user", "u")
    with pytest.raises(ValueError):
        prompts.build_prompts(parts, ["conv_id"], use_rag=True)


def test_records_of_one_id_give_one_example_each(spark):
    """Two hits are two examples, also of one record id, and each has its own text; items may
    be answered by popular records, in parts, and by none."""
    corpus = spark.createDataFrame(
        [("a", 0, "q0", "w0"), ("a", 1, "q1", "w1"), ("b", 2, "q2", "w2")],
        "id string, index long, user string, workflow string")
    rows = [(i, 1, "a", 1) for i in range(40)] + [(i, 2, "a", 0) for i in range(40)] + [(99, 1, "b", 2)]
    hits = spark.createDataFrame(rows, "conv_id long, rank int, record_id string, index long")
    blocks = {r["conv_id"]: r for r in prompts.few_shot_blocks(hits, corpus, ["conv_id"]).collect()}
    assert len(blocks) == 41 and all(blocks[i]["n_examples"] == 2 for i in range(40))
    assert all(blocks[i]["block"].index("q1") < blocks[i]["block"].index("q0") for i in range(40))
    split = retrieved.with_records(hits, corpus, ["workflow"], part_hits=7)
    assert sorted(map(tuple, split.collect())) == sorted((*r, f"w{r[3]}") for r in rows)
    items = spark.createDataFrame([(i,) for i in (0, 1, 99, 100)], "conv_id long")
    got = prediction.copy_nearest(hits, corpus, items, "conv_id").collect()
    assert {r["conv_id"]: (r["workflow"], r["error"]) for r in got} == {
        0: ("w1", None), 1: ("w1", None), 99: ("w2", None), 100: ("", "RuntimeError: empty answer")}


def test_inject_before_first_user(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "human", "u"), (1, 2, "gpt", "a"), (2, 0, "gpt", "b")],
        "conv_id long, turn long, role string, content string")
    blocks = spark.createDataFrame([(1, "B"), (2, "B")], "conv_id long, block string")
    got = prompts.inject_block(turns, blocks, ["conv_id"]).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"]) for r in got] == [
        (1, 0, "system"), (1, 1, "system"), (1, 2, "human"), (1, 3, "gpt"), (2, 0, "gpt")]
    assert got[1]["content"].endswith("\n\nB")

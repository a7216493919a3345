import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from colloquy import schemas
from colloquy.operators import embedding, prediction, runs, scenarios
from colloquy.sources import json_items as J, tables as S, vector_store

CHAT = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_train_positions_run_over_files(spark, tmp_path):
    put(tmp_path / "a.json", [{"id": "x", "conversations": CHAT}, {"source": "s"}])
    put(tmp_path / "b.json", "\n [" + json.dumps({"id": 5, "messages": CHAT}) + "]")
    got = J.read_train(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["idx"], r["id"], r["source"]) for r in got] == [(0, "x", None), (1, None, "s"), (2, "5", None)]
    assert J.count_train(spark, str(tmp_path)) == 3


def test_an_object_is_no_list(spark, tmp_path):
    put(tmp_path / "a.json", {"id": "x"})
    with pytest.raises(Exception, match="not a JSON list"):
        J.count_train(spark, str(tmp_path))


def test_gold_layout(spark, tmp_path):
    put(tmp_path / "wikihow" / "graph_eval.json", [{"conversations": CHAT}] * 3)
    put(tmp_path / "os" / "graph_eval.json", [])
    put(tmp_path / "lumos" / "graph_eval.json", {"no": "list"})
    put(tmp_path / "webshop" / "other.json", [{}])
    counts = {r["task"]: r["n_items"] for r in J.task_counts(spark, str(tmp_path)).collect()}
    assert counts == {"wikihow": 3, "os": 0, "lumos": 0}
    put(tmp_path / "lumos" / "graph_eval.json", [{"id": "z"}])
    got = J.read_gold(spark, str(tmp_path)).orderBy("task", "idx").collect()
    assert [(r["task"], r["idx"]) for r in got] == [("lumos", 0), ("wikihow", 0), ("wikihow", 1), ("wikihow", 2)]


def test_prediction_files(spark, tmp_path):
    def run(*names):
        return [{"query": {"id": n, "conversations": CHAT}, "workflow": f"w{n}"} for n in names]

    put(tmp_path / "model-x" / "os" / "graph_eval_rag_20250102_030405.json", run("a", "b"))
    put(tmp_path / "model-x" / "os" / "graph_eval_sft_rag_20250102_030406.json", run())
    put(tmp_path / "model-x" / "os" / "graph_eval_rag.json", run("old"))
    put(tmp_path / "model-y" / "lumos" / "graph_eval_i0_20250102_030405.json", run("c"))
    got = J.read_prediction_files(spark, str(tmp_path)).orderBy("model", F.col("stamp").asc_nulls_last(), "idx").collect()
    assert [(r.model, r.task, r.scenario, r.stamp, r.idx, r.query.id, r.workflow) for r in got] == [
        ("model-x", "os", "rag", "20250102_030405", 0, "a", "wa"),
        ("model-x", "os", "rag", "20250102_030405", 1, "b", "wb"),
        ("model-x", "os", "rag", None, 0, "old", "wold"),
        ("model-y", "lumos", "i0", "20250102_030405", 0, "c", "wc"),
    ]
    put(tmp_path / "model-y" / "lumos" / "graph_eval_i0_20250102_030407.json", {"no": "list"})
    with pytest.raises(Exception, match="not a JSON list"):
        J.read_prediction_files(spark, str(tmp_path)).count()


def test_scenario_from_file_names(spark):
    names = {
        "p/graph_eval_sft_20260710_030000.json": "sft",
        "p/graph_eval_sft_rag_20260710_040651.json": "sft_rag",
        "graph_eval_sft.json": None,
        "x_graph_eval_sft_20260710_030000.json": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select("p", runs.scenario_of(runs.file_name(F.col("p"))).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == names


def test_latest_run_prefers_the_stamp(spark):
    rows = [("m", "t", "sft", "20260710_030000"), ("m", "t", "sft", "20260710_040651"),
            ("m", "t", "sft", None), ("m", "t", "rag", None)]
    df = spark.createDataFrame(rows, "model string, task string, scenario string, stamp string")
    got = {r["scenario"]: r["stamp"] for r in runs.latest_runs(df).collect()}
    assert got == {"sft": "20260710_040651", "rag": None}
    assert runs.latest_predictions(df).count() == 2


def test_predictions_round_trip_and_export(spark, tmp_path):
    rows = [("m", s, "t", "20260710_030000", i, f"w{i}", None) for s in ("i0", "rag") for i in range(3)]
    df = spark.createDataFrame(rows, "model string, scenario string, task string, stamp string, idx long, workflow string, error string")
    S.write_predictions(df, str(tmp_path / "p"))
    back = S.read_predictions(spark, str(tmp_path / "p"))
    assert {tuple(r) for r in back.collect()} == set(rows)
    plan = back.filter("scenario = 'rag'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan
    put(tmp_path / "gold" / "t" / "graph_eval.json", [{"id": str(i), "conversations": CHAT} for i in range(3)])
    gold = J.read_gold(spark, str(tmp_path / "gold"))
    unstamped = df.withColumn("stamp", F.lit(None).cast("string")).withColumn("workflow", F.concat(F.lit("old "), "workflow"))
    for _ in range(2):  # A second export replaces the first.
        S.export_predictions(df.unionByName(unstamped), gold, str(tmp_path / "e"), per_file=2)
    out = J.read_prediction_files(spark, str(tmp_path / "e"))
    assert sorted((r["scenario"], r["stamp"] or "", r["idx"], r["query"]["id"], r["workflow"]) for r in out.collect()) == sorted(
        (s, stamp, i, str(i), old + f"w{i}")
        for s in ("i0", "rag") for i in range(3) for stamp, old in (("20260710_030000", ""), ("", "old ")))
    for found in (runs.latest_predictions(out), runs.latest_predictions(out, newest_by="modified")):
        assert {r["stamp"] for r in found.collect()} == {"20260710_030000"} and found.count() == 6
    lone = runs.latest_predictions(out.where("stamp is null"), newest_by="modified")
    assert {r["workflow"] for r in lone.collect()} == {f"old w{i}" for i in range(3)}


def test_an_export_leaves_no_copy_of_its_texts(spark, tmp_path):
    """Neither in the scratch folder nor as shuffles of queries that have ended."""
    noise = "".join(map(chr, np.random.default_rng(0).integers(33, 0x2000, 400_000)))
    rows = [("t", i, str(i), None, None, [("user", noise[i * 1_000:][:1_000])], None) for i in range(400)]
    gold = spark.createDataFrame(rows, T.StructType(
        [T.StructField("task", T.StringType()), T.StructField("idx", T.LongType()), *schemas.ITEM.fields]))
    answers = gold.select(F.lit("m").alias("model"), F.lit("rag").alias("scenario"), "task", F.lit("20260710_030000").alias("stamp"), "idx", F.lit("w").alias("workflow"))
    kept = Path(spark.conf.get("spark.checkpoint.dir"))

    def held():
        return {p: p.stat().st_size for p in kept.rglob("*") if p.is_file()}

    before = held()
    S.export_predictions(answers, gold, str(tmp_path / "e"), per_file=100)
    left = sum(n for p, n in held().items() if p not in before)
    written = sorted((tmp_path / "e").rglob("*.txt"))
    assert len(written) == 4 and left < 0.2 * sum(p.stat().st_size for p in written)


def test_a_run_written_twice_counts_once(spark, tmp_path):
    rows = [("m", s, "t", "20260710_030000", i, f"w{i}", None) for s in ("i0", "rag") for i in range(3)]
    df = spark.createDataFrame(rows, "model string, scenario string, task string, stamp string, idx long, workflow string, error string")
    S.write_predictions(df.withColumn("workflow", F.lit("first try")), str(tmp_path / "p"))
    S.write_predictions(df.where("scenario = 'rag'"), str(tmp_path / "p"))
    back = {(r["scenario"], r["idx"]): r["workflow"] for r in S.read_predictions(spark, str(tmp_path / "p")).collect()}
    assert back == {(s, i): f"w{i}" if s == "rag" else "first try" for s in ("i0", "rag") for i in range(3)}
    assert S.read_predictions(spark, str(tmp_path / "p")).count() == 6


def test_newest_files_win_over_greater_stamps(spark):
    df = spark.createDataFrame(
        [("m", "t", "i0", "20260101_000000", 5), ("m", "t", "i0", "20250101_000000", 9), ("m", "t", "i0", None, 11), ("m", "t", "rag", None, 1)],
        "model string, task string, scenario string, stamp string, modified long")
    by_time = {(r["scenario"], r["stamp"]) for r in runs.latest_predictions(df, newest_by="modified").collect()}
    assert by_time == {("i0", "20250101_000000"), ("rag", None)}
    assert {(r["scenario"], r["stamp"]) for r in runs.latest_predictions(df).collect()} == {("i0", "20260101_000000"), ("rag", None)}


def test_result_files_and_summary(spark, tmp_path):
    results = spark.createDataFrame(
        [('a"b', "rag", "t", "node", 0.25, 0.5, 1 / 3, 4, 2, 1, 1)],
        "model string, scenario string, task string, eval_type string, precision double, recall double, "
        "f1_score double, n_total long, n_evaluated long, n_skipped_unparseable long, n_skipped_runtime long")
    S.write_result_files(results.withColumn("model", F.lit("a")), str(tmp_path))
    S.write_result_files(results.withColumn("model", F.lit("a")), str(tmp_path))
    (back,) = S.read_result_files(spark, str(tmp_path)).collect()
    assert (back["model"], back["scenario"], back["task"], back["eval_type"], back["f1_score"], back["eval_device"]) == (
        "a", "rag", "t", "node", 1 / 3, "cpu")
    # The layout of others: an indented object in a plain file.
    put(tmp_path / "b" / "t" / "sft_rag_graph.json", json.dumps({"precision": 1.0, "recall": 0.5, "f1_score": 0.6, "n_total": 2}, indent=4))
    other = S.read_result_files(spark, str(tmp_path)).where("model = 'b'").first()
    assert (other["scenario"], other["eval_type"], other["n_total"], other["n_evaluated"]) == ("sft_rag", "graph", 2, None)
    models = spark.createDataFrame([('a"b', ["i0", "rag"])], "model string, scenarios array<string>")
    matrix = scenarios.evaluation_matrix(scenarios.matrix_cells(models, ["t"], ["node"]), results)
    told = json.loads(S.summary_json(matrix).first()["summary"])
    assert told["models"]['a"b']["rag"]["t"]["node"]["n_total"] == 4
    assert told["models"]['a"b']["i0"]["t"]["node"] == {"status": "pending", "expected_output": 'eval_results/a"b/t/i0_node.json'}


def test_training_set_as_arrays(spark, tmp_path):
    rows = [(i, [("user", f"q{i}"), ("assistant", None)]) for i in range(5)] + [(9, [])]
    df = spark.createDataFrame(rows, "idx long, messages array<struct<role:string,content:string>>")
    stats = spark.createDataFrame([(1,)], "total long")
    S.write_sft(df, stats, str(tmp_path), "array", order=["idx"])
    texts = [json.loads(p.read_text()) for p in (tmp_path / "set").rglob("*.txt")]
    assert [m["messages"][0]["content"] for m in texts[0][:5]] == [f"q{i}" for i in range(5)]
    back = S.read_sft(spark, str(tmp_path), "array").collect()
    assert sorted(r["messages"][0]["content"] for r in back) == [f"q{i}" for i in range(5)]
    assert {r["messages"][1]["content"] for r in back} == {""}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(50)], "idx long, t string")
    def of(x):
        return tuple(S.corpus_fingerprint(x, ["idx", "t"]).first())
    assert of(df) == of(df.orderBy(F.desc("idx")).repartition(7))
    assert of(df) != of(df.fillna("")) != of(df.filter("idx > 1"))
    empty, n = of(df.limit(0))
    assert len(empty) == 64 and n == 0


def test_missing_index_and_staleness(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_index(spark, str(tmp_path / "none"))
    records = spark.createDataFrame(
        [("b", 1, "t", "t", "w", None, [1.0, 0.0]), ("a", 0, "u", "u", "v", "s", [0.0, 2.0])],
        "id string, index long, text string, user string, workflow string, source string, embedding array<float>")
    S.write_index(records, str(tmp_path / "ix"), "f1")
    stored, meta = S.read_index(spark, str(tmp_path / "ix"))
    assert [(r["id"], r["norm"]) for r in stored.orderBy("id").collect()] == [("a", 2.0), ("b", 1.0)]
    assert meta.first()["num_vectors"] == 2
    now = spark.createDataFrame([("f1",)], "fingerprint string")
    new = spark.createDataFrame([("f2",)], "fingerprint string")
    assert S.index_staleness(now, meta).first()["is_stale"] is False
    assert S.index_staleness(new, meta).first()["reason"] == "train set changed"
    assert S.index_staleness(now, meta, force=True).first()["is_stale"] is True
    assert S.index_staleness(now, None).first()["reason"] == "absent"


def test_one_failing_prompt_does_not_stop_the_run(spark):
    rows = [(i, "toy", [("system", ""), ("user", u)]) for i, u in enumerate(["ok1", "fail", "ok2", "blank"])]
    prompts = spark.createDataFrame(
        rows, "idx long, task string, messages array<struct<role:string,content:string>>")

    def load():
        def generate(messages, model, finetuned):
            if messages[1]["content"] == "fail":
                raise RuntimeError("boom")
            return "  " if messages[1]["content"] == "blank" else f" {model}/{finetuned} \n"
        return generate

    got = prediction.batch_predict(prompts, ["task", "idx"], load, model="m", finetuned=True).orderBy("idx").collect()
    assert [r["workflow"] for r in got] == ["m/True", "", "m/True", ""]
    assert got[1]["error"] == "RuntimeError: boom" and got[0]["error"] is None
    counts = prediction.skip_counts(spark.createDataFrame(got)).collect()
    assert [tuple(r) for r in counts] == [("toy", 2)]


def test_matrix_has_pending_cells(spark):
    models = spark.createDataFrame([("a", None), ("base", ["i0"])], "model string, scenarios array<string>")
    cells = scenarios.matrix_cells(models, ["t"], ["node"])
    assert {(r["model"], r["scenario"]) for r in cells.collect()} == {
        ("a", "i0"), ("a", "rag"), ("a", "sft"), ("a", "sft_rag"), ("base", "i0")}
    results = spark.createDataFrame(
        [("a", "rag", "t", "node", 0.5, 0.5, 0.5, 2, 2, 0, 0)],
        "model string, scenario string, task string, eval_type string, precision double, recall double, "
        "f1_score double, n_total long, n_evaluated long, n_skipped_unparseable long, n_skipped_runtime long")
    matrix = scenarios.evaluation_matrix(cells, results)
    assert {r["status"] for r in matrix.collect()} == {"pending", "done"}
    wide = {r["model"]: r for r in scenarios.pivot_matrix(matrix).collect()}
    assert wide["a"]["rag"] == 0.5 and wide["a"]["i0"] is None


def test_eval_results_and_file_fingerprints(spark, tmp_path):
    import hashlib

    rows = [("a", "rag", "t", "node", 0.5), ("a", "i0", "t", "node", 0.25)]
    df = spark.createDataFrame(rows, "model string, scenario string, task string, eval_type string, f1_score double")
    S.append_results(df, str(tmp_path / "r"))
    S.append_results(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    put(tmp_path / "f" / "train.json", "x" * 3_000_000)
    got = S.file_fingerprints(spark, str(tmp_path / "f")).first()["sha256"]
    assert got == hashlib.sha256(b"x" * 3_000_000).hexdigest()


def test_fingerprint_tells_field_borders(spark):
    def of(*rows):
        return S.corpus_fingerprint(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]).first()["fingerprint"]

    assert of(("a\x1fvb", "c")) != of(("a", "b\x1fvc"))
    assert of(("x", "y"), ("x", "y")) != of(("z", "y"), ("z", "y"))


def encoder(seen):
    """Hash vectors; ``seen`` gets the texts that each run embeds."""

    def encode(df):
        seen.append(sorted(str(r["text"]) for r in df.select("text").collect()))
        return embedding.with_hash_embedding(df, "text")

    return encode


def test_index_embeds_only_what_is_new(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []
    rows = [("a", 0, "one two"), ("b", 1, "one two"), ("c", 2, ""), ("d", 3, None), ("e", 4, "n")]
    schema = "id string, index long, text string"
    with pytest.raises(FileNotFoundError):
        vector_store.read(spark, path)
    first = vector_store.refresh(spark.createDataFrame(rows, schema), path, "f1", encoder(seen)).first()
    assert (first["version"], first["num_vectors"], first["n_texts"], first["n_embedded"]) == (1, 5, 4, 4)
    assert seen == [["", "None", "n", "one two"]]  # a null text is not the text "n"

    rows = rows[1:] + [("f", 5, "three"), ("a", 6, "three")]
    vector_store.refresh(spark.createDataFrame(rows, schema), path, "f2", encoder(seen))
    assert seen[1:] == [["three"]]
    stored, meta = vector_store.read(spark, path)
    assert sorted((r["id"], r["index"], r["text"]) for r in stored.collect()) == sorted(rows)
    fresh = embedding.with_hash_embedding(stored, "text", "fresh")
    assert fresh.where("embedding = CAST(fresh AS array<float>)").count() == len(rows)
    assert S.index_staleness(spark.createDataFrame([("f2",)], "fingerprint string"), meta).first()["is_stale"] is False
    # The first version is still there as it was.
    old, _ = vector_store.read(spark, path, 1)
    assert {r["id"] for r in old.collect()} == set("abcde")
    # Texts that come back, and an encoder that comes back, embed nothing anew.
    again = [("a", 0, "one two")]
    vector_store.refresh(spark.createDataFrame(again, schema), path, "f3", encoder(seen), embedding_model="it's other")
    vector_store.refresh(spark.createDataFrame(again, schema), path, "f4", encoder(seen))
    assert seen[2:] == [["one two"], []]
    assert vector_store.read(spark, path)[1].first()["version"] == 4
    # No records at all.
    assert vector_store.refresh(spark.createDataFrame([], schema), path, "f5", encoder(seen)).first()["num_vectors"] == 0
    assert vector_store.read(spark, path)[0].count() == 0


def test_index_of_a_failed_run_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")

    def broken(df):
        return df.withColumn("embedding", F.expr("array(CAST(raise_error('no encoder') AS float))"))

    def records(*texts):
        return spark.createDataFrame([(t, n, t) for n, t in enumerate(texts)], "id string, index long, text string")

    vector_store.refresh(records("x"), path, "f1", encoder([]))
    with pytest.raises(Exception, match="no encoder"):
        vector_store.refresh(records("x", "y"), path, "f2", broken)
    assert [r["id"] for r in vector_store.read(spark, path)[0].collect()] == ["x"]
    # A run that died while it wrote its row leaves a folder without one.
    (tmp_path / "store" / "manifest" / "version=2" / "_temporary").mkdir(parents=True)
    assert vector_store.refresh(records("x", "y"), path, "f2", encoder([])).first()["version"] == 2
    # Another run's version is left alone.
    row = vector_store.manifests(spark, path).where("version = 2").drop("version")
    with pytest.raises(RuntimeError):
        vector_store._commit(row, path, 2)
    assert vector_store.manifests(spark, path).where("version = 2").count() == 1


def test_index_folds_its_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in range(5):
        made = spark.createDataFrame([(str(i), i, f"t{i}") for i in range(n, n + 2)], "id string, index long, text string")
        meta = vector_store.refresh(made, path, "f", encoder([]), most_batches=2).first()
        assert len(meta["batches"]) <= 2
        stored = vector_store.read(spark, path)[0]
        fresh = embedding.with_hash_embedding(stored, "text", "fresh")
        assert fresh.where("embedding = CAST(fresh AS array<float>)").count() == 2

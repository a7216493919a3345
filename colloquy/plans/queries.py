"""Every operator as a query over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.functions import text as X
from colloquy.operators import (
    budget,
    conversations as C,
    corpus as R,
    embedding,
    evaluation,
    prediction,
    prompts,
    runs,
    scenarios,
    scoring,
    similarity,
    training,
    workflows,
)
from colloquy.plans import tables as G
from colloquy.session import materialize, scratch_dir
from colloquy.sources import answer_store, json_items, tables as S, vector_store

Query = Callable[[SparkSession, str], DataFrame]

BUDGET = 500
WORD_BUDGET = 300
SFT_LENGTH = 1_500
TOP_K = 2
CONV = ["conv_id"]
WF = G.WORKFLOW_KEYS


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


# --- sources and sinks ------------------------------------------------------


def _flat_items(items: DataFrame, *keys: str) -> DataFrame:
    chat = X.first_non_empty(F.col("conversations"), F.col("messages"))
    return items.select(
        *keys,
        "id",
        "source",
        "task_type",
        F.size(chat).cast("long").alias("n_messages"),
        F.md5(X.plain_text(chat)).alias("text_md5"),
    )


def scan_train(spark, sf_dir):
    return _flat_items(json_items.read_train(spark, G.train_files(spark, sf_dir)), "idx")


def scan_gold_tasks(spark, sf_dir):
    return _flat_items(
        json_items.read_gold(spark, G.gold_files(spark, sf_dir)), "task", "idx"
    )


def task_counts(spark, sf_dir):
    path = G.gold_files(spark, sf_dir)
    # One more task whose file is an empty list.
    G.read(spark, sf_dir, "documents", "doc_id").agg(F.lit("[]").alias("value")).write.text(
        f"{path}/task=nothing/file=graph_eval.json/shard=0"
    )
    return json_items.task_counts(spark, path).select("task", long("n_items"))


def predictions_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "predictions")
    S.write_predictions(G.predictions(spark, sf_dir), path)
    return S.read_predictions(spark, path).select(
        "model", "scenario", "task", "stamp", "idx", F.md5("workflow").alias("workflow_md5"), "error"
    )


def predictions_rerun(spark, sf_dir):
    """The given runs written twice, the second time as after a failure."""
    path = scratch_dir(spark, "predictions")
    given = materialize(G.predictions(spark, sf_dir), "runs")
    S.write_predictions(given.where("idx % 3 = 0").withColumn("workflow", F.lit("half done")), path)
    S.write_predictions(given, path)
    return S.read_predictions(spark, path).select(
        "model", "scenario", "task", "stamp", "idx", F.md5("workflow").alias("workflow_md5"), "error"
    )


def predictions_export(spark, sf_dir):
    """The runs as array files, model-c without stamps, exported twice and read again; then
    the newest of each by the time of its files."""
    path = scratch_dir(spark, "export")
    items = G.doc_items(spark, sf_dir).select(
        G.one_of(scenarios.TASKS, F.col("doc_id")).alias("task"), F.col("doc_id").alias("idx"),
        "id", "source", "task_type", "conversations", "messages",
    )
    answers = items.select(
        G.one_of(G.MODELS, F.expr("idx div 7")).alias("model"), F.lit("rag").alias("scenario"), "task",
        F.when(F.expr("idx div 7") % 3 < 2, G.STAMP).alias("stamp"), "idx",
        F.when(F.col("idx") % 10 > 0, F.concat(F.lit('\\"{'), F.col("idx").cast("string"))).alias("workflow"),
    )
    for _ in range(2):
        S.export_predictions(answers, items, path, per_file=G.SHARD_ITEMS)
    found = runs.latest_predictions(json_items.read_prediction_files(spark, path), newest_by="modified")
    return found.select(
        "model", "scenario", "task", "stamp", "idx", F.col("query")["id"].alias("query_id"),
        F.col("query")["source"].alias("query_source"), "workflow",
    )


def scan_prediction_files(spark, sf_dir):
    found = json_items.read_prediction_files(spark, G.prediction_files(spark, sf_dir))
    return found.select(
        "model", "scenario", "task", "stamp", "idx",
        F.col("query")["id"].alias("query_id"), F.md5("workflow").alias("workflow_md5"),
    )


def _stored_predictions(spark, sf_dir, labels: DataFrame | None = None) -> DataFrame:
    path = scratch_dir(spark, "predictions")
    S.write_predictions(G.stored_predictions(spark, sf_dir, labels), path)
    return S.read_predictions(spark, path)


def latest_predictions(spark, sf_dir):
    return runs.latest_predictions(_stored_predictions(spark, sf_dir)).select(
        "model", "scenario", "task", "stamp", "idx", F.md5("workflow").alias("workflow_md5")
    )


def scenario_from_path(spark, sf_dir):
    name = runs.file_name(F.col("path"))
    return G.runs(spark, sf_dir).select(
        "event_id",
        "path",
        runs.scenario_of(name).alias("scenario"),
        runs.stamp_of(name).alias("stamp"),
    )


def latest_run(spark, sf_dir):
    return runs.latest_runs(
        G.runs(spark, sf_dir).select("model", "task", "scenario", "stamp", "path")
    )


def _corpus_turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    idx = F.col("conv_id").alias("idx")
    turns = G.turns(spark, sf_dir).select(idx, "turn", "role", "content")
    headers = G.headers(spark, sf_dir).select(idx, "id", "source", "task_type")
    return turns, headers


def _corpus(spark, sf_dir) -> DataFrame:
    return R.retrieval_corpus(*_corpus_turns(spark, sf_dir))


def _fingerprint(spark, sf_dir) -> DataFrame:
    turns = G.turns(spark, sf_dir)
    return S.corpus_fingerprint(turns, ["conv_id", "turn", "role", "content"])


def index_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "index")
    records = embedding.with_hash_embedding(_corpus(spark, sf_dir), "text")
    S.write_index(records, path, _fingerprint(spark, sf_dir).first()["fingerprint"])
    stored, meta = S.read_index(spark, path)
    one = F.lit(1).alias("_one")
    return (
        stored.select("*", one)
        .join(meta.select(one, "embedding_model", "top_k", "num_vectors", "fingerprint"), "_one")
        .select(
            "id", "index", "source",
            F.md5("text").alias("text_md5"),
            F.md5("workflow").alias("workflow_md5"),
            F.size("embedding").cast("long").alias("dim"),
            F.round("norm", 4).alias("norm"),
            "embedding_model", "top_k", "num_vectors", "fingerprint",
        )
    )


def index_refresh(spark, sf_dir):
    """Three versions of one index: all records; a hundredth of them with other texts; the
    same again. Per version the texts embedded, and the records read back whose vector is
    that of their text."""
    path = scratch_dir(spark, "store")
    corpus = materialize(_corpus(spark, sf_dir), "corpus")
    revised = F.when(F.col("index") % 100 == 7, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    changed = corpus.withColumn("text", revised)

    def encode(df: DataFrame) -> DataFrame:
        return embedding.with_hash_embedding(df, "text")

    def told(version: int) -> DataFrame:
        stored, meta = vector_store.read(spark, path, version)
        fresh = embedding.with_hash_embedding(stored, "text", "fresh")
        right = F.col("embedding") == F.col("fresh").cast("array<float>")
        seen = fresh.agg(
            F.count_if(right).alias("n_right"), F.count_if(F.col("text").endswith(" revised")).alias("n_revised")
        )
        one = F.lit(1).alias("_one")
        return meta.select(one, "version", "num_vectors", "n_texts", "n_embedded").join(
            seen.select(one, "n_right", "n_revised"), "_one"
        ).drop("_one")

    for version, records in enumerate((corpus, changed, changed), 1):
        vector_store.refresh(records, path, f"state-{version}", encode)
    return told(1).union(told(2)).union(told(3))


def corpus_fingerprint(spark, sf_dir):
    docs = G.read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return S.corpus_fingerprint(docs, ["doc_id", "text", "lang", "source"])


def index_staleness(spark, sf_dir):
    """An unchanged set, a changed one, another encoder, a forced build, no index."""
    path = scratch_dir(spark, "index")
    now = _fingerprint(spark, sf_dir)
    records = embedding.with_hash_embedding(_corpus(spark, sf_dir), "text")
    S.write_index(records, path, now.first()["fingerprint"])
    _, meta = S.read_index(spark, path)
    changed = S.corpus_fingerprint(
        G.turns(spark, sf_dir).withColumn("content", F.concat("content", F.lit("!"))),
        ["conv_id", "turn", "role", "content"],
    )

    def case(name: str, report: DataFrame) -> DataFrame:
        return report.select(F.lit(name).alias("case"), "is_stale", "reason", "fingerprint")

    return (
        case("same", S.index_staleness(now, meta))
        .union(case("changed", S.index_staleness(changed, meta)))
        .union(case("encoder", S.index_staleness(now, meta, embedding_model="other")))
        .union(case("forced", S.index_staleness(now, meta, force=True)))
        .union(case("absent", S.index_staleness(now, None)))
    )


def _stats_row(stats: DataFrame) -> DataFrame:
    return stats.select(
        *[long(c) for c in ("total", "kept", "dropped", "truncated", "full", "max_tokens")],
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("outcomes")),
                lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
            ),
            ",",
        ).alias("outcomes"),
        "tokenizer",
        r6("drop_pct"),
    )


def _write_sft(spark, sf_dir) -> str:
    path = scratch_dir(spark, "sft")
    turns = G.turns(spark, sf_dir)
    fitted = budget.fit_budget(turns, CONV, BUDGET)
    S.write_sft(
        budget.sft_dataset(turns, CONV, BUDGET),
        budget.budget_stats(fitted, BUDGET),
        path,
    )
    return path


def sft_sink(spark, sf_dir):
    """What the sink wrote: the set's text digests and sizes."""
    return S.read_sft(spark, _write_sft(spark, sf_dir)).select(
        F.md5(X.plain_text(F.col("messages"))).alias("text_md5"),
        F.size("messages").cast("long").alias("n_messages"),
    )


def sft_reload(spark, sf_dir):
    """Items with null contents and empty message lists, reloaded."""
    no_text = F.transform(
        "messages",
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(m["role"] != "system", m["content"]).alias("content"),
        ),
    )
    records = G.doc_items(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<struct<role:string,content:string>>")).otherwise(no_text).alias("messages")
    )
    return S.reload_messages(records).select(
        "doc_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.md5(X.plain_text(F.col("messages"))).alias("text_md5"),
    )


def run_metadata(spark, sf_dir):
    path = scratch_dir(spark, "runs")
    rows = runs.run_metadata(
        G.predictions(spark, sf_dir), "2025-03-14T09:26:53+00:00", "2025-03-14T10:41:00+00:00"
    )
    S.append_runs(rows, path)
    skipped = F.map_values("skipped_errors")
    return S.read_runs(spark, path).select(
        "model", "stamp", "started_at", "finished_at", "finetuned", "rag", "limit",
        F.array_join("tasks", ",").alias("tasks"),
        F.aggregate(skipped, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_skipped"),
        F.array_join(F.array_sort(F.map_keys("skipped_errors")), ",").alias("skipped_tasks"),
        F.array_join(F.array_sort(F.map_values("predictions")), ",").alias("predictions"),
    )


# --- conversations ----------------------------------------------------------


def conv_assemble(spark, sf_dir):
    return C.select_field(G.field_turns(spark, sf_dir), CONV, prefer="messages")


def role_normalize(spark, sf_dir):
    return C.normalize_roles(G.alias_turns(spark, sf_dir))


def _part(name: str) -> Query:
    def query(spark, sf_dir):
        parts = C.conversation_parts(G.alias_turns(spark, sf_dir), CONV)
        return parts.select("conv_id", name)

    return query


def example_text(spark, sf_dir):
    parts = C.conversation_parts(G.turns(spark, sf_dir), CONV)
    both = R.example_texts(parts, CONV, ["workflow", "unknown", "query"])
    query = R.example_texts(parts, CONV, ["query"]).withColumnRenamed("text", "query_text")
    return both.join(query, CONV)


def rag_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir)


def rag_corpus_legacy(spark, sf_dir):
    return R.retrieval_corpus_plain_ids(*_corpus_turns(spark, sf_dir))


def limit_per_task(spark, sf_dir):
    gold = G.headers(spark, sf_dir).select(
        "conv_id",
        G.one_of(scenarios.TASKS, F.col("conv_id")).alias("task"),
        F.expr("conv_id div 7").alias("idx"),
    )
    return C.limit_per_task(gold, 5)


# --- retrieval and prompts --------------------------------------------------


def hash_embed(spark, sf_dir):
    docs = G.read(spark, sf_dir, "documents", "doc_id", "text")
    return (
        embedding.with_hash_embedding(docs, "text")
        .select("doc_id", F.posexplode("embedding").alias("dim", "weight"))
        .filter(F.col("weight") > 0)
        .select("doc_id", long("dim"), r6("weight"))
    )


def _vectors_topk(spark, sf_dir, exclude: bool = False, **options) -> DataFrame:
    vec = G.read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    barred = F.array(F.col("vec_id"), F.col("vec_id") + 1)
    return similarity.topk_cosine(
        vec.withColumn("exclude", barred) if exclude else vec,
        vec,
        5,
        query_id="vec_id",
        record_id="vec_id",
        exclude="exclude" if exclude else None,
        **options,
    ).select("vec_id", long("rank"), "record_id", r6("score"))


def topk_cosine(spark, sf_dir):
    return _vectors_topk(spark, sf_dir)


def topk_exclude(spark, sf_dir):
    return _vectors_topk(spark, sf_dir, exclude=True)


def topk_scan_corpus(spark, sf_dir):
    return _vectors_topk(spark, sf_dir, strategy="broadcast_queries")


def topk_blocked(spark, sf_dir):
    return _vectors_topk(
        spark, sf_dir, exclude=True, strategy="blocked", block_rows=512, pivots=32
    )


def _parts(spark, sf_dir) -> DataFrame:
    return materialize(C.conversation_parts(G.turns(spark, sf_dir), CONV), "parts")


def _hits(spark, sf_dir, corpus: DataFrame, parts: DataFrame) -> DataFrame:
    """Each conversation's nearest records other than its own."""
    own = G.headers(spark, sf_dir).select(
        "conv_id",
        F.array(
            F.concat_ws(
                "::",
                F.coalesce("source", F.lit("unknown")),
                F.coalesce("id", F.col("conv_id").cast("string")),
            )
        ).alias("own"),
    )
    queries = embedding.with_hash_embedding(parts.select("conv_id", "user").join(own, CONV), "user")
    records = embedding.with_hash_embedding(corpus.select("id", "index", "text"), "text")
    return similarity.topk_cosine(
        queries, records, TOP_K, query_id="conv_id", record_key="index", exclude="own"
    )


def _blocks(spark, sf_dir, parts: DataFrame, separator: str = "\n") -> DataFrame:
    corpus = materialize(_corpus(spark, sf_dir), "corpus")
    return prompts.few_shot_blocks(_hits(spark, sf_dir, corpus, parts), corpus, CONV, separator)


def fewshot_block(spark, sf_dir):
    return _blocks(spark, sf_dir, _parts(spark, sf_dir))


def _flat_prompt(df: DataFrame) -> DataFrame:
    def part(i: int, field: str) -> Column:
        return F.col("messages")[i][field]

    return df.select(
        "conv_id",
        part(0, "role").alias("role_1"),
        part(0, "content").alias("content_1"),
        part(1, "role").alias("role_2"),
        part(1, "content").alias("content_2"),
    )


def prompt_base(spark, sf_dir):
    parts = C.conversation_parts(G.turns(spark, sf_dir), CONV)
    return _flat_prompt(prompts.build_prompts(parts, CONV))


def prompt_rag(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    blocks = _blocks(spark, sf_dir, parts)
    return _flat_prompt(prompts.build_prompts(parts, CONV, use_rag=True, blocks=blocks))


def prompt_joined(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    blocks = _blocks(spark, sf_dir, parts, separator="\n\n")
    return _flat_prompt(
        prompts.build_prompts(parts, CONV, use_rag=True, blocks=blocks, layout="joined")
    )


def prompt_inject(spark, sf_dir):
    blocks = _blocks(spark, sf_dir, _parts(spark, sf_dir))
    return prompts.inject_block(G.turns(spark, sf_dir), blocks, CONV)


# --- token budget and training set ------------------------------------------


def plain_text(spark, sf_dir):
    return C.plain_lines(G.turns(spark, sf_dir), CONV)


def token_estimate(spark, sf_dir):
    sized = C.plain_chars(G.turns(spark, sf_dir), CONV)
    return sized.withColumn("tokens", X.estimate_tokens(F.col("n_chars")))


def budget_fit(spark, sf_dir):
    return budget.fit_budget(G.turns(spark, sf_dir), CONV, BUDGET).select(
        "conv_id", long("n_turns"), "tag", "n_dropped", "tokens_before", "tokens_after"
    )


def budget_messages(spark, sf_dir):
    turns = G.turns(spark, sf_dir)
    return budget.kept_turns(turns, CONV, budget.fit_budget(turns, CONV, BUDGET))


def budget_outcomes(spark, sf_dir):
    return budget.outcomes(budget.fit_budget(G.turns(spark, sf_dir), CONV, BUDGET))


def budget_stats(spark, sf_dir):
    fitted = budget.fit_budget(G.turns(spark, sf_dir), CONV, BUDGET)
    return _stats_row(budget.budget_stats(fitted, BUDGET))


def sft_dataset(spark, sf_dir):
    # The set is used three times below: written once, then read.
    turns = materialize(
        C.select_field(G.field_turns(spark, sf_dir), CONV, prefer="messages"), "turns"
    )
    return budget.sft_dataset(turns, CONV, BUDGET).select(
        "conv_id",
        "tag",
        F.size("messages").cast("long").alias("n_messages"),
        X.plain_text(F.col("messages")).alias("text"),
    )


def _word_tokenizer():
    """A tokenizer SQL can restate: words between ASCII blanks."""
    word = re.compile(r"[^ \t-\r]+")

    def count(text: str) -> int:
        return len(word.findall(text))

    count.joins = lambda left, right: 0  # a newline is a blank
    return count


def sft_dataset_tokenizer(spark, sf_dir):
    turns = materialize(
        C.select_field(G.field_turns(spark, sf_dir), CONV, prefer="messages"), "turns"
    )
    fitted = materialize(
        budget.fit_budget_with_tokenizer(turns, CONV, WORD_BUDGET, _word_tokenizer), "fitted"
    )
    return budget.sft_dataset(turns, CONV, fitted=fitted).select(
        "conv_id",
        "tag",
        F.size("messages").cast("long").alias("n_messages"),
        X.plain_text(F.col("messages")).alias("text"),
    )


def _examples(spark, sf_dir) -> DataFrame:
    dataset = budget.sft_dataset(G.turns(spark, sf_dir), CONV, BUDGET)
    return training.masked_examples(dataset, CONV, SFT_LENGTH)


def _flat_examples(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "conv_id",
        *extra,
        F.size("input_ids").cast("long").alias("n_ids"),
        F.array_join("input_ids", ",").alias("input_ids"),
        F.array_join("attention_mask", ",").alias("attention_mask"),
        F.array_join("labels", ",").alias("labels"),
    )


def masked_examples(spark, sf_dir):
    kept = F.col("reason") == "kept"
    return _flat_examples(_examples(spark, sf_dir), "reason").withColumn(
        "n_ids", F.when(kept, F.col("n_ids"))
    )


def _load_letters():
    """One id per character, told with its place."""

    def encode(text: str) -> tuple[list[int], range]:
        return [ord(c) for c in text], range(len(text))

    encode.cuts = lambda left, right: True
    return encode


def masked_examples_once(spark, sf_dir):
    dataset = budget.sft_dataset(G.turns(spark, sf_dir), CONV, BUDGET)
    examples = training.masked_examples_encoded_once(dataset, CONV, SFT_LENGTH, _load_letters)
    return _flat_examples(examples, "reason").withColumn(
        "n_ids", F.when(F.col("reason") == "kept", F.col("n_ids"))
    )


def mask_report(spark, sf_dir):
    return training.mask_report(_examples(spark, sf_dir))


def pad_examples(spark, sf_dir):
    kept = _examples(spark, sf_dir).filter(F.col("reason") == "kept")
    return _flat_examples(training.pad_examples(kept, 0))


# --- prediction -------------------------------------------------------------


def predict_nn_copy(spark, sf_dir):
    corpus = materialize(_corpus(spark, sf_dir), "corpus")
    hits = _hits(spark, sf_dir, corpus, _parts(spark, sf_dir))
    return prediction.copy_nearest(hits, corpus, G.headers(spark, sf_dir), "conv_id")


def _load_echo():
    """A deterministic generator that fails on some prompts."""

    def echo(messages: list[dict[str, str]], model: str, finetuned: bool) -> str:
        user = messages[-1]["content"]
        if len(user) % 7 == 0:
            raise ValueError("unlucky length")
        return "" if len(user) % 7 == 1 else f" {model}: {user}\n"

    return echo


def _echoed(spark, sf_dir) -> DataFrame:
    parts = C.conversation_parts(G.turns(spark, sf_dir), CONV)
    return prediction.batch_predict(
        prompts.build_prompts(parts, CONV), CONV, _load_echo, model="model-a", finetuned=False
    )


def predict_fail_isolated(spark, sf_dir):
    return _echoed(spark, sf_dir)


def skip_counts(spark, sf_dir):
    task = G.one_of(scenarios.TASKS, F.col("conv_id"))
    return prediction.skip_counts(_echoed(spark, sf_dir).withColumn("task", task))


def predict_resume(spark, sf_dir):
    """A run over even conversations, then one over all that goes on from it; per
    conversation its answer, the run that made it and how many answers that run made."""
    parts = _parts(spark, sf_dir)
    asked = materialize(prompts.build_prompts(parts, CONV), "prompts")
    path = scratch_dir(spark, "answers")
    run = {"model": "model-a", "finetuned": False, "slices": 4}
    answer_store.predict_rest(asked.where("conv_id % 2 = 0"), CONV, path, _load_echo, run="first", **run)
    answer_store.predict_rest(asked, CONV, path, _load_echo, run="second", retry_failed=False, **run)
    # Nothing is left for a third.
    found = answer_store.predict_rest(asked, CONV, path, _load_echo, run="third", retry_failed=False, **run)
    made = answer_store.read_answers(spark, path).groupBy("run").agg(F.count("*").alias("n_made"))
    return found.join(F.broadcast(made), "run")


# --- evaluation -------------------------------------------------------------


def _parsed(spark, sf_dir) -> DataFrame:
    pairs = G.workflow_pairs(spark, sf_dir)
    return workflows.with_graph(pairs, "pred_workflow", "pred")


def workflow_nodes(spark, sf_dir):
    return workflows.explode_nodes(_parsed(spark, sf_dir), WF, "pred_nodes").select(
        *WF, long("pos"), "no", "label"
    )


def workflow_edges(spark, sf_dir):
    return workflows.explode_edges(
        _parsed(spark, sf_dir), WF, "pred_nodes", "pred_edges"
    ).select(*WF, long("pos"), "src", "dst", "is_self_loop", "ends_known")


def _prepared(spark, sf_dir) -> DataFrame:
    return evaluation.prepare(G.workflow_pairs(spark, sf_dir))


def node_match(spark, sf_dir):
    return workflows.explode_matches(_prepared(spark, sf_dir), WF).select(
        *WF, long("pred_pos"), long("gold_pos")
    )


def _load_label_encoder():
    """The hashing encoder for lists of labels."""
    import pyarrow as pa

    def encode(labels: list[str]):
        return embedding.unit_counts(pa.array(labels)).flatten().to_numpy().reshape(len(labels), -1)

    return encode


def node_match_similarity(spark, sf_dir):
    def match(df: DataFrame) -> DataFrame:
        return scoring.match_by_similarity(df, _load_label_encoder, threshold=0.6)

    prepared = evaluation.prepare(G.workflow_pairs(spark, sf_dir), match)
    return workflows.explode_matches(prepared, WF).select(
        *WF, long("pred_pos"), long("gold_pos")
    )


def _score_columns(df: DataFrame) -> DataFrame:
    return df.select(*WF, "status", r6("precision"), r6("recall"), r6("f1_score"))


def chain_score(spark, sf_dir):
    return _score_columns(scoring.chain_score(_prepared(spark, sf_dir)))


def chain_score_any_order(spark, sf_dir):
    return _score_columns(scoring.chain_score(_prepared(spark, sf_dir), order="any"))


def _branching(spark, sf_dir) -> DataFrame:
    return evaluation.prepare(G.branching_pairs(spark, sf_dir))


def branching_edges(spark, sf_dir):
    parsed = workflows.with_graph(G.branching_pairs(spark, sf_dir), "pred_workflow", "pred")
    return workflows.explode_edges(parsed, WF, "pred_nodes", "pred_edges").select(
        *WF, long("pos"), "src", "dst", "is_self_loop", "ends_known"
    )


def branching_levels(spark, sf_dir):
    parsed = workflows.with_graph(G.branching_pairs(spark, sf_dir), "gold_workflow", "gold")
    # The outer form, as in workflows: the inner one would peel every graph twice.
    levels = scoring.with_levels(parsed).select(
        *WF, "gold_cyclic", F.posexplode_outer("gold_levels").alias("pos", "level")
    )
    return levels.where("pos IS NOT NULL").select(
        *WF, (F.col("pos") + 1).cast("long").alias("pos"), long("level"), F.col("gold_cyclic").alias("is_cyclic")
    )


def branching_chain(spark, sf_dir):
    """Node scores in any order that the gold edges allow, beside those in listed order."""
    rows = materialize(_branching(spark, sf_dir), "branching")
    listed = scoring.chain_score(rows).select(*WF, F.round("f1_score", 6).alias("listed_f1"))
    return _score_columns(scoring.chain_score(rows, order="any")).join(listed, WF)


def branching_graph(spark, sf_dir):
    return _score_columns(scoring.graph_score(_branching(spark, sf_dir)))


def edge_overlap(spark, sf_dir):
    return _score_columns(scoring.edge_overlap(_prepared(spark, sf_dir)))


def graph_score(spark, sf_dir):
    return _score_columns(scoring.graph_score(_prepared(spark, sf_dir)))


def eval_status(spark, sf_dir):
    return _prepared(spark, sf_dir).select(*WF, "status")


def _results(spark, sf_dir) -> DataFrame:
    pairs = G.workflow_pairs(spark, sf_dir)
    scores = evaluation.evaluate(pairs, ["model", "scenario", "task"])
    return evaluation.aggregate(scores)


def _metrics(df: DataFrame) -> DataFrame:
    metrics = ("precision", "recall", "f1_score")
    return df.select(*[r6(c) if c in metrics else F.col(c) for c in df.columns])


def eval_aggregate(spark, sf_dir):
    return _metrics(_results(spark, sf_dir))


def _gold_and_pred(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Predictions with some null texts and some positions gold does not have."""
    pairs = materialize(G.workflow_pairs(spark, sf_dir), "pairs")
    gold = pairs.select("task", "idx", F.col("gold_workflow").alias("workflow"))
    order = F.expr("idx div 1048576")
    pred = pairs.select(
        "model",
        "scenario",
        "task",
        F.when(order % 89 == 0, F.col("idx") + 524_288).otherwise(F.col("idx")).alias("idx"),
        F.when(order % 97 != 0, F.col("pred_workflow")).alias("workflow"),
    )
    return gold, pred


def validate_inputs(spark, sf_dir):
    """Besides the given runs: one that is complete, but for a task without gold; one
    that repeats positions; and one that is expected but absent."""
    gold, pred = _gold_and_pred(spark, sf_dir)
    full = gold.select(
        F.lit("model-full").alias("model"), F.lit("i0").alias("scenario"),
        F.when(F.col("task") == "os", "untold").otherwise(F.col("task")).alias("task"), "idx", "workflow",
    )
    twice = gold.select(F.lit("model-twice").alias("model"), F.lit("i0").alias("scenario"), "task", "idx", "workflow")
    again = twice.where("idx div 1048576 % 97 = 0")
    absent = gold.select(F.lit("model-none").alias("model"), F.lit("i0").alias("scenario"), "task").distinct()
    return evaluation.validate_inputs(
        gold, pred.unionByName(full).unionByName(twice).unionByName(again), expected=absent
    )


def pair_gold_pred(spark, sf_dir):
    return evaluation.pair_gold_pred(*_gold_and_pred(spark, sf_dir)).select(
        "model", "scenario", *WF,
        F.md5("gold_workflow").alias("gold_md5"),
        F.md5("pred_workflow").alias("pred_md5"),
    )


def scenario_name(spark, sf_dir):
    """The scenario of every run, from its two flags, with the dimension's text."""
    flags = G.runs(spark, sf_dir).select(
        "event_id",
        F.col("scenario").isin("sft", "sft_rag").alias("finetuned"),
        F.col("scenario").isin("rag", "sft_rag").alias("rag"),
    )
    named = flags.withColumn("id", scenarios.scenario_name(F.col("finetuned"), F.col("rag")))
    return named.join(scenarios.scenario_dimension(spark), "id").select(
        "event_id", F.col("id").alias("scenario"), "use_rag", "use_sft_checkpoint"
    )


def _matrix(spark, sf_dir) -> DataFrame:
    cells = scenarios.matrix_cells(
        G.models(spark), scenarios.TASKS, evaluation.EVAL_TYPES
    )
    return scenarios.evaluation_matrix(cells, _results(spark, sf_dir))


def eval_matrix(spark, sf_dir):
    return _metrics(_matrix(spark, sf_dir))


def eval_results_roundtrip(spark, sf_dir):
    """Results of the runs, after worse ones of an earlier run."""
    path = scratch_dir(spark, "results")
    now = materialize(_results(spark, sf_dir).withColumn("stamp", F.lit(G.STAMP)), "results-now")
    before = now.withColumn("stamp", F.lit(G.OLD_STAMP)).withColumn("precision", F.lit(0.0))
    S.append_results(now, path)
    S.append_results(before, path)
    return _metrics(S.read_results(spark, path))


def eval_result_files(spark, sf_dir):
    """Results as JSON files, written twice, read back into the matrix."""
    path = scratch_dir(spark, "result-files")
    found = materialize(_results(spark, sf_dir), "results-now")
    S.write_result_files(found.withColumn("precision", F.lit(0.0)), path)
    S.write_result_files(found, path)
    cells = scenarios.matrix_cells(G.models(spark), scenarios.TASKS, evaluation.EVAL_TYPES)
    return _metrics(scenarios.evaluation_matrix(cells, S.read_result_files(spark, path)))


def eval_latest(spark, sf_dir):
    """Stored predictions to the matrix: newest runs, scores, stored results, cells."""
    # Gold and predictions come from one pass over the lines.
    labels = G.stored_labels(spark, sf_dir)
    gold = G.workflow_pairs(spark, sf_dir, labels).select("task", "idx", F.col("gold_workflow").alias("workflow"))
    path = scratch_dir(spark, "results")
    # An order is predicted by one model only, so no run covers the gold of its task.
    found = evaluation.evaluate_latest(gold, _stored_predictions(spark, sf_dir, labels), on_mismatch="report")
    S.append_results(found, path)
    cells = scenarios.matrix_cells(G.models(spark), scenarios.TASKS, evaluation.EVAL_TYPES)
    return _metrics(scenarios.evaluation_matrix(cells, S.read_results(spark, path)))


def eval_matrix_pivot(spark, sf_dir):
    wide = scenarios.pivot_matrix(_matrix(spark, sf_dir))
    return wide.select(
        "model", "task", "eval_type", *[r6(s) for s in scenarios.SCENARIO_IDS]
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_train, scan_gold_tasks, task_counts, predictions_roundtrip,
        predictions_rerun, predictions_export, eval_result_files,
        scan_prediction_files, latest_predictions,
        scenario_from_path, latest_run, index_roundtrip, index_refresh, corpus_fingerprint,
        index_staleness, sft_sink, sft_reload, run_metadata,
        conv_assemble, role_normalize, example_text, rag_corpus, rag_corpus_legacy,
        limit_per_task,
        hash_embed, topk_cosine, topk_exclude, topk_scan_corpus, topk_blocked,
        fewshot_block, prompt_base, prompt_rag, prompt_joined, prompt_inject,
        plain_text, token_estimate, budget_fit, budget_messages, budget_outcomes,
        budget_stats, sft_dataset, sft_dataset_tokenizer, masked_examples, masked_examples_once, mask_report, pad_examples,
        predict_nn_copy, predict_fail_isolated, skip_counts, predict_resume,
        workflow_nodes, workflow_edges, node_match, node_match_similarity, chain_score,
        chain_score_any_order, branching_edges, branching_levels, branching_chain, branching_graph, edge_overlap, graph_score, eval_status,
        eval_aggregate, validate_inputs, pair_gold_pred, scenario_name,
        eval_matrix, eval_matrix_pivot, eval_results_roundtrip, eval_latest,
    )
} | {
    "last_user": _part("user"),
    "last_assistant": _part("assistant"),
    "system_message": _part("system"),
    "gold_workflow": _part("gold_workflow"),
}

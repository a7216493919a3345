"""The given tables read as this package's inputs.

``conversations`` are turns, ``documents`` are JSON items (one item per row),
``lineitem`` with ``part`` gives workflows, ``events`` gives runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.operators.runs import run_stamp
from colloquy.operators.scenarios import SCENARIO_IDS, TASKS
from colloquy.session import FREE_SHUFFLES, materialize, passing_dir, scratch_dir, settings

MODELS = ("model-a", "model-b", "model-c")
# Items per JSON array file: large enough for several ranges to a file.
SHARD_ITEMS = 16_384
# Order numbers per prediction file. Orders are spread over some hundred runs, each a file of
# its own, and every file's name goes through the driver.
SHARD_ORDERS = 64 * SHARD_ITEMS
WORKFLOW_KEYS = ["task", "idx"]
STAMP = "20250314_092653"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def one_of(values, number: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(number, F.lit(len(values))).cast("int")]


# --- conversations ----------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


def alias_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd conversations speak as human and gpt; every 11th drops its user role."""
    role, conv = F.col("role"), F.col("conv_id")
    odd = conv % 2 == 1
    return turns(spark, sf_dir).withColumn(
        "role",
        F.when((conv % 11 == 0) & (role == "user"), F.lit(None))
        .when(odd & (role == "user"), "human")
        .when(odd & (role == "assistant"), "gpt")
        .otherwise(role),
    )


def field_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns tagged with the message field they stand in: ``messages`` (with role
    aliases) where conv_id % 4 < 2, ``conversations`` where conv_id % 4 > 0."""
    conv = F.col("conv_id")
    tagged = F.explode(
        F.when(conv % 4 == 0, F.array(F.lit("messages")))
        .when(conv % 4 == 1, F.array(F.lit("messages"), F.lit("conversations")))
        .otherwise(F.array(F.lit("conversations")))
    )
    role = (
        F.when((F.col("field") == "messages") & (F.col("role") == "user"), "human")
        .when((F.col("field") == "messages") & (F.col("role") == "assistant"), "gpt")
        .otherwise(F.col("role"))
    )
    return turns(spark, sf_dir).withColumn("field", tagged).withColumn("role", role)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; some lack an id, a source or a task type."""
    conv = F.col("conv_id")
    return (
        read(spark, sf_dir, "conversations", "conv_id")
        .distinct()
        .select(
            "conv_id",
            F.when(conv % 3 == 0, F.concat(F.lit("c"), conv.cast("string"))).alias("id"),
            F.when(conv % 4 != 0, F.concat(F.lit("src"), (conv % 5).cast("string"))).alias("source"),
            F.when(conv % 2 == 0, one_of(TASKS, conv)).alias("task_type"),
        )
    )


# --- documents as JSON items ------------------------------------------------


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system turn (the language), the first line as the question and the whole
    text as the answer; every third item uses ``messages``."""
    doc = F.col("doc_id")

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    chat = F.array(
        said("system", F.col("lang")),
        said("user", F.split("text", "\n")[0]),
        said("assistant", F.col("text")),
    )
    return read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id",
        F.when(doc % 5 != 0, doc.cast("string")).alias("id"),
        F.when(doc % 7 != 0, F.col("source")).alias("source"),
        F.col("lang").alias("task_type"),
        F.when(doc % 3 != 0, chat).alias("conversations"),
        F.when(doc % 3 == 0, chat).alias("messages"),
    )


def write_array_files(items: DataFrame, path: str, folders: list[str]) -> None:
    """JSON array files of at most ``SHARD_ITEMS`` items, in ``doc_id`` order, under
    one folder per value of ``folders`` and shard."""
    shard = F.lpad(F.expr(f"doc_id div {SHARD_ITEMS}").cast("string"), 12, "0")
    part = Window.partitionBy(*folders, "shard")
    ordered = part.orderBy("doc_id")
    body = F.to_json(F.struct("id", "source", "task_type", "conversations", "messages"))
    rows = items.select(*folders, "doc_id", shard.alias("shard"), body.alias("body")).select(
        *folders,
        "shard",
        "doc_id",
        F.concat(
            F.when(F.row_number().over(ordered) == 1, "[").otherwise(","),
            "body",
            F.when(F.row_number().over(ordered) == F.count("*").over(part), "]").otherwise(""),
        ).alias("value"),
    )
    (
        # The window has brought each shard into one task already.
        rows.sortWithinPartitions(*folders, "shard", "doc_id")
        .drop("doc_id")
        .write.partitionBy(*folders, "shard")
        .text(path)
    )


def train_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "train")
    write_array_files(doc_items(spark, sf_dir), path, [])
    return path


def gold_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "gold")
    items = doc_items(spark, sf_dir).select(
        "*", one_of(TASKS, F.col("doc_id")).alias("task"), F.lit("graph_eval.json").alias("file")
    )
    write_array_files(items, path, ["task", "file"])
    return path


# --- workflows --------------------------------------------------------------


def workflow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, labels): the part names of an order's lines in ship order; lines of one day in the
    order of their other columns.

    An order is one row in the end, so its lines meet once and are sorted inside that row.
    """
    within = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", *within).where(
        "l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL"
    )
    # A key may name several parts: a line has all their names, next to each other.
    names = read(spark, sf_dir, "part", "p_partkey", "p_name").groupBy("p_partkey").agg(
        F.sort_array(F.collect_list(F.struct("p_name"))).alias("names")
    )
    named = lines.join(names, F.col("l_partkey") == F.col("p_partkey"))
    sorted_lines = F.sort_array(F.collect_list(F.struct(*within, "names")))
    labels = F.flatten(F.transform(sorted_lines, lambda x: x["names"]["p_name"]))
    return named.groupBy(F.col("l_orderkey").alias("o")).agg(labels.alias("labels"))


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``workflow_labels`` written to the scratch folder in two steps, of which each holds
    little on disk: the parts of an order in the order of its lines, then their names. What
    puts the lines in order stays out of the way to the names, and names out of the first step."""
    within = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", *within).where(
        "l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL"
    )
    # Dealt out as they are: lists of one line, gathered before, would be larger.
    parts = lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("o")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(*within))), lambda x: x["l_partkey"]).alias("parts")
    )
    names = read(spark, sf_dir, "part", "p_partkey", "p_name")
    with passing_dir(spark, "order-parts") as path:
        with settings(spark, FREE_SHUFFLES):
            parts.write.parquet(path)
        placed = spark.read.schema(parts.schema).parquet(path).select("o", F.posexplode("parts").alias("i", "p"))
        # A key may name several parts: a line has all their names, next to each other.
        named = placed.join(names, F.col("p") == F.col("p_partkey")).select("o", F.struct("i", "p_name").alias("n"))
        labels = F.transform(F.sort_array(F.collect_list("n")), lambda x: x["p_name"])
        return materialize(named.repartition("o").groupBy("o").agg(labels.alias("labels")), "labels")


def _edges(n: Column, skip: Column) -> Column:
    """START, each node to the next, END, and where ``skip`` node 1 to node 3."""

    def edge(a: Column, b: Column) -> Column:
        return F.concat(F.lit("("), a.cast("string"), F.lit(","), b.cast("string"), F.lit(")"))

    inner = F.when(
        n > 1,
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: edge(i, i + 1)),
    ).otherwise(F.array().cast("array<string>"))
    first = F.when(n > 0, F.array(edge(F.lit("START"), F.lit(1)))).otherwise(
        F.array(edge(F.lit("START"), F.lit("END")))
    )
    last = F.when(n > 0, F.array(edge(n, F.lit("END")))).otherwise(F.array().cast("array<string>"))
    jump = F.when(skip & (n >= 3), F.array(F.lit("(1,3)"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(first, inner, last, jump)


def _workflow_text(labels: Column, edges: Column) -> Column:
    nodes = F.transform(
        labels, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)
    )
    return F.concat(
        F.lit("Node:\n"), F.array_join(nodes, "\n"),
        F.lit("\nEdge: "), F.array_join(edges, " "),
    )


def workflow_pairs(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """Gold workflows and a prediction for each, one of ten ways off by order. ``labels`` are
    those of the orders where they are known already."""
    grouped = workflow_labels(spark, sf_dir) if labels is None else labels
    o, labels = F.col("o"), F.col("labels")
    n = F.size(labels)
    skip = o % 3 == 0
    way = o % 10
    edges = _edges(n, skip)
    pred_labels = (
        F.when(way == 2, F.concat(F.slice(labels, 2, n), F.slice(labels, 1, 1)))
        .when(way == 3, F.slice(labels, 1, n - 1))
        .when(way == 5, F.concat(F.array(F.lit("replaced step")), F.slice(labels, 2, n)))
        .when(way == 6, F.reverse(labels))
        .when(way == 7, F.concat(labels, F.slice(labels, n, 1)))
        .otherwise(labels)
    )
    n_pred = n + F.when(way == 3, -1).when(way == 7, 1).otherwise(0)
    gone = F.when(way == 4, "(1,2)").otherwise("none")
    pred_edges = F.array_remove(_edges(n_pred, skip), gone)
    pred = (
        F.when(way == 0, "")
        .when(way == 1, "There is nothing to plan here, so no steps follow.")
        .otherwise(_workflow_text(pred_labels, pred_edges))
    )
    model = one_of(MODELS, o)
    scenario = one_of(SCENARIO_IDS, F.expr("o div 3"))
    return grouped.select(
        one_of(TASKS, o).alias("task"),
        (o * 1_048_576).alias("idx"),
        model.alias("model"),
        F.when(model == "model-c", "i0")
        .when((model == "model-b") & (scenario == "sft_rag"), "sft")
        .otherwise(scenario)
        .alias("scenario"),
        F.lit(STAMP).alias("stamp"),
        _workflow_text(labels, edges).alias("gold_workflow"),
        pred.alias("pred_workflow"),
    )


def _edge_list(of: Column, edge) -> Column:
    """``edge(i)`` for 1 to ``of``, none where that is below 1."""
    numbers = F.when(of > 0, F.sequence(F.lit(1), of)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        numbers,
        lambda i: F.concat(F.lit("("), edge(i)[0].cast("string"), F.lit(","), edge(i)[1].cast("string"), F.lit(")")),
    )


def branching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows whose edges are a chain, a star, none, two strands, a ring, or strands with
    an edge to nowhere; predictions in other orders, some blank, some with a self-loop."""
    grouped = workflow_labels(spark, sf_dir)
    o, labels = F.col("o"), F.col("labels")
    n = F.size(labels)
    form = F.expr("o div 10 % 6")
    chain = _edge_list(n - 1, lambda i: (i, i + 1))
    strands = _edge_list(n - 2, lambda i: (i, i + 2))
    inner = (
        F.when(form == 0, chain)
        .when(form == 1, _edge_list(n - 1, lambda i: (F.lit(1), i + 1)))
        .when(form == 2, F.array().cast("array<string>"))
        .when(form == 3, strands)
        .when(form == 4, F.concat(chain, F.array(F.concat(F.lit("("), n.cast("string"), F.lit(",1)")))))
        .otherwise(F.concat(strands, F.array(F.concat(F.lit("("), n.cast("string"), F.lit(",99)")))))
    )
    gold_edges = F.concat(F.array(F.lit("(START,1)")), inner)
    pred_edges = F.when(form == 5, F.concat(gold_edges, F.array(F.lit("(1,1)")))).otherwise(gold_edges)
    pred_labels = (
        F.when(o % 4 == 0, F.reverse(labels))
        .when(o % 4 == 1, F.concat(F.slice(labels, 2, n), F.slice(labels, 1, 1)))
        .when(o % 4 == 2, F.concat(F.slice(labels, 3, n), F.slice(labels, 1, 2)))
        .otherwise(labels)
    )
    return grouped.select(
        one_of(TASKS, o).alias("task"),
        (o * 1_048_576).alias("idx"),
        F.lit("model-a").alias("model"),
        F.lit("i0").alias("scenario"),
        _workflow_text(labels, gold_edges).alias("gold_workflow"),
        F.when(o % 11 == 0, "").otherwise(_workflow_text(pred_labels, pred_edges)).alias("pred_workflow"),
    )


def predictions(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """The predictions alone, with an error where the text is empty."""
    w = F.col("pred_workflow")
    return workflow_pairs(spark, sf_dir, labels).select(
        "model", "scenario", "task", "stamp", "idx",
        w.alias("workflow"),
        F.when(w == "", "RuntimeError: empty answer").alias("error"),
    )


#: A run before and one after the given ones.
OLD_STAMP, NEW_STAMP = "20240102_030405", "20260102_030405"


def stored_predictions(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """The predictions, an earlier run of all but one task with other texts, and for
    model-b a later one of half the orders."""
    given = predictions(spark, sf_dir, labels)
    old = given.where("task <> 'os'").select(
        "model", "scenario", "task", F.lit(OLD_STAMP).alias("stamp"), "idx",
        F.concat(F.lit("old "), "workflow").alias("workflow"), F.lit(None).cast("string").alias("error"),
    )
    new = given.where("model = 'model-b' AND idx div 1048576 % 2 = 0").withColumn("stamp", F.lit(NEW_STAMP))
    return given.unionByName(old).unionByName(new)


def prediction_files(spark: SparkSession, sf_dir: str) -> str:
    """The predictions as JSON arrays of {query, workflow}, one folder of files per
    model, task, scenario and stamp."""
    path = scratch_dir(spark, "prediction-files")
    folders = ["model", "task", "file", "shard"]
    part = Window.partitionBy(*folders)
    place = F.row_number().over(part.orderBy("idx"))
    query = F.struct(F.col("idx").cast("string").alias("id"), F.col("task").alias("source"))
    name = F.concat(F.lit("graph_eval_"), F.concat_ws("_", "scenario", "stamp"), F.lit(".json"))
    shard = F.lpad(F.expr(f"idx div 1048576 div {SHARD_ORDERS}").cast("string"), 12, "0")
    (
        predictions(spark, sf_dir)
        .withColumn("file", name)
        .withColumn("shard", shard)
        .select(
            *folders, "idx",
            F.concat(
                F.when(place == 1, "[").otherwise(","),
                F.to_json(F.struct(query.alias("query"), "workflow")),
                F.when(place == F.count("*").over(part), "]").otherwise(""),
            ).alias("value"),
        )
        .sortWithinPartitions(*folders, "idx")
        .drop("idx")
        .write.partitionBy(*folders)
        .text(path)
    )
    return path


def models(spark: SparkSession) -> DataFrame:
    """The model dimension: the last model is only run in the plain scenario."""
    return spark.createDataFrame(
        [("model-a", None), ("model-b", None), ("model-c", ["i0"])],
        "model string, scenarios array<string>",
    )


# --- runs -------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction runs, one per event; ``error`` events are unstamped ones."""
    kind = F.col("event_type")
    scenario = (
        F.when(kind == "click", "rag")
        .when(kind == "signup", "sft")
        .when(kind == "purchase", "sft_rag")
        .otherwise("i0")
    )
    stamp = F.when(kind != "error", run_stamp(F.col("ts")))
    named = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").select(
        one_of(MODELS, F.col("user_id")).alias("model"),
        one_of(TASKS, F.col("event_id")).alias("task"),
        scenario.alias("scenario"),
        stamp.alias("stamp"),
        "event_id",
    )
    name = F.concat(
        F.lit("graph_eval_"), F.concat_ws("_", "scenario", "stamp"), F.lit(".json")
    )
    return named.withColumn(
        "path", F.concat_ws("/", F.lit("predictions"), "model", "task", name)
    )

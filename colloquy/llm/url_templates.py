"""Operator 9: URL filters by a path-template tree.

Given rules (host, path prefix) come first; the longest that fits decides. Other pages
are judged by templates: per host, runs of digits become wildcards. Then, from the last
segment to the first, templates that differ in that segment alone are siblings; those
whose share of bad labels does not differ statistically from all siblings' become one
template with ``{any}`` there. Neither depth nor number of children is bounded. A
template is rejected when its smoothed share of bad labels is half or more.

Everything is DataFrame functions. Pages are combined to (host, shape of path) counts
before anything is shuffled, so a hot host is one row per shape and task. A url that is
null or has no ``://`` has empty host and path and is its own template; repeated urls
are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize

#: Weight, in labels, of the overall share that every template starts from.
PRIOR_WEIGHT = 10.0
REJECT_FROM = 0.5
#: Standard errors by which a template must differ from its siblings to stand alone.
DIFFERENT = 3.0

RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host and path fit, else null."""
    found = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = (host == rule_host) | host.endswith("." + rule_host)
        found = F.when(fits & path.startswith(slash + rule_path), F.lit(text)).otherwise(found)
    return found


def path_shape(path: Column) -> Column:
    """The path's segments with runs of digits as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))


def open_levels(shapes: DataFrame) -> list[int]:
    """Positions at which shapes of one host and length differ, deepest first. Siblings
    have one length, so no other position has any."""
    segments = shapes.select("host", F.size("shape").alias("length"), F.posexplode("shape").alias("level", "segment"))
    differ = segments.groupBy("host", "length", "level").agg(F.min("segment").alias("a"), F.max("segment").alias("b"))
    return sorted((r.level for r in differ.where("a <> b").select("level").distinct().collect()), reverse=True)


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, n_labels, n_bad) with the template each shape belongs to."""
    tree = shapes.withColumn("template", F.col("shape"))
    for level in open_levels(shapes):
        family = F.transform("template", lambda s, i: F.when(i == level, F.lit("{any}")).otherwise(s))
        nodes = tree.where(F.size("template") > level).groupBy("host", "template").agg(
            F.sum("n_labels").alias("n"), F.sum("n_bad").alias("bad")
        ).withColumn("family", family)
        families = nodes.groupBy("host", "family").agg(
            F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count("*").alias("members")
        )
        share = (F.col("all_bad") + 1) / (F.col("all_n") + 2)
        n = F.when(F.col("n") > 0, F.col("n"))
        alike = (F.col("n") == 0) | (
            F.abs(F.col("bad") / n - share) <= DIFFERENT * F.sqrt(share * (1 - share) / n)
        )
        merged = nodes.join(families, ["host", "family"]).where((F.col("members") > 1) & alike)
        tree = tree.join(merged.select("host", "template", "family"), ["host", "template"], "left").select(
            "host", "shape", "n_labels", "n_bad", F.coalesce("family", "template").alias("template")
        )
        # A level reads the one above more than once; written, the plan doesn't grow with each.
        tree = materialize(tree, "templates")
    steps = F.transform("template", lambda s: F.concat(F.lit("/"), s))
    return tree.withColumn("template", F.array_join(steps, ""))


def judged_templates(tree: DataFrame) -> DataFrame:
    """(host, template, purity): purity is the smoothed share of bad labels."""
    nodes = tree.groupBy("host", "template").agg(F.sum("n_labels").alias("n"), F.sum("n_bad").alias("bad"))
    everywhere = nodes.agg(
        ((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior")
    ).select(F.coalesce("prior", F.lit(0.5)).alias("prior"))
    # One row of prior: a count over all labels.
    return nodes.join(F.broadcast(everywhere)).select(
        "host", "template",
        ((F.col("bad") + PRIOR_WEIGHT * F.col("prior")) / (F.col("n") + PRIOR_WEIGHT)).alias("purity"),
    )


def judge(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url",
          rules=RULES) -> DataFrame:
    """``labels``: (document, bad). A page is labelled by the document whose number ends
    its path. Returns id, host, path, rule, verdict, template, purity."""
    host, path = host_and_path(url_column)
    parsed = pages.select(id_column, host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9/]*/?$", 1)
    shaped = parsed.withColumn("shape", path_shape(F.col("path"))).withColumn(
        "document", F.when(number != "", number.cast("long"))
    )
    one = labels.groupBy("document").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    shapes = materialize(
        shaped.join(one, "document", "left").groupBy("host", "shape")
        .agg(F.count("bad").alias("n_labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")), "shapes",
    )
    tree = template_tree(shapes)
    known = materialize(
        tree.select("host", "shape", "template").join(judged_templates(tree), ["host", "template"]), "judged"
    )
    rules_by_text = {text: verdict for verdict, text in rules}
    by_rule = F.create_map(*[F.lit(x) for item in rules_by_text.items() for x in item])
    return (
        shaped.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
        .join(known, ["host", "shape"], "left")
        .select(
            id_column, "host", "path", "rule",
            F.when(F.col("rule").isNotNull(), F.element_at(by_rule, F.col("rule")))
            .when(F.col("purity") >= REJECT_FROM, "block").otherwise("allow").alias("verdict"),
            "template",
        )
    )


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("document"), (F.col("quality") == 0).alias("bad")
    )
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labels)

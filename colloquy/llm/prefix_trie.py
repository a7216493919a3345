"""Operator 12: the trie of conversation prefixes, rolled up by centroid decomposition.

Conversations are rebuilt (a head borrowed from the first of their hundred, then their own
turns), and every distinct sequence of first turns is a node. Three steps are spread so that
neither one endless conversation nor one prefix shared by most is a task of its own:

* Turns get their places by ranges: each range counts its own, and the ranges' counts are
  added. A node's key is the sum of hashes of (place, turn digest) over its turns, so
  prefix sums in two levels give the keys of a conversation in pieces of bounded length.
* Totals of subtrees come from the tree of parent edges, cut at centroids. Each node weighs
  as many as its members, so a subtree's weight is known from the members' lengths, without
  a walk: the nodes with more than half the weight of their component form the path from
  its top to the centroid, the deepest of them. The total below the centroid is added along
  that path, the centroid leaves, its children's subtrees become components, and what is left
  goes on. Every component at least halves, so rounds grow with the logarithm of the turns,
  whatever the depth. Components of bounded weight are cut up whole inside tasks.
* Ids of conversations that end at a node are sorted by range, joined in chunks, and the
  chunks of a node run through one hash as a stream; no list of them is held.

A null role or text is empty. Turns with one number are ordered by a digest of role and text;
rows that repeat are turns of their own. Rows without a conv_id belong to no conversation and
are left out. Extra columns are ignored. An empty table has no conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import materialize

#: Turns of a conversation that one running sum goes over.
BLOCK_TURNS = 4096
#: Components of at most this weight, and so at most as many nodes, are one task's.
MOST_WEIGHT = 1 << 14
#: Depths of a conversation that are matched together when its nodes change component.
DEPTHS_TOGETHER = 1 << 16
#: Ids in a chunk of those that end at a node.
CHUNK_IDS = 4096
#: The conversation whose head others borrow is the first of this many ids.
FAMILY = 100
HEADS = 6

SUMS = ("s0", "s1", "s2", "s3")


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, the role with its length before it."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def placed_turns(df: DataFrame) -> DataFrame:
    """(conv, pos, digest, chars) of each turn, positions from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", turn_digest(role, text).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    # The place, last, lets even turns that are all alike be dealt to several ranges.
    ranged = materialize(
        rows.repartitionByRange("conv", *order, "place").withColumn("part", F.spark_partition_id()).drop("place"),
        "turns-by-range",
    )
    here = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1)
    # One row per conversation and range that holds some of it.
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = counts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return here.join(before, ["conv", "part"]).select("conv", (F.col("before") + F.col("at")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns): (conv, n_turns) and (conv, d, digest, chars), d from 1."""
    head = F.crc32(F.col("conv").cast("string")) % HEADS
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), head.alias("h")
    )
    firsts = convs.select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    convs = convs.join(firsts, "first", "left").withColumn("borrowed", F.least("h", F.coalesce("n_first", F.lit(0))))
    convs = materialize(
        convs.select("conv", "first", "h", "borrowed", (F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")),
        "rebuilt",
    )
    heads = turns.where(F.col("pos") < HEADS - 1).select(F.col("conv").alias("first"), "pos", "digest", "chars")
    # At most a few turns for each of the conversations of one hundred ids.
    lent = convs.join(heads, "first").where("pos < borrowed").select("conv", (F.col("pos") + 1).alias("d"), "digest", "chars", "n_turns")
    kept = turns.join(convs, "conv").where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("borrowed") + 1).alias("d"), "digest", "chars", "n_turns"
    )
    return convs.select("conv", "n_turns"), lent.union(kept)


def node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def memberships(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(key, parent, conv, d, chars, n_turns): each conversation at each of its prefixes, the
    empty one included."""
    one, two = F.xxhash64("d", "digest"), F.xxhash64("digest", F.lit("turn"), "d")
    low = F.lit((1 << 32) - 1)
    pieces = [x for y in (one, two) for x in (F.shiftrightunsigned(y, 32), y.bitwiseAND(low))]
    rows = turns.select(
        "conv", "d", "chars", "n_turns", F.floor((F.col("d") - 1) / BLOCK_TURNS).alias("block"),
        *[p.alias(f"x{i}") for i, p in enumerate(pieces)],
    )
    inside = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several blocks have any blocks before others.
    totals = rows.where(F.col("n_turns") > BLOCK_TURNS).groupBy("conv", "block").agg(
        *[F.sum(f"x{i}").alias(f"t{i}") for i in range(4)]
    )
    before = totals.select("conv", "block", *[F.sum(f"t{i}").over(earlier).alias(f"b{i}") for i in range(4)])
    summed = rows.select("*", *[F.sum(f"x{i}").over(inside).alias(s) for i, s in enumerate(SUMS)]).join(
        before, ["conv", "block"], "left"
    )
    sums = [F.col(s) + F.coalesce(f"b{i}", F.lit(0)) for i, s in enumerate(SUMS)]
    at = summed.select(
        node_key(F.col("d"), sums).alias("key"),
        node_key(F.col("d") - 1, [s - F.col(f"x{i}") for i, s in enumerate(sums)]).alias("parent"),
        "conv", "d", "chars", "n_turns",
    )
    root = node_key(F.lit(0), [F.lit(0)] * 4)
    return at.union(
        convs.select(root, F.lit(None).cast("binary"), "conv", F.lit(0).cast("long"), F.lit(0).cast("long"), "n_turns")
    )


def trie_nodes(members: DataFrame) -> DataFrame:
    """(key, parent, conv, depth, n_convs, chars, weight, n_children) of each distinct prefix;
    ``weight`` sums n_convs over the subtree."""
    nodes = members.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("conv").alias("conv"), F.min("d").alias("depth"),
        F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.sum(F.col("n_turns") - F.col("d") + 1).alias("weight"),
    )
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "of")
    return nodes.join(children, F.col("key") == F.col("of"), "left").drop("of").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
    )


STATE = ("component", "key", "parent", "conv", "depth", "w", "leaf", "saved", "leaves", "saved_below")


def subtree_totals(nodes: DataFrame, members: DataFrame, most: int = MOST_WEIGHT) -> DataFrame:
    """(key, n_leaves, saved_tokens), sums over the subtree of each node."""
    zero = F.lit(0).cast("long")
    # Not a plain literal, on which an equi-join would become a nested loop.
    whole = F.when(F.col("key").isNotNull(), node_key(F.lit(0), [F.lit(0)] * 4))
    state = nodes.select(
        whole.alias("component"), "key", "parent", "conv", "depth", F.col("weight").alias("w"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        zero.alias("leaves"), zero.alias("saved_below"),
    )
    done, closed = [], []
    while True:
        # A top weighs as much as its component. Few components can be large.
        large = materialize(
            state.groupBy("component").agg(F.max("w").alias("total")).where(F.col("total") > most), "large-components"
        )
        if large.isEmpty():
            closed.append(state)
            break
        closed.append(state.join(large, "component", "left_anti"))
        split, below = _cut(state.join(large, "component"), members)
        after = split.join(below, "component").withColumns({
            "leaves": F.col("leaves") + F.when(F.col("on_path"), F.col("all_leaves")).otherwise(0),
            "saved_below": F.col("saved_below") + F.when(F.col("on_path"), F.col("all_saved")).otherwise(0),
        })
        done.append(after.where("is_centroid").select("key", "leaves", "saved_below"))
        state = after.where("not is_centroid").withColumn("component", F.coalesce("child", "component")).select(*STATE)
    small = reduce(DataFrame.union, [c.select(*STATE) for c in closed])
    found = _small_components(small, most).union(reduce(DataFrame.union, done)) if done else _small_components(small, most)
    return found.toDF("key", "n_leaves", "saved_tokens")


def _cut(state: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every component at its centroid: (nodes with on_path, is_centroid and the child of the
    centroid they are under; totals from the centroid down by component)."""
    marked = state.withColumn("on_path", 2 * F.col("w") > F.col("total"))
    centroids = materialize(
        marked.where("on_path").groupBy("component")
        .agg(F.max_by(F.struct("key", "w", "depth"), "depth").alias("c"))
        .select("component", F.col("c.key").alias("c_key"), F.col("c.w").alias("c_w"), F.col("c.depth").alias("c_depth")),
        "centroids",
    )
    # Who goes on from the centroid, and by which child; long conversations in stretches.
    stretch = lambda depth: F.floor(depth / DEPTHS_TOGETHER)
    onward = members.select("parent", F.col("key").alias("child"), F.col("conv").alias("by"), "d", "n_turns").join(
        centroids.select(F.col("component").alias("within"), "c_key"), F.col("parent") == F.col("c_key")
    ).select(
        "within", "child", "by", F.col("d").alias("from_depth"),
        F.explode(F.sequence(stretch(F.col("d")), stretch(F.col("n_turns")))).alias("part"),
    )
    under = (
        (F.col("component") == F.col("within")) & (F.col("conv") == F.col("by"))
        & (stretch(F.col("depth")) == F.col("part")) & (F.col("depth") >= F.col("from_depth"))
    )
    is_centroid = F.col("key") == F.col("c_key")
    split = materialize(
        marked.join(centroids, "component").join(onward, under, "left").select(
            *[c for c in STATE if c != "w"],
            (F.col("w") - F.when(F.col("on_path") & ~is_centroid, F.col("c_w")).otherwise(0)).alias("w"),
            "on_path", is_centroid.alias("is_centroid"), "child",
        ),
        "split-components",
    )
    below = materialize(
        split.where("is_centroid or child is not null").groupBy("component")
        .agg(F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved")),
        "centroid-totals",
    )
    return split, below


def tree_totals(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row per quantity) over the subtrees of a forest. ``parent`` is
    -1 for tops; ``weight`` sums positive node weights over the subtree. Cut at centroids,
    all trees at once, until no node is left."""
    n = len(parent)
    if not n:
        return values.copy()
    child = np.flatnonzero(parent >= 0)
    own = weight.copy()
    np.subtract.at(own, parent[child], weight[child])
    # Intervals of a preorder: what lies before a node within its parent, then summed over
    # the ancestors by doubling steps.
    begin, up = np.zeros(n + 1, np.int64), np.full(n + 1, n)
    tops = np.flatnonzero(parent < 0)
    begin[tops] = np.cumsum(weight[tops]) - weight[tops]
    if len(child):
        child = child[np.argsort(parent[child], kind="stable")]
        ends = np.cumsum(weight[child])
        new = np.flatnonzero(np.diff(parent[child], prepend=-1))
        base = np.repeat((ends - weight[child])[new], np.diff(np.append(new, len(child))))
        begin[child] = own[parent[child]] + ends - weight[child] - base
        up[child] = parent[child]
    while (up != n).any():
        begin, up = begin + begin[up], up[up]
    order = np.argsort(begin[:n])
    sorted_begin, last_begin = begin[order], begin[:n] + weight
    begin = np.empty(n, np.int64)
    begin[order] = np.arange(n)
    end = np.searchsorted(sorted_begin, last_begin)
    w, out = weight.copy(), np.zeros_like(values)
    # A component is named after its top.
    label = np.empty(n, np.int64)
    tops = tops[np.argsort(begin[tops])]
    label[order] = np.repeat(tops, np.diff(np.append(begin[tops], n)))
    live = np.arange(n)
    total, centroid = np.zeros(n, np.int64), np.full(n, -1)
    while len(live):
        of = label[live]
        total[of] = 0
        np.maximum.at(total, of, w[live])
        path = live[2 * w[live] > total[of]]
        path = path[np.lexsort((depth[path], label[path]))]
        # The deepest of each path.
        last = np.append(np.flatnonzero(np.diff(label[path])), len(path) - 1)
        chosen = path[last]
        centroid[label[chosen]] = chosen
        c = centroid[of]
        under = (begin[live] >= begin[c]) & (begin[live] < end[c])
        for value, result in zip(values, out):
            below = np.zeros(n, np.int64)
            np.add.at(below, of[under], value[live[under]])
            result[path] += below[label[path]]
        taken = w[chosen]
        at = np.searchsorted(label[chosen], label[path])
        upper = path != chosen[at]
        w[path[upper]] -= taken[at[upper]]
        moved = live[under & (live != c)]
        kids = moved[parent[moved] == centroid[label[moved]]]
        if len(kids):
            place = label * n + begin  # Within the component: others may lie in between.
            kids = kids[np.argsort(place[kids])]
            label[moved] = kids[np.searchsorted(place[kids], place[moved], "right") - 1]
        live = live[live != c]
    return out


def _small_components(state: DataFrame, most: int) -> DataFrame:
    """(key, leaves, saved_below) of components that fit into a task, several at a time."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys = np.array(table.column("key").to_pylist(), "S16")
        parents = np.array([p or b"" for p in table.column("parent").to_pylist()], "S16")
        component = np.array(table.column("component").to_pylist(), "S16")
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[order], parents), len(keys) - 1)
        parent = order[at]
        whole = pa.array([p is not None for p in table.column("parent").to_pylist()]).to_numpy(zero_copy_only=False)
        parent = np.where(whole & (keys[parent] == parents) & (component[parent] == component), parent, -1)
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        leaves, saved = tree_totals(parent, number("depth"), number("w"), np.stack([number("leaf"), number("saved")]))
        return pa.RecordBatch.from_pydict({
            "key": table.column("key").combine_chunks(), "leaves": leaves + number("leaves"),
            "saved_below": saved + number("saved_below"),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            table = pa.Table.from_batches(held)
            last = table.column("component")[n - 1].as_py()
            # The last component may go on in the next batch.
            cut = n
            while cut and table.column("component")[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield solve(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield solve(pa.Table.from_batches(held))

    return (
        state.drop("conv").repartition("component").sortWithinPartitions("component")
        .mapInArrow(run, "key binary, leaves bigint, saved_below bigint")
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) over the ids (key, conv) of each key, ascending, joined by commas."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, convs = batch.column("key").to_pylist(), batch.column("conv").to_pylist()
            out = {"key": [], "first": [], "ids": []}
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi == len(keys) or keys[hi] != keys[lo] or hi - lo == CHUNK_IDS:
                    out["key"].append(keys[lo])
                    out["first"].append(convs[lo])
                    out["ids"].append(",".join(map(str, convs[lo:hi])))
                    lo = hi
            yield pa.RecordBatch.from_pydict(out)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, running = None, None
        for batch in batches:
            out = {"key": [], "ends_sha256": []}
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == open_key:
                    running.update(b"," + ids.encode())
                    continue
                if running:
                    out["key"].append(open_key)
                    out["ends_sha256"].append(running.hexdigest())
                open_key, running = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.binary()), "ends_sha256": pa.array(out["ends_sha256"], pa.string())})
        if running:
            yield pa.RecordBatch.from_pydict({"key": [open_key], "ends_sha256": [running.hexdigest()]})

    parts = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        chunks, "key binary, first bigint, ids string"
    )
    return parts.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(
        hashes, "key binary, ends_sha256 string"
    )


def prefix_trie(df: DataFrame, most: int = MOST_WEIGHT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    convs, turns = rebuilt(materialize(placed_turns(df), "placed-turns"))
    members = materialize(memberships(convs, turns), "trie-members")
    nodes = materialize(trie_nodes(members), "trie-nodes")
    totals = subtree_totals(nodes, members, most)
    ends = end_digests(members.where("d = n_turns").select("key", "conv"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, "key").join(ends, "key", "left").join(parents, F.col("parent") == F.col("up"), "left")
        .select(
            F.col("conv").alias("conv_id"), F.col("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE = f"""WITH RECURSIVE
  bits AS (
    SELECT i AS n, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
  crc AS (
    SELECT c, s, 0 AS i, 4294967295 AS v FROM (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL)
    UNION ALL SELECT crc.c, s, i + 1, xor(v >> 8, bits.c)
    FROM crc JOIN bits ON bits.k = 8 AND bits.n = xor(v & 255, ascii(substr(s, i + 1, 1))) WHERE i < length(s)),
  turns AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  digests AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS g FROM turns),
  chars AS (SELECT DISTINCT g, length(text) AS n FROM digests),
  own AS (SELECT c, list(g ORDER BY turn NULLS FIRST, g) AS v FROM digests GROUP BY c),
  built AS (
    SELECT own.c, coalesce(p.v[1:h], []) || own.v[h + 1:] AS v
    FROM own JOIN (SELECT c, xor(v, 4294967295) % {HEADS} AS h FROM crc WHERE i = length(s)) USING (c)
    LEFT JOIN own p ON p.c = own.c - own.c % {FAMILY}),
  members AS (SELECT c, v, unnest(range(0, len(v) + 1)) AS d FROM built),
  nodes AS (
    SELECT v[1:d] AS path, d, min(c) AS c, count(*) AS n,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(v) = d), '')) AS h
    FROM members GROUP BY ALL),
  counted AS (SELECT nodes.*, coalesce(k.k, 0) AS k, coalesce(chars.n, 0) AS chars
    FROM nodes LEFT JOIN (SELECT path[1:d - 1] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL) k USING (path)
    LEFT JOIN chars ON chars.g = nodes.path[d]),
  below AS (
    SELECT u.path, count(*) FILTER (WHERE w.k = 0) AS leaves, sum((w.n - 1) * w.chars) AS saved
    FROM counted u JOIN (SELECT *, unnest(range(0, d + 1)) AS e FROM counted) w ON w.path[1:w.e] = u.path GROUP BY u.path)
SELECT counted.c AS conv_id, counted.d AS depth, up.c AS parent_conv_id, counted.n AS n_convs, counted.k AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, counted.h AS ends_sha256
FROM counted JOIN below USING (path) LEFT JOIN nodes up ON counted.d > 0 AND up.path = counted.path[1:counted.d - 1]"""

"""Exact top-k where neither side can be broadcast: a tree of balls over the records.

Some sqrt(N) records are pivots, and some sqrt(pivots) of those are the centres of large
balls. A record belongs to the nearest centre and, in that ball, to the nearest pivot: its
cell, of about sqrt(N) records. Balls and cells know the ring of angles their records lie in,
which bounds the score a query can reach there. A query is answered in three rounds, each with
the k-th best score of the rounds before as the bound to beat:

1. one block of its own cell,
2. the other cells of its own ball,
3. the cells of all other balls.

Cells with many records are several blocks. Blocks of one ball that fit into a task together
are a part; a query travels once to a part, with the spans of blocks it has to meet there
and the score to beat. Parts that many queries visit are repeated for chunks of them, so a task holds one part
and one chunk. Copies of a vector beyond those that
can be answers are left out beforehand; how many can depends on that vector's own exclusions,
so a query with a long list changes nothing for the others. Both sides are written once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from colloquy.operators.vectors import (
    EPSILON, Best, matrix_of, norms_of, order_of,
)
from colloquy.session import materialize

PIVOT_BYTES = 64 << 20  # all pivots, which every task gets
PART_BYTES = 32 << 20  # the records of a task
CHUNKS = 4  # a chunk of queries is so much smaller than a part, for more tasks ...
MANY_CHUNKS = 8  # ... until a part has so many; each of them gets the part's records
COPY_SALTS = 32
_BOUND_SLACK = 1e-6  # above the rounding of arc cosines
_QUERY_SLICE = 256


def angles(m: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    unit = m / np.where(norm > 0, norm, 1.0)[:, None]
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


# --- the tree, small enough for every task ------------------------------------


@dataclass
class Rings:
    """Centres and what is known of the records nearest to each; ``hi`` below ``lo`` where
    there are none."""

    centres: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    min_norm: np.ndarray

    def reach(self, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The best score each row of ``v`` can have with a record of each centre."""
        a = angles(v, norm, self.centres)
        j = a.argmin(axis=1)
        near = a[np.arange(len(v)), j]
        # Records lie in a ring around their centre ...
        gap = np.maximum(0.0, np.maximum(a - self.hi, self.lo - a))
        # ... and on its side of the plane halfway to the query's nearest centre.
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.centres[j] @ self.centres.T)))
        plane = (np.cos(near)[:, None] - np.cos(a)) / np.maximum(apart, EPSILON)
        plane[apart <= 1e-6] = 0.0
        cos = np.minimum(np.cos(np.minimum(gap, np.pi)), 1.0 - np.maximum(plane, 0.0) ** 2 / 2.0)
        # A negative score shrinks towards zero with the vectors' lengths.
        size = np.outer(norm, self.min_norm)
        best = np.where(cos >= 0, cos, cos * size / (size + EPSILON))
        best[norm == 0] = 0.0
        best[:, self.hi < self.lo] = -np.inf
        return best


class BallTree:
    """Pivots in balls. Cell numbers are pivot numbers; records of length zero have the cell
    and ball after the last."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        n_balls = math.ceil(math.sqrt(len(pivots)))
        step = max(1, len(pivots) // max(1, n_balls))
        self.centres = pivots[::step][:n_balls]
        owner = np.zeros(0, int)
        if len(pivots):
            owner = np.concatenate([
                (pivots[lo:lo + 4096] @ self.centres.T).argmax(axis=1) for lo in range(0, len(pivots), 4096)
            ])
            owner[::step][:n_balls] = np.arange(n_balls)  # also of centres that nearly coincide
        self.members = [np.flatnonzero(owner == b) for b in range(len(self.centres))]

    @property
    def zero_cell(self) -> int:
        return len(self.pivots)

    def place(self, m: np.ndarray, norm: np.ndarray):
        """Ball, cell, and the angles to both centres, of each row."""
        n = len(m)
        ball, cell = np.full(n, len(self.centres)), np.full(n, self.zero_cell)
        ball_angle, cell_angle = np.zeros(n), np.zeros(n)
        live = np.flatnonzero(norm > 0)
        if len(self.pivots) and len(live):
            a = angles(m[live], norm[live], self.centres)
            ball[live], ball_angle[live] = a.argmin(axis=1), a.min(axis=1)
            for b in np.unique(ball[live]):
                rows = live[ball[live] == b]
                a = angles(m[rows], norm[rows], self.pivots[self.members[b]])
                cell[rows], cell_angle[rows] = self.members[b][a.argmin(axis=1)], a.min(axis=1)
        return ball, cell, ball_angle, cell_angle

    def fill(self, stats: dict[str, list], block_rows: int, k: int, part_rows: int = 0) -> None:
        """Take in what the records say about each cell, and deal its blocks to parts of at
        most ``part_rows`` records (one block at least)."""
        size = self.zero_cell + 1
        at = np.asarray(stats["cell"], int)
        self.counts = np.zeros(size, np.int64)
        self.counts[at] = stats["n"]
        self.blocks = np.maximum(1, -(-self.counts // block_rows))
        # A home cell should have enough records in one block to give a bound.
        self.full = self.counts // self.blocks >= k
        self.first_block = np.cumsum(self.blocks) - self.blocks
        # Cells of one ball share a part as long as their blocks fit; larger ones have their own.
        self.part_blocks = max(1, part_rows // block_rows)
        self.first_part = np.zeros(size, np.int64)
        part = room = 0
        for members in [*self.members, [self.zero_cell]]:
            room = 0
            for c in members:
                n = int(self.blocks[c])
                if n > room:
                    part, room = part + 1, self.part_blocks
                self.first_part[c] = part
                room -= n
                if n > self.part_blocks:
                    part, room = part + (n - 1) // self.part_blocks, 0

        def rings(centres, rows, lo, hi):
            low, high, norm = (np.full(len(centres), x) for x in (np.inf, -np.inf, np.inf))
            np.minimum.at(low, rows, lo)
            np.maximum.at(high, rows, hi)
            np.minimum.at(norm, rows, np.asarray(stats["min_norm"])[live])
            norm[~np.isfinite(norm)] = 0.0
            return Rings(centres, low, high, norm)

        live = np.flatnonzero(at < self.zero_cell)

        def column(name, kind=float):
            return np.asarray(stats[name], kind)[live]

        cells = rings(self.pivots, at[live], column("lo"), column("hi"))
        self.balls = rings(self.centres, column("ball", int), column("ball_lo"), column("ball_hi"))
        self.cells = [
            Rings(self.pivots[m], cells.lo[m], cells.hi[m], cells.min_norm[m]) for m in self.members
        ]

    def homes(self, v: np.ndarray, norm: np.ndarray):
        """Ball and home cell of each query: the nearest cell of its ball that has records,
        full ones before others."""
        ball = np.full(len(v), len(self.centres))
        home = np.full(len(v), int(self.counts.argmax()))
        if len(self.pivots):
            ball = angles(v, norm, self.centres).argmin(axis=1)
            for b in np.unique(ball):
                rows, cells = np.flatnonzero(ball == b), self.members[b]
                cells = cells[self.counts[cells] > 0]
                if len(cells):
                    a = angles(v[rows], norm[rows], self.pivots[cells])
                    home[rows] = cells[(a + 2 * np.pi * ~self.full[cells]).argmin(axis=1)]
        return ball, home

    def candidates(self, v, norm, tau, ball, scope: str):
        """(query row, cell) of the cells that can hold a score of ``tau`` or more, in the
        query's own ball or in all others."""
        floor = tau - _BOUND_SLACK
        found_q, found_c = [], []
        own = ball[:, None] == np.arange(len(self.centres))
        if len(self.centres):
            open_balls = own if scope == "ball" else ~own & (self.balls.reach(v, norm) >= floor[:, None])
            for b in np.flatnonzero(open_balls.any(axis=0)):
                rows = np.flatnonzero(open_balls[:, b])
                reach = self.cells[b].reach(v[rows], norm[rows])
                qi, ci = np.nonzero((reach >= floor[rows, None]) & (reach > -np.inf))
                found_q.append(rows[qi])
                found_c.append(self.members[b][ci])
        if scope == "rest" and self.counts[self.zero_cell]:
            rows = np.flatnonzero(floor <= 0.0)
            found_q.append(rows)
            found_c.append(np.full(len(rows), self.zero_cell))
        if not found_q:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(found_q), np.concatenate(found_c)


# --- building it ---------------------------------------------------------------


def without_surplus_copies(held: DataFrame, bans: DataFrame | None, k: int) -> DataFrame:
    """Records (id, key, vec) of which each vector keeps its first k and as many more as any
    one query excludes of it. Vectors that occur once pass without a sort; copies are ranked
    in salted parts first."""
    h = F.xxhash64("vec").alias("h")
    groups = held.groupBy(h).agg(F.count("*").alias("n")).where("n > 1").select("h")
    copies = held.withColumn("h", h)
    singles = copies.join(groups, "h", "left_anti")
    need = F.lit(k)
    if bans is not None:
        spare = (
            copies.select("id", "h").join(groups, "h", "left_semi").join(bans, "id")
            .groupBy("h", "rep").agg(F.count("*").alias("spare"))
            .groupBy("h").agg(F.max("spare").alias("spare"))
        )
        groups = groups.join(spare, "h", "left")
        need = F.lit(k) + F.coalesce("spare", F.lit(0))
    copies = copies.join(groups, "h").withColumn("need", need)
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(COPY_SALTS)).alias("salt")
    for parts in (["h", "vec", salt], ["h", "vec"]):
        order = Window.partitionBy(*parts).orderBy("id", "key")
        copies = copies.withColumn("_rn", F.row_number().over(order)).where("_rn <= need")
    return singles.select("id", "key", "vec").unionByName(copies.select("id", "key", "vec"))


def pick_pivots(records: DataFrame, pivots: int | None) -> np.ndarray:
    """Different unit vectors out of the records: ``pivots``, or the root of their number,
    but never more than ``PIVOT_BYTES``."""
    n = records.count()
    head = records.select(F.size("vec").alias("n")).head()
    if head is None:
        return np.zeros((0, 0))
    wanted = min(pivots or math.ceil(math.sqrt(n)), max(1, PIVOT_BYTES // (8 * max(1, head["n"]))))
    drawn = F.xxhash64("id", "key")
    # Some four times as many as needed are sorted, not all records.
    some = records.where(F.pmod(drawn, F.lit(max(1, n // (4 * wanted)))) == 0)
    table = some.orderBy(drawn, "id", "key").limit(wanted).select("vec").toArrow()
    m = matrix_of(table.column("vec"))
    if not m.size:
        return np.zeros((0, head["n"]))
    norm = norms_of(m)
    return np.unique(m[norm > 0] / norm[norm > 0, None], axis=0)


def assign_cells(records: DataFrame, tree: BallTree) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast(tree)
    names = ["id", "key", "vec"]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix_of(batch.column("vec"))
            norm = norms_of(m)
            ball, cell, ball_angle, angle = shared.value.place(m, norm)
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names]
                + [pa.array(ball, pa.int32()), pa.array(cell, pa.int32())]
                + [pa.array(x) for x in (ball_angle, angle, norm)],
                names=[*names, "ball", "cell", "ball_angle", "angle", "norm"],
            )

    source = records.select(*names)
    schema = T.StructType(list(source.schema.fields)).add("ball", "integer").add("cell", "integer")
    for name in ("ball_angle", "angle", "norm"):
        schema = schema.add(name, "double")
    return source.mapInArrow(assign, schema)


def build(records: DataFrame, pivots: int | None, block_rows: int, k: int) -> tuple[BallTree, DataFrame]:
    """The tree, and the records with their block and part."""
    tree = BallTree(pick_pivots(records, pivots))
    cells = materialize(assign_cells(records, tree), "cells")
    stats = cells.groupBy("cell").agg(
        F.first("ball").alias("ball"),
        F.count("*").alias("n"),
        F.min("angle").alias("lo"), F.max("angle").alias("hi"),
        F.min("ball_angle").alias("ball_lo"), F.max("ball_angle").alias("ball_hi"),
        F.min("norm").alias("min_norm"),
    )
    part_rows = PART_BYTES // (8 * max(1, tree.pivots.shape[1]))
    tree.fill(stats.toArrow().to_pydict(), block_rows, k, part_rows)  # one row per pivot
    places = pd.DataFrame({
        "cell": np.arange(tree.zero_cell + 1, dtype=np.int32), "blocks": tree.blocks,
        "first_block": tree.first_block, "first_part": tree.first_part,
    })
    # One row per pivot, of which there are at most PIVOT_BYTES.
    found = cells.join(F.broadcast(records.sparkSession.createDataFrame(places)), "cell")
    within = F.pmod(F.xxhash64("id", "key"), F.col("blocks"))
    return tree, found.select(
        "id", "key", "vec",
        (F.col("first_block") + within).alias("block"),
        (F.col("first_part") + F.floor(within / tree.part_blocks)).alias("part"),
    )


# --- asking it -----------------------------------------------------------------


def plan_visits(reps: DataFrame, tree: BallTree, scope: str, spans: bool = False) -> DataFrame:
    """(rep, qvec, tau, part, blocks): ``home`` for the first block, ``ball`` and ``rest`` for
    what ``tau`` leaves open; a null ``tau`` leaves all open. With ``spans`` the blocks of a
    cell are told by the first and the last of them, not each."""
    shared = reps.sparkSession.sparkContext.broadcast(tree)
    names = ["rep", "qvec", "h"] if scope == "home" else ["rep", "qvec", "h", "tau"]

    def plan(batches):
        tree = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _QUERY_SLICE):
                rows = batch.slice(start, _QUERY_SLICE)
                v = matrix_of(rows.column("qvec"))
                norm = norms_of(v)
                ball, home = tree.homes(v, norm)
                first = np.mod(rows.column("h").to_numpy(), tree.blocks[home])
                bound = pa.nulls(len(v), pa.float64()) if scope == "home" else rows.column("tau")
                if scope == "home":
                    qi, cell, lo, hi = np.arange(len(v)), home, first, first
                else:
                    tau = pc.fill_null(bound, -np.inf).to_numpy(zero_copy_only=False)
                    qi, cell = tree.candidates(v, norm, tau, ball, scope)
                    # The blocks of a cell that lie in one part, but for the one met already.
                    pieces = -(-tree.blocks[cell] // tree.part_blocks)
                    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    qi, cell = np.repeat(qi, pieces), np.repeat(cell, pieces)
                    lo = piece * tree.part_blocks
                    hi = np.minimum(lo + tree.part_blocks, tree.blocks[cell]) - 1
                    met = np.flatnonzero((cell == home[qi]) & (lo <= first[qi]) & (first[qi] <= hi))
                    qi, cell = np.append(qi, qi[met]), np.append(cell, cell[met])
                    lo, hi = np.append(lo, first[qi[met]] + 1), np.append(hi, hi[met])
                    hi[met] = first[qi[met]] - 1
                    left = lo <= hi
                    qi, cell, lo, hi = qi[left], cell[left], lo[left], hi[left]
                part = tree.first_part[cell] + lo // tree.part_blocks
                lo, hi = tree.first_block[cell] + lo, tree.first_block[cell] + hi
                order = np.lexsort((lo, part, qi))
                qi, part, lo, hi = qi[order], part[order], lo[order], hi[order]
                if spans:
                    told, n = np.stack([lo, hi], axis=1).ravel(), np.full(len(lo), 2)
                else:
                    n = hi - lo + 1
                    told = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
                starts = np.flatnonzero(np.diff(qi, prepend=-1) | np.diff(part, prepend=-1))
                offsets = np.append(0, np.cumsum(n))[[*starts, len(n)]]
                at = pa.array(qi[starts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rep").take(at), rows.column("qvec").take(at), bound.take(at), pa.array(part[starts], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(told, pa.int64()))],
                    names=["rep", "qvec", "tau", "part", "blocks"],
                )

    source = reps.withColumn("h", F.xxhash64("rep")).select(*names)
    schema = T.StructType([source.schema["rep"], source.schema["qvec"]]).add("tau", "double")
    schema = schema.add("part", "long").add("blocks", T.ArrayType(T.LongType()))
    return source.mapInArrow(plan, schema)


def meet_parts(
    visits: DataFrame, blocks: DataFrame, bans: DataFrame | None, k: int, chunk_rows: int, part_rows: int
) -> DataFrame:
    """(rep, id, key, score): at most k rows per query and part, none below the query's ``tau``.
    A part that many queries visit is met in ``MANY_CHUNKS``, more if they are larger than itself."""
    n = F.count("*")
    chunks = F.least(F.ceil(n / chunk_rows), F.greatest(F.lit(MANY_CHUNKS), F.ceil(n / part_rows)))
    load = visits.groupBy("part").agg(chunks.cast("long").alias("chunks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk")
    record = {name: blocks.schema[name].dataType for name in ("id", "key")}
    asked_types = {name: visits.schema[name].dataType for name in ("qvec", "tau", "blocks")}
    left = visits.join(load, "part").select(
        "part", mine, "rep", "qvec", "tau", "blocks", F.lit(None).cast(record["id"]).alias("ban")
    )
    if bans is not None:
        left = left.unionByName(bans.join(load, "part").select(
            "part", mine, "rep", *[F.lit(None).cast(t).alias(n) for n, t in asked_types.items()], F.col("id").alias("ban")
        ))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    right = blocks.join(load, "part").select("part", every, "block", "id", "key", "vec")
    schema = T.StructType([visits.schema["rep"], *(T.StructField(n, t) for n, t in record.items())])
    schema = schema.add("score", "double")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        is_query = pc.is_valid(asked.column("qvec"))
        queries, barred = asked.filter(is_query), asked.filter(pc.invert(is_query))
        qi = mi = np.zeros(0, int)
        s = np.zeros(0)
        if queries.num_rows and held.num_rows:
            qi, mi, s = _best_of_part(queries, barred, held, k)
        hit = held.take(pa.array(mi, pa.int64()))
        return pa.table({
            "rep": queries.column("rep").take(pa.array(qi, pa.int64())),
            "id": hit.column("id"), "key": hit.column("key"), "score": s,
        })

    keys = ["part", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _best_of_part(queries: pa.Table, barred: pa.Table, held: pa.Table, k: int):
    """Query rows, record rows and scores of the k best in the blocks each query asks for."""
    numbers = held.column("block").to_numpy()
    by_block = np.argsort(numbers, kind="stable")
    held, numbers = held.take(pa.array(by_block)), numbers[by_block]
    v, m = matrix_of(queries.column("qvec")), matrix_of(held.column("vec"))
    order = order_of(held.column("id").to_pylist(), held.column("key").to_pylist())
    banned = None
    if barred.num_rows:
        pairs = pd.DataFrame({"rep": barred.column("rep").to_pylist(), "id": barred.column("ban").to_pylist()})
        rows = pd.DataFrame({"rep": queries.column("rep").to_pylist(), "q": np.arange(len(v))})
        records = pd.DataFrame({"id": held.column("id").to_pylist(), "m": np.arange(len(m))})
        pairs = pairs.merge(rows, on="rep").merge(records, on="id")
        banned = pairs["q"].to_numpy(), pairs["m"].to_numpy()
    tau = pc.fill_null(queries.column("tau").combine_chunks(), -np.inf).to_numpy(zero_copy_only=False)
    best = Best(v, norms_of(v), m, norms_of(m), order, k, banned, tau)

    lists = queries.column("blocks").combine_chunks()
    asking = pc.list_parent_indices(lists).to_numpy()[::2]
    spans = lists.flatten().to_numpy().reshape(-1, 2)
    blocks, starts = np.unique(numbers, return_index=True)
    ends = np.append(starts[1:], len(numbers))
    lo, hi = np.searchsorted(blocks, spans[:, 0]), np.searchsorted(blocks, spans[:, 1], side="right")
    # Blocks next to each other that the same queries ask for are met together.
    edges = np.unique(np.concatenate([lo, hi]))
    for a, b in zip(edges[:-1], edges[1:]):
        rows = np.unique(asking[(lo <= a) & (hi >= b)])
        if len(rows):
            best.meet(rows, starts[a], ends[b - 1])
    qi, mi, s = best.found()
    return qi, by_block[mi], s


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(q: DataFrame, c: DataFrame, k: int, has_exclude: bool, block_rows: int, pivots: int | None) -> DataFrame:
    """(qid, rank, id, key, score) of queries (qid, qvec[, excl]) and records (id, key, vec)."""
    asked = materialize(q, "queries")
    held = materialize(c, "records")
    same = ["qvec", "excl"] if has_exclude else ["qvec"]
    if has_exclude:
        asked = asked.withColumn("excl", F.array_sort(F.array_distinct("excl")))
    # Equal queries with equal exclusions have one answer.
    reps = materialize(asked.groupBy(*same).agg(F.min("qid").alias("rep")), "distinct-queries")
    bans = reps.select("rep", F.explode("excl").alias("id")) if has_exclude else None

    records = materialize(without_surplus_copies(held, bans, k), "different-records")
    tree, blocks = build(records, pivots, block_rows, k)
    blocks = materialize(blocks, "blocks")
    if has_exclude:
        placed = bans.join(blocks.select("id", "part"), "id").distinct()
        bans = materialize(placed, "bans")

    best = None
    for scope in ("home", "ball", "rest"):
        asking = reps
        if best is not None:
            bound = best.where(F.col("rank") == k).select("rep", F.col("score").alias("tau"))
            asking = reps.join(bound, "rep", "left")
        visits = materialize(plan_visits(asking, tree, scope, spans=True), f"visits-{scope}")
        part_rows = tree.part_blocks * block_rows
        found = meet_parts(visits, blocks, bans, k, max(block_rows, part_rows // CHUNKS), part_rows)
        if best is not None:
            found = best.drop("rank").unionByName(found)
        best = materialize(ranked(found, k), f"best-{scope}")

    keys = [F.col(f"a.{x}").eqNullSafe(F.col(f"r.{x}")) for x in same]
    return (
        asked.alias("a").join(reps.alias("r"), keys).select("a.qid", "r.rep")
        .join(best, "rep").select("qid", "rank", "id", "key", "score")
    )

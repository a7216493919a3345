"""Cosine work on blocks of vectors, inside the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EPSILON = 1e-9
SCORE_DIGITS = 12
_SLICE_CELLS = 1 << 22  # scores held at once inside a task
_SCORE_SLACK = 1e-9  # above the rounding of a matrix product
_MOST_SLACK = 1e-3  # beyond it single precision keeps too many candidates
_TILE_ROWS, _TILE_RECORDS = 512, 1024  # scores that stay in a core's cache
_EXACT_ROWS = 1 << 14


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a float64 matrix; all lists must be of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if len(np.unique(lengths)) > 1:
        raise ValueError("vectors of different lengths in one column")
    return flat.reshape(n, -1)


def norms_of(m: np.ndarray) -> np.ndarray:
    total = np.zeros(m.shape[0])
    for j in range(m.shape[1]):
        total += m[:, j] * m[:, j]
    return np.sqrt(total)


def order_of(ids, keys=None) -> np.ndarray:
    """Rank of each id in the order of ids, equal ids by key."""
    rank = np.unique(np.asarray(ids), return_inverse=True)[1]
    if keys is None or not len(rank):
        return rank
    within = np.unique(np.asarray(keys), return_inverse=True)[1]
    return rank * (int(within.max()) + 1) + within


def best_in_block(q, q_norm, m, m_norm, m_order, k, banned=None):
    """Index pairs and exact scores of the ``k`` best rows of ``m`` per row of
    ``q``, in rank order. ``banned`` lists (query row, record row) to leave out."""
    if not len(q) or not m.shape[0]:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    best = Best(q, q_norm, m, m_norm, m_order, k, banned)
    best.meet(np.arange(len(q)), 0, len(m))
    return best.found()


class Best:
    """The ``k`` best rows of ``m`` per row of ``q`` among those they have met, equal scores by
    ``m_order``. ``floor`` is a score per query that ``k`` records reach elsewhere: records
    below it may be left out.

    A matrix product of unit vectors in single precision finds the candidates: what comes
    near the k-th best score so far, by more than the product's rounding. Their scores are
    then summed in double precision and one fixed order, so a score does not depend on where
    a vector stands.
    """

    def __init__(self, q, q_norm, m, m_norm, m_order, k, banned=None, floor=None):
        self.q, self.q_norm, self.m, self.m_norm, self.m_order, self.k = q, q_norm, m, m_norm, m_order, k
        self.bound = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
        self.score = np.full((len(q), k), -np.inf)
        self.record = np.full((len(q), k), -1)
        ban_q, ban_m = banned if banned is not None else (np.zeros(0, int), np.zeros(0, int))
        by_query = np.argsort(ban_q, kind="stable")
        self.ban_q, self.ban_m = ban_q[by_query], ban_m[by_query]
        self.slack = _single_slack(q_norm, m_norm, m.shape[1])
        if self.slack is not None:
            self.q_unit, self.m_unit = _units(q, q_norm), _units(m, m_norm)

    def meet(self, rows: np.ndarray, lo: int, hi: int) -> None:
        """Queries ``rows`` (ascending) meet the records ``lo`` to ``hi``."""
        step = _TILE_ROWS if self.slack is not None else max(1, _SLICE_CELLS // max(1, hi - lo))
        for at in range(0, len(rows) if hi > lo else 0, step):
            some = rows[at:at + step]
            first, end = np.searchsorted(self.ban_q, [some[0], some[-1] + 1])
            ban_q, ban_m = self.ban_q[first:end], self.ban_m[first:end]
            place = np.minimum(np.searchsorted(some, ban_q), len(some) - 1)
            here = (some[place] == ban_q) & (ban_m >= lo) & (ban_m < hi)
            if self.slack is None:
                self._take(*self._in_double(some, lo, hi, place[here], ban_m[here]))
            else:
                self._in_single(some, lo, hi, place[here], ban_m[here])

    def found(self):
        qi, rank = np.nonzero(self.record >= 0)
        return qi, self.record[qi, rank], self.score[qi, rank]

    def _in_single(self, rows, lo, hi, ban_q, ban_m) -> None:
        mine, k = self.q_unit[rows], self.k
        waiting, tiles, due = [], 0, 1
        for at in range(lo, hi, _TILE_RECORDS):
            # Whole words of marks: records beyond the end have no score.
            end = min(at + _TILE_RECORDS, hi)
            rough = np.full((len(rows), -(-(end - at) // 8) * 8), -np.inf, np.float32)
            np.matmul(mine, self.m_unit[at:end].T, out=rough[:, :end - at])
            if len(ban_q):
                here = (ban_m >= at) & (ban_m < end)
                rough[ban_q[here], ban_m[here] - at] = -np.inf
            edge = self.bound[rows] - self.slack
            unbound = np.flatnonzero(edge == -np.inf)
            if len(unbound) and end - at > k:
                kth = np.partition(rough[unbound], rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
                edge[unbound] = kth - 2 * self.slack
            keep = rough >= np.maximum(edge, -2.0).astype(np.float32)[:, None]
            # Few are kept: eight marks are looked at at once.
            words = np.flatnonzero(keep.reshape(-1).view(np.uint64))
            if len(words):
                word, mark = np.nonzero(keep.reshape(-1, 8)[words])
                qi, mi = np.divmod(words[word] * 8 + mark, rough.shape[1])
                waiting.append((rows[qi], mi + at))
            tiles += 1
            # The bound is worth raising as the records met double.
            if waiting and (tiles >= due or end == hi):
                qi, mi = (np.concatenate(x) for x in zip(*waiting))
                self._take(qi, mi, _exact(self.q, self.q_norm, self.m, self.m_norm, qi, mi))
                waiting = []
            due = max(due, 2 * tiles if tiles >= due else due)

    def _in_double(self, rows, lo, hi, ban_q, ban_m):
        """Vectors that single precision does not tell apart: very short or not finite."""
        k, n_m = self.k, hi - lo
        rough = (self.q[rows] @ self.m[lo:hi].T) / (np.outer(self.q_norm[rows], self.m_norm[lo:hi]) + EPSILON)
        rough[ban_q, ban_m - lo] = -np.inf
        if n_m > k:
            floor = np.partition(rough, n_m - k, axis=1)[:, n_m - k] - _SCORE_SLACK
            keep = rough >= floor[:, None]
            keep &= rough > -np.inf
        else:
            keep = rough > -np.inf
        qi, mi = np.nonzero(keep)
        qi, mi = rows[qi], mi + lo
        return qi, mi, _exact(self.q, self.q_norm, self.m, self.m_norm, qi, mi)

    def _take(self, qi, mi, score) -> None:
        near = ~(score < self.bound[qi])
        qi, mi, score = qi[near], mi[near], score[near]
        if not len(qi):
            return
        rows = np.unique(qi)
        held_q, held_rank = np.nonzero(self.record[rows] >= 0)
        held_q = rows[held_q]
        qi = np.concatenate([held_q, qi])
        mi = np.concatenate([self.record[rows][self.record[rows] >= 0], mi])
        score = np.concatenate([self.score[held_q, held_rank], score])
        order = np.lexsort((self.m_order[mi], -score, qi))
        qi, mi, score = qi[order], mi[order], score[order]
        rank = ranks_within(qi) - 1
        top = rank < self.k
        self.record[qi[top], rank[top]] = mi[top]
        self.score[qi[top], rank[top]] = score[top]
        self.bound[rows] = np.fmax(self.bound[rows], self.score[rows, self.k - 1])


def _units(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    out = np.empty(m.shape, np.float32)
    for lo in range(0, len(m), 4096):
        part = slice(lo, lo + 4096)
        out[part] = m[part] / np.where(norm[part] > 0, norm[part], 1.0)[:, None]
    return out


def _single_slack(q_norm: np.ndarray, m_norm: np.ndarray, width: int) -> float | None:
    """How far a product of unit vectors in single precision may be from the score; None
    where that says too little."""
    if not (np.isfinite(q_norm).all() and np.isfinite(m_norm).all()):
        return None
    least = 1.0
    for norm in (q_norm, m_norm):
        least *= norm[norm > 0].min(initial=np.inf)
    slack = (width + 8) * 2.0**-23 + EPSILON / least + _SCORE_SLACK
    return slack if slack <= _MOST_SLACK else None


def _exact(q, q_norm, m, m_norm, qi, mi) -> np.ndarray:
    score = np.zeros(len(qi))
    for lo in range(0, len(qi), _EXACT_ROWS):
        a, b = qi[lo:lo + _EXACT_ROWS], mi[lo:lo + _EXACT_ROWS]
        products = (q[a] * m[b]).T
        dot = np.zeros(len(a))
        for of_one in products:
            dot += of_one
        score[lo:lo + _EXACT_ROWS] = np.round(dot / (m_norm[b] * q_norm[a] + EPSILON), SCORE_DIGITS)
    return score


def banned_pairs(exclude_lists, record_ids):
    """(query row, record row) of the excluded ids that occur in this block."""
    ids = np.asarray(record_ids)
    if not len(ids):
        return None
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    rows = np.repeat(np.arange(len(exclude_lists)), [len(e) for e in exclude_lists])
    flat = [x for e in exclude_lists for x in e]
    if not flat:
        return None
    flat = np.asarray(flat, dtype=ids.dtype if ids.dtype.kind != "U" else None)
    # All records of an excluded id, of which there may be several.
    first, end = (np.searchsorted(ids, flat, side=side) for side in ("left", "right"))
    n = end - first
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.repeat(rows, n), order[at]


def ranks_within(qi: np.ndarray) -> np.ndarray:
    return np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") + 1

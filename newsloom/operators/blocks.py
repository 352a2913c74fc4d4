"""NumPy kernels on blocks of vectors, called inside Arrow functions.

Every kernel sees a bounded number of rows; Spark cuts, moves and merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

# Scores are compared after rounding, so that copies of a vector tie exactly.
SCORE_DECIMALS = 12
NO_RANK = -np.inf
# A bound on the distance counts as a bound on the score with so much room for rounding.
RADIUS_SLACK = 1e-9
# Numbers gathered at once when single pairs are looked at.
GATHERED = 1 << 22
# Stored rows whose scores with a slice of queries are made and looked at while they stay in a processor's cache.
TILE = 1024


def matrix(column) -> np.ndarray:
    """A list<float> column as unit rows in double precision; a zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1).astype(np.float64)
    return unit(rows)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def same_ids(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of equal ids."""
    codes = pd.factorize(np.concatenate([left, right]))[0]
    a, b = codes[: len(left)], codes[len(left) :]
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(a)), n), order[np.repeat(low, n) + within]


def products(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows ``i`` of ``left`` and rows ``j`` of ``right``, pair by pair, a few rows gathered at once."""
    out, step = np.empty(len(i), left.dtype), max(1, GATHERED // max(1, left.shape[1]))
    for at in range(0, len(i), step):
        np.einsum("ij,ij->i", left[i[at : at + step]], right[j[at : at + step]], out=out[at : at + step])
    return out


def true_places(marks: np.ndarray) -> np.ndarray:
    """The places in memory order of the few true values of a whole array, eight looked at at once."""
    flat = marks.reshape(-1)
    whole = len(flat) // 8 * 8
    hit = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    at = np.flatnonzero(flat[:whole].reshape(-1, 8)[hit])
    return np.concatenate([hit[at >> 3] * 8 + (at & 7), whole + np.flatnonzero(flat[whole:])])


def reaching(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of ``left`` and of ``right`` whose product is at least the left row's ``least``, by the left row, and the products; None if these
    are more than one pair in sixteen, so that all pairs are as soon looked at."""
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, left.dtype)
    found, n, most = [], 0, len(left) * len(right) // 16
    room, marked = np.empty(len(left) * TILE, left.dtype), np.empty(len(left) * TILE, bool)
    for at in range(0, len(right), TILE):
        part = right[at : at + TILE]
        scores, marks = (x[: len(left) * len(part)].reshape(len(left), -1) for x in (room, marked))
        np.matmul(left, part.T, out=scores)
        np.greater_equal(scores, least[:, None], out=marks)
        places = true_places(marks)
        n += len(places)
        if n > most:
            return None
        q, s = np.divmod(places, len(part))
        found.append((q, s + at, scores.reshape(-1)[places]))
    q, s, scores = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(q, kind="stable")
    return q[order], s[order], scores[order]


class Sketch:
    """Short stand-ins of unit vectors, whose products no cosine exceeds by more than a rounding error.

    They are coordinates along the directions in which a sample varies most, ``FIRST`` of them and then up to ``SECOND``, each time
    with the length of what these leave out (Cauchy and Schwarz). Orthonormal directions bound every vector, whatever the sample.
    """

    FIRST, SECOND = 96, 256

    def __init__(self, directions: np.ndarray):
        self.directions = directions
        self.first = min(self.FIRST, len(directions) // 4)

    @classmethod
    def directions_of(cls, sample: np.ndarray) -> np.ndarray:
        """One column for each direction, those that tell most first."""
        return np.linalg.svd(np.nan_to_num(sample), full_matrices=False)[2][: min(cls.SECOND, sample.shape[1] // 2)].T

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``near`` bounds by its product. Without the product of its last column and with that of ``far`` the bound is lower."""
        along, whole = rows @ self.directions, (rows * rows).sum(axis=1)
        parts = along[:, : self.first], along[:, self.first :]
        left = whole - (parts[0] ** 2).sum(axis=1)
        near, far = (np.sqrt(np.maximum(rest, 0)) for rest in (left, left - (parts[1] ** 2).sum(axis=1)))
        return np.column_stack([parts[0], near]).astype(np.float32), np.column_stack([parts[1], far]).astype(np.float32)


class TopMatches:
    """The best ``k`` stored rows per query, fed block by block.

    ``thresholds`` rises to the k-th best score seen, so later blocks pass on few candidates. Scores are made in single precision
    first; what is not below the threshold by more than their error is scored again in double precision, and only that counts. With
    a ``sketch`` only pairs whose bounds reach the threshold are scored at all. ``radius`` of a query bounds the distance of its best
    ``k``; one of 2 or more bounds nothing.
    """

    COMPACT_AT = 500_000

    def __init__(self, queries: np.ndarray, k: int, min_score: float | None, sketch: Sketch | None = None, radius: np.ndarray | None = None):
        self.queries = queries
        self.sketch = None if sketch is None else sketch.of(queries)
        self.coarse = queries.astype(np.float32)
        #: No single-precision product of two unit rows is further from the exact one.
        self.error = np.float32((queries.shape[1] + 8) * 2.0**-23)
        self.k = k
        start = NO_RANK if min_score is None else np.round(min_score, SCORE_DECIMALS)
        self.thresholds = np.full(len(queries), start)
        if radius is not None:
            self.thresholds = np.maximum(self.thresholds, np.where(radius < 2, 1 - radius * radius / 2 - RADIUS_SLACK, NO_RANK))
        #: The best single-precision scores of each query that were seen one by one.
        self.best = np.full((len(queries), k), NO_RANK, np.float32)
        self.q = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=object)
        self.scores = np.empty(0)
        self.pending: list[tuple] = []
        self.n_pending = 0

    def add(self, stored: np.ndarray, ids: np.ndarray, seq=None, barred=None, rows=None, sketch=None) -> None:
        """``seq``: numbers of the queries and of the stored rows, of which only the smaller ones count; None if all do. ``barred``:
        places of pairs that do not count. ``rows``: the queries that are meant, by default all; ``seq`` and ``barred`` count among
        them. ``sketch``: of the stored rows."""
        rows = np.arange(len(self.queries)) if rows is None else rows
        found = None if sketch is None else self._bounded(rows, sketch, seq, barred)
        found = self._few(rows, stored, seq, barred) if found is None else found
        q, s, n_pairs = self._coarse(rows, stored, seq, barred) if found is None else found
        scores = self._exact(rows, q, stored, s, n_pairs)
        good = scores >= self.thresholds[rows[q]]
        q, s, scores = rows[q[good]], s[good], scores[good]
        self.pending.append((q, ids[s], scores))
        self.n_pending += len(q)
        if self.n_pending > self.COMPACT_AT:
            self.compact()

    def _few(self, rows: np.ndarray, stored: np.ndarray, seq, barred) -> tuple[np.ndarray, np.ndarray, int] | None:
        """The pairs that reach the thresholds in single precision, while these rise; None if every query's has to be found first or too
        many pairs reach it."""
        least = (self.thresholds[rows] - 2 * self.error).astype(np.float32)
        if not (least > NO_RANK).all():
            return None
        found = reaching(self.coarse[rows], stored.astype(np.float32), least)
        if found is None:
            return None
        q, s, scores = found
        counted = np.ones(len(q), bool)
        if seq is not None:
            counted &= seq[1][s] < seq[0][q]
        if barred is not None:
            counted &= ~np.isin(q * len(stored) + s, barred[0] * len(stored) + barred[1])
        q, s, scores = q[counted], s[counted], scores[counted]
        by_score = np.lexsort((-scores, q))
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        first = by_score[place < self.k]
        both = np.full((len(rows), 2 * self.k), NO_RANK, np.float32)
        both[:, : self.k] = self.best[rows]
        both[q[first], self.k + place[place < self.k]] = scores[first]
        both.partition(self.k, axis=1)
        self.best[rows] = both[:, self.k :]
        self.thresholds[rows] = np.maximum(self.thresholds[rows], both[:, self.k].astype(np.float64) - self.error)
        left = scores >= (self.thresholds[rows] - 2 * self.error).astype(np.float32)[q]
        return q[left], s[left], len(rows) * len(stored)

    def _coarse(self, rows: np.ndarray, stored: np.ndarray, seq, barred) -> tuple[np.ndarray, np.ndarray, int]:
        """The pairs that single precision does not rule out, and how many there are in all."""
        coarse = self.coarse[rows] @ stored.astype(np.float32).T
        if seq is not None:
            coarse[~(seq[1][None, :] < seq[0][:, None])] = NO_RANK
        if barred is not None:
            coarse[barred] = NO_RANK
        m = coarse.shape[1]
        if m > self.k:
            kth = coarse.max(axis=1) if self.k == 1 else np.partition(coarse, m - self.k, axis=1)[:, m - self.k]
            self.thresholds[rows] = np.maximum(self.thresholds[rows], kth.astype(np.float64) - self.error)
        least = self.thresholds[rows] - 2 * self.error
        q, s = np.nonzero((coarse >= least.astype(np.float32)[:, None]) & (coarse > NO_RANK))
        return q, s, coarse.size

    def _bounded(self, rows: np.ndarray, sketch: tuple[np.ndarray, np.ndarray], seq, barred) -> tuple[np.ndarray, np.ndarray, int] | None:
        """The pairs that the sketches do not rule out; None if they leave so many that all pairs are sooner scored."""
        (q_near, q_far), (near, far) = self.sketch, sketch
        bounds = q_near[rows] @ near.T
        least = (self.thresholds[rows] - 2 * self.error).astype(np.float32)
        at = np.flatnonzero(bounds >= least[:, None])
        if len(at) * 16 > bounds.size:
            return None
        if barred is not None:
            at = np.setdiff1d(at, barred[0] * len(near) + barred[1], assume_unique=True)
        q, s = np.divmod(at, len(near))
        if seq is not None:
            earlier = seq[1][s] < seq[0][q]
            q, s = q[earlier], s[earlier]
        lower = bounds[q, s] - q_near[rows[q], -1] * near[s, -1] + products(q_far, rows[q], far, s)
        left = lower >= least[q]
        return q[left], s[left], bounds.size

    def _exact(self, rows: np.ndarray, q: np.ndarray, stored: np.ndarray, s: np.ndarray, n_pairs: int) -> np.ndarray:
        if len(q) * 16 > n_pairs:
            return np.round(self.queries[rows] @ stored.T, SCORE_DECIMALS)[q, s]
        return np.round(products(self.queries, rows[q], stored, s), SCORE_DECIMALS)

    def compact(self) -> None:
        q = np.concatenate([self.q, *[p[0] for p in self.pending]])
        ids = np.concatenate([self.ids, *[p[1] for p in self.pending]])
        scores = np.concatenate([self.scores, *[p[2] for p in self.pending]])
        # thresholds have risen since
        good = scores >= self.thresholds[q]
        q, ids, scores = q[good], ids[good], scores[good]
        order = np.lexsort((ids.astype(str), -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - starts
        keep = place < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        last = self.q[place[keep] == self.k - 1]
        self.thresholds[last] = np.maximum(
            self.thresholds[last], self.scores[place[keep] == self.k - 1]
        )
        self.pending, self.n_pending = [], 0

    def table(self, query_ids: np.ndarray) -> pa.Table:
        self.compact()
        return pa.table(
            {
                "query_id": pa.array(query_ids[self.q], pa.string()),
                "article_id": pa.array(self.ids, pa.string()),
                "score": pa.array(self.scores, pa.float64()),
            }
        )


def distances(cosines: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors from their cosines."""
    return np.sqrt(np.maximum(2.0 - 2.0 * np.round(cosines, SCORE_DECIMALS), 0.0))


def spanning_tree(rows: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of one block under mutual reachability: ends and weights (Prim)."""
    n = len(rows)
    weight = np.full(n, np.inf)
    source = np.zeros(n, dtype=np.int64)
    done = np.zeros(n, dtype=bool)
    a, b, w = (np.empty(n - 1, dtype=np.int64), np.empty(n - 1, dtype=np.int64), np.empty(n - 1))
    current = 0
    for step in range(n - 1):
        done[current] = True
        d = np.maximum(np.maximum(distances(rows @ rows[current]), core), core[current])
        closer = ~done & (d < weight)
        weight[closer] = d[closer]
        source[closer] = current
        current = int(np.argmin(np.where(done, np.inf, weight)))
        a[step], b[step], w[step] = source[current], current, weight[current]
    return a, b, w

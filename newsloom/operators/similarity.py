"""Exact nearest-vector search by cosine, for a few queries or for very many.

A small set of queries travels to the stored vectors: one scan, no shuffle of
the stored side. A larger one is joined with them block by block. Stored vectors lie in
cells around pivot vectors, and a query visits only cells that can hold a match,
by the triangle inequality and the hyperplane between two pivots (Lu, Shen, Chen,
Ooi 2012). A block is several neighbouring cells, and a query goes once to each block in which it visits a cell, so
what is shuffled does not grow with the number of cells. Cells larger than a block are cut into chunks, so a crowded cell is
many tasks. Nothing is capped: the result equals a comparison with every vector, unless the caller
asks for an approximate search (``lsh.py``).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.blocks import NO_RANK, Sketch, TopMatches, matrix, same_ids, unit
from newsloom.operators.lsh import Lsh, meeting
from newsloom.session import cut_lineage, passing_tables

MATCH_SCHEMA = "query_id string, article_id string, score double"
# Queries sent to all executors: bounded by rows and by bytes.
MAX_SENT_QUERIES = 4096
MAX_SENT_BYTES = 64 << 20
BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
# A block gets more than ``BLOCK_ROWS`` rows if else there were more blocks than this (of long vectors, whose copies cost more than
# their products), up to so many bytes of vectors.
MOST_BLOCKS, WIDE_BLOCKS = 16, 6
BLOCK_BYTES = 64 << 20
# Blocks of short stored vectors: every block gives ``k`` matches for each query that visits it, and these are more bytes than the vectors.
STORED_BLOCKS = 4
# What a pass of a block join shuffles at most: so many bytes of vectors, or so many copies of both sides if these are more. Copies of all
# blocks at once would take disk with the square of the vectors.
PASS_BYTES, PASS_COPIES = 2 << 30, 2
# Tasks of a block join at most, pairs that are worth one more task, and rows of either side compared at once in one.
MOST_TASKS, TASK_PAIRS = 512, 1 << 25
SLICE_ROWS = 2048
QUERY_SLICE, STORED_SLICE = 1024, 8192
SLACK = 1e-9
# From so many dimensions on, pairs are bounded by sketches before they are scored; rows that the sketches are made from.
WIDE, SAMPLE = 256, 1024


def vectors_only(df: DataFrame, id_col: str, *carry: str) -> DataFrame:
    """id, embedding and the carried columns, without rows that have no vector."""
    return df.where(F.col("embedding").isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col("embedding").cast("array<float>"), *carry
    )


def _allowed(q_seq, s_seq):
    """Which pairs count: only stored rows of an earlier ``seq``, if there is one."""
    return None if q_seq is None else s_seq[None, :] < q_seq[:, None]


def block_size(n: int, block_rows: int, dim: int, most: int = MOST_BLOCKS) -> int:
    """Rows of a block: ``block_rows``, or as many as make ``most`` blocks of ``n`` rows (``WIDE_BLOCKS`` from ``WIDE``
    dimensions on), within ``BLOCK_BYTES``.

    Each side of a block join is copied once for every block of the other, so small blocks of many rows would be mostly copies.
    """
    return max(block_rows, min(math.ceil(n / (most if dim < WIDE else WIDE_BLOCKS)), BLOCK_BYTES // (4 * max(1, dim))))


def _pair_seq(q_seq, s_seq):
    return None if q_seq is None else (q_seq, s_seq)


def _slices(batches):
    """Arrow batches in pieces small enough for a dense score matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _column(table, name: str):
    return table.column(name).to_numpy(zero_copy_only=False) if name in table.schema.names else None


def _strings(table, name: str) -> np.ndarray:
    return np.array(table.column(name).to_pylist(), dtype=object)


def _scan_with_sent_queries(stored: DataFrame, rows: list, k: int, min_score, skip_self: bool) -> DataFrame:
    q_ids = np.array([r["id"] for r in rows], dtype=object)
    q_seq = np.array([r["seq"] for r in rows]) if "seq" in rows[0] else None
    vectors = np.array([r["embedding"] for r in rows], dtype=np.float32)
    sent = stored.sparkSession.sparkContext.broadcast((q_ids, q_seq, vectors))

    def scan(batches):
        ids, seq, raw = sent.value
        top = TopMatches(unit(raw.astype(np.float64)), k, min_score)
        for piece in _slices(batches):
            s_ids = _strings(piece, "id")
            barred = same_ids(ids, s_ids) if skip_self else None
            top.add(matrix(piece.column("embedding")), s_ids, _pair_seq(seq, _column(piece, "seq")), barred)
        yield from top.table(ids).to_batches()

    return stored.mapInArrow(scan, MATCH_SCHEMA)


def choose_pivots(stored: DataFrame, n: int, block_rows: int) -> np.ndarray:
    """Up to ``MAX_PIVOTS`` stored vectors, picked by a hash of the id so that they repeat."""
    wanted = max(1, min(MAX_PIVOTS, n // (2 * block_rows)))
    rows = stored.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").collect()
    return unit(np.array([r["embedding"] for r in rows], dtype=np.float64))


def sketch_directions(stored: DataFrame, n: int, dim: int) -> np.ndarray | None:
    """Of a sketch made from about ``SAMPLE`` of the ``n`` stored vectors; None for short vectors, which are as soon scored. What is found does not
    depend on the sample, only how soon."""
    if dim < WIDE:
        return None
    share = math.ceil(min(1.0, SAMPLE / n) * (1 << 20))
    some = stored.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("embedding").limit(2 * SAMPLE).toArrow()
    return Sketch.directions_of(matrix(some.column("embedding"))) if some.num_rows else None


def with_cell(stored: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``cell`` (nearest pivot) and ``reach`` (distance to it) of each stored vector."""
    sent = stored.sparkSession.sparkContext.broadcast(pivots)
    carried = [f for f in stored.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)

    def assign(batches):
        for batch in _slices(batches):
            cos = matrix(batch.column("embedding")) @ sent.value.T
            cell = cos.argmax(axis=1)
            reach = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(cell)), cell], 0))
            yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column(
                "reach", pa.array(reach, pa.float64())
            )

    return stored.mapInArrow(assign, schema + ", cell int, reach double")


class _Visits:
    """Which cells can hold a match of a query: ``pivots`` and how far the vectors of each cell lie from it."""

    def __init__(self, pivots: np.ndarray, reach: np.ndarray, min_score):
        self.pivots, self.reach = pivots, reach
        self.gaps = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
        self.limit = 2.0 if min_score is None else math.sqrt(max(2 - 2 * min_score, 0.0))

    def of(self, q: np.ndarray, radius) -> np.ndarray:
        d2 = np.maximum(2 - 2 * (q @ self.pivots.T), 0)
        home = d2.argmin(axis=1)
        r = np.full(len(q), self.limit) if radius is None else np.minimum(radius, self.limit)
        # distance from the query to the plane halfway between its own pivot and another
        gap = self.gaps[home]
        own = d2[np.arange(len(q)), home][:, None]
        plane = np.divide(d2 - own, 2 * gap, out=np.zeros_like(d2), where=gap > 0)
        visit = (plane <= r[:, None] + SLACK) & (np.sqrt(d2) - self.reach <= r[:, None] + SLACK)
        # cells nothing was assigned to hold no match
        return visit & (self.reach >= 0)


def route(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, min_score, block_of: np.ndarray | None = None) -> DataFrame:
    """One row per query and cell that can hold a match: ``cell``. With ``block_of``, the block of each cell, one row
    per query and block that has such a cell: ``block``.

    ``radius`` of a query, if present, bounds the distance of its matches; else ``min_score`` does.
    """
    name = "cell" if block_of is None else "block"
    return _with_places(queries, pivots, reach, min_score, block_of).withColumn(name, F.explode("places")).drop("places")


def _with_places(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, min_score, block_of: np.ndarray | None = None) -> DataFrame:
    """Queries with all numbers that ``route`` gives them, as ``places``."""
    sent = queries.sparkSession.sparkContext.broadcast((pivots, reach, block_of))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)

    def place(batches):
        pivots, reach, block_of = sent.value
        visits = _Visits(pivots, reach, min_score)
        for batch in _slices(batches):
            visit = visits.of(matrix(batch.column("embedding")), _column(batch, "radius"))
            found = (np.flatnonzero(v) for v in visit)
            places = pa.array([f if block_of is None else np.unique(block_of[f]) for f in found], pa.list_(pa.int32()))
            yield batch.append_column("places", places)

    return queries.mapInArrow(place, schema + ", places array<int>")


def packed(pivots: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The block of each cell. A block is cells near one another with at most ``size`` rows, or one larger cell."""
    leaders = pivots[: max(1, math.ceil(int(counts.sum()) / size))]
    order = np.argsort((pivots @ leaders.T).argmax(axis=1), kind="stable")
    block_of, block, held = np.zeros(len(pivots), np.int32), 0, 0
    for cell in order:
        if held and held + counts[cell] > size:
            block, held = block + 1, 0
        block_of[cell] = block
        held += counts[cell]
    return block_of


def _block_join(queries: DataFrame, stored: DataFrame, k: int, min_score, skip_self: bool, block_rows: int) -> DataFrame:
    spark = stored.sparkSession
    n = stored.count()
    if n == 0:
        return spark.createDataFrame([], MATCH_SCHEMA)
    pivots = choose_pivots(stored, n, block_rows)
    q_size, size = (block_size(n, block_rows, pivots.shape[1], most) for most in (MOST_BLOCKS, STORED_BLOCKS))
    in_cells = with_cell(stored, pivots)
    reach, counts = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for row in in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect():
        reach[row["cell"]], counts[row["cell"]] = row["reach"], row["n"]
    block_of = packed(pivots, counts, size)
    routed = _with_places(queries, pivots, reach, min_score, block_of)
    visits = {r["block"]: r["n"] for r in routed.select(F.explode("places").alias("block")).groupBy("block").agg(F.count("*").alias("n")).collect()}
    if not visits:
        return spark.createDataFrame([], MATCH_SCHEMA)
    held = np.bincount(block_of, weights=counts)
    # blocks, or chunks of crowded ones: block, its chunk, chunks of its queries, chunks of its stored rows
    cuts = []
    for b, v in visits.items():
        s_cuts = math.ceil(int(held[b]) / size)
        cuts += [(int(b), s, math.ceil(v / q_size), s_cuts) for s in range(s_cuts)]
    cells = F.broadcast(spark.createDataFrame([(c, int(b)) for c, b in enumerate(block_of)], "cell int, block int"))
    right = in_cells.drop("reach").join(cells, "cell")
    directions = None if min_score is None else sketch_directions(stored, n, pivots.shape[1])
    sent = spark.sparkContext.broadcast((pivots, reach, directions))

    def joined(routed: DataFrame, right: DataFrame, units: list[tuple[int, int, int, int]]) -> DataFrame:
        """The blocks, or chunks of crowded ones, named by ``units``."""
        keys, pairs = ["block", "s_chunk", "q_chunk"], sum(visits[b] * int(held[b]) // s for b, _, _, s in units)
        # few bytes and much work in a block: their number decides on the tasks, not their size
        tasks = min(MOST_TASKS, sum(q for _, _, q, _ in units), max(spark.sparkContext.defaultParallelism, pairs // TASK_PAIRS))
        # one for each side, whose columns must not be the same
        l_cut, r_cut = (F.broadcast(spark.createDataFrame(units, "block int, s_chunk int, q_cuts int, s_cuts int")) for _ in "lr")
        here = F.array_intersect("places", F.array(*[F.lit(b) for b in sorted({u[0] for u in units})]))
        left = routed.withColumn("block", F.explode(here)).drop("places").join(l_cut, "block")
        left = left.withColumn("q_chunk", F.pmod(F.xxhash64("id"), F.col("q_cuts")).cast("int")).drop("q_cuts", "s_cuts")
        own = F.pmod(F.xxhash64("id"), F.col("s_cuts")).cast("int") == F.col("s_chunk")
        right = right.join(r_cut, "block").where(own).withColumn("q_chunk", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1))).drop("q_cuts", "s_cuts")
        return _compare(left.repartition(tasks, *keys), right.repartition(tasks, *keys), keys, k, min_score, skip_self, sent)

    most = max(PASS_BYTES // (4 * pivots.shape[1]), PASS_COPIES * (n + max(visits.values())))
    passes = _passes(cuts, [visits[b] + math.ceil(int(held[b]) / s) * q for b, _, q, s in cuts], most)
    if len(passes) == 1:
        return joined(routed, right, cuts)
    with passing_tables(spark):
        routed, right = cut_lineage(routed), cut_lineage(right)
        found = [cut_lineage(joined(routed, right, units)) for units in passes]
        return cut_lineage(reduce(DataFrame.unionByName, found), outlasting=True)


def _passes(units: list, rows: list[int], most: int) -> list[list]:
    """``units`` in order, in runs that shuffle at most ``most`` rows each, or one unit that has more."""
    runs, taken = [], 0
    for unit, n in zip(units, rows):
        if not runs or taken + n > most:
            runs.append([])
            taken = 0
        runs[-1].append(unit)
        taken += n
    return runs


def _compare(left: DataFrame, right: DataFrame, keys: list[str], k: int, min_score, skip_self: bool, cells=None) -> DataFrame:
    """The best ``k`` stored rows of each query within each block; with ``cells`` (pivots, reaches and, or None, directions of a
    sketch, broadcast) a query is compared only with the cells that it visits, and pairs are bounded before they are scored. Rows
    that have a ``seq`` are sorted by it, so that later stored ones are passed over in one piece."""

    def pieces(s: pa.Table):
        """Bounds of runs of stored rows of one cell, and the cell."""
        if cells is None:
            return [(i, min(i + STORED_SLICE, s.num_rows), None) for i in range(0, s.num_rows, STORED_SLICE)]
        cell = s.column("cell").to_numpy()
        ends = [*(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        runs = zip([0, *ends], ends)
        return [(i, min(i + STORED_SLICE, hi), cell[lo]) for lo, hi in runs for i in range(lo, hi, STORED_SLICE)]

    def compare(q: pa.Table, s: pa.Table) -> pa.Table:
        if q.num_rows == 0 or s.num_rows == 0:
            return TopMatches(np.zeros((0, 1)), k, min_score).table(_strings(q, "id")[:0])
        in_order = [(name, "ascending") for name in ("cell", "seq") if name in s.schema.names]
        if in_order:
            s = s.sort_by(in_order)
        ordered = "seq" in s.schema.names and not s.column("seq").null_count and not q.column("seq").null_count
        if ordered:
            q = q.sort_by("seq")
        sketch = None
        if cells is not None:
            pivots, reach, directions = cells.value
            visits, sketch = _Visits(pivots, reach, min_score), None if directions is None else Sketch(directions)
        s_ids, s_rows, s_seq, runs = _strings(s, "id"), matrix(s.column("embedding")), _column(s, "seq"), pieces(s)
        short = None if sketch is None else sketch.of(s_rows)
        found = []
        for start in range(0, q.num_rows, QUERY_SLICE):
            part = q.slice(start, QUERY_SLICE)
            q_ids, q_seq = _strings(part, "id"), _column(part, "seq")
            radius = _column(part, "radius")
            top = TopMatches(matrix(part.column("embedding")), k, min_score, sketch, radius)
            visit = None if cells is None else visits.of(top.queries, radius)
            for lo, hi, cell in runs:
                rows = np.arange(part.num_rows) if cell is None else np.flatnonzero(visit[:, cell])
                if ordered:
                    hi = lo + int(np.searchsorted(s_seq[lo:hi], q_seq[-1]))
                if len(rows) and lo < hi:
                    barred = same_ids(q_ids[rows], s_ids[lo:hi]) if skip_self else None
                    seq = None if q_seq is None else (q_seq[rows], s_seq[lo:hi])
                    top.add(s_rows[lo:hi], s_ids[lo:hi], seq, barred, rows, None if short is None else tuple(p[lo:hi] for p in short))
            found.append(top.table(q_ids))
        return pa.concat_tables(found)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, MATCH_SCHEMA)


def _meeting_matches(queries: DataFrame, stored: DataFrame, k: int, min_score, skip_self: bool, block_rows: int, lsh: Lsh) -> DataFrame:
    likely = lsh.likely if lsh.likely is not None else min_score
    if likely is None:
        raise ValueError("a search without a least score needs Lsh(likely=...)")
    n = stored.count()
    first = stored.select(F.size("embedding").alias("dim")).first()
    size = block_size(n, block_rows, first["dim"] if first else 1)
    left, right, keys = meeting(queries, stored, n, likely, lsh.recall, size)
    found = _compare(left, right, keys, k, min_score, skip_self)
    # a pair may meet in several tables
    return found.groupBy("query_id", "article_id").agg(F.max("score").alias("score"))


def top_matches(
    queries: DataFrame,
    stored: DataFrame,
    k: int,
    min_score: float | None = None,
    skip_self: bool = False,
    max_sent: int = MAX_SENT_QUERIES,
    block_rows: int = BLOCK_ROWS,
    lsh: Lsh | None = None,
) -> DataFrame:
    """The ``k`` stored vectors with the highest cosine per query, ties to the smaller id:
    query_id, article_id, score, rank. With ``lsh`` only those that it lets meet.

    Both sides have ``id`` and ``embedding``. With a ``seq`` on both, only stored
    rows with a smaller one count; ``skip_self`` leaves out the row with the query's id.
    """
    # counted first: too many queries are not fetched in vain
    sent = queries.collect() if lsh is None and queries.limit(max_sent + 1).count() <= max_sent else None
    if sent is not None and sent and len(sent) * len(sent[0]["embedding"]) * 4 > MAX_SENT_BYTES:
        sent = None
    if lsh is not None:
        partial = _meeting_matches(queries, stored, k, min_score, skip_self, block_rows, lsh)
    elif sent is None:
        if min_score is None:
            queries = _with_radius(queries, stored, k, skip_self, block_rows)
        partial = _block_join(queries, stored, k, min_score, skip_self, block_rows)
    elif not sent:
        partial = stored.sparkSession.createDataFrame([], MATCH_SCHEMA)
    else:
        partial = _scan_with_sent_queries(stored, sent, k, min_score, skip_self)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "article_id")
    ranked = partial.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def _with_radius(queries: DataFrame, stored: DataFrame, k: int, skip_self: bool, block_rows: int) -> DataFrame:
    """Queries with an upper bound on the distance of their k-th match, from a bounded set of
    stored vectors. A query with fewer than ``k`` of them gets no bound."""
    sample = stored.orderBy(F.xxhash64("id"), "id").limit(block_rows).collect()
    if not sample:
        return queries
    s_ids = np.array([r["id"] for r in sample], dtype=object)
    s_seq = np.array([r["seq"] for r in sample]) if "seq" in sample[0] else None
    vectors = np.array([r["embedding"] for r in sample], dtype=np.float32)
    sent = stored.sparkSession.sparkContext.broadcast((s_ids, s_seq, vectors))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)

    def bound(batches):
        ids, seq, raw = sent.value
        known = unit(raw.astype(np.float64))
        broken = np.flatnonzero(np.isnan(known).any(axis=1))
        for batch in _slices(batches):
            scores = matrix(batch.column("embedding")) @ known.T
            allowed = _allowed(_column(batch, "seq"), seq)
            if allowed is not None:
                scores[~allowed] = NO_RANK
            if skip_self:
                scores[same_ids(_strings(batch, "id"), ids)] = NO_RANK
            # a vector that has no score is no match
            scores[:, broken] = NO_RANK
            m = scores.shape[1]
            kth = np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else np.full(len(scores), NO_RANK)
            radius = np.where(kth > NO_RANK, np.sqrt(np.maximum(2 - 2 * np.maximum(kth, -1), 0)), 2.0)
            yield batch.append_column("radius", pa.array(radius, pa.float64()))

    return queries.mapInArrow(bound, schema + ", radius double")

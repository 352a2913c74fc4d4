"""Minimum spanning tree under mutual reachability, without comparing all pairs.

Borůvka rounds: every component looks for its nearest outside vector and joins it. What a round has to look at
shrinks by four bounds, all exact:

- Each row lists its ``LISTED`` nearest vectors. Any vector it does not list is at least as far as the last one listed
  (``low``), so a row whose best listed outside vector is within that needs no search.
- The best edge that is known to leave a component bounds its search (``bound``); rows whose ``low`` reaches it are left out. A component
  without a known edge gets one to the nearest pivot outside it.
- Rows lie in cells around pivots, and a row visits a cell only if the triangle inequality, the plane between two pivots and the
  cell's smallest core distance leave room for a vector below the bound.
- A cell whose rows are all of the row's own component is never visited; so the inside of a component costs nothing.

A row goes once to each block of cells in which it visits one. There pairs are scored in single precision, and only those that this leaves
below the best edge found so far are looked at closely.

A row that has been searched keeps what was found, or the bound, as its new ``low``: outside vectors only become fewer.
Equal vectors are one row here and join it by their core distance, the least that any edge of theirs can have.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.blocks import distances, matrix, products, reaching, unit
from newsloom.operators.forest import components
from newsloom.operators.similarity import QUERY_SLICE, STORED_BLOCKS, block_size, packed
from newsloom.session import cut_lineage

#: Nearest vectors that every row lists before the first round.
LISTED = 16
#: Rows in a cell on average, cells at most (their sizes come to the driver), rows of a block.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 256, 2048, 2048
#: Pairs that are worth one more task of a search, and tasks of a block at most if its searching rows are no more than its own.
TASK_PAIRS, MOST_CUTS = 1 << 26, 8
SLACK = 1e-9

EDGES = "a string, b string, w double"


class Cells:
    """Pivots and what the driver knows of their cells: ``MOST_CELLS`` entries at most."""

    def __init__(self, rows: DataFrame, n: int, cell_rows: int):
        wanted = max(1, min(MOST_CELLS, n // cell_rows))
        found = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        self.ids = [r["id"] for r in found]
        self.cores = np.array([r["core"] for r in found])
        self.pivots = unit(np.array([r["embedding"] for r in found], dtype=np.float64))
        self.reach = np.full(wanted, -1.0)
        self.least_core = np.full(wanted, np.inf)
        self.pure: list = [None] * wanted
        self.n = np.zeros(wanted, np.int64)
        self.size, self.block_of = 1, np.zeros(wanted, np.int32)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their ``cell``; takes down how far each reaches."""
        sent = rows.sparkSession.sparkContext.broadcast(self.pivots)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

        def assign(batches):
            for batch in batches:
                cos = matrix(batch.column("embedding")) @ sent.value.T
                cell = cos.argmax(axis=1)
                far = distances(cos[np.arange(len(cell)), cell])
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("far", pa.array(far, pa.float64()))

        out = cut_lineage(rows.mapInArrow(assign, ", ".join([*fields, "cell int", "far double"])))
        for r in out.groupBy("cell").agg(F.max("far").alias("far"), F.min("core").alias("core"), F.count("*").alias("n")).collect():
            self.reach[r["cell"]], self.least_core[r["cell"]], self.n[r["cell"]] = r["far"], r["core"], r["n"]
        return out.drop("far")

    def pack(self, block_rows: int) -> None:
        """Puts cells together to few blocks of bounded size."""
        self.size = block_size(int(self.n.sum()), block_rows, self.pivots.shape[1], STORED_BLOCKS)
        self.block_of = packed(self.pivots, self.n, self.size)

    def known(self) -> tuple:
        """What the tasks of a search are sent."""
        return self.pivots, self.reach, self.least_core, np.array(self.pure, object), self.block_of

    def look_at(self, placed: DataFrame) -> None:
        """Which cells hold rows of one component only."""
        for r in placed.groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).collect():
            self.pure[r["cell"]] = r["x"] if r["x"] == r["y"] else None

    def components(self, state: DataFrame) -> list:
        """The component of each pivot."""
        named = state.sparkSession.createDataFrame([(i,) for i in self.ids], "id string")
        of = {r["id"]: r["comp"] for r in state.join(F.broadcast(named), "id").collect()}
        return [of[i] for i in self.ids]


def _pivot_edges(lost: DataFrame, cells: Cells, comps: list) -> DataFrame:
    """For every row of ``lost`` its edge to the best pivot of another component."""
    sent = lost.sparkSession.sparkContext.broadcast((cells.pivots, cells.cores, np.array(cells.ids, object), np.array(comps, object)))

    def run(batches):
        pivots, cores, ids, of = sent.value
        for batch in batches:
            core = batch.column("core").to_numpy()
            w = np.maximum(np.maximum(distances(matrix(batch.column("embedding")) @ pivots.T), cores), core[:, None])
            comp = np.array(batch.column("comp").to_pylist(), object)
            w[comp[:, None] == of[None, :]] = np.inf
            best = w.argmin(axis=1)
            least = w[np.arange(len(best)), best]
            on = pa.array(np.isfinite(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(on), pa.array(ids[best], pa.string()).filter(on), pa.array(least).filter(on)], names=["a", "b", "w"]
            )

    return lost.mapInArrow(run, EDGES)


class _Visits:
    """Which cells may hold an outside vector below a row's bound; made from ``Cells.known``."""

    def __init__(self, pivots, reach, least_core, pure, block_of):
        self.pivots, self.reach, self.least_core, self.pure = pivots, reach, least_core, pure
        self.gaps = distances(pivots @ pivots.T)

    def of(self, q: np.ndarray, table) -> np.ndarray:
        """For unit rows ``q`` and their ``bound`` and ``comp`` in ``table``."""
        d2 = np.maximum(2 - 2 * (q @ self.pivots.T), 0)
        home = d2.argmin(axis=1)
        r = table.column("bound").to_numpy()[:, None] + SLACK
        gap, own = self.gaps[home], d2[np.arange(len(q)), home][:, None]
        plane = np.divide(d2 - own, 2 * gap, out=np.zeros_like(d2), where=gap > 0)
        visit = (plane <= r) & (np.sqrt(d2) - self.reach <= r) & (self.least_core <= r) & (self.reach >= 0)
        comp = np.array(table.column("comp").to_pylist(), object)
        return visit & (comp[:, None] != self.pure[None, :])


def _route(looking: DataFrame, cells: Cells) -> DataFrame:
    """A row of ``looking`` once for every block with a cell that may hold an outside vector below its ``bound``: ``block``."""
    sent = looking.sparkSession.sparkContext.broadcast(cells.known())
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in looking.schema.fields]

    def run(batches):
        visits, block_of = _Visits(*sent.value), sent.value[-1]
        for batch in batches:
            for part in (batch.slice(at, QUERY_SLICE) for at in range(0, batch.num_rows, QUERY_SLICE)):
                visit = visits.of(matrix(part.column("embedding")), part)
                yield part.append_column("blocks", pa.array([np.unique(block_of[v]) for v in visit], pa.list_(pa.int32())))

    routed = looking.mapInArrow(run, ", ".join([*fields, "blocks array<int>"]))
    return routed.withColumn("block", F.explode("blocks")).drop("blocks")


class _Nearest:
    """The best edge below its bound from each query row to a stored row of another component, fed run by run."""

    def __init__(self, rows: np.ndarray, core: np.ndarray, comp: np.ndarray, bound: np.ndarray):
        self.rows, self.coarse, self.core, self.comp = rows, rows.astype(np.float32), core, comp
        self.w, self.found = bound.copy(), np.full(len(rows), -1)
        #: No single-precision product of two unit rows is further from the exact one.
        self.error = (rows.shape[1] + 8) * 2.0**-23

    def add(self, at: np.ndarray, rows: np.ndarray, core: np.ndarray, comp: np.ndarray, first: int) -> None:
        """Compares the queries ``at`` with a run of stored rows, of which the first has the number ``first``."""
        w = self.w[at]
        few = reaching(self.coarse[at], rows.astype(np.float32), (1 - w * w / 2 - 2 * self.error).astype(np.float32))
        if few is None:
            far = np.maximum(np.maximum(distances(self.rows[at] @ rows.T), core), self.core[at][:, None])
            far[self.comp[at][:, None] == comp] = np.inf
            q, s = np.arange(len(at)), far.argmin(axis=1)
            far = far[q, s]
        else:
            q, s, _ = few
            out = (self.comp[at[q]] != comp[s]) & (core[s] < w[q])
            q, s = q[out], s[out]
            far = np.maximum(np.maximum(distances(products(self.rows, at[q], rows, s)), core[s]), self.core[at[q]])
            order = np.lexsort((s, far, q))
            q, s, far = q[order], s[order], far[order]
            least = np.flatnonzero(np.diff(q, prepend=-1))
            q, s, far = q[least], s[least], far[least]
        better = far < w[q]
        q = at[q[better]]
        self.w[q], self.found[q] = far[better], first + s[better]


def _nearest_outside(q: pa.Table, s: pa.Table, visits: _Visits) -> pa.Table:
    """The best edge below its bound from each query row to a stored row of another component in a cell that it visits."""
    empty = pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "w": pa.array([], pa.float64())})
    if not q.num_rows or not s.num_rows:
        return empty
    s = s.sort_by([("cell", "ascending"), ("id", "ascending")])
    comp = pa.concat_arrays([c for t in (q, s) for c in t.column("comp").chunks]).dictionary_encode().indices.to_numpy()
    rows, core, cell = matrix(s.column("embedding")), s.column("core").to_numpy(), s.column("cell").to_numpy()
    ends = [*(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
    out = []
    for start in range(0, q.num_rows, QUERY_SLICE):
        part = q.slice(start, QUERY_SLICE)
        vectors = matrix(part.column("embedding"))
        visit = visits.of(vectors, part)
        nearest = _Nearest(vectors, part.column("core").to_numpy(), comp[start : start + part.num_rows], part.column("bound").to_numpy())
        for low, high in zip([0, *ends], ends):
            at = np.flatnonzero(visit[:, cell[low]])
            if len(at):
                nearest.add(at, rows[low:high], core[low:high], comp[q.num_rows + low : q.num_rows + high], low)
        hit = np.flatnonzero(nearest.found >= 0)
        out.append(pa.table({"a": part.column("id").take(pa.array(hit)), "b": s.column("id").take(pa.array(nearest.found[hit])), "w": pa.array(nearest.w[hit])}))
    return pa.concat_tables(out)


def _search(looking: DataFrame, placed: DataFrame, cells: Cells) -> DataFrame:
    """The nearest outside vector of each row of ``looking`` if it is below the row's ``bound``: ``EDGES``."""
    spark = placed.sparkSession
    routed = cut_lineage(_route(looking.select("id", "embedding", "core", "comp", "bound"), cells))
    visits = {r["block"]: r["n"] for r in routed.groupBy("block").agg(F.count("*").alias("n")).collect()}
    if not visits:
        return spark.createDataFrame([], EDGES)
    held = np.bincount(cells.block_of, weights=cells.n)
    rows = []
    for b, n in visits.items():
        wanted = min(MOST_CUTS, math.ceil(n * int(held[b]) / TASK_PAIRS))
        rows.append((int(b), max(wanted, math.ceil(n / cells.size)), max(1, math.ceil(int(held[b]) / cells.size))))
    tasks = max(spark.sparkContext.defaultParallelism, sum(q * s for _, q, s in rows))
    cuts = F.broadcast(spark.createDataFrame(rows, "block int, q_cuts int, s_cuts int"))
    blocks = F.broadcast(spark.createDataFrame([(c, int(b)) for c, b in enumerate(cells.block_of)], "cell int, block int"))
    sent = spark.sparkContext.broadcast(cells.known())

    def chunked(df: DataFrame, own: str, other: str) -> DataFrame:
        cut = df.join(cuts, "block")
        own_chunk = F.pmod(F.xxhash64("id"), F.col(f"{own}_cuts")).cast("int").alias(f"{own}_chunk")
        return cut.select("*", own_chunk, F.explode(F.sequence(F.lit(0), F.col(f"{other}_cuts") - 1)).alias(f"{other}_chunk")).drop("q_cuts", "s_cuts").repartition(tasks, *keys)

    keys = ["block", "q_chunk", "s_chunk"]
    left, right = chunked(routed, "q", "s"), chunked(placed.select("id", "embedding", "core", "comp", "cell").join(blocks, "cell"), "s", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda q, s: _nearest_outside(q, s, _Visits(*sent.value)), EDGES)
    best = found.groupBy("a").agg(F.min(F.struct("w", "b")).alias("e"))
    return best.select("a", F.col("e.b").alias("b"), F.col("e.w").alias("w"))


def _with_components(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``edges`` that lead from one component to another, with ``ca`` and ``cb``."""
    side = lambda end: state.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}"))
    return edges.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b", "w", "ca", "cb")


def _bounds(live: DataFrame) -> DataFrame:
    """``comp`` and ``bound``, the least weight of the known edges that leave it."""
    ends = live.select(F.col("ca").alias("comp"), "w").unionByName(live.select(F.col("cb").alias("comp"), "w"))
    return ends.groupBy("comp").agg(F.min("w").alias("bound"))


def _picked(live: DataFrame) -> DataFrame:
    """The least known edge of every component, each edge once."""
    edge = F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb")
    ends = live.select(F.col("ca").alias("comp"), edge.alias("e")).unionByName(live.select(F.col("cb").alias("comp"), edge.alias("e")))
    best = ends.groupBy("comp").agg(F.min("e").alias("e")).select("e.*")
    return best.groupBy("a", "b").agg(F.min("w").alias("w"), F.min(F.least("ca", "cb")).alias("ca"), F.max(F.greatest("ca", "cb")).alias("cb"))


def distinct_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of each vector, the one with the least id, and the edges by which its copies join it."""
    crowds = cut_lineage(rows.groupBy("embedding").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("embedding", "first"))
    copies = cut_lineage(rows.join(crowds, "embedding").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.col("core").alias("w")))
    return rows.join(copies.select(F.col("b").alias("id")), "id", "left_anti"), copies


def tree_in_cells(rows: DataFrame, near: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(a, b, w)`` of a minimum spanning tree of ``rows`` (id, embedding, core).

    ``near`` lists nearest vectors of every row (article_id, neighbour_id, distance, rank), the same number for each.
    """
    rows, copies = distinct_rows(rows)
    cells = Cells(rows, rows.count(), cell_rows)
    rows = cells.dealt(rows)
    cells.pack(block_rows)
    cores = rows.select("id", "core")
    # copies are left out of the lists; the rows that they stand for are listed themselves or as far away
    edges = near.select(F.col("article_id").alias("a"), F.col("neighbour_id").alias("b"), "distance")
    edges = edges.join(cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(cores.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    known = edges.select("a", "b", F.greatest("distance", "core_a", "core_b").alias("w"))
    low = near.groupBy(F.col("article_id").alias("id")).agg(F.max("distance").alias("low"))
    state = cut_lineage(cores.join(low, "id").select("id", F.col("id").alias("comp"), F.greatest("low", "core").alias("low")))
    picked: list[DataFrame] = [copies]
    while state.limit(2).count() > 1 and state.agg(F.min("comp") < F.max("comp")).first()[0]:
        live = cut_lineage(_with_components(known, state))
        placed = None
        bounds = cut_lineage(_bounds(live))
        lost = state.select("comp").distinct().join(bounds, "comp", "left_anti")
        if not lost.isEmpty():
            placed = cut_lineage(rows.join(state, "id"))
            more = _pivot_edges(placed.join(lost, "comp", "left_semi"), cells, cells.components(state))
            live = live.unionByName(cut_lineage(_with_components(more, state)))
            bounds = cut_lineage(_bounds(live))
        own = live.groupBy(F.col("a").alias("id")).agg(F.min("w").alias("own"))
        looking = state.join(bounds, "comp").join(own, "id", "left").where("(own is null or own > low) and low < bound").select("id", "comp", "low", "bound")
        looking = cut_lineage(looking)
        if not looking.isEmpty():
            placed = cut_lineage(rows.join(state, "id")) if placed is None else placed
            cells.look_at(placed)
            found = cut_lineage(_search(placed.join(looking.select("id", "bound"), "id"), placed, cells))
            live = live.unionByName(cut_lineage(_with_components(found, state)))
            seen = looking.join(found.select(F.col("a").alias("id"), "w"), "id", "left").select("id", F.coalesce("w", "bound").alias("seen"))
            state = state.join(seen, "id", "left").select("id", "comp", F.coalesce("seen", "low").alias("low"))
        round_picks = cut_lineage(_picked(live))
        picked.append(round_picks.select("a", "b", "w"))
        joined = components(round_picks.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        labels = joined.select(F.col("node").alias("comp"), "component")
        state = cut_lineage(state.join(labels, "comp").select("id", F.col("component").alias("comp"), "low"))
        known = live.select("a", "b", "w")
    return reduce(DataFrame.unionByName, picked)

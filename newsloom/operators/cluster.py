"""Density clusters (HDBSCAN*: Campello, Moulavi, Sander 2013) over unit vectors.

Steps: distance to the k-th neighbour, minimum spanning tree under mutual
reachability, cluster hierarchy bottom up, choice of the most stable clusters.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.blocks import matrix, spanning_tree
from newsloom.operators.forest import spanning_forest
from newsloom.operators.reachability import BLOCK_ROWS, CELL_ROWS, LISTED, tree_in_cells
from newsloom.operators.similarity import MOST_BLOCKS, top_matches, vectors_only
from newsloom.session import cut_lineage

EDGE_SCHEMA = "a string, b string, w double"
# Rows whose tree one task makes at once.
TREE_BLOCK_ROWS = 8192
# Tree edges that one round of the hierarchy covers at most.
SLICE_EDGES = 500_000
# Every slice is a driver round: smaller slices than asked for are not made if there were more than this, up to ``SLICE_EDGES``.
MOST_SLICES = 8
# Identical vectors have distance 0; their density stays finite.
MIN_DISTANCE = 1e-6


def neighbours(vectors: DataFrame, k: int, **tuning) -> DataFrame:
    """article_id, neighbour_id, distance, rank: the ``k`` nearest other vectors of each."""
    rows = vectors_only(vectors, "article_id")
    found = top_matches(rows, rows, k, skip_self=True, **tuning)
    distance = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
    return found.select(
        F.col("query_id").alias("article_id"),
        F.col("article_id").alias("neighbour_id"),
        distance.alias("distance"),
        "rank",
    )


def neighbour_edges(vectors: DataFrame, k: int = 3, **tuning) -> DataFrame:
    """Each vector's ``k`` nearest with the mutual reachability distance: the largest of
    their distance and both core distances (the distance to the k-th neighbour)."""
    near = cut_lineage(neighbours(vectors, k, **tuning))
    core = near.where(F.col("rank") == k).select("article_id", F.col("distance").alias("core"))
    other = core.select(F.col("article_id").alias("neighbour_id"), F.col("core").alias("other_core"))
    return (
        near.join(core, "article_id")
        .join(other, "neighbour_id")
        .select(
            "article_id",
            "neighbour_id",
            "rank",
            "distance",
            "core",
            F.greatest("distance", "core", "other_core").alias("reachability"),
        )
    )


def reachability_tree(vectors: DataFrame, k: int, block_rows: int = TREE_BLOCK_ROWS, **tuning) -> DataFrame:
    """Edges ``(a, b, w)`` of a minimum spanning tree under mutual reachability.

    One block gives its tree at once; more rows are joined in rounds over cells (``reachability.py``). Rows with
    fewer than ``k`` neighbours cannot occur while there are more than ``k`` rows.
    """
    alone = vectors.where("embedding is not null").limit(block_rows + 1).count() <= block_rows
    near = cut_lineage(neighbours(vectors, k if alone else max(k, LISTED), **tuning))
    core = near.where(F.col("rank") == k).select(F.col("article_id").alias("id"), F.col("distance").alias("core"))
    rows = cut_lineage(vectors_only(vectors, "article_id").join(core, "id"))
    if not alone:
        # small blocks of many rows would be mostly copies, one for each block of the other side
        least = math.ceil(rows.count() / MOST_BLOCKS)
        return tree_in_cells(rows, near, min(CELL_ROWS, max(block_rows, least)), min(BLOCK_ROWS, max(block_rows, least)))

    def tree(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        a, b, w = spanning_tree(matrix(table.column("embedding")), table.column("core").to_numpy())
        return pa.table({"a": pa.array(ids[a], pa.string()), "b": pa.array(ids[b], pa.string()), "w": w})

    return rows.groupBy().applyInArrow(tree, EDGE_SCHEMA)


class _Parts:
    """The parts of one slice of the tree while its edges are added, smallest first.

    A part below ``min_size`` remembers its rows. A larger one is a cluster: an id, its
    size, ``mass`` (sum over its rows of the density at which each leaves it) and the best
    total stability among the clusters below it.
    """

    def __init__(self, nodes: pd.DataFrame, min_size: int):
        self.min_size = min_size
        self.parent = {n: n for n in nodes["node"]}
        self.size = dict(zip(nodes["node"], nodes["size"]))
        self.members = {n: list(m) for n, m in zip(nodes["node"], nodes["members"])}
        self.cluster = dict(zip(nodes["node"], nodes["cluster"]))
        self.mass = dict(zip(nodes["node"], nodes["mass"]))
        self.below = dict(zip(nodes["node"], nodes["below"]))
        self.finished: list[tuple] = []
        self.joined: list[tuple] = []

    def root(self, n):
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def _enter(self, part, cluster):
        self.joined.extend((m, cluster) for m in self.members[part])
        self.members[part] = []

    def _close(self, part, density, parent):
        """A cluster ends where it merges with another: its stability is settled."""
        stability = self.mass[part] - self.size[part] * density
        chosen = stability >= self.below[part]
        self.finished.append((self.cluster[part], parent, float(stability), bool(chosen)))
        return max(stability, self.below[part])

    def merge_level(self, ends: list[tuple], w: float):
        """Adds all edges of one weight at once, so that the order among them does not matter."""
        met: dict = {}
        for a, b in ends:
            a, b = self.root(a), self.root(b)
            together = met.setdefault(a, {a}) | met.setdefault(b, {b})
            for part in together:
                met[part] = together
        for pieces in {id(group): sorted(group) for group in met.values()}.values():
            self._merge(pieces, 1.0 / max(w, MIN_DISTANCE))

    def _merge(self, pieces: list, density: float):
        clusters = [p for p in pieces if self.cluster[p] is not None]
        small = [p for p in pieces if self.cluster[p] is None]
        size = sum(self.size[p] for p in pieces)
        top = clusters[0] if clusters else pieces[0]
        if len(clusters) > 1:
            names = "|".join(sorted(self.cluster[p] for p in clusters))
            name = hashlib.md5(names.encode()).hexdigest()
            self.below[top] = sum(self._close(p, density, name) for p in clusters)
            self.cluster[top], self.mass[top] = name, size * density
        elif clusters:
            self.mass[top] += sum(self.size[p] for p in small) * density
        else:
            rows = [m for p in small for m in self.members[p]]
            if size >= self.min_size:
                self.cluster[top], self.mass[top], self.below[top] = min(rows), size * density, 0.0
            else:
                self.members[top] = rows
        if self.cluster[top] is not None:
            for p in small:
                self._enter(p, self.cluster[top])
        for p in pieces:
            self.parent[p] = top
        self.size[top] = size


STEP_SCHEMA = (
    "kind string, node string, size bigint, members array<string>, cluster string, mass double, "
    "below double, parent string, chosen boolean"
)


def _merge_slice(edges: DataFrame, state: DataFrame, labels: DataFrame, min_size: int) -> DataFrame:
    """Adds one slice of edges. Parts that the slice connects form a group; groups are
    independent tasks of at most ``SLICE_EDGES`` edges."""
    sides = labels.select(F.col("node").alias("a"), F.col("component").alias("group"))
    work_edges = edges.join(sides, "a").select("group", "a", "b", "w")
    work_nodes = state.join(labels.select("node", F.col("component").alias("group")), "node")

    def run(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.astype({"cluster": object})
        nodes["cluster"] = nodes["cluster"].where(nodes["cluster"].notna(), None)
        parts = _Parts(nodes, min_size)
        pairs = pairs.sort_values("w")
        ends = list(zip(pairs["a"], pairs["b"]))
        weights = pairs["w"].to_numpy()
        levels = np.flatnonzero(np.diff(weights)) + 1
        for lo, hi in zip([0, *levels], [*levels, len(weights)]):
            parts.merge_level(ends[lo:hi], weights[lo])
        root = parts.root(nodes["node"].iloc[0])
        out = [
            ("part", root, int(parts.size[root]), parts.members[root], parts.cluster[root],
             float(parts.mass[root]), float(parts.below[root]), None, None)
        ]
        out += [("row", r, None, None, c, None, None, None, None) for r, c in parts.joined]
        out += [("cluster", None, None, None, c, s, None, p, ok) for c, p, s, ok in parts.finished]
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])

    return (
        work_nodes.groupBy("group").cogroup(work_edges.groupBy("group")).applyInPandas(run, STEP_SCHEMA)
    )


def _copies(tree: DataFrame, nodes: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The level of distance 0: ``part_of`` (node, part), the state of the parts, and the rows
    that enter a cluster there. Rows of equal vectors may be any share of all rows, so they are
    joined as a table and reach a task of the hierarchy as one part."""
    labels = spanning_forest(tree.where("w <= 0"))[1]
    part_of = cut_lineage(
        nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    )
    sizes = part_of.groupBy("part").agg(F.count("*").alias("size"))
    large = F.col("size") >= min_size
    listed = part_of.join(sizes.where(~large).select("part"), "part", "left_semi")
    members = listed.groupBy("part").agg(F.collect_list("node").alias("members"))
    state = sizes.join(members, "part", "left").select(
        F.col("part").alias("node"),
        "size",
        F.coalesce("members", F.array().cast("array<string>")).alias("members"),
        F.when(large, F.col("part")).alias("cluster"),
        F.when(large, F.col("size") / F.lit(MIN_DISTANCE)).otherwise(F.lit(0.0)).alias("mass"),
        F.lit(0.0).alias("below"),
    )
    rows = part_of.join(sizes.where(large).select("part"), "part", "left_semi")
    return part_of, cut_lineage(state), rows.select("node", F.col("part").alias("cluster"))


def slice_count(edges: int, slice_edges: int) -> int:
    return max(1, math.ceil(edges / max(slice_edges, min(SLICE_EDGES, math.ceil(edges / MOST_SLICES)))))


def hierarchy(tree: DataFrame, min_size: int, slice_edges: int = SLICE_EDGES) -> tuple[DataFrame, DataFrame]:
    """``(node, cluster)`` for rows that enter a cluster, and ``(cluster, parent, chosen)``
    for every cluster that ends in a merge. The last cluster of a tree, the root, never ends and is
    not among them.

    Edges are added in order of weight, in few slices of bounded size; within a slice
    unconnected parts are processed side by side.
    """
    tree = cut_lineage(tree)
    nodes = tree.select(F.col("a").alias("node")).union(tree.select(F.col("b").alias("node"))).distinct()
    part_of, state, first_rows = _copies(tree, nodes, min_size)
    tree = tree.where("w > 0")
    slices = slice_count(tree.count(), slice_edges)
    cuts: list[float] = []
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        cuts = sorted(set(tree.approxQuantile("w", shares, 0.1 / slices)))
    rows, finished = [first_rows], []
    for low, high in zip([0.0, *cuts], [*cuts, math.inf]):
        ends = [part_of.select(F.col("node").alias(c), F.col("part").alias("p" + c)) for c in ("a", "b")]
        edges = cut_lineage(
            tree.where((F.col("w") > low) & (F.col("w") <= high))
            .join(ends[0], "a")
            .join(ends[1], "b")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"), "w")
        )
        if cuts:
            labels = cut_lineage(spanning_forest(edges)[1])
        else:
            # one slice, and the tree connects everything: one group of bounded size
            labels = state.select("node", F.lit("all").alias("component"))
        step = cut_lineage(_merge_slice(edges, state, labels, min_size))
        rows.append(step.where("kind = 'row'").select("node", "cluster"))
        finished.append(step.where("kind = 'cluster'").select("cluster", "parent", "chosen"))
        if high == math.inf:
            break
        parts = step.where("kind = 'part'").select("node", "size", "members", "cluster", "mass", "below")
        # a group goes on under the name of one of its parts
        heads = parts.select(F.col("node").alias("to")).join(labels.withColumnRenamed("node", "to"), "to")
        moved = labels.join(heads, "component").select(F.col("node").alias("part"), "to")
        part_of = cut_lineage(
            part_of.join(moved, "part", "left").select("node", F.coalesce("to", "part").alias("part"))
        )
        untouched = state.join(labels.select("node"), "node", "left_anti")
        state = cut_lineage(untouched.unionByName(parts))
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, finished)


def chosen_clusters(finished: DataFrame) -> DataFrame:
    """``(cluster, story)``: the topmost chosen cluster at or above each, by pointer jumping."""
    links = finished.select(
        "cluster",
        F.col("parent").alias("up"),
        F.when(F.col("chosen"), F.col("cluster")).alias("story"),
    )
    links = cut_lineage(links)
    while True:
        above = links.select(
            F.col("cluster").alias("up"), F.col("up").alias("next_up"), F.col("story").alias("up_story")
        )
        # a chosen cluster higher up outranks one below
        jumped = links.join(above, "up", "left").select(
            "cluster",
            F.col("next_up").alias("up"),
            F.coalesce("up_story", "story").alias("story"),
        )
        links = cut_lineage(jumped)
        if links.where("up is not null").isEmpty():
            return links.select("cluster", "story")


def cluster_vectors(vectors: DataFrame, min_size: int = 3, **tuning) -> DataFrame:
    """``(article_id, story)`` of every vector in a cluster; noise is left out. The story is
    named after its cluster in the hierarchy."""
    tree_tuning = {k: tuning.pop(k) for k in ("tree_block_rows",) if k in tuning}
    slice_edges = tuning.pop("slice_edges", SLICE_EDGES)
    vectors = cut_lineage(vectors.select("article_id", "embedding"))
    empty = vectors.sparkSession.createDataFrame([], "article_id string, story string")
    if vectors.limit(max(min_size, 2)).count() < max(min_size, 2):
        return empty
    k = min(min_size, vectors.limit(min_size + 1).count() - 1)
    tree = reachability_tree(vectors, k, tree_tuning.get("tree_block_rows", TREE_BLOCK_ROWS), **tuning)
    rows, finished = hierarchy(tree, min_size, slice_edges)
    stories = chosen_clusters(finished).where("story is not null")
    return rows.join(stories, "cluster").select(F.col("node").alias("article_id"), "story")


def cluster_stories(
    articles: DataFrame,
    vectors: DataFrame,
    article_clusters: DataFrame,
    as_of: Column,
    hours: float = 24,
    min_size: int = 3,
    **tuning,
) -> DataFrame:
    """``(article_id, cluster_id)`` for the unclustered articles of the window.

    The cluster id is derived from the smallest member id, so that a repeated run names it alike.
    """
    from newsloom.operators.reads import in_window_days, unclustered_ids, vectors_by_ids

    ids = unclustered_ids(articles, article_clusters, as_of, hours)
    stories = cluster_vectors(vectors_by_ids(in_window_days(vectors, as_of, hours), ids), min_size, **tuning)
    named = stories.groupBy("story").agg(F.sha2(F.min("article_id"), 256).alias("cluster_id"))
    return stories.join(named, "story").select("article_id", "cluster_id")


def build_clusters(assignments: DataFrame, articles: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """id, label, summary, article_count: the label is the earliest title, cut to 200 characters.
    ``summaries`` has cluster_id and summary; without one the summary is ``''``."""
    members = articles.select("id", "title", "published_at").join(
        assignments.withColumnRenamed("article_id", "id"), "id"
    )
    age = F.struct(F.col("published_at").isNull(), "published_at", "id")
    built = members.groupBy("cluster_id").agg(
        F.substring(F.min_by("title", age), 1, 200).alias("label"), F.count("*").alias("article_count")
    )
    if summaries is None:
        built = built.withColumn("summary", F.lit(""))
    else:
        built = built.join(summaries, "cluster_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return built.select(F.col("cluster_id").alias("id"), "label", "summary", "article_count")

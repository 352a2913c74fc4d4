"""Minimum spanning forest and connected components of an edge table.

Borůvka rounds: every component picks its smallest outgoing edge, components
joined by picked edges become one, and inner edges are dropped. Each round at
least halves the components. All steps are joins and partial aggregates, so a hub
with a large share of all edges is reduced before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut_lineage

# Edges that one task sorts and joins in memory.
FINISH_EDGES = 100_000


def _jump_to_roots(parents: DataFrame) -> DataFrame:
    """``(comp, root)`` from ``(comp, parent)`` by pointer jumping, log of the depth rounds."""
    links = parents
    while True:
        up = links.select(F.col("comp").alias("parent"), F.col("parent").alias("grand"))
        jumped = cut_lineage(
            links.join(up, "parent").select("comp", "parent", "grand")
        )
        moved = jumped.where("parent <> grand").limit(1).count()
        links = jumped.select("comp", F.col("grand").alias("parent"))
        if not moved:
            return links.select("comp", F.col("parent").alias("root"))


def _finish(live: DataFrame) -> DataFrame:
    """The rest of the work on few edges, in one task: picked edges and ``(comp, root)`` rows."""

    def kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict = {}

        def find(x):
            top.setdefault(x, x)
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        picked = []
        for e in pdf.sort_values(["w", "a", "b"]).itertuples(index=False):
            x, y = find(e.ca), find(e.cb)
            if x != y:
                top[max(x, y)] = min(x, y)
                picked.append((e.a, e.b, e.w, None, None))
        roots = [(None, None, None, c, find(c)) for c in list(top)]
        return pd.DataFrame(picked + roots, columns=["a", "b", "w", "comp", "root"])

    one = live.withColumn("all", F.lit(1))
    return one.groupBy("all").applyInPandas(kruskal, "a string, b string, w double, comp string, root string")


def spanning_forest(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b, w)`` of a minimum spanning forest, and ``(node, component)`` for
    every node that has an edge; a component is named after its smallest node.

    Once at most ``finish_edges`` edges are left between components, one task completes the work.
    """
    ordered = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"
    )
    ordered = ordered.groupBy("a", "b").agg(F.min("w").alias("w"))
    live = cut_lineage(ordered.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    labels = cut_lineage(nodes.select("node", F.col("node").alias("comp")))
    picked: list[DataFrame] = []
    while n_live := live.count():
        if n_live <= finish_edges:
            rest = cut_lineage(_finish(live))
            picked.append(rest.where("comp is null").select("a", "b", "w"))
            roots = rest.where("comp is not null").select("comp", "root")
            labels = labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
            break
        edge = F.struct("w", "a", "b")
        ends = live.select(F.col("ca").alias("comp"), F.struct(edge.alias("e"), F.col("cb").alias("to")).alias("pick"))
        ends = ends.union(live.select(F.col("cb"), F.struct(edge.alias("e"), F.col("ca").alias("to"))))
        best = cut_lineage(ends.groupBy("comp").agg(F.min("pick").alias("pick")).select("comp", "pick.*"))
        picked.append(best.select("e.a", "e.b", "e.w").distinct())
        # Two components that picked each other: the smaller one becomes the root.
        back = best.select(F.col("comp").alias("to"), F.col("to").alias("back"))
        mutual = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
        parents = best.join(back, "to").select(
            "comp", F.when(mutual, F.col("comp")).otherwise(F.col("to")).alias("parent")
        )
        roots = _jump_to_roots(cut_lineage(parents))
        labels = cut_lineage(
            labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        )
        ra = roots.select(F.col("comp").alias("ca"), F.col("root").alias("ra"))
        rb = roots.select(F.col("comp").alias("cb"), F.col("root").alias("rb"))
        outer = (
            live.join(ra, "ca")
            .join(rb, "cb")
            .where("ra <> rb")
            .select(
                F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"), F.struct("w", "a", "b").alias("e")
            )
        )
        # between two components only the smallest edge can be picked later
        live = cut_lineage(outer.groupBy("ca", "cb").agg(F.min("e").alias("e")).select("ca", "cb", "e.*"))
    names = labels.groupBy("comp").agg(F.min("node").alias("component"))
    forest = reduce(DataFrame.union, picked) if picked else edges.select("a", "b", "w").limit(0)
    return forest, labels.join(names, "comp").select("node", "component")


def components(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``(node, component)`` of the edges ``(a, b)``."""
    return spanning_forest(edges.select("a", "b", F.lit(1.0).alias("w")), finish_edges)[1]

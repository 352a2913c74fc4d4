"""The first two layers of duplicate removal: exact URL and SimHash.

``ord`` is the place of a row in the order of arrival, any sortable column or
struct; ``id`` breaks ties.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.merge import without_known
from newsloom.operators.near_hash import near_pairs
from newsloom.session import cut_lineage

# Hashes that one task compares in arrival order.
FINISH_HASHES = 20_000


def dedup_url(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows with an unknown URL, one of each URL within the batch: the first, and of rows in one place the one
    with the least hash of all its values.

    The choice is made on URL, place and hash alone, so article texts are not grouped or
    sorted, and a URL shared by very many rows is reduced before the shuffle.
    """
    marked = batch.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]))
    first = marked.groupBy("source_url").agg(F.min(F.struct("ord", "id", "_row")).alias("first"))
    fresh = without_known(first, existing, "source_url")
    chosen = fresh.select("source_url", "first.ord", "first.id", "first._row")
    place = ["source_url", "ord", "id", "_row"]
    # only equal rows are left to choose from: one place of each URL, so they lie where the join left them
    return marked.join(chosen, place, "left_semi").dropDuplicates(place).select(*batch.columns)


def first_per_hash(batch: DataFrame) -> DataFrame:
    """Distinct hashes with their first row: copies of a text collapse before any shuffle."""
    return batch.groupBy("simhash").agg(F.min(F.struct("ord", "id")).alias("first"))


def simhash_pairs(articles: DataFrame, t: int = 3) -> DataFrame:
    """Each article beside the first earlier one at most ``t`` bits away, with the distance.

    One row per article that has such an earlier one.
    """
    articles = cut_lineage(articles.select("id", "ord", "simhash"))
    # places are plain numbers: their least is kept in a hash table, where structs would have all pairs of a task sorted
    ordered = first_per_hash(articles).orderBy("first", "simhash")
    firsts = cut_lineage(ordered.select("simhash", "first", F.monotonically_increasing_id().alias("place")))
    left = firsts.select(F.col("simhash").alias("lh"))
    right = firsts.select(F.col("simhash").alias("rh"), "place")
    best = (
        near_pairs(left, right, t, firsts.count())
        .groupBy(F.col("lh").alias("simhash"))
        .agg(F.min("place").alias("place"))
    )
    match = F.struct("first", "simhash").alias("match")
    matched = articles.join(best.join(firsts.select("place", match), "place"), "simhash")
    earlier = F.col("match.first") < F.struct("ord", "id")
    return matched.where(earlier).select(
        "id",
        F.col("match.first.id").alias("match_id"),
        F.bit_count(F.col("simhash").bitwiseXOR(F.col("match.simhash"))).alias("distance"),
    )


def _without_near(firsts: DataFrame, recent: DataFrame, t: int) -> DataFrame:
    """Hashes not near any of ``recent``."""
    stored = recent.select(F.col("simhash").alias("rh")).distinct()
    n = max(firsts.count(), stored.count())
    near = near_pairs(firsts.select(F.col("simhash").alias("lh")), stored, t, n)
    hit = near.select(F.col("lh").alias("simhash")).distinct()
    return firsts.join(hit, "simhash", "left_anti")


def _greedy(undecided: DataFrame, t: int) -> DataFrame:
    """The pass itself over at most ``FINISH_HASHES`` hashes, in one task."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = np.empty(len(pdf), dtype=np.uint64)
        n, places = 0, []
        pdf = pdf.sort_values("place")
        for place, h in enumerate(pdf["simhash"].to_numpy().view(np.uint64)):
            if n == 0 or np.bitwise_count(kept[:n] ^ h).min() > t:
                kept[n] = h
                n += 1
                places.append(place)
        return pdf.iloc[places][["simhash"]]

    # bounded rows, so one window over all of them is
    placed = undecided.select("simhash", F.row_number().over(Window.orderBy("first")).alias("place"))
    chosen = placed.groupBy().applyInPandas(keep, "simhash long")
    return undecided.join(chosen, "simhash", "left_semi")


def dedup_simhash(
    batch: DataFrame, recent: DataFrame | None = None, t: int = 3, finish_hashes: int = FINISH_HASHES
) -> DataFrame:
    """The rows a pass in arrival order keeps: no stored hash and no hash of an earlier
    kept row is within ``t`` bits. ``batch`` has id, simhash and ord; of an id only its first row counts.

    Computed in rounds instead of row by row (Blelloch, Fineman, Shun 2012). In a
    round an undecided hash is dropped if an earlier one near it was kept last
    round, kept if no earlier one near it is undecided, and otherwise waits. Only
    waiting hashes enter the next round; once at most ``finish_hashes`` are left,
    one task completes the pass.
    """
    # one row per id: its first
    first = batch.groupBy("id").agg(F.min(F.struct("ord", "simhash")).alias("f"))
    batch = first.select("id", "f.simhash", "f.ord")
    undecided = cut_lineage(first_per_hash(batch))
    if recent is not None:
        undecided = cut_lineage(_without_near(undecided, recent, t))
    n = undecided.count()
    just_kept, n_kept = undecided.limit(0), 0
    kept: list[DataFrame] = []
    while n > finish_hashes:
        left = undecided.select(F.col("simhash").alias("lh"), F.col("first").alias("l_first"))
        pool = undecided.withColumn("kept", F.lit(False)).unionByName(
            just_kept.withColumn("kept", F.lit(True))
        )
        right = pool.select(F.col("simhash").alias("rh"), F.col("first").alias("r_first"), "kept")
        earlier = F.col("r_first") < F.col("l_first")
        seen = (
            near_pairs(left, right, t, n + n_kept, earlier)
            .groupBy(F.col("lh").alias("simhash"))
            .agg(F.bool_or("kept").alias("near_kept"))
        )
        judged = cut_lineage(undecided.join(seen, "simhash", "left"))
        just_kept = judged.where("near_kept is null").drop("near_kept")
        undecided = judged.where("not near_kept").drop("near_kept")
        kept.append(just_kept)
        n_kept, n = judged.agg(
            F.count_if(F.col("near_kept").isNull()), F.count_if(~F.col("near_kept"))
        ).first()
    if n:
        if kept:
            undecided = cut_lineage(_without_near(undecided, just_kept, t))
        kept.append(cut_lineage(_greedy(undecided, t)))
    if not kept:
        return batch.limit(0)
    survivors = reduce(DataFrame.unionByName, kept)
    return survivors.select(F.col("first.id").alias("id"), "simhash", F.col("first.ord").alias("ord"))

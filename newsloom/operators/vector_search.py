"""Search over the vector table, and the third layer of duplicate removal."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.blocks import SCORE_DECIMALS, matrix
from newsloom.operators.similarity import top_matches, vectors_only
from newsloom.session import cut_lineage

# Below every character that an id has.
DAY_MARK = "\x00"
# Rows that one task settles feed by feed.
FINISH_ROWS = 4096


def filter_vectors(
    vectors: DataFrame,
    region: str | None = None,
    source_feed: str | None = None,
    since: Column | None = None,
) -> DataFrame:
    """The payload filters, applied before any scoring so that they reach the scan.
    A vector without date never passes ``since``."""
    if region:
        vectors = vectors.where(F.col("region") == region)
    if source_feed:
        vectors = vectors.where(F.col("source_feed") == source_feed)
    if since is not None:
        vectors = vectors.where(F.col("published_at") >= since)
    return vectors


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    min_score: float | None = 0.0,
    region: str | None = None,
    source_feed: str | None = None,
    since: Column | None = None,
    **tuning,
) -> DataFrame:
    """query_id, article_id, score, rank: the best ``k`` filtered vectors of each query
    with a cosine of at least ``min_score``. Vectors laid out by day give their ``ingest_date`` too."""
    stored = filter_vectors(vectors, region, source_feed, since)
    by_day = "ingest_date" in stored.columns
    if by_day:  # the day travels behind the id, where it changes no order among ids
        stored = stored.withColumn("article_id", F.concat("article_id", F.lit(DAY_MARK), F.col("ingest_date").cast("string")))
    found = top_matches(vectors_only(queries, "query_id"), vectors_only(stored, "article_id"), k, min_score, **tuning)
    if by_day:
        parts = F.split("article_id", DAY_MARK)
        found = found.withColumns({"article_id": parts[0], "ingest_date": parts[1].cast("date")})
    return found


def best_matches(batch: DataFrame, vectors: DataFrame, t: float, **tuning) -> DataFrame:
    """For each new vector the best stored one with cosine ``t`` or more: article_id, match_id,
    score. One row per new vector at most, however many copies are stored."""
    found = top_matches(
        vectors_only(batch, "article_id"), vectors_only(vectors, "article_id"), 1, t, **tuning
    )
    return found.select(
        F.col("query_id").alias("article_id"), F.col("article_id").alias("match_id"), "score"
    )


def dedup_vectors(batch: DataFrame, vectors: DataFrame, t: float = 0.95, **tuning) -> DataFrame:
    """Rows of the batch without a stored vector of cosine ``t`` or more."""
    hits = best_matches(batch, vectors, t, **tuning).select("article_id")
    return batch.join(hits, "article_id", "left_anti").select(*batch.columns)


def _feed_by_feed(undecided: DataFrame, t: float) -> DataFrame:
    """The ids a pass over the feeds keeps, for a bounded number of rows, in one task."""

    def keep(table: pa.Table) -> pa.Table:
        rows = matrix(table.column("embedding"))
        feed = table.column("batch_seq").to_numpy()
        kept = np.zeros(len(rows), dtype=bool)
        for number in np.unique(feed):
            mine = np.flatnonzero(feed == number)
            near = np.round(rows[mine] @ rows[kept].T, SCORE_DECIMALS) >= np.round(t, SCORE_DECIMALS)
            kept[mine] = ~near.any(axis=1)
        return pa.table({"article_id": table.column("article_id").filter(pa.array(kept))})

    rows = undecided.select(
        "article_id", F.col("embedding").cast("array<float>"), F.col("batch_seq").cast("long").alias("batch_seq")
    )
    return rows.groupBy().applyInArrow(keep, "article_id string")


def dedup_vectors_in_order(
    batch: DataFrame, vectors: DataFrame, t: float = 0.95, finish_rows: int = FINISH_ROWS, **tuning
) -> DataFrame:
    """As ``dedup_vectors`` for several feeds that are stored one after the other.

    A row is compared with the stored vectors and with kept rows of a smaller
    ``batch_seq``, never within its own. In rounds: a row waits while an earlier row
    near it is undecided. At most ``finish_rows`` remaining rows are settled in one task.
    """
    undecided = cut_lineage(dedup_vectors(batch, vectors, t, **tuning))
    kept: list[DataFrame] = []
    just_kept = undecided.limit(0)

    def hit_ids(rows: DataFrame, pool: DataFrame, name: str) -> DataFrame:
        seq = F.col("batch_seq").cast("long").alias("seq")
        found = top_matches(
            vectors_only(rows, "article_id", seq), vectors_only(pool, "article_id", seq), 1, t, **tuning
        )
        return found.select(F.col("query_id").alias("article_id"), F.lit(True).alias(name))

    while (n := undecided.count()) > finish_rows:
        judged = undecided.join(hit_ids(undecided, undecided, "waits"), "article_id", "left")
        if kept:
            judged = judged.join(hit_ids(undecided, just_kept, "dropped"), "article_id", "left")
        else:
            judged = judged.withColumn("dropped", F.lit(None).cast("boolean"))
        judged = cut_lineage(judged)
        just_kept = judged.where("dropped is null and waits is null").select(*batch.columns)
        undecided = judged.where("dropped is null and waits").select(*batch.columns)
        kept.append(just_kept)
    if n:
        if kept:
            dropped = hit_ids(undecided, just_kept, "dropped").select("article_id")
            undecided = cut_lineage(undecided.join(dropped, "article_id", "left_anti").select(*batch.columns))
        kept.append(undecided.join(_feed_by_feed(undecided, t), "article_id", "left_semi").select(*batch.columns))
    return reduce(DataFrame.unionByName, kept) if kept else undecided

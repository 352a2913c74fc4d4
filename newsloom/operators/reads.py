"""Lookups on the stored tables. ``as_of`` stands for "now", so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import since, utc_day
from newsloom.session import cut_lineage


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published_at"), F.asc("id")]


def within(
    df: DataFrame, as_of: Column, hours: float, column: str = "ingested_at", day_granular: bool = False
) -> DataFrame:
    """Rows of the last ``hours``. On a table laid out by ingest day the day is
    filtered too, so that older directories are not listed."""
    start = since(as_of, hours, day_granular)
    recent = df.where(F.col(column) > start)
    if column == "ingested_at" and "ingest_date" in df.columns:
        recent = recent.where(F.col("ingest_date") >= utc_day(start))
    return recent


def recent_articles(
    articles: DataFrame,
    as_of: Column,
    hours: float = 24,
    limit: int = 100,
    category: str | None = None,
    region: str | None = None,
    day_granular: bool = False,
) -> DataFrame:
    recent = within(articles, as_of, hours, day_granular=day_granular)
    if category:
        recent = recent.where(F.col("category") == category)
    if region:
        recent = recent.where(F.col("region") == region)
    return recent.orderBy(*newest_first()).limit(limit)


def articles_by_region(
    articles: DataFrame, as_of: Column, region: str, hours: float = 24, limit: int = 50
) -> DataFrame:
    return recent_articles(articles, as_of, hours, limit, region=region)


def on_days_of(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``df`` on the ingest days that occur in ``rows``, if both are laid out by day.

    The days, as many as the store keeps, come to the driver, so the scan lists their directories only. ``rows`` is
    evaluated for it and should be written already if it is costly.
    """
    if "ingest_date" not in df.columns or "ingest_date" not in rows.columns:
        return df
    days = [r["ingest_date"] for r in rows.select("ingest_date").distinct().collect()]
    return df.where(F.col("ingest_date").isin([d for d in days if d is not None]))


def in_window_days(df: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """The rows of ``df`` on the ingest days of the last ``hours``, if it is laid out by day.

    What hangs on an article lies on the article's day, so nothing that belongs to the window is left out.
    """
    if "ingest_date" not in df.columns:
        return df
    return df.where(F.col("ingest_date") >= utc_day(since(as_of, hours)))


def _keys(*tables: DataFrame) -> list[str]:
    """What rows of tables about articles are joined by: the day too, if all of them have it."""
    return ["id"] if any("ingest_date" not in t.columns for t in tables) else ["id", "ingest_date"]


def _members(article_clusters: DataFrame) -> DataFrame:
    day = [c for c in ("ingest_date",) if c in article_clusters.columns]
    return article_clusters.select(F.col("article_id").alias("id"), "cluster_id", *day)


def cluster_articles(
    articles: DataFrame, clusters: DataFrame, article_clusters: DataFrame | None = None
) -> DataFrame:
    """Articles of every given cluster in one join, with ``cluster_id``. Newest first
    within a cluster is the reader's ordering (``newest_first``).

    The assignments are cut down to the clusters before they meet the articles, and of the articles only the days of the
    members are read; without ``article_clusters`` the articles carry ``cluster_id`` themselves.
    """
    ids = clusters.select(F.col("id").alias("cluster_id"))
    if article_clusters is None:
        return articles.join(ids, "cluster_id", "left_semi")
    members = _members(article_clusters).join(ids, "cluster_id", "left_semi")
    if "ingest_date" in members.columns:
        members = cut_lineage(members)
    keys = _keys(articles, members)
    return on_days_of(articles, members).join(members.select(*keys, "cluster_id"), keys)


def with_cluster(found: DataFrame, article_clusters: DataFrame | None) -> DataFrame:
    """Result rows with their nullable ``cluster_id``. Called after limits, so that only the
    result is joined; rows that carry one already are left alone."""
    if article_clusters is None:
        return found
    members = on_days_of(_members(article_clusters), found)
    keys = _keys(found, members)
    return found.join(members.select(*keys, "cluster_id"), keys, "left")


def articles_by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return articles.join(ids.select("id"), "id", "left_semi")


def unclustered_ids(
    articles: DataFrame, article_clusters: DataFrame, as_of: Column, hours: float = 24
) -> DataFrame:
    """Ids of recent articles without an assignment."""
    recent = within(articles, as_of, hours).select("id")
    taken = in_window_days(article_clusters, as_of, hours).select(F.col("article_id").alias("id"))
    return recent.join(taken, "id", "left_anti")


def top_clusters(clusters: DataFrame, as_of: Column, hours: float = 24, limit: int = 10) -> DataFrame:
    recent = within(clusters, as_of, hours, "updated_at")
    return recent.orderBy(F.desc("article_count"), "id").limit(limit)


def article_entities(entities: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col("id").alias("article_id"))
    return entities.join(wanted, "article_id", "left_semi")


def recent_simhashes(articles: DataFrame, as_of: Column, hours: float = 48) -> DataFrame:
    return within(articles, as_of, hours).select("id", "simhash")


def vectors_by_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col("id").alias("article_id"))
    return vectors.join(wanted, "article_id", "left_semi")

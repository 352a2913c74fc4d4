"""News of one region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import iso_or_empty
from newsloom.operators.reads import articles_by_region, newest_first, with_cluster


def news_by_region(
    articles: DataFrame,
    as_of: Column,
    region: str,
    hours: float = 24,
    limit: int = 50,
    article_clusters: DataFrame | None = None,
) -> DataFrame:
    """``cluster_id`` comes from ``article_clusters``, or without it from the articles."""
    found = with_cluster(articles_by_region(articles, as_of, region, hours, limit), article_clusters)
    return found.orderBy(*newest_first()).select(
        "title",
        "summary",
        F.col("source_url").alias("url"),
        F.col("source_feed").alias("source"),
        "category",
        iso_or_empty(F.col("published_at")).alias("published_at"),
        "cluster_id",
    )

"""Latest headlines: the largest current stories, or single articles where there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import iso_or_empty
from newsloom.operators.reads import cluster_articles, recent_articles, top_clusters
from newsloom.operators.rollup import article_card, cluster_rollup, nested_articles, top_per_cluster
from newsloom.session import cut_lineage


def _stories(
    articles: DataFrame,
    clusters: DataFrame,
    as_of: Column,
    hours: float,
    limit: int,
    category: str | None,
    article_clusters: DataFrame | None,
) -> DataFrame:
    top = top_clusters(clusters, as_of, hours, limit)
    members = cluster_articles(articles, top, article_clusters)
    stories = (
        top.select(
            F.col("id").alias("cluster_id"),
            F.col("label").alias("headline"),
            "summary",
            "article_count",
        )
        .join(cluster_rollup(members, category), "cluster_id", "left")
        .join(nested_articles(top_per_cluster(members), "cluster_id"), "cluster_id", "left")
    )
    if category:
        stories = stories.where("has_category")
    return stories.select(
        "cluster_id",
        "headline",
        "summary",
        "article_count",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("latest_published", F.lit("")).alias("latest_published"),
        "articles",
        F.struct((-F.col("article_count")).alias("a"), F.col("cluster_id").alias("b")).alias("_place"),
    )


def latest_headlines(
    articles: DataFrame,
    clusters: DataFrame,
    as_of: Column,
    hours: float = 24,
    limit: int = 20,
    category: str | None = None,
    article_clusters: DataFrame | None = None,
) -> DataFrame:
    """Top clusters of the window with sources, latest date and five newest articles.

    The category test comes after the limit, so fewer than ``limit`` stories may
    remain. If none do, the newest articles of the window (and category) are
    returned one by one. Members come from ``article_clusters``, or without it from the
    ``cluster_id`` of the articles.
    """
    # at most ``limit`` rows, computed once: for the answer and to see whether there are any
    stories = cut_lineage(_stories(articles, clusters, as_of, hours, limit, category, article_clusters))
    if not stories.isEmpty():
        return stories.orderBy("_place").drop("_place")
    singles = (
        recent_articles(articles, as_of, hours, limit, category=category)
        .select(
            F.lit(None).cast("string").alias("cluster_id"),
            F.col("title").alias("headline"),
            "summary",
            F.lit(1).cast("bigint").alias("article_count"),
            F.array("source_feed").alias("sources"),
            iso_or_empty(F.col("published_at")).alias("latest_published"),
            F.array(article_card()).alias("articles"),
            F.struct(
                F.coalesce(-F.unix_micros("published_at"), F.lit(2**63 - 1)).alias("a"),
                F.col("id").alias("b"),
            ).alias("_place"),
        )
    )
    return singles.orderBy("_place").drop("_place")


def headlines_json(headlines: DataFrame) -> DataFrame:
    """Each result as JSON text, in the order given."""
    return headlines.select(F.to_json(F.struct("*")).alias("json"))

"""Trending topics: the largest current stories, or categories where there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.reads import cluster_articles, recent_articles, top_clusters
from newsloom.operators.rollup import category_rollup, cluster_rollup


def trending_topics(
    articles: DataFrame,
    clusters: DataFrame,
    as_of: Column,
    hours: float = 12,
    limit: int = 10,
    article_clusters: DataFrame | None = None,
) -> DataFrame:
    """Top clusters with sources, regions and latest date. If the window has none, its
    newest ``3 * limit`` articles grouped by category. Members come from ``article_clusters``, or
    without it from the ``cluster_id`` of the articles."""
    top = top_clusters(clusters, as_of, hours, limit)
    rollup = cluster_rollup(cluster_articles(articles, top, article_clusters))
    empty = F.array().cast("array<string>")
    stories = (
        top.withColumnRenamed("id", "cluster_id")
        .join(rollup, "cluster_id", "left")
        .select(
            "cluster_id",
            F.col("label").alias("topic"),
            "summary",
            "article_count",
            F.coalesce("sources", empty).alias("sources"),
            F.coalesce("regions", empty).alias("regions"),
            F.coalesce("latest_published", F.lit("")).alias("latest_published"),
            F.struct(F.lit(0).cast("bigint").alias("age"), F.col("cluster_id").alias("id")).alias("_place"),
        )
    )
    none_left = top.limit(1).agg((F.count("*") == 0).alias("none_left")).scalar()
    newest = recent_articles(articles.where(none_left), as_of, hours, 3 * limit)
    groups = category_rollup(newest).withColumnRenamed("first", "_place")
    groups = groups.withColumn("cluster_id", F.lit(None).cast("string"))
    return (
        stories.unionByName(groups.select(*stories.columns))
        .orderBy(F.desc("article_count"), "_place")
        .limit(limit)
        .drop("_place")
    )

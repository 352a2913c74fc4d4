"""Per-cluster and per-category summaries used by the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import iso_or_empty, sorted_set
from newsloom.operators.reads import newest_first


def cluster_rollup(members: DataFrame, category: str | None = None) -> DataFrame:
    """Sources, non-empty regions and latest date of each ``cluster_id``; with a category
    also whether any member has it. All are partial aggregates."""
    extra = [F.bool_or(F.col("category") == category).alias("has_category")] if category else []
    return members.groupBy("cluster_id").agg(
        sorted_set(F.col("source_feed")).alias("sources"),
        sorted_set(F.nullif(F.col("region"), F.lit(""))).alias("regions"),
        iso_or_empty(F.max("published_at")).alias("latest_published"),
        *extra,
    )


def top_per_cluster(members: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` articles of each cluster with their ``position``.

    Spark limits each group before the shuffle, so at most ``n`` rows per group
    and task move.
    """
    w = Window.partitionBy("cluster_id").orderBy(*newest_first())
    return members.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def article_card() -> Column:
    return F.struct(
        "title",
        F.col("source_url").alias("url"),
        F.col("source_feed").alias("source"),
        iso_or_empty(F.col("published_at")).alias("published_at"),
    )


def nested_articles(ranked: DataFrame, key: str) -> DataFrame:
    """``articles``: the ranked rows of each key as an array in rank order. The input has
    at most a fixed number of rows per key."""
    pairs = F.sort_array(F.collect_list(F.struct("position", article_card().alias("card"))))
    return ranked.groupBy(key).agg(F.transform(pairs, lambda p: p["card"]).alias("articles"))


def category_rollup(articles: DataFrame) -> DataFrame:
    """Articles grouped by category (``general`` if empty) as pseudo topics. ``first`` is
    the place of its newest article, for ordering groups of equal size."""
    newest = F.struct(
        F.coalesce(-F.unix_micros("published_at"), F.lit(2**63 - 1)).alias("age"), F.col("id")
    )
    grouped = articles.groupBy(
        F.when(F.coalesce("category", F.lit("")) == "", "general")
        .otherwise(F.col("category"))
        .alias("category")
    ).agg(
        F.min_by("title", newest).alias("summary"),
        F.count("*").alias("article_count"),
        sorted_set(F.col("source_feed")).alias("sources"),
        sorted_set(F.nullif(F.col("region"), F.lit(""))).alias("regions"),
        iso_or_empty(F.max("published_at")).alias("latest_published"),
        F.min(newest).alias("first"),
    )
    return grouped.select(
        F.concat("category", F.lit(" news")).alias("topic"),
        "summary",
        "article_count",
        "sources",
        "regions",
        "latest_published",
        "first",
    )

"""Retention and the agreement check between the article and the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import since
from newsloom.tables import NewsTables


def expired_articles(
    articles: DataFrame, as_of: Column, days: int = 180, day_granular: bool = False
) -> DataFrame:
    """Ids of the articles ingested before the cutoff."""
    cutoff = since(as_of, days * 24, day_granular)
    return articles.where(F.col("ingested_at") < cutoff).select("id")


def apply_retention(
    tables: NewsTables, as_of: Column, days: int = 180, day_granular: bool = False
) -> tuple[NewsTables, DataFrame]:
    """The tables without expired articles and what hangs on them, and the deleted ids.

    Articles are cut by a filter on the ingest time, which removes whole day
    directories. Clusters left without article go too, but only if anything was
    deleted at all.
    """
    cutoff = since(as_of, days * 24, day_granular)
    deleted = expired_articles(tables.articles, as_of, days, day_granular)
    kept = tables.articles.where(F.col("ingested_at") >= cutoff)
    gone = deleted.withColumnRenamed("id", "article_id")
    assigned = tables.article_clusters.join(gone, "article_id", "left_anti")
    clusters = live_clusters(tables.clusters, assigned, deleted)
    return (
        tables.with_(
            articles=kept,
            entities=tables.entities.join(gone, "article_id", "left_anti").select(
                *tables.entities.columns
            ),
            vectors=tables.vectors.join(gone, "article_id", "left_anti").select(
                *tables.vectors.columns
            ),
            article_clusters=assigned.select(*tables.article_clusters.columns),
            clusters=clusters.select(*tables.clusters.columns),
        ),
        deleted,
    )


def live_clusters(clusters: DataFrame, assigned: DataFrame, deleted: DataFrame) -> DataFrame:
    """Clusters that still have an article; all of them if nothing was deleted."""
    in_use = assigned.select(F.col("cluster_id").alias("id"))
    any_deleted = deleted.limit(1).agg((F.count("*") > 0).alias("any_deleted")).scalar()
    used = clusters.join(in_use.distinct().withColumn("used", F.lit(True)), "id", "left")
    return used.where(F.col("used").isNotNull() | ~any_deleted).select(*clusters.columns)


def empty_clusters(clusters: DataFrame, assigned: DataFrame) -> DataFrame:
    in_use = assigned.select(F.col("cluster_id").alias("id")).distinct()
    return clusters.join(in_use, "id", "left_anti")


def with_live_count(clusters: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clusters with the number of articles they hold now, beside the stored count."""
    counts = assigned.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("live_article_count"))
    return clusters.join(counts, "id", "left").withColumn(
        "live_article_count", F.coalesce("live_article_count", F.lit(0))
    )


def audit_stores(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many ids are on both sides or on one only, and what to do about it.

    If one side is empty and the other is not, the other is to be cleared.
    """
    a = articles.select("id", F.lit(1).alias("a"))
    v = vectors.select(F.col("article_id").alias("id"), F.lit(1).alias("v"))
    both = a.join(v, "id", "full_outer")
    counts = both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("v").isNotNull()).alias("in_both"),
        F.count_if(F.col("v").isNull()).alias("articles_only"),
        F.count_if(F.col("a").isNull()).alias("vectors_only"),
    )
    n_articles = F.col("in_both") + F.col("articles_only")
    n_vectors = F.col("in_both") + F.col("vectors_only")
    action = (
        F.when((n_articles == 0) & (n_vectors > 0), "reset_vectors")
        .when((n_articles > 0) & (n_vectors == 0), "clear_articles")
        .otherwise("none")
    )
    return counts.withColumn("action", action)


def reconcile_stores(tables: NewsTables) -> NewsTables:
    """The tables after the audit's action. The audit is one row, so reading it is bounded."""
    action = audit_stores(tables.articles, tables.vectors).first()["action"]
    if action == "reset_vectors":
        return tables.with_(vectors=tables.vectors.limit(0))
    if action == "clear_articles":
        return tables.with_(
            articles=tables.articles.limit(0),
            entities=tables.entities.limit(0),
            article_clusters=tables.article_clusters.limit(0),
            clusters=tables.clusters.limit(0),
        )
    return tables

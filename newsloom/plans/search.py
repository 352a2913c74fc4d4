"""Semantic search over the articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import hours_before
from newsloom.functions.text import iso_or_empty
from newsloom.operators.reads import on_days_of, with_cluster
from newsloom.operators.vector_search import knn
from newsloom.session import cut_lineage


def found_articles(
    articles: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    as_of: Column,
    k: int,
    min_score: float,
    region: str | None = None,
    hours: float | None = None,
) -> DataFrame:
    """The articles of the best vectors with query_id, score and rank. ``hours`` counts back
    from ``as_of`` by publication date."""
    start = None if hours is None else hours_before(as_of, hours)
    hits = knn(vectors, queries, k, min_score, region=region, since=start).withColumnRenamed("article_id", "id")
    if "ingest_date" not in articles.columns or "ingest_date" not in hits.columns:
        return articles.join(hits.drop("ingest_date"), "id")
    # a few rows a query, looked up in the directories of their days alone
    hits = cut_lineage(hits)
    return on_days_of(articles, hits).join(hits, ["id", "ingest_date"])


def search_news(
    articles: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    as_of: Column,
    limit: int = 20,
    region: str | None = None,
    hours: float | None = None,
    article_clusters: DataFrame | None = None,
) -> DataFrame:
    """Results of all queries (query_id, embedding), each query's best score first.
    ``cluster_id`` comes from ``article_clusters``, or without it from the articles."""
    found = found_articles(articles, vectors, queries, as_of, limit, 0.0, region, hours)
    found = with_cluster(found, article_clusters)
    return found.orderBy("query_id", "rank").select(
        "query_id",
        "rank",
        "title",
        "summary",
        F.col("source_url").alias("url"),
        F.col("source_feed").alias("source"),
        "region",
        "category",
        iso_or_empty(F.col("published_at")).alias("published_at"),
        F.round("score", 4).alias("relevance_score"),
        "cluster_id",
    )

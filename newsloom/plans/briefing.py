"""Topic briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import sorted_set
from newsloom.operators.reads import on_days_of
from newsloom.operators.rollup import nested_articles
from newsloom.operators.summarize import TextFn, briefing_text
from newsloom.plans.search import found_articles

NOTHING = "No relevant articles found."
MIN_SCORE = 0.3


def topic_briefing(
    articles: DataFrame,
    vectors: DataFrame,
    topics: DataFrame,
    as_of: Column,
    hours: float | None = 48,
    max_articles: int = 10,
    entities: DataFrame | None = None,
    fn: TextFn | None = None,
) -> DataFrame:
    """One row per topic (query_id, topic, embedding): the briefing, its sources and articles.

    Topics without an article of cosine 0.3 or more get a fixed sentence. ``hours=None``
    searches all dates.
    """
    found = found_articles(articles, vectors, topics, as_of, max_articles, MIN_SCORE, hours=hours)
    found = found.join(topics.select("query_id", "topic"), "query_id")
    if entities is not None:
        entities = on_days_of(entities, found)
    summary = found.groupBy("query_id").agg(
        F.count("*").alias("article_count"), sorted_set(F.col("source_feed")).alias("sources")
    )
    cards = nested_articles(found.withColumn("position", F.col("rank")), "query_id")
    return (
        topics.select("query_id", "topic")
        .join(briefing_text(found, entities, fn), "query_id", "left")
        .join(summary, "query_id", "left")
        .join(cards, "query_id", "left")
        .select(
            "query_id",
            "topic",
            F.when(F.col("article_count").isNull(), NOTHING).otherwise(F.col("briefing")).alias("briefing"),
            F.coalesce("article_count", F.lit(0)).alias("article_count"),
            F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
            "articles",
        )
    )

"""Raw entries and records to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_compact_date, parse_feed_date
from newsloom.functions.regions import country_region
from newsloom.functions.text import clean_html, non_empty, strip_text

ARTICLE_COLUMNS = [
    "id",
    "title",
    "summary",
    "content",
    "source_url",
    "source_feed",
    "author",
    "region",
    "category",
    "published_at",
    "ingested_at",
]


def article_id(url: Column) -> Column:
    """Derived from the URL, so that a repeated task or batch names the article alike."""
    return F.sha2(url, 256)


def carried(df: DataFrame) -> list[str]:
    """The column that orders payloads, if there is one."""
    return [c for c in ("payload",) if c in df.columns]


def normalize_rss(entries: DataFrame, feeds: DataFrame, as_of: Column) -> DataFrame:
    """Articles of feed entries, plus ``feed_id`` and ``item_seq``.

    Entries without URL or title are left out. Name, region and category come
    from the feed.
    """
    first_content = F.try_element_at("content", F.lit(1))["value"]
    cleaned = entries.select(
        "feed_id",
        "item_seq",
        strip_text(F.col("link")).alias("source_url"),
        clean_html(F.col("title")).alias("title"),
        clean_html(non_empty(F.col("summary"), F.col("description"))).alias("summary"),
        clean_html(F.coalesce(first_content, F.lit(""))).alias("body"),
        F.coalesce("author", F.lit("")).alias("author"),
        parse_feed_date(non_empty(F.col("published"), F.col("updated"))).alias("published_at"),
        *carried(entries),
    ).where((F.length("source_url") > 0) & (F.length("title") > 0))
    origin = feeds.select(
        F.col("id").alias("feed_id"), F.col("name").alias("source_feed"), "region", "category"
    )
    return (
        cleaned.join(origin, "feed_id")
        .withColumn("content", non_empty(F.col("body"), F.col("summary")))
        .withColumn("id", article_id(F.col("source_url")))
        .withColumn("ingested_at", as_of)
        .select(*ARTICLE_COLUMNS, "feed_id", "item_seq", *carried(entries))
    )


def normalize_gdelt(records: DataFrame, as_of: Column) -> DataFrame:
    """Articles of API records, plus ``item_seq``; title doubles as summary and content."""
    trimmed = records.withColumn("url", strip_text(F.col("url"))).withColumn(
        "title", strip_text(F.col("title"))
    )
    return trimmed.where((F.length("url") > 0) & (F.length("title") > 0)).select(
        article_id(F.col("url")).alias("id"),
        "title",
        F.col("title").alias("summary"),
        F.col("title").alias("content"),
        F.col("url").alias("source_url"),
        F.lit("gdelt").alias("source_feed"),
        F.coalesce("domain", F.lit("")).alias("author"),
        country_region(F.col("sourcecountry")).alias("region"),
        F.lit("general").alias("category"),
        parse_compact_date(F.col("seendate")).alias("published_at"),
        as_of.alias("ingested_at"),
        "item_seq",
        *carried(records),
    )

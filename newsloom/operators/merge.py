"""Table updates, each a new DataFrame made from the stored one and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Distinct keys of a batch that are sent to the stored ones.
MAX_SENT_KEYS = 200_000

def merge_feeds(feeds: DataFrame, config: DataFrame) -> DataFrame:
    """The feed table after the configuration took effect.

    New ids are inserted; known ones take name, URL, region, category and enabled
    from the configuration and keep their validators while the URL stays. An id
    that is new but whose URL belongs to a stored feed outside the configuration
    takes that feed over. Stored feeds left over are disabled.
    """
    cfg = config.select(
        F.col("id").alias("c_id"),
        F.col("name").alias("c_name"),
        F.col("url").alias("c_url"),
        F.col("region").alias("c_region"),
        F.col("category").alias("c_category"),
        F.col("enabled").alias("c_enabled"),
    )
    configured_ids = cfg.select(F.col("c_id").alias("id"))
    orphans = feeds.join(configured_ids, "id", "left_anti").select("id", "url")
    unknown = cfg.join(feeds.select(F.col("id").alias("c_id")), "c_id", "left_anti")
    # old id -> configured id, for feeds recognised by URL alone
    adopted = orphans.join(unknown, orphans["url"] == unknown["c_url"]).select("id", "c_id")
    renamed = feeds.join(adopted, "id", "left").withColumn("id", F.coalesce("c_id", "id")).drop("c_id")
    both = renamed.join(cfg, renamed["id"] == cfg["c_id"], "full_outer")
    configured = F.col("c_id").isNotNull()
    same_url = F.col("url") == F.col("c_url")

    def chosen(name: str) -> Column:
        return F.when(configured, F.col(f"c_{name}")).otherwise(F.col(name)).alias(name)

    def validator(name: str) -> Column:
        kept = F.when(configured & ~F.coalesce(same_url, F.lit(False)), "").otherwise(F.col(name))
        return kept.alias(name)

    return both.select(
        F.coalesce("c_id", "id").alias("id"),
        chosen("name"),
        chosen("url"),
        chosen("region"),
        chosen("category"),
        validator("etag"),
        validator("last_modified"),
        F.when(configured, F.col("c_enabled")).otherwise(F.lit(False)).alias("enabled"),
    )


def first_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of every key. As an aggregate, so that a key holding a large
    share of all rows is reduced before the shuffle instead of sorted in one task."""
    row = F.struct(*df.columns)
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, rank).alias("_row"))
    return picked.select("_row.*")


def without_known(rows: DataFrame, existing: DataFrame, key: str, sent: int = MAX_SENT_KEYS) -> DataFrame:
    """``rows`` whose ``key`` is not in ``existing``.

    An anti-join could only send or move the history. The keys of a batch of at most ``sent`` go to the history
    instead, which is read once in place; what it finds there is as small as the batch.
    """
    keys = rows.select(key).distinct()
    if keys.limit(sent + 1).count() > sent:
        return rows.join(existing.select(key), key, "left_anti")
    known = existing.select(key).join(F.broadcast(keys), key, "left_semi").distinct()
    return rows.join(F.broadcast(known), key, "left_anti")


def new_urls(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose URL is not stored yet."""
    return without_known(batch, existing, "source_url").select(*batch.columns)


def insertable_articles(existing: DataFrame, new: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows that may be appended: unknown URL, and the first of each URL in the batch."""
    return new_urls(first_per_key(new, "source_url", order), existing)


def append_articles(existing: DataFrame, new: DataFrame, order: list[Column | str]) -> DataFrame:
    added = insertable_articles(existing, new, order)
    return existing.unionByName(added.select(*existing.columns))


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Union that keeps stored rows on a key clash and the first of equal new keys."""
    added = without_known(first_per_key(new, key, order), existing, key)
    return existing.unionByName(added.select(*existing.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union in which a new row replaces the stored one of its key. Keys are unique on each side."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "article_id")


def assign_clusters(assignments: DataFrame, new: DataFrame) -> DataFrame:
    """``article_clusters`` with new assignments; the later one of an article counts."""
    return upsert(assignments, new, "article_id")


def upsert_clusters(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """New label, summary, count and update time; the creation time stays."""
    o = old.select(F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "id"])
    n = new.select("id", "label", "summary", "article_count")
    both = o.join(n, o["o_id"] == n["id"], "full_outer")
    is_new = F.col("id").isNotNull()

    def chosen(name: str) -> Column:
        return F.when(is_new, F.col(name)).otherwise(F.col(f"o_{name}")).alias(name)

    return both.select(
        F.coalesce("id", "o_id").alias("id"),
        chosen("label"),
        chosen("summary"),
        chosen("article_count"),
        F.coalesce("o_created_at", as_of).alias("created_at"),
        F.when(is_new, as_of).otherwise(F.col("o_updated_at")).alias("updated_at"),
    )


def ingestion_log(outcomes: DataFrame) -> DataFrame:
    """One log row per run and source.

    ``outcomes``: source, run_id, started_at, finished_at, fetched, stored, error —
    one row per article or per feed, with its counts.
    """
    return outcomes.groupBy("source", "run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.sum("fetched").cast("bigint").alias("articles_fetched"),
        F.sum("stored").cast("bigint").alias("articles_stored"),
        F.min("error").alias("error"),
    )

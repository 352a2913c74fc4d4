"""The feed list: which feeds to read, and checks on a feed configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9][a-z0-9_-]*$"
# scheme, host, rest
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^\s]*)$"
DEFAULTS = {"region": "global", "category": "general", "enabled": True}


def select_feeds(feeds: DataFrame, enabled_only: bool = True) -> DataFrame:
    return feeds.where("enabled") if enabled_only else feeds


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, ``/`` for an empty path; null unless http(s)."""
    scheme = F.lower(F.regexp_extract(c, _URL, 1))
    host = F.lower(F.regexp_extract(c, _URL, 2))
    rest = F.regexp_extract(c, _URL, 3)
    host = (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
    )
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(c.rlike(_URL) & host.isNotNull(), F.concat(scheme, F.lit("://"), host, path))


def with_defaults(config: DataFrame) -> DataFrame:
    """Fill the optional columns and bring URLs to one form."""
    for name, value in DEFAULTS.items():
        given = F.col(name) if name in config.columns else F.lit(None)
        config = config.withColumn(name, F.coalesce(given, F.lit(value)))
    return config.withColumn("url", F.coalesce(normalize_url(F.col("url")), F.col("url")))


def validate_feeds(config: DataFrame) -> DataFrame:
    """One row ``(id, url, rule)`` per broken rule; none for a sound configuration.

    Repeats are found by counting per value, so a value shared by very many rows
    costs one pre-aggregated group, not a comparison of its rows.
    """
    urls = config.select("id", "name", "url", normalize_url(F.col("url")).alias("norm_url"))
    rules = F.array(
        F.when(F.col("id").isNull() | F.col("name").isNull() | F.col("url").isNull(), "missing_field"),
        F.when(~F.col("id").rlike(SLUG), "bad_id"),
        F.when(F.col("name") == "", "empty_name"),
        F.when(F.col("url").isNotNull() & F.col("norm_url").isNull(), "bad_url"),
    )
    by_row = urls.select("id", "url", F.explode(F.array_compact(rules)).alias("rule"))
    repeated_ids = (
        urls.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("id", F.lit(None).cast("string").alias("url"), F.lit("duplicate_id").alias("rule"))
    )
    repeated_urls = (
        urls.where(F.col("norm_url").isNotNull())
        .groupBy("norm_url")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(
            F.lit(None).cast("string").alias("id"),
            F.col("norm_url").alias("url"),
            F.lit("duplicate_url").alias("rule"),
        )
    )
    empty = (
        config.agg(F.count("*").alias("n"))
        .where("n = 0")
        .select(
            F.lit(None).cast("string").alias("id"),
            F.lit(None).cast("string").alias("url"),
            F.lit("empty_file").alias("rule"),
        )
    )
    return by_row.unionByName(repeated_ids).unionByName(repeated_urls).unionByName(empty)


# Broken rules that an error names; it says how many there are.
SHOWN = 20


class FeedConfigError(ValueError):
    """The feed configuration breaks at least one rule."""


def load_feeds(config: DataFrame) -> DataFrame:
    """The configuration with defaults filled in; raises if any rule is broken."""
    found = validate_feeds(config)
    broken = found.limit(SHOWN).collect()
    if broken:
        shown = "; ".join(f"{r['rule']}: id={r['id']!r} url={r['url']!r}" for r in broken)
        raise FeedConfigError(f"{found.count()} broken rules, all in validate_feeds(config); some of them: {shown}")
    return with_defaults(config)

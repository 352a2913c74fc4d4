"""Article lists of the JSON news API, from landed response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import hours_before, parse_compact_date

RECORD = (
    "struct<url:string,title:string,seendate:string,sourcecountry:string,"
    "language:string,domain:string>"
)


def read_gdelt_articles(raw: DataFrame) -> DataFrame:
    """Records of payload rows ``(payload_id, body)``.

    An empty body, one that is not JSON and one without ``articles`` give no rows.
    ``status`` is looked at if present: anything but 200 gives no rows either.
    """
    if "status" in raw.columns:
        raw = raw.where(F.col("status") == 200)
    doc = F.from_json("body", f"struct<articles:array<{RECORD}>>")
    return (
        raw.select("payload_id", doc["articles"].alias("articles"))
        .select("payload_id", F.posexplode("articles").alias("item_seq", "a"))
        .where(F.col("a").isNotNull())
        .select("payload_id", F.col("item_seq").cast("bigint").alias("item_seq"), "a.*")
    )


def select_recent_gdelt(
    records: DataFrame,
    as_of: Column,
    minutes: float = 15,
    max_records: int | None = 75,
    lang: str | None = "english",
) -> DataFrame:
    """The selection the API makes: one language, the last minutes, newest first, capped."""
    seen = parse_compact_date(F.col("seendate"))
    recent = records.withColumn("seen_at", seen).where(
        (F.col("seen_at") > hours_before(as_of, minutes / 60)) & (F.col("seen_at") <= as_of)
    )
    if lang:
        recent = recent.where(F.lower("language") == lang.lower())
    ordered = recent.orderBy(F.desc("seen_at"), "url", "payload_id", "item_seq")
    return ordered if max_records is None else ordered.limit(max_records)

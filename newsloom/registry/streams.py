"""The whole ingestion chain, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.operators.dedup import dedup_url
from newsloom.plans.ingest import arrivals, ingest_batch
from newsloom.registry import query
from newsloom.registry.ingest import PAYLOAD_BODY
from newsloom.session import cut_lineage, require_checkpoint_dir
from newsloom.sources.feeds import with_defaults
from newsloom.sources.gdelt import read_gdelt_articles
from newsloom.sources.rss import parse_feed_payloads
from newsloom.streaming.ingest import process_payloads, start_ingest
from newsloom.tables import NewsTables, init_tables, read_table


def page_feeds(spark, sf):
    """One feed per page, matching the payload texts."""
    pages = fx.base(spark, sf, "pages")
    name = F.concat(F.lit("feed"), F.col("page_id").cast("string"))
    url = F.concat(F.lit("https://f"), F.col("page_id").cast("string"), F.lit(".example.com/rss"))
    feeds = with_defaults(pages.select(name.alias("id"), name.alias("name"), url.alias("url")))
    return feeds.withColumns({"etag": F.lit(""), "last_modified": F.lit("")})


def page_arrivals(spark, sf):
    fx.base(spark, sf, "pages").createOrReplaceTempView("pages")
    entries = parse_feed_payloads(spark.sql(PAYLOAD_BODY))
    records = read_gdelt_articles(fx.derived(spark, sf, "gdelt_raw"))
    return arrivals(entries, records, page_feeds(spark, sf), fx.as_of())


@query("ingest_chain")
def ingest_chain(spark, sf):
    """Both sources into empty tables, then the same run again, which stores nothing: rows each stage left, entities found."""
    batch = cut_lineage(page_arrivals(spark, sf))
    empty = NewsTables.empty(spark).with_(feeds=page_feeds(spark, sf))
    first = ingest_batch(batch, empty, fx.as_of())
    second = ingest_batch(batch, first.added_to(empty), fx.as_of())
    counts = [run.stage_counts.unionByName(run.entity_counts) for run in (first, second)]
    return counts[0].withColumn("run", F.lit(1)).unionByName(counts[1].withColumn("run", F.lit(2)))


@query(
    "ingest_same_url",
    fx.ctes("gdelt_raw")
    + """, urls as (
        select trim(regexp_replace(url, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as u from pages
        union select concat('https://example.com/', cast(page_id as varchar)) from pages)
    select cast(count(*) as bigint) as urls, cast(4 * (select count(*) from pages) as bigint) as arrived from urls where u <> ''""",
)
def ingest_same_url(spark, sf):
    """Every page's payload landed twice in one run, the second time with changed texts: one row for each URL."""
    fx.base(spark, sf, "pages").createOrReplaceTempView("pages")
    once = spark.sql(PAYLOAD_BODY)
    again = once.withColumn("body", F.replace(F.col("body"), F.lit("<title>"), F.lit("<title>Again: ")))
    payloads = once.withColumn("payload", F.lit("1")).unionByName(again.withColumn("payload", F.lit("2")))
    batch = cut_lineage(arrivals(parse_feed_payloads(payloads), None, page_feeds(spark, sf), fx.as_of()))
    placed = batch.withColumn("ord", F.struct("source_seq", "feed_id", "payload", "item_seq"))
    fresh = dedup_url(placed, NewsTables.empty(spark).articles)
    arrived = batch.agg(F.count("*").alias("arrived"))
    kept = fresh.agg(F.count("*").alias("urls"), F.countDistinct("source_url").alias("distinct_urls"), F.countDistinct("id").alias("ids"))
    checked = kept.where("urls = distinct_urls and urls = ids").select("urls")
    return checked.join(arrived, F.lit(True))


def landed(spark, sf):
    """All payloads as rows, in the form the stream reads."""
    fx.base(spark, sf, "pages").createOrReplaceTempView("pages")
    rss = spark.sql(PAYLOAD_BODY).select(
        F.lit("rss").alias("source"), F.concat("feed_id", F.lit(".xml")).alias("file_name"), "body"
    )
    gdelt = fx.derived(spark, sf, "gdelt_raw").select(
        F.lit("gdelt").alias("source"), F.concat("payload_id", F.lit(".json")).alias("file_name"), "body"
    )
    return rss.unionByName(gdelt).withColumn("landed_at", fx.as_of())


def new_folder(spark) -> str:
    return f"{require_checkpoint_dir(spark)}/news-{uuid.uuid4().hex}"


@query("stream_replay")
def stream_replay(spark, sf):
    """Two micro-batches of payloads into a store, the second one twice: its articles once.

    The batches are handed over as the stream hands them over.
    """
    root = new_folder(spark)
    payloads = cut_lineage(landed(spark, sf))
    init_tables(spark, root, page_feeds(spark, sf))
    process_payloads(payloads.where("source = 'rss'"), 0, root)
    process_payloads(payloads, 1, root)
    process_payloads(payloads, 1, root)
    return read_table(spark, root, "articles").select("id", "source_url", "source_feed", "batch")


@query("stream_ingest")
def streamed_articles(spark, sf):
    """The payloads landed as a table and stored by the stream; its log."""
    root = new_folder(spark)
    payloads = landed(spark, sf)
    landing = f"{root}/landing"
    payloads.write.parquet(landing)
    init_tables(spark, f"{root}/store", page_feeds(spark, sf))
    stream = spark.readStream.schema(payloads.schema).parquet(landing)
    run = start_ingest(stream, f"{root}/store", f"{root}/progress", available_now=True)
    run.awaitTermination()
    return read_table(spark, f"{root}/store", "ingestion_log").select(
        "batch", "source", "articles_fetched", "articles_stored"
    )

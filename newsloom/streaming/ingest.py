"""Continuous ingestion from landed payload files, and the stored forms of the two jobs.

A folder ``landing`` holds ``rss/<feed id>[.anything].xml`` and ``gdelt/<anything>.json``, one
payload per file, and ``fetches/<anything>.json`` with the outcomes of fetches, one JSON object a line. All run in one
stream, so that each sees what the others stored.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.config import Settings
from newsloom.functions.dates import since, utc_day
from newsloom.operators.merge import merge_feeds, upsert_clusters
from newsloom.operators.reads import within
from newsloom.operators.stored_cells import stored_cells
from newsloom.operators.retention import audit_stores, live_clusters
from newsloom.operators.summarize import TextFn
from newsloom.plans.ingest import Models, arrivals, ingest_batch
from newsloom.plans.jobs import new_stories
from newsloom.session import passing_tables
from newsloom.sources.feeds import load_feeds
from newsloom.sources.gdelt import read_gdelt_articles
from newsloom.sources.rss import feed_of_file, parse_feed_payloads, read_fetches, resolve_fetches, run_errors
from newsloom.tables import BY_DAY, VersionMoved, last_version, read_table, read_tables, read_version, write_part, write_version


def _payloads(spark: SparkSession, folder: str, source: str) -> DataFrame:
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(
        F.lit(source).alias("source"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("value").alias("body"),
    )


def landed_payloads(spark: SparkSession, landing: str, settings: Settings = Settings()) -> DataFrame:
    """The stream of payloads of all switched-on sources, and of fetch outcomes if their folder is there."""
    rss = _payloads(spark, f"{landing}/rss", "rss")
    fetches = spark._jvm.org.apache.hadoop.fs.Path(f"{landing}/fetches")
    if fetches.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fetches):
        rss = rss.unionByName(_payloads(spark, f"{landing}/fetches", "fetch"))
    if not settings.gdelt_enabled:
        return rss
    return rss.unionByName(_payloads(spark, f"{landing}/gdelt", "gdelt"))


def process_payloads(
    payloads: DataFrame, batch_id: int, root: str, models: Models = Models(), settings: Settings = Settings()
) -> None:
    """Store one micro-batch; tables that it writes on the way are removed.

    The clock is the landing time of the batch's newest file and ids come from URLs, so
    a repeated batch writes the same rows into the same directories. Rows an earlier attempt
    left there do not count as stored.
    """
    with passing_tables(payloads.sparkSession):
        newest = payloads.agg(F.max("landed_at")).first()[0]
        if newest is not None:
            _store_batch(payloads, batch_id, root, newest, models, settings)


def _store_batch(payloads: DataFrame, batch_id: int, root: str, newest: datetime, models: Models, settings: Settings) -> None:
    spark = payloads.sparkSession
    as_of = F.lit(newest).cast("timestamp")
    tables = read_tables(spark, root)
    others = {
        name: getattr(tables, name).where((F.col("batch") != batch_id) | F.col("batch").isNull())
        for name in ("articles", "vectors", "entities", "ingestion_log")
    }
    landed = F.concat_ws("|", F.lpad(F.unix_micros(F.col("landed_at").cast("timestamp")).cast("string"), 20, "0"), "file_name")
    payloads = payloads.withColumn("payload", landed)
    entries = parse_feed_payloads(
        payloads.where("source = 'rss'").select(feed_of_file("file_name").alias("feed_id"), "payload", "body")
    )
    records = read_gdelt_articles(payloads.where("source = 'gdelt'").select(F.col("payload").alias("payload_id"), "body"))
    batch = arrivals(entries, records, tables.feeds, as_of)
    keys = {"ingest_date": utc_day(as_of), "batch": F.lit(batch_id)}
    # the sources that ran, two at most: each gets its row in the log, also without articles or with an error
    names = {r["source"] for r in payloads.select("source").distinct().collect()}
    fetches = read_fetches(payloads.where("source = 'fetch'")) if "fetch" in names else None
    failed_fetches = run_errors(fetches).first()["error"] if fetches is not None else None
    # a fetch is part of the feeds' run
    ran = sorted({"rss" if n == "fetch" else n for n in names})
    ran = spark.createDataFrame([(n, failed_fetches if n == "rss" else None) for n in ran], "source string, of_fetches string")
    try:
        added = ingest_batch(batch, tables.with_(**others), as_of, models, settings, stored_cells(spark, root))
        write_part(added.entities, root, "entities", **keys)
        write_part(added.vectors, root, "vectors", **keys)
        write_part(_logged(ran.join(added.log, "source", "left"), as_of), root, "ingestion_log", batch=F.lit(batch_id))
        # last, so that a batch cut short leaves no article without its vector
        write_part(added.articles, root, "articles", **keys)
        if fetches is not None:
            keep_validators(spark, root, fetches)
    except Exception as error:
        failed = ran.withColumns({c: F.lit(None) for c in ("started_at", "finished_at", "articles_fetched", "articles_stored")})
        failed = failed.withColumns({"error": F.lit(f"{type(error).__name__}: {error}"), "of_fetches": F.lit(None)})
        write_part(_logged(failed, as_of), root, "ingestion_log", batch=F.lit(batch_id))
        raise


def _logged(log: DataFrame, as_of: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return log.select(
        "source",
        F.coalesce("started_at", as_of).alias("started_at"),
        F.coalesce("finished_at", as_of).alias("finished_at"),
        F.coalesce("articles_fetched", zero).alias("articles_fetched"),
        F.coalesce("articles_stored", zero).alias("articles_stored"),
        F.coalesce("error", "of_fetches").alias("error"),
    )


#: How often validators are derived anew when another job has written a version of the feed list meanwhile.
ATTEMPTS = 5


def keep_validators(spark: SparkSession, root: str, fetches: DataFrame) -> None:
    """Bring the stored feed list up to date with fetch outcomes; a repeated batch writes nothing."""
    columns = ["id", "etag", "last_modified"]
    for left in reversed(range(ATTEMPTS)):
        seen = last_version(spark, root, "feeds")
        feeds = read_table(spark, root, "feeds")
        resolved = resolve_fetches(fetches, feeds)
        if resolved.select(columns).exceptAll(feeds.select(columns)).isEmpty():
            return
        try:
            return write_version(resolved, root, "feeds", seen)
        except VersionMoved:
            if not left:
                raise


def start_ingest(
    payloads: DataFrame,
    root: str,
    progress: str,
    models: Models = Models(),
    settings: Settings = Settings(),
    available_now: bool = False,
) -> StreamingQuery:
    """Start storing a stream of payloads (source, file_name, landed_at, body) at ``root``;
    ``progress`` is the stream's checkpoint folder."""
    writer = payloads.writeStream.option("checkpointLocation", progress).foreachBatch(
        lambda df, batch_id: process_payloads(df, batch_id, root, models, settings)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{settings.rss_interval_seconds} seconds").start()


def stream_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    progress: str,
    models: Models = Models(),
    settings: Settings = Settings(),
    available_now: bool = False,
) -> StreamingQuery:
    """``start_ingest`` over the landing folder."""
    payloads = landed_payloads(spark, landing, settings)
    return start_ingest(payloads, root, progress, models, settings, available_now)


def _epoch(as_of: datetime) -> int:
    return int(as_of.replace(tzinfo=as_of.tzinfo or timezone.utc).timestamp())


def instant(as_of: datetime) -> Column:
    return F.timestamp_seconds(F.lit(_epoch(as_of)))


def finished_clusters(spark: SparkSession, root: str, seen: int) -> DataFrame:
    """The clusters of version ``seen``, without those that it added and that have no article.

    A run that was cut short between its two writes leaves such; the articles are still unassigned, so the
    next run finds them again.
    """
    now = read_version(spark, root, "clusters", seen)
    before = read_version(spark, root, "clusters", seen - 1).select("id")
    mine = read_table(spark, root, "article_clusters").where(F.col("batch") == seen)
    empty = now.select("id").join(before, "id", "left_anti").join(mine.select(F.col("cluster_id").alias("id")), "id", "left_anti")
    return now.join(empty, "id", "left_anti")


def cluster_stored(
    spark: SparkSession,
    root: str,
    as_of: datetime,
    settings: Settings = Settings(),
    summarize: TextFn | None = None,
) -> None:
    """The clustering job on the store: a new version of the clusters, then the assignments.

    The assignments have the number of the version, which belongs to one run alone; a run never
    replaces those of another, whatever ``as_of`` says.
    """
    seen = last_version(spark, root, "clusters")
    tables, now = read_tables(spark, root), instant(as_of)
    with passing_tables(spark):
        assigned, built = new_stories(tables, now, settings, summarize)
        clusters = upsert_clusters(finished_clusters(spark, root, seen), built, now)
        write_version(clusters, root, "clusters", seen)
        days = within(tables.articles, now, settings.cluster_window_hours).select(F.col("id").alias("article_id"), "ingest_date")
        write_part(assigned.join(days, "article_id"), root, "article_clusters", batch=F.lit(seen + 1))


def expire_stored(spark: SparkSession, root: str, as_of: datetime, settings: Settings = Settings()) -> list[str]:
    """The retention job on the store: day directories before the cutoff day are removed, then
    clusters left without article. Returns the removed days."""
    tables = read_tables(spark, root)
    cutoff = utc_day(since(instant(as_of), settings.retention_days * 24, day_granular=True))
    # a run that was cut short may have left a day in some of the tables only
    stored = [read_table(spark, root, name).select("ingest_date") for name in BY_DAY]
    before = reduce(DataFrame.unionByName, stored).where(F.col("ingest_date") < cutoff).distinct()
    days = sorted(str(r["ingest_date"]) for r in before.collect())
    seen = last_version(spark, root, "clusters")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in reversed(BY_DAY):
        for day in days:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/ingest_date={day}")
            path.getFileSystem(conf).delete(path, True)
    if days:
        deleted = spark.range(1).select(F.col("id").cast("string").alias("id"))
        assigned = read_table(spark, root, "article_clusters")
        left = live_clusters(tables.clusters, assigned, deleted)
        write_version(left, root, "clusters", seen)
    return days


def reconcile_stored(spark: SparkSession, root: str) -> str:
    """Apply the audit of articles and vectors to the store; returns what was done.

    If one side is empty, the other one and what hangs on it is removed.
    """
    action = audit_stores(read_table(spark, root, "articles"), read_table(spark, root, "vectors")).first()["action"]
    names = {"reset_vectors": ["vectors"], "clear_articles": ["article_clusters", "entities", "articles"]}.get(action, [])
    seen = last_version(spark, root, "clusters")
    if action == "clear_articles":
        write_version(read_table(spark, root, "clusters").limit(0), root, "clusters", seen)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        days = [r["ingest_date"] for r in read_table(spark, root, name).select("ingest_date").distinct().collect()]
        for day in days:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/ingest_date={day}")
            path.getFileSystem(conf).delete(path, True)
    return action


def sync_feeds_stored(spark: SparkSession, root: str, config: DataFrame) -> None:
    """Bring the stored feed list in line with a configuration; raises if that breaks a rule."""
    seen = last_version(spark, root, "feeds")
    merged = merge_feeds(read_table(spark, root, "feeds"), load_feeds(config))
    write_version(merged, root, "feeds", seen)


def save_validators_stored(spark: SparkSession, root: str, fetches: DataFrame) -> None:
    """Keep what the latest fetch of each feed leaves behind, as a new version of the feed list."""
    keep_validators(spark, root, fetches)

"""Feed payloads: landed XML files to entries, and fetch outcomes to feed validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ITEM = (
    "title:string,link:string,description:string,summary:string,`content:encoded`:string,"
    "pubDate:string,`dc:date`:string,updated:string,author:string,`dc:creator`:string"
)
_ENTRY = (
    "title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,"
    "published:string,updated:string,author:array<struct<name:string>>"
)
# RSS 2.0 has its items in a channel, RSS 1.0 beside it, Atom has entries
_FEED = f"struct<channel:struct<item:array<struct<{_ITEM}>>>,item:array<struct<{_ITEM}>>,entry:array<struct<{_ENTRY}>>>"


def feed_of_file(name: Column | str) -> Column:
    """``<feed id>.<anything>``: the id is what stands before the first dot."""
    return F.regexp_extract(name, r"^([^.]*)", 1)


def _of_atom(entry: Column) -> Column:
    """An Atom entry in the fields of an item. The link is the alternate one, else the first."""
    links = F.coalesce(entry["link"], F.array().cast("array<struct<_href:string,_rel:string>>"))
    page = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.try_element_at(page, F.lit(1)), F.try_element_at(links, F.lit(1)))
    none = F.lit(None).cast("string")
    return F.struct(
        entry["title"].alias("title"),
        link["_href"].alias("link"),
        none.alias("description"),
        entry["summary"].alias("summary"),
        entry["content"].alias("content:encoded"),
        entry["published"].alias("pubDate"),
        none.alias("dc:date"),
        entry["updated"].alias("updated"),
        F.try_element_at(entry["author"], F.lit(1))["name"].alias("author"),
        none.alias("dc:creator"),
    )


def _entries(items: DataFrame) -> DataFrame:
    encoded = F.col("`content:encoded`")
    return items.select(
        "feed_id",
        "item_seq",
        *[c for c in ("payload",) if c in items.columns],
        "link",
        "title",
        "summary",
        "description",
        F.when(encoded.isNotNull(), F.array(F.struct(encoded.alias("value")))).alias("content"),
        F.coalesce("pubDate", "`dc:date`").alias("published"),
        "updated",
        F.coalesce("author", "`dc:creator`").alias("author"),
    )


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed feed files named ``<feed id>.<anything>.xml`` below ``path``.

    Each file is one document, so an entry's place in it does not depend on how files are split.
    A file that is not XML gives no rows and does not stop the others.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_name")
    return parse_feed_payloads(files.select(feed_of_file(name).alias("feed_id"), name.alias("payload"), F.col("value").alias("body"))).drop("payload")


def parse_feed_payloads(payloads: DataFrame) -> DataFrame:
    """Entries of payload rows ``(feed_id, body)`` in document order: RSS 2.0 and 1.0 items, Atom entries.

    For payloads that arrive as text rows (a landed table or a stream). ``payload`` is kept if there.
    """
    doc = F.from_xml(F.col("body"), _FEED, {"mode": "PERMISSIVE"})
    kept = [c for c in ("feed_id", "payload") if c in payloads.columns]
    parsed = payloads.select(*kept, doc.alias("doc"))
    none = F.array().cast(f"array<struct<{_ITEM}>>")
    found = [
        F.coalesce("doc.channel.item", none),
        F.coalesce("doc.item", none),
        F.coalesce(F.transform("doc.entry", _of_atom), none).cast(f"array<struct<{_ITEM}>>"),
    ]
    items = parsed.select(*kept, F.posexplode(F.concat(*found)).alias("item_seq", "item"))
    return _entries(items.select(*kept, F.col("item_seq").cast("bigint").alias("item_seq"), "item.*"))


def resolve_fetches(fetches: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds with the validators their latest fetch leaves behind.

    Only status 200 replaces them, with ``''`` where the header is missing; an error,
    304 or any other status keeps them. ``fetched_ok`` tells whether entries count.
    ``fetches``: feed_id, fetched_at, fetch_seq, status, etag_header, last_modified_header.
    """
    latest = fetches.groupBy("feed_id").agg(
        F.max_by(
            F.struct("status", "etag_header", "last_modified_header"),
            F.struct("fetched_at", "fetch_seq"),
        ).alias("f")
    )
    ok = F.coalesce(F.col("f.status") == 200, F.lit(False))
    joined = feeds.join(latest, feeds["id"] == latest["feed_id"], "left")
    return joined.select(
        feeds["id"],
        feeds["name"],
        feeds["url"],
        feeds["region"],
        feeds["category"],
        F.when(ok, F.coalesce("f.etag_header", F.lit("")))
        .otherwise(feeds["etag"])
        .alias("etag"),
        F.when(ok, F.coalesce("f.last_modified_header", F.lit("")))
        .otherwise(feeds["last_modified"])
        .alias("last_modified"),
        feeds["enabled"],
        ok.alias("fetched_ok"),
    )


_FETCH = "feed_id string, fetched_at timestamp, fetch_seq bigint, status int, etag_header string, last_modified_header string, error string"


def read_fetches(payloads: DataFrame) -> DataFrame:
    """Fetch outcomes from payload rows (``body``) with one JSON object a line. Lines that are none, and those without a
    feed, give no rows."""
    lines = payloads.select(F.explode(F.split("body", "\n")).alias("line"))
    parsed = lines.select(F.from_json("line", _FETCH, {"mode": "PERMISSIVE", "timeZone": "UTC"}).alias("f")).select("f.*")
    return parsed.where("feed_id is not null")


#: Feeds that a run's message names.
NAMED_FEEDS = 5


def run_errors(fetches: DataFrame, *run: str) -> DataFrame:
    """For every run (the columns named, or all rows): its ``feeds``, how many ``failed`` and the ``error`` to log, null if none did.

    Of each feed the latest fetch of the run counts. It failed unless its status is 200 or 304; the message names the
    first ``NAMED_FEEDS`` of them in the order of their ids, with the error or else the status.
    """
    of_fetch = [F.col("error")] if "error" in fetches.columns else [F.lit(None).cast("string").alias("error")]
    latest = fetches.groupBy(*run, "feed_id").agg(F.max_by(F.struct("status", *of_fetch), F.struct("fetched_at", "fetch_seq")).alias("f"))
    why = F.coalesce("f.error", F.concat(F.lit("status "), F.col("f.status").cast("string")), F.lit("no answer"))
    failed = F.coalesce(F.col("f.error").isNotNull() | ~F.col("f.status").isin(200, 304), F.lit(True))
    judged = latest.select(*run, "feed_id", failed.alias("failed"), F.concat("feed_id", F.lit(": "), why).alias("said"))
    counted = judged.groupBy(*run).agg(F.count("*").alias("feeds"), F.count_if("failed").alias("failed"))
    named = judged.where("failed").withColumn("place", F.row_number().over(Window.partitionBy(*run).orderBy("feed_id"))).where(F.col("place") <= NAMED_FEEDS)
    listed = named.groupBy(*run).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "; ").alias("listed"))
    both = counted.join(listed, list(run), "left") if run else counted.join(listed, F.lit(True), "left")
    rest = F.when(F.col("failed") > NAMED_FEEDS, F.concat(F.lit("; and "), (F.col("failed") - NAMED_FEEDS).cast("string"), F.lit(" more"))).otherwise("")
    error = F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("feeds").cast("string"), F.lit(" feeds failed: "), "listed", rest))
    return both.select(*run, "feeds", "failed", error.alias("error"))

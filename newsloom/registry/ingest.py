"""Sources, column functions and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.functions.dates import parse_compact_date, parse_feed_date
from newsloom.functions.regions import COUNTRY_REGION, country_region
from newsloom.functions.text import clean_html, non_empty, text_hash
from newsloom.operators.normalize import normalize_gdelt, normalize_rss
from newsloom.registry import query
from newsloom.sources.feeds import select_feeds, validate_feeds
from newsloom.sources.gdelt import read_gdelt_articles, select_recent_gdelt
from newsloom.sources.rss import parse_feed_payloads, resolve_fetches, run_errors

WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def clean_sql(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'))"
    )


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def feed_date_sql(c: str) -> str:
    rfc = f"regexp_replace({c}, '^[A-Za-z]+, ', '')"
    return f"""coalesce(
        try_strptime(replace({rfc}, 'GMT', '+0000'), '%d %b %Y %H:%M:%S %z') at time zone 'UTC',
        case when {c} like '____-__-__T%' then try_cast({c} as timestamptz) at time zone 'UTC' end)"""


def compact_date_sql(c: str) -> str:
    return f"try_strptime(rtrim({c}, 'Z'), '%Y%m%dT%H%M%S')"


def region_sql(c: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in COUNTRY_REGION.items())
    return f"case lower({c}) {cases} else 'global' end"


# Payload texts for the XML reader, one feed document per page with the page's text escaped.
PAYLOAD_BODY = """
select concat('feed', cast(page_id as string)) as feed_id,
       concat('<rss><channel><title>c</title>',
              '<item><title>One ', cast(page_id as string), '</title><link> ', replace(url, '&', '&amp;'),
              ' </link><description>',
              replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
              '</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>',
              '<item><title>Two</title><link>https://example.com/', cast(page_id as string),
              '</link></item></channel></rss>') as body
from pages
"""


@query(
    "rss_entries",
    """
    select concat('feed', cast(page_id as string)) as feed_id, cast(i as bigint) as item_seq,
           case i when 0 then concat('One ', cast(page_id as string)) else 'Two' end as title,
           case i when 0 then trim(url) else concat('https://example.com/', cast(page_id as string)) end as link,
           case i when 0 then sha256(trim(regexp_replace(html, '\\s+', ' ', 'g'))) end as description_hash,
           case i when 0 then 'Mon, 01 Jan 2024 00:00:00 GMT' end as published
    from pages, (values (0), (1)) as t(i)
    """,
)
def rss_entries(spark, sf):
    fx.base(spark, sf, "pages").createOrReplaceTempView("pages")
    entries = parse_feed_payloads(spark.sql(PAYLOAD_BODY))
    return entries.select(
        "feed_id",
        "item_seq",
        "title",
        F.trim("link").alias("link"),
        text_hash(F.trim(F.regexp_replace("description", r"\s+", " "))).alias("description_hash"),
        "published",
    )


# One Atom document per page, RSS 1.0 for every other one.
ATOM_BODY = """
select concat('feed', cast(page_id as string)) as feed_id,
       case when page_id % 2 = 0
            then concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title><entry><title>One ', cast(page_id as string),
                        '</title><link rel="self" href="x"/><link rel="alternate" href="', replace(url, '&', '&amp;'),
                        '"/><summary>s ', cast(page_id as string), '</summary><updated>2024-01-01T00:00:00Z</updated>',
                        '<author><name>A</name></author></entry><entry><title>Two</title><link href="https://example.com/',
                        cast(page_id as string), '"/></entry></feed>')
            else concat('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel>',
                        '<item><title>One ', cast(page_id as string), '</title><link>', replace(url, '&', '&amp;'),
                        '</link><description>s ', cast(page_id as string), '</description><dc:date>2024-01-01T00:00:00Z</dc:date>',
                        '<dc:creator>A</dc:creator></item><item><title>Two</title><link>https://example.com/',
                        cast(page_id as string), '</link></item></rdf:RDF>') end as body
from pages
"""


@query(
    "atom_entries",
    """
    select concat('feed', cast(page_id as string)) as feed_id, cast(i as bigint) as item_seq,
           case i when 0 then concat('One ', cast(page_id as string)) else 'Two' end as title,
           case i when 0 then trim(url) else concat('https://example.com/', cast(page_id as string)) end as link,
           case i when 0 then concat('s ', cast(page_id as string)) end as about,
           case i when 0 then '2024-01-01T00:00:00Z' end as dated, case i when 0 then 'A' end as author
    from pages, (values (0), (1)) as t(i)
    """,
)
def atom_entries(spark, sf):
    fx.base(spark, sf, "pages").createOrReplaceTempView("pages")
    entries = parse_feed_payloads(spark.sql(ATOM_BODY))
    about, dated = F.coalesce("summary", "description").alias("about"), F.coalesce("published", "updated").alias("dated")
    return entries.select("feed_id", "item_seq", "title", F.trim("link").alias("link"), about, dated, "author")


@query(
    "fetch_outcome",
    fx.ctes("feeds", "fetches")
    + """, latest as (
        select * from fetches qualify row_number() over (
            partition by feed_id order by fetched_at desc, fetch_seq desc) = 1)
    select f.id, f.name, f.url, f.region, f.category,
           case when l.status = 200 then coalesce(l.etag_header, '') else f.etag end as etag,
           case when l.status = 200 then coalesce(l.last_modified_header, '') else f.last_modified end as last_modified,
           f.enabled, coalesce(l.status = 200, false) as fetched_ok
    from feeds f left join latest l on l.feed_id = f.id
    """,
)
def fetch_outcome(spark, sf):
    return resolve_fetches(fx.derived(spark, sf, "fetches"), fx.derived(spark, sf, "feeds"))


@query(
    "run_log",
    fx.ctes("fetches")
    + """, latest as (
        select fetched_at as run, feed_id, status from fetches qualify row_number() over (
            partition by fetched_at, feed_id order by fetch_seq desc) = 1),
    judged as (
        select run, feed_id, not coalesce(status in (200, 304), false) as failed,
               feed_id || ': ' || coalesce('status ' || cast(status as varchar), 'no answer') as said from latest),
    counted as (select run, count(*) as feeds, count_if(failed) as failed from judged group by run),
    listed as (
        select run, string_agg(said, '; ' order by feed_id) as listed
        from (select * from judged where failed qualify row_number() over (partition by run order by feed_id) <= 5) group by run)
    select run, feeds, failed, case when failed > 0 then failed || ' of ' || feeds || ' feeds failed: ' || listed
        || case when failed > 5 then '; and ' || (failed - 5) || ' more' else '' end end as error
    from counted left join listed using (run)
    """,
)
def logged_fetches(spark, sf):
    """What each day's run logs of its fetches."""
    return run_errors(fx.derived(spark, sf, "fetches").withColumn("run", F.col("fetched_at")), "run")


GDELT_SQL = (
    fx.ctes("gdelt_raw")
    + """, docs as (select payload_id, try_cast(case when body like '{%' then body end as json) as j from gdelt_raw),
    records as (
        select payload_id, cast(0 as bigint) as item_seq, j->'articles'->0 as a
        from docs where (j->'articles'->0) is not null),
    gdelt as (
        select payload_id, item_seq, a->>'url' as url, a->>'title' as title, a->>'seendate' as seendate,
               a->>'sourcecountry' as sourcecountry, a->>'language' as language, a->>'domain' as domain
        from records)
    """
)


@query("gdelt_articles", GDELT_SQL + "select * from gdelt")
def gdelt_articles(spark, sf):
    return read_gdelt_articles(fx.derived(spark, sf, "gdelt_raw"))


@query(
    "gdelt_recent",
    GDELT_SQL
    + f"""select payload_id, url, title, {compact_date_sql('seendate')} as seen_at
    from gdelt where lower(language) = 'english'
      and {compact_date_sql('seendate')} > timestamp '2024-01-31 00:00:00' - interval 480 hour
      and {compact_date_sql('seendate')} <= timestamp '2024-01-31 00:00:00'
    order by seen_at desc, url, payload_id limit 75""",
)
def gdelt_recent(spark, sf):
    records = read_gdelt_articles(fx.derived(spark, sf, "gdelt_raw"))
    recent = select_recent_gdelt(records, fx.as_of(), minutes=480 * 60)
    return recent.select("payload_id", "url", "title", "seen_at")


@query("enabled_feeds", fx.ctes("feeds") + "select * from feeds where enabled")
def enabled_feeds(spark, sf):
    return select_feeds(fx.derived(spark, sf, "feeds"))


@query(
    "feed_violations",
    fx.ctes("feed_config_bad")
    + r"""
    , c as (select *, case when url ~ '(?i)^https?://[^/?#\s]+\S*$' then
                lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) ||
                case when regexp_extract(url, '^[A-Za-z]+://[^/?#]+(.*)$', 1) = '' then '/'
                     else regexp_extract(url, '^[A-Za-z]+://[^/?#]+(.*)$', 1) end end as n
            from feed_config_bad)
    select id, url, 'missing_field' as rule from c where id is null or name is null or url is null
    union all select id, url, 'bad_id' from c where not regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$')
    union all select id, url, 'empty_name' from c where name = ''
    union all select id, url, 'bad_url' from c where url is not null and n is null
    union all select id, null, 'duplicate_id' from c where id is not null group by id having count(*) > 1
    union all select null, n, 'duplicate_url' from c where n is not null group by n having count(*) > 1
    """,
)
def feed_violations(spark, sf):
    return validate_feeds(fx.derived(spark, sf, "feed_config_bad"))


@query("clean_html", f"select page_id, {clean_sql('html')} as text from pages")
def clean_html_pages(spark, sf):
    return fx.base(spark, sf, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


@query("text_hash", "select doc_id, sha256(text) as hash from documents")
def text_hashes(spark, sf):
    return fx.base(spark, sf, "documents").select("doc_id", text_hash(F.col("text")).alias("hash"))


@query(
    "parse_dates",
    fx.ctes("rss_entries")
    + f"""select item_seq, {feed_date_sql("coalesce(nullif(published, ''), updated)")} as published_at
    from rss_entries""",
)
def parse_dates(spark, sf):
    entries = fx.derived(spark, sf, "rss_entries")
    date = parse_feed_date(non_empty(F.col("published"), F.col("updated")))
    return entries.select("item_seq", date.alias("published_at"))


@query(
    "gdelt_dates",
    GDELT_SQL + f"select payload_id, {compact_date_sql('seendate')} as seen_at from gdelt",
)
def gdelt_dates(spark, sf):
    records = read_gdelt_articles(fx.derived(spark, sf, "gdelt_raw"))
    return records.select("payload_id", parse_compact_date(F.col("seendate")).alias("seen_at"))


@query(
    "country_region",
    GDELT_SQL + f"select payload_id, {region_sql('sourcecountry')} as region from gdelt",
)
def country_regions(spark, sf):
    records = read_gdelt_articles(fx.derived(spark, sf, "gdelt_raw"))
    return records.select("payload_id", country_region(F.col("sourcecountry")).alias("region"))


@query(
    "normalize_rss",
    fx.ctes("rss_entries", "feeds")
    + f""", n as (
        select e.feed_id, e.item_seq, {strip_sql('e.link')} as source_url, {clean_sql('e.title')} as title,
               {clean_sql("coalesce(nullif(e.summary, ''), e.description, '')")} as summary,
               {clean_sql("coalesce(e.content_value, '')")} as body,
               {feed_date_sql("coalesce(nullif(e.published, ''), e.updated)")} as published_at
        from rss_entries e)
    select sha256(n.source_url) as id, n.title, n.summary,
           case when n.body = '' then n.summary else n.body end as content, n.source_url,
           f.name as source_feed, '' as author, f.region, f.category, n.published_at, n.feed_id, n.item_seq
    from n join feeds f on f.id = n.feed_id where n.source_url <> '' and n.title <> ''
    """,
)
def normalized_rss(spark, sf):
    entries = fx.derived(spark, sf, "rss_entries", parallel=True)
    return normalize_rss(entries, fx.derived(spark, sf, "feeds"), fx.as_of()).drop("ingested_at")


@query(
    "normalize_gdelt",
    GDELT_SQL
    + f"""select sha256({strip_sql('url')}) as id, {strip_sql('title')} as title, {strip_sql('title')} as summary,
           {strip_sql('title')} as content, {strip_sql('url')} as source_url, 'gdelt' as source_feed,
           domain as author, {region_sql('sourcecountry')} as region, 'general' as category,
           {compact_date_sql('seendate')} as published_at, item_seq
    from gdelt where {strip_sql('url')} <> '' and {strip_sql('title')} <> ''""",
)
def normalized_gdelt(spark, sf):
    records = read_gdelt_articles(fx.derived(spark, sf, "gdelt_raw"))
    return normalize_gdelt(records, fx.as_of()).drop("ingested_at")

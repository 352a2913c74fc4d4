"""News tables derived from the benchmark's parquet files.

Each block is one SQL text that Spark and DuckDB both run, so a check in DuckDB
starts from the same rows. ``FIXTURES.md`` describes what they contain. Cases
are dealt out with ``case`` on a key; every source row is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import spread

AS_OF_TEXT = "2024-01-31 00:00:00"
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

ARTICLES = """
select cast(d.doc_id as string) as id,
       split_part(d.text, chr(10), 1) as title,
       d.text as summary,
       d.text as content,
       concat('https://', d.source, '.example.com/a/',
              cast(case when d.doc_id >= 20 and d.doc_id % 37 = 0 then d.doc_id - 20 else d.doc_id end as string)) as source_url,
       d.source as source_feed,
       '' as author,
       case d.lang when 'en' then 'north_america' when 'es' then 'south_america'
                   when 'fr' then 'europe' when 'de' then 'europe' else 'global' end as region,
       case cast(d.doc_id % 4 as int) when 0 then 'world' when 1 then 'business'
                                      when 2 then 'technology' else '' end as category,
       case when d.doc_id % 17 = 0 then null
            else timestamp '2024-01-01 00:00:00' + interval '1' minute * cast((d.doc_id * 7919) % 43200 as int) end as published_at,
       timestamp '2024-01-01 00:05:00' + interval '1' minute * cast((d.doc_id * 7919) % 43200 as int) as ingested_at,
       case when e.label is null or d.doc_id % 5 = 0 then null
            else concat('c', cast(e.label as string)) end as cluster_id
from documents d left join embeddings e on e.vec_id = d.doc_id
"""

CLUSTERS = """
select cluster_id as id, substring(min(title), 1, 200) as label, '' as summary,
       count(*) as article_count, min(ingested_at) as created_at, max(ingested_at) as updated_at
from articles where cluster_id is not null group by cluster_id
"""

VECTORS = """
select a.id as article_id, e.embedding, a.source_feed, a.region, a.published_at
from embeddings e join articles a on a.id = cast(e.vec_id as string)
"""

# kind 0 is a scaled copy, kind 1 the opposite, kind 2 a blend with the next vector
INCOMING = """
select concat('n', cast(e.vec_id as string)) as article_id, cast(e.vec_id % 3 as int) as kind,
       e.vec_id as item_seq, e.embedding as base, coalesce(o.embedding, e.embedding) as other
from embeddings e left join embeddings o on o.vec_id = e.vec_id + 1
"""

RSS_ENTRIES = """
select concat('feed', cast(page_id % 5 as string)) as feed_id, page_id as item_seq,
       case when page_id % 29 = 0 then '  ' else concat(' ', url) end as link,
       case when page_id % 31 = 0 then '<b> </b>' else concat('<b>', regexp_extract(html, '<title>(.*?)</title>', 1), '</b>') end as title,
       case when page_id % 3 = 0 then '' else html end as summary,
       html as description,
       case when page_id % 2 = 0 then html end as content_value,
       case cast(page_id % 6 as int)
            when 0 then concat('Mon, ', cast(1 + page_id % 28 as string), ' Jan 2024 10:20:30 GMT')
            when 1 then concat(cast(1 + page_id % 28 as string), ' Jan 2024 10:20:30 -0530')
            when 2 then concat('2024-01-', lpad(cast(1 + page_id % 28 as string), 2, '0'), 'T10:20:30Z')
            when 3 then 'not a date'
            when 4 then concat('Tue, ', lpad(cast(1 + page_id % 28 as string), 2, '0'), ' Jan 2024 23:59:59 +0000')
       end as published,
       case when page_id % 6 = 5 and page_id % 2 = 1 then '2024-01-15T00:00:00+02:00' end as updated
from pages
"""

GDELT_RAW = """
select page_id as payload_id,
       case when page_id % 41 = 0 then ''
            when page_id % 43 = 0 then '<html><body>Rate limited</body></html>'
            when page_id % 47 = 0 then '{}'
            else concat('{"articles":[{"url":"', url, '","title":"Story ', cast(page_id as string),
                 '","seendate":"202401', lpad(cast(1 + page_id % 28 as string), 2, '0'), 'T120000',
                 case when page_id % 2 = 0 then 'Z' else '' end,
                 '","sourcecountry":"',
                 case cast(page_id % 5 as int) when 0 then 'United States' when 1 then 'France' when 2 then 'Japan'
                                               when 3 then 'Narnia' else 'Egypt' end,
                 '","language":"', case when page_id % 3 = 0 then 'French' else 'English' end,
                 '","domain":"d', cast(page_id % 9 as string), '.example.com"}]}') end as body
from pages
"""

# one feed per customer
FEEDS = """
select concat('feed', cast(c_custkey as string)) as id, c_name as name,
       concat('https://f', cast(c_custkey as string), '.example.com/rss') as url, 'global' as region,
       'general' as category, concat('etag', cast(c_custkey as string)) as etag, 'lm' as last_modified,
       c_acctbal >= 0 as enabled
from customer
"""

# By market segment: renamed, new URL, missing, new id for a known URL, switched off; and new feeds.
FEED_CONFIG = """
select case c_mktsegment when 'MACHINERY' then concat('adopted', cast(c_custkey as string))
            else concat('feed', cast(c_custkey as string)) end as id,
       case c_mktsegment when 'AUTOMOBILE' then concat('Renamed ', c_name) else c_name end as name,
       case c_mktsegment when 'BUILDING' then concat('https://f', cast(c_custkey as string), '.example.com/new')
            else concat('https://f', cast(c_custkey as string), '.example.com/rss') end as url,
       case c_mktsegment when 'AUTOMOBILE' then 'europe' else 'global' end as region,
       case c_mktsegment when 'AUTOMOBILE' then 'world' else 'general' end as category,
       c_mktsegment <> 'HOUSEHOLD' as enabled
from customer where c_mktsegment <> 'FURNITURE'
union all
select concat('new', cast(s_suppkey as string)), s_name,
       concat('https://s', cast(s_suppkey as string), '.example.com/rss'), 'oceania', 'general', true
from supplier
"""

FEED_CONFIG_BAD = """
select case p_type when 'ECONOMY' then concat('Bad ID ', cast(p_partkey as string))
                   when 'SMALL' then concat('size-', cast(p_size as string))
                   else concat('part-', cast(p_partkey as string)) end as id,
       case when p_size = 2 then '' when p_size = 3 then null else p_name end as name,
       case when p_size = 4 then 'not-a-url' when p_size = 5 then null
            when p_size = 6 then concat('HTTPS://', replace(p_brand, '#', ''), '.example.com')
            when p_size = 7 then concat('https://', lower(replace(p_brand, '#', '')), '.example.com/')
            else concat('https://p', cast(p_partkey as string), '.example.com/rss') end as url
from part
"""

# one fetch per order: F = 200, O = 304, P = error status, or null for a network error
FETCHES = """
select concat('feed', cast(o_custkey as string)) as feed_id, o_orderdate as fetched_at, o_orderkey as fetch_seq,
       case when o_orderstatus = 'F' then 200 when o_orderstatus = 'O' then 304
            when o_orderpriority = '1-URGENT' then null else 500 end as status,
       case when o_orderpriority = '2-HIGH' then null else concat('e', cast(o_orderkey as string)) end as etag_header,
       case when o_orderpriority = '3-MEDIUM' then cast(o_totalprice as string) end as last_modified_header
from orders
"""

GAZETTEER = """
select term, min(item_id % 6) as label_no
from (select item_id, {each_word} as term from (select item_id, lower(text) as text from benchmark)) where term <> '' group by 1
"""

RAW_ENTITIES = """
select id as article_id, cast(row_number() over (partition by id order by text, label) as int) as pos, text, label
from (select id, word as text, case when length(word) % 2 = 0 then 'person' else 'location' end as label
      from (select id, {each_word} as word from (select id, title as text from articles))
      union all
      select id, lower(word), case when length(word) % 2 = 0 then 'person' else 'location' end
      from (select id, {each_word} as word from (select id, title as text from articles)))
where text <> ''
"""

# one outcome per event, one run per day and event type
OUTCOMES = """
select event_type as source, cast(cast(ts as date) as string) as run_id, ts as started_at, ts as finished_at,
       cast(user_id % 5 as bigint) as fetched, cast(case when value > 10 then user_id % 5 else 0 end as bigint) as stored,
       case when event_type = 'error' and value > 50 then concat('failed ', cast(event_id as string)) end as error
from events
"""

DERIVED = {
    "articles": ARTICLES,
    "clusters": CLUSTERS,
    "vectors": VECTORS,
    "incoming": INCOMING,
    "rss_entries": RSS_ENTRIES,
    "gdelt_raw": GDELT_RAW,
    "feeds": FEEDS,
    "feed_config": FEED_CONFIG,
    "feed_config_bad": FEED_CONFIG_BAD,
    "fetches": FETCHES,
    "gazetteer": GAZETTEER,
    "raw_entities": RAW_ENTITIES,
    "outcomes": OUTCOMES,
}
DEPENDS = {
    "clusters": ["articles"],
    "vectors": ["articles"],
    "raw_entities": ["articles"],
}


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, parallel: bool = False) -> DataFrame:
    """One derived table; timestamps as instants (UTC). ``parallel`` is for costly work per
    row: it deals an unsplittable text file out to all task slots."""
    for table in BASE_TABLES:
        if table in DERIVED[name]:
            scan = base(spark, sf_dir, table)
            if parallel and table in ("documents", "pages"):
                scan = spread(scan)
            scan.createOrReplaceTempView(table)
    for needed in DEPENDS.get(name, []):
        derived(spark, sf_dir, needed, parallel).createOrReplaceTempView(needed)
    df = spark.sql(DERIVED[name].replace("{each_word}", "explode(split(text, '[^\\\\p{L}\\\\p{N}_]+'))"))
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    if name == "rss_entries":
        value = F.col("content_value")
        df = df.withColumn("content", F.when(value.isNotNull(), F.array(F.struct(value.alias("value")))))
        df = df.drop("content_value").withColumn("author", F.lit("").cast("string"))
    return df


def incoming_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = derived(spark, sf_dir, "incoming")
    embedding = (
        F.when(F.col("kind") == 0, F.transform("base", lambda x: x * F.lit(2).cast("float")))
        .when(F.col("kind") == 1, F.transform("base", lambda x: -x))
        .otherwise(F.zip_with("base", "other", lambda x, y: x + y))
    )
    return pairs.select("article_id", "kind", "item_seq", embedding.alias("embedding"))


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search vectors: the mean embedding of each label, over all rows."""
    means = (
        base(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg("x").alias("m"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    )
    return means.select(
        F.concat(F.lit("q"), F.col("label").cast("string")).alias("query_id"),
        F.transform("ms", lambda p: p["m"].cast("float")).alias("embedding"),
    )


def ctes(*names: str) -> str:
    """The named derived tables, and what they need, as a ``with`` clause for DuckDB."""
    ordered: list[str] = []
    for name in names:
        for needed in [*DEPENDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    words = r"unnest(string_split_regex(text, '[^\p{L}\p{N}_]+'))"
    return "with " + ",\n".join(f"{name} as ({DERIVED[name].replace('{each_word}', words)})" for name in ordered) + "\n"

"""Table updates, retention and the store audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.operators.merge import (
    append_articles,
    assign_clusters,
    ingestion_log,
    insert_ignore,
    merge_feeds,
    new_urls,
    upsert_clusters,
    upsert_vectors,
)
from newsloom.operators.retention import (
    apply_retention,
    audit_stores,
    empty_clusters,
    expired_articles,
    with_live_count,
)
from newsloom.registry import query
from newsloom.sources.feeds import with_defaults
from newsloom.tables import NewsTables

HISTORY = "(extract(day from published_at) <= 15 or published_at is null)"


def article_clusters(articles):
    return articles.where("cluster_id is not null").select(F.col("id").alias("article_id"), "cluster_id")


def tables_of(spark, sf) -> NewsTables:
    articles = fx.derived(spark, sf, "articles")
    entities = fx.derived(spark, sf, "raw_entities")
    return NewsTables.empty(spark).with_(
        articles=articles.drop("cluster_id"),
        entities=entities.select(
            F.concat_ws("-", "article_id", "pos").alias("id"), "article_id", "text", "label"
        ),
        clusters=fx.derived(spark, sf, "clusters"),
        article_clusters=article_clusters(articles),
        vectors=fx.derived(spark, sf, "vectors"),
    )


@query(
    "feed_merge",
    fx.ctes("feeds", "feed_config")
    + """, adopted as (
        select f.id as old_id, c.id as new_id from feeds f join feed_config c on c.url = f.url
        where f.id not in (select id from feed_config) and c.id not in (select id from feeds)),
    renamed as (
        select coalesce(a.new_id, f.id) as id, f.name, f.url, f.region, f.category, f.etag, f.last_modified
        from feeds f left join adopted a on a.old_id = f.id)
    select coalesce(c.id, r.id) as id,
           case when c.id is null then r.name else c.name end as name,
           case when c.id is null then r.url else c.url end as url,
           case when c.id is null then r.region else c.region end as region,
           case when c.id is null then r.category else c.category end as category,
           case when c.id is null or c.url = r.url then r.etag else '' end as etag,
           case when c.id is null or c.url = r.url then r.last_modified else '' end as last_modified,
           case when c.id is null then false else c.enabled end as enabled
    from renamed r full outer join feed_config c on c.id = r.id
    """,
)
def feed_merge(spark, sf):
    config = with_defaults(fx.derived(spark, sf, "feed_config"))
    return merge_feeds(fx.derived(spark, sf, "feeds"), config)


@query(
    "insert_unique_url",
    fx.ctes("articles")
    + f""", old as (select id, source_url, row_number() over (
            partition by source_url order by cast(id as bigint)) as r from articles where {HISTORY}),
    stored as (select id, source_url from old where r = 1),
    fresh as (select id, source_url, row_number() over (
            partition by source_url order by cast(id as bigint)) as r from articles
        where not {HISTORY})
    select id, source_url from stored
    union all select id, source_url from fresh
    where r = 1 and source_url not in (select source_url from stored)
    """,
)
def insert_unique_url(spark, sf):
    """The first half of the month is stored first, the second half arrives then."""
    articles = fx.derived(spark, sf, "articles").select("id", "source_url", "published_at")
    order = [F.col("id").cast("bigint")]
    nothing = articles.limit(0)
    stored = append_articles(nothing, articles.where(HISTORY), order)
    grown = append_articles(stored, articles.where(f"not {HISTORY}"), order)
    return grown.select("id", "source_url")


@query(
    "new_urls",
    fx.ctes("articles", "rss_entries")
    + """select id, source_url from articles where source_url not in (
        select source_url from articles where region = 'europe' and source_url is not null)""",
)
def urls_not_stored(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    stored = articles.where("region = 'europe'")
    return new_urls(articles, stored).select("id", "source_url")


@query(
    "insert_entities",
    fx.ctes("raw_entities")
    + """, keyed as (select concat(article_id, '-', lower(text)) as id, article_id, text, label, pos from raw_entities),
    old as (select id, article_id, text, label from keyed where label = 'location'
            qualify row_number() over (partition by id order by pos) = 1),
    fresh as (select id, article_id, text, label from keyed where label <> 'location'
            qualify row_number() over (partition by id order by pos) = 1)
    select * from old union all select * from fresh where id not in (select id from old)
    """,
)
def insert_entities(spark, sf):
    """Person entities into a table that holds the locations; equal ids are ignored."""
    keyed = fx.derived(spark, sf, "raw_entities").withColumn(
        "id", F.concat_ws("-", "article_id", F.lower("text"))
    )
    columns = ["id", "article_id", "text", "label", "pos"]
    locations = keyed.where("label = 'location'").select(columns)
    stored = insert_ignore(locations.limit(0), locations, "id", ["pos"])
    grown = insert_ignore(stored, keyed.where("label <> 'location'").select(columns), "id", ["pos"])
    return grown.drop("pos")


@query(
    "vector_upsert",
    fx.ctes("vectors")
    + """, fresh as (select cast(vec_id + 100 as varchar) as article_id, embedding, 'new' as source_feed from embeddings)
    select article_id, source_feed, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total
    from (select article_id, source_feed, embedding from vectors
          where article_id not in (select article_id from fresh)
          union all select article_id, source_feed, embedding from fresh)
    """,
)
def vector_upsert(spark, sf):
    stored = fx.derived(spark, sf, "vectors").select("article_id", "embedding", "source_feed")
    fresh = fx.base(spark, sf, "embeddings").select(
        (F.col("vec_id") + 100).cast("string").alias("article_id"),
        "embedding",
        F.lit("new").alias("source_feed"),
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return upsert_vectors(stored, fresh).select("article_id", "source_feed", F.round(total, 4).alias("total"))


@query(
    "assign_clusters",
    fx.ctes("articles")
    + """, fresh as (select id as article_id, concat('n', region) as cluster_id from articles where category = 'world')
    select id as article_id, cluster_id from articles
    where cluster_id is not null and id not in (select article_id from fresh)
    union all select * from fresh
    """,
)
def assigned_clusters(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    fresh = articles.where("category = 'world'").select(
        F.col("id").alias("article_id"), F.concat(F.lit("n"), "region").alias("cluster_id")
    )
    return assign_clusters(article_clusters(articles), fresh)


@query(
    "cluster_upsert",
    fx.ctes("clusters")
    + """, fresh as (
        select case region when 'global' then 'c1' else region end as id, max(source_feed) as label,
               'new' as summary, count(*) as article_count
        from articles group by 1)
    select coalesce(f.id, c.id) as id,
           case when f.id is null then c.label else f.label end as label,
           case when f.id is null then c.summary else f.summary end as summary,
           case when f.id is null then c.article_count else f.article_count end as article_count,
           coalesce(c.created_at, timestamp '2024-01-31 00:00:00') as created_at,
           case when f.id is null then c.updated_at else timestamp '2024-01-31 00:00:00' end as updated_at
    from clusters c full outer join fresh f on f.id = c.id
    """,
)
def cluster_upsert(spark, sf):
    fresh = (
        fx.derived(spark, sf, "articles")
        .groupBy(F.when(F.col("region") == "global", "c1").otherwise(F.col("region")).alias("id"))
        .agg(F.max("source_feed").alias("label"), F.lit("new").alias("summary"), F.count("*").alias("article_count"))
    )
    return upsert_clusters(fx.derived(spark, sf, "clusters"), fresh, fx.as_of())


@query(
    "ingestion_log",
    fx.ctes("outcomes")
    + """select source, run_id, min(started_at) as started_at, max(finished_at) as finished_at,
           cast(sum(fetched) as bigint) as articles_fetched, cast(sum(stored) as bigint) as articles_stored,
           min(error) as error
    from outcomes group by source, run_id""",
)
def logged_runs(spark, sf):
    return ingestion_log(fx.derived(spark, sf, "outcomes"))


CUTOFF = "timestamp '2024-01-31 00:00:00' - interval 15 day"


@query(
    "retention_articles",
    fx.ctes("articles")
    + f"""select id, source_feed, ingested_at, ingested_at < {CUTOFF} as deleted from articles""",
)
def retention_articles(spark, sf):
    """Kept and deleted articles after a retention of 15 days, told apart by ``deleted``."""
    articles = fx.derived(spark, sf, "articles")
    tables, gone = apply_retention(tables_of(spark, sf), fx.as_of(), days=15)
    columns = ["id", "source_feed", "ingested_at"]
    kept = tables.articles.select(*columns, F.lit(False).alias("deleted"))
    deleted = articles.join(gone, "id", "left_semi").select(*columns, F.lit(True).alias("deleted"))
    return kept.unionByName(deleted)


@query(
    "retention_entities",
    fx.ctes("raw_entities")
    + f"""select e.article_id, e.pos, e.text, e.label from raw_entities e
    where e.article_id not in (select id from articles where ingested_at < {CUTOFF})""",
)
def retention_entities(spark, sf):
    tables, _ = apply_retention(tables_of(spark, sf), fx.as_of(), days=15)
    pos = F.split("id", "-")[1].cast("int")
    return tables.entities.select("article_id", pos.alias("pos"), "text", "label")


@query(
    "retention_vectors",
    fx.ctes("vectors")
    + f"""select article_id, source_feed, region from vectors
    where article_id not in (select id from articles where ingested_at < {CUTOFF})""",
)
def retention_vectors(spark, sf):
    tables, _ = apply_retention(tables_of(spark, sf), fx.as_of(), days=15)
    return tables.vectors.select("article_id", "source_feed", "region")


@query(
    "retention_clusters",
    fx.ctes("clusters")
    + """, stories as (
        select concat(source_feed, '-', cast(cast(ingested_at as date) as varchar)) as id, id as article_id, ingested_at
        from articles)
    select id, max(ingested_at) < timestamp '2024-01-16 00:00:00' as emptied,
           count(*) as article_count,
           count(*) filter (where ingested_at >= timestamp '2024-01-16 00:00:00') as live_article_count
    from stories group by id
    """,
)
def retention_clusters(spark, sf):
    """One story per source and day: which are emptied by retention, and the counts of all."""
    articles = fx.derived(spark, sf, "articles")
    assigned = articles.select(
        F.col("id").alias("article_id"),
        F.concat_ws("-", "source_feed", F.to_date("ingested_at").cast("string")).alias("cluster_id"),
    )
    clusters = assigned.groupBy(F.col("cluster_id").alias("id")).agg(
        F.lit("").alias("label"),
        F.lit("").alias("summary"),
        F.count("*").alias("article_count"),
        fx.as_of().alias("created_at"),
        fx.as_of().alias("updated_at"),
    )
    before = tables_of(spark, sf).with_(clusters=clusters, article_clusters=assigned)
    after, _ = apply_retention(before, fx.as_of(), days=15)
    emptied = empty_clusters(clusters, after.article_clusters)
    kept = with_live_count(after.clusters, after.article_clusters)
    return kept.select("id", F.lit(False).alias("emptied"), "article_count", "live_article_count").unionByName(
        emptied.select(
            "id", F.lit(True).alias("emptied"), "article_count", F.lit(0).cast("bigint").alias("live_article_count")
        )
    )


@query(
    "expired_ids",
    fx.ctes("articles") + "select id from articles where ingested_at < date_trunc('day', " + CUTOFF + ")",
)
def expired_ids(spark, sf):
    """The day-granular variant of the cutoff."""
    return expired_articles(fx.derived(spark, sf, "articles"), fx.as_of(), days=15, day_granular=True)


@query(
    "store_audit",
    fx.ctes("articles")
    + """, s as (
        select count(a.id) filter (where e.vec_id is not null) as in_both,
               count(a.id) filter (where e.vec_id is null) as articles_only,
               count(e.vec_id) filter (where a.id is null) as vectors_only
        from articles a full outer join embeddings e on cast(e.vec_id + 100 as varchar) = a.id)
    select *, case when in_both + articles_only = 0 and in_both + vectors_only > 0 then 'reset_vectors'
                   when in_both + articles_only > 0 and in_both + vectors_only = 0 then 'clear_articles'
                   else 'none' end as action
    from s
    """,
)
def store_audit(spark, sf):
    vectors = fx.base(spark, sf, "embeddings").select((F.col("vec_id") + 100).cast("string").alias("article_id"))
    return audit_stores(fx.derived(spark, sf, "articles"), vectors)

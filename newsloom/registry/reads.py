"""Lookups and roll-ups on the stored tables. Windows of 480 hours, so that they cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.functions.hashing import simhash
from newsloom.functions.text import article_text
from newsloom.operators import reads
from newsloom.operators.rollup import cluster_rollup, top_per_cluster
from newsloom.registry import query
from newsloom.registry.sqlparts import simhash_sql
from newsloom.registry.storage import article_clusters

WINDOW = "ingested_at > timestamp '2024-01-31 00:00:00' - interval 480 hour"
CARD = ["id", "title", "source_url", "source_feed", "region", "category", "published_at", "ingested_at"]
CARD_SQL = ", ".join(CARD)


@query(
    "recent_articles",
    fx.ctes("articles")
    + f"""select {CARD_SQL} from articles where {WINDOW} and category = 'business' and region = 'europe'
    order by published_at desc nulls last, id limit 100""",
)
def recent_articles(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    return reads.recent_articles(articles, fx.as_of(), 480, 100, "business", "europe").select(CARD)


@query(
    "recent_articles_default",
    fx.ctes("articles")
    + f"""select {CARD_SQL} from articles
    where ingested_at > timestamp '2024-01-31 00:00:00' - interval 24 hour
    order by published_at desc nulls last, id limit 100""",
)
def recent_articles_default(spark, sf):
    return reads.recent_articles(fx.derived(spark, sf, "articles"), fx.as_of()).select(CARD)


@query(
    "recent_articles_by_day",
    fx.ctes("articles")
    + f"""select {CARD_SQL} from articles
    where ingested_at > date_trunc('day', timestamp '2024-01-31 00:00:00' - interval 100 hour)
    order by published_at desc nulls last, id limit 100""",
)
def recent_articles_by_day(spark, sf):
    """The window rounded down to the UTC day."""
    articles = fx.derived(spark, sf, "articles")
    return reads.recent_articles(articles, fx.as_of(), 100, day_granular=True).select(CARD)


@query(
    "articles_by_region",
    fx.ctes("articles")
    + f"""select {CARD_SQL} from articles where {WINDOW} and region = 'south_america'
    order by published_at desc nulls last, id limit 50""",
)
def articles_by_region(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    return reads.articles_by_region(articles, fx.as_of(), "south_america", 480).select(CARD)


@query(
    "cluster_articles",
    fx.ctes("clusters")
    + f"select cluster_id, {CARD_SQL} from articles where cluster_id in (select id from clusters)",
)
def cluster_articles(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    return reads.cluster_articles(articles, fx.derived(spark, sf, "clusters")).select("cluster_id", *CARD)


@query(
    "articles_by_ids",
    fx.ctes("articles")
    + f"""select {CARD_SQL} from articles
    where id in (select cast(doc_id as varchar) from labels where quality = 1)""",
)
def articles_by_ids(spark, sf):
    ids = fx.base(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return reads.articles_by_ids(fx.derived(spark, sf, "articles"), ids).select(CARD)


@query("unclustered_ids", fx.ctes("articles") + f"select id from articles where {WINDOW} and cluster_id is null")
def unclustered_ids(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    return reads.unclustered_ids(articles, article_clusters(articles), fx.as_of(), 480)


@query(
    "top_clusters",
    fx.ctes("clusters")
    + """select * from clusters where updated_at > timestamp '2024-01-31 00:00:00' - interval 480 hour
    order by article_count desc, id limit 10""",
)
def top_clusters(spark, sf):
    return reads.top_clusters(fx.derived(spark, sf, "clusters"), fx.as_of(), 480)


@query(
    "article_entities",
    fx.ctes("raw_entities")
    + """select article_id, pos, text, label from raw_entities
    where article_id in (select cast(doc_id as varchar) from labels where toxic = 0)""",
)
def article_entities(spark, sf):
    ids = fx.base(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("id"))
    entities = fx.derived(spark, sf, "raw_entities").select("article_id", "pos", "text", "label")
    return reads.article_entities(entities, ids)


@query(
    "recent_simhashes",
    fx.ctes("articles")
    + f""", recent as (select * from articles where {WINDOW}),
    {simhash_sql("recent", "title || ' ' || summary")}
    select r.id, h.simhash from recent r join hashes h on h.id = r.id
    """,
)
def recent_simhashes(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    articles = articles.withColumn("simhash", simhash(article_text(articles)))
    return reads.recent_simhashes(articles, fx.as_of(), 480)


@query(
    "vectors_by_ids",
    fx.ctes("vectors")
    + """select article_id, source_feed, region, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total
    from vectors where article_id in (select cast(doc_id as varchar) from labels)""",
)
def vectors_by_ids(spark, sf):
    ids = fx.base(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    found = reads.vectors_by_ids(fx.derived(spark, sf, "vectors"), ids)
    return found.select("article_id", "source_feed", "region", F.round(total, 4).alias("total"))


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"


@query(
    "cluster_rollup",
    fx.ctes("clusters")
    + f"""select cluster_id, string_agg(distinct source_feed, ',' order by source_feed) as sources,
           string_agg(distinct region, ',' order by region) filter (where region <> '') as regions,
           coalesce({ISO.format('max(published_at)')}, '') as latest_published,
           bool_or(category = 'world') as has_category
    from articles where cluster_id is not null group by cluster_id""",
)
def rolled_up_clusters(spark, sf):
    members = fx.derived(spark, sf, "articles").where("cluster_id is not null")
    rolled = cluster_rollup(members, "world")
    return rolled.withColumn("sources", F.array_join("sources", ",")).withColumn(
        "regions", F.array_join("regions", ",")
    )


@query(
    "cluster_top5",
    fx.ctes("articles")
    + """select cluster_id, id, title, row_number() over (
            partition by cluster_id order by published_at desc nulls last, id) as position
    from articles where cluster_id is not null qualify position <= 5""",
)
def cluster_top5(spark, sf):
    members = fx.derived(spark, sf, "articles").where("cluster_id is not null")
    return top_per_cluster(members).select("cluster_id", "id", "title", "position")

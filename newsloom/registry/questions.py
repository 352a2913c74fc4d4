"""The five questions. Windows of 480 hours, so that they cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.operators.embed import embed_articles, embed_text
from newsloom.operators.summarize import briefing_context
from newsloom.plans.briefing import topic_briefing
from newsloom.plans.headlines import headlines_json, latest_headlines
from newsloom.plans.region import news_by_region
from newsloom.plans.search import found_articles, search_news
from newsloom.plans.trending import trending_topics
from newsloom.registry import query
from newsloom.registry.reads import ISO, WINDOW
from newsloom.registry.similarity import KNN
from newsloom.registry.sqlparts import counted_sql

HOURS = 480
DATE = f"coalesce({ISO.format('published_at')}, '')"
LATEST = f"coalesce({ISO.format('max(published_at)')}, '')"
CARD_SQL = f"concat_ws('|', title, source_url, source_feed, {DATE})"


def flat_lists(df):
    """Arrays as text, so that values compare across engines."""
    for name in ("sources", "regions"):
        if name in df.columns:
            df = df.withColumn(name, F.array_join(name, ","))
    if "articles" in df.columns:
        cards = F.transform("articles", lambda a: F.concat_ws("|", a["title"], a["url"], a["source"], a["published_at"]))
        df = df.withColumn("articles", F.array_join(cards, ";"))
    return df


def stories_sql(limit: int, category: str | None = None) -> str:
    wanted = f"where has_category" if category else ""
    return (
        fx.ctes("clusters")
        + f""", top as (
            select * from clusters where updated_at > timestamp '2024-01-31 00:00:00' - interval 480 hour
            order by article_count desc, id limit {limit}),
        members as (
            select a.*, row_number() over (partition by cluster_id order by published_at desc nulls last, id) as position
            from articles a where cluster_id in (select id from top)),
        rolled as (
            select cluster_id, string_agg(distinct source_feed, ',' order by source_feed) as sources,
                   {LATEST} as latest_published, bool_or(category = '{category or ''}') as has_category
            from members group by cluster_id),
        cards as (
            select cluster_id, string_agg({CARD_SQL}, ';' order by position) as articles
            from members where position <= 5 group by cluster_id)
        select t.id as cluster_id, t.label as headline, t.summary, t.article_count, r.sources, r.latest_published, c.articles
        from top t join rolled r on r.cluster_id = t.id join cards c on c.cluster_id = t.id {wanted}
        """
    )


@query("headlines", stories_sql(20))
def headlines(spark, sf):
    articles, clusters = fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "clusters")
    return flat_lists(latest_headlines(articles, clusters, fx.as_of(), HOURS))


@query("headlines_category", stories_sql(5, "world"))
def headlines_category(spark, sf):
    articles, clusters = fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "clusters")
    return flat_lists(latest_headlines(articles, clusters, fx.as_of(), HOURS, limit=5, category="world"))


@query(
    "headlines_fallback",
    fx.ctes("articles")
    + f"""select cast(null as varchar) as cluster_id, title as headline, summary, 1 as article_count, source_feed as sources,
           {DATE} as latest_published, {CARD_SQL} as articles
    from articles where {WINDOW} and category = 'technology' order by published_at desc nulls last, id limit 20""",
)
def headlines_fallback(spark, sf):
    """Before the first clustering."""
    articles, clusters = fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "clusters").limit(0)
    return flat_lists(latest_headlines(articles, clusters, fx.as_of(), HOURS, category="technology"))


@query(
    "headlines_json",
    fx.ctes("clusters")
    + f""", top as (
        select * from clusters where updated_at > timestamp '2024-01-31 00:00:00' - interval 480 hour
        order by article_count desc, id limit 20),
    members as (
        select a.*, row_number() over (partition by cluster_id order by published_at desc nulls last, id) as position
        from articles a where cluster_id in (select id from top)),
    rolled as (
        select cluster_id, list(distinct source_feed order by source_feed) as sources, {LATEST} as latest_published
        from members group by cluster_id),
    cards as (
        select cluster_id, list({{'title': title, 'url': source_url, 'source': source_feed, 'published_at': {DATE}}} order by position) as articles
        from members where position <= 5 group by cluster_id)
    select cast(to_json({{'cluster_id': t.id, 'headline': t.label, 'summary': t.summary, 'article_count': t.article_count,
        'sources': r.sources, 'latest_published': r.latest_published, 'articles': c.articles}}) as varchar) as json
    from top t join rolled r on r.cluster_id = t.id join cards c on c.cluster_id = t.id""",
)
def headlines_as_json(spark, sf):
    articles, clusters = fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "clusters")
    return headlines_json(latest_headlines(articles, clusters, fx.as_of(), HOURS))


@query(
    "search_news",
    KNN
    + f""", hits as (
        select query_id, article_id, score,
               row_number() over (partition by query_id order by round(score, 12) desc, article_id) as rank
        from scored where score >= 0 and region = 'europe'
          and published_at >= timestamp '2024-01-31 00:00:00' - interval 480 hour
        qualify rank <= 20)
    select h.query_id, h.rank, a.title, a.summary, a.source_url as url, a.source_feed as source, a.region, a.category,
           coalesce({ISO.format('a.published_at')}, '') as published_at, round(h.score, 4) as relevance_score, a.cluster_id
    from hits h join articles a on a.id = h.article_id""",
)
def searched_news(spark, sf):
    return search_news(
        fx.derived(spark, sf, "articles"),
        fx.derived(spark, sf, "vectors"),
        fx.topic_vectors(spark, sf),
        fx.as_of(),
        region="europe",
        hours=HOURS,
    )


@query(
    "search_by_text",
    fx.ctes("articles")
    + """, asked as (select 'q' || cast(item_id as varchar) as id, text as body from benchmark),
    both_sides as (select 'a' || id as id, title || ' ' || summary as body from articles union all select * from asked)"""
    + counted_sql("both_sides")
    + f""", lengths as (select id, sqrt(sum(x * x)) as n from weighed group by id),
    dots as (
        select q.id as q, a.id as a, sum(q.x * a.x) as d from weighed q join weighed a using (bucket)
        where q.id like 'q%' and a.id like 'a%' group by all),
    scored as (
        select q.id as q, a.id as article_id, coalesce(d / (x.n * y.n), 0) as score
        from asked q cross join articles a left join dots on dots.q = q.id and dots.a = 'a' || a.id
        left join lengths x on x.id = q.id left join lengths y on y.id = 'a' || a.id),
    hits as (
        select *, row_number() over (partition by q order by round(score, 12) desc, article_id) as rank from scored qualify rank <= 5)
    select substr(q, 2) as query_id, rank, title, source_url as url, source_feed as source, region, category, {DATE} as published_at,
           round(score, 4) as relevance_score, cluster_id
    from hits join articles on id = article_id""",
)
def search_by_text(spark, sf):
    """Every benchmark text as a query, embedded like the articles."""
    articles = fx.derived(spark, sf, "articles")
    vectors = embed_articles(fx.derived(spark, sf, "articles", parallel=True)).withColumnRenamed("id", "article_id")
    asked = fx.base(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    found = search_news(articles, vectors, embed_text(asked, "text"), fx.as_of(), limit=5)
    return found.drop("summary")


@query(
    "news_by_region",
    fx.ctes("articles")
    + f"""select title, summary, source_url as url, source_feed as source, category, {DATE} as published_at, cluster_id
    from articles where {WINDOW} and region = 'europe' order by articles.published_at desc nulls last, id limit 50""",
)
def region_news(spark, sf):
    return news_by_region(fx.derived(spark, sf, "articles"), fx.as_of(), "europe", HOURS)


FOUND = (
    KNN
    + """, hits as (
        select query_id, article_id, score,
               row_number() over (partition by query_id order by round(score, 12) desc, article_id) as rank
        from scored where score >= 0.3 and published_at >= timestamp '2024-01-31 00:00:00' - interval 480 hour
        qualify rank <= 10),
    found as (select h.query_id, h.rank, a.* from hits h join articles a on a.id = h.article_id)
    """
)


@query(
    "briefing_context",
    FOUND
    + """select query_id, string_agg(concat('Title: ', title, chr(10), 'Source: ', source_feed, chr(10), 'Summary: ', summary),
           chr(10) || chr(10) order by rank) as context
    from found group by query_id""",
)
def contexts(spark, sf):
    found = found_articles(
        fx.derived(spark, sf, "articles"),
        fx.derived(spark, sf, "vectors"),
        fx.topic_vectors(spark, sf),
        fx.as_of(),
        10,
        0.3,
        hours=HOURS,
    )
    return briefing_context(found)


@query(
    "topic_briefing",
    FOUND
    + f""", told as (
        select query_id, count(*) as article_count, string_agg(distinct source_feed, ',' order by source_feed) as sources,
               string_agg({CARD_SQL}, ';' order by rank) as articles,
               '1. Key developments' || chr(10) || string_agg(title, '; ' order by rank) || chr(10)
               || '2. Notable entities involved' || chr(10) || chr(10)
               || '3. Potential implications' || chr(10) || first(title order by published_at desc nulls last, id) as briefing
        from found group by query_id)
    select q.query_id, replace(q.query_id, 'q', 'topic ') as topic,
           coalesce(t.briefing, 'No relevant articles found.') as briefing, coalesce(t.article_count, 0) as article_count,
           coalesce(t.sources, '') as sources, t.articles
    from query_vectors q left join told t on t.query_id = q.query_id""",
)
def briefed_topics(spark, sf):
    topics = fx.topic_vectors(spark, sf).withColumn("topic", F.regexp_replace("query_id", "^q", "topic "))
    briefed = topic_briefing(
        fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "vectors"), topics, fx.as_of(), hours=HOURS
    )
    return flat_lists(briefed)


@query(
    "trending",
    fx.ctes("clusters")
    + f""", top as (
        select * from clusters where updated_at > timestamp '2024-01-31 00:00:00' - interval 480 hour
        order by article_count desc, id limit 10)
    select t.id as cluster_id, any_value(t.label) as topic, any_value(t.summary) as summary,
           any_value(t.article_count) as article_count, string_agg(distinct source_feed, ',' order by source_feed) as sources,
           coalesce(string_agg(distinct region, ',' order by region) filter (where region <> ''), '') as regions,
           {LATEST} as latest_published
    from top t join articles a on a.cluster_id = t.id group by t.id""",
)
def trending(spark, sf):
    articles, clusters = fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "clusters")
    return flat_lists(trending_topics(articles, clusters, fx.as_of(), HOURS))


@query(
    "trending_fallback",
    fx.ctes("articles")
    + f""", newest as (
        select *, row_number() over (order by published_at desc nulls last, id) as place from articles
        where {WINDOW} order by place limit 300)
    select cast(null as varchar) as cluster_id, concat(case category when '' then 'general' else category end, ' news') as topic,
           arg_min(title, place) as summary, count(*) as article_count,
           string_agg(distinct source_feed, ',' order by source_feed) as sources,
           coalesce(string_agg(distinct region, ',' order by region) filter (where region <> ''), '') as regions,
           {LATEST} as latest_published
    from newest group by category""",
)
def trending_fallback(spark, sf):
    """Before the first clustering."""
    articles, clusters = fx.derived(spark, sf, "articles"), fx.derived(spark, sf, "clusters").limit(0)
    return flat_lists(trending_topics(articles, clusters, fx.as_of(), HOURS, limit=100))

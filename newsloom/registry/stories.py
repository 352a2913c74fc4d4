"""Model jobs, components and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.functions.vectors import norm
from newsloom.operators.cluster import build_clusters, cluster_stories
from newsloom.operators.dedup import simhash_pairs
from newsloom.operators.embed import embed_articles
from newsloom.operators.entities import LABELS, distinct_entities, extract_entities
from newsloom.operators.forest import components
from newsloom.operators.summarize import summarize_clusters
from newsloom.registry import ORACLES, query
from newsloom.registry.dedup import HASHES, hashed_articles
from newsloom.registry.density_sql import DENSITY_SQL
from newsloom.registry.similarity import INCOMING
from newsloom.registry.sqlparts import WORDS_SQL, counted_sql
from newsloom.registry.storage import article_clusters
from newsloom.session import cut_lineage

@query(
    "embed_articles",
    fx.ctes("articles")
    + ", spoken as (select id, title || ' ' || summary as body from articles)"
    + counted_sql("spoken")
    + """, least as (select id, min(c) as least, count(*) as used from counted group by id),
    summed as (
        select id, sum(cast(floor(c / least + 0.3137) as bigint) * (bucket + 1)) as moment from counted join least using (id) group by id)
    select id, if(used is null, 0.0, 1.0) as length, coalesce(used, 0) as used, cast(coalesce(moment, 0) as bigint) as moment
    from articles left join least using (id) left join summed using (id)""",
)
def embedded_articles(spark, sf):
    """Length and number of used dimensions of each article's default embedding, and its weights, in whole multiples of the
    least one, summed over the numbers of their dimensions."""
    embedded = cut_lineage(embed_articles(fx.derived(spark, sf, "articles", parallel=True)).select("id", "embedding"))
    used = F.filter("embedding", lambda x: x != 0)
    # no quotient of two counts lies near the edge between two whole numbers, so single precision is enough
    weight = lambda x, least: F.floor(F.coalesce(x / least, F.lit(0.0)) + 0.3137)
    total = lambda least: F.aggregate(F.transform("embedding", lambda x, i: weight(x, least) * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # the least weight as the element of an array, so that it is found once a row and not once a dimension
    moment = F.get(F.transform(F.array(F.array_min(used)), total), 0)
    return embedded.select("id", F.round(norm(F.col("embedding")), 4).alias("length"), F.size(used).alias("used"), moment.alias("moment"))


@query(
    "entity_distinct",
    fx.ctes("raw_entities")
    + """select article_id, min(pos) as pos, min_by(text, pos) as text, label
    from raw_entities group by article_id, lower(text), label""",
)
def entity_distinct(spark, sf):
    return distinct_entities(fx.derived(spark, sf, "raw_entities")).drop("id")


@query(
    "extract_entities",
    fx.ctes("articles", "gazetteer")
    + f""", texts as (select id, {WORDS_SQL.format("title || ' ' || content")} as words from articles),
    tokens as (select id, unnest(words) as text, generate_subscripts(words, 1) as pos from texts)
    select t.id as article_id, min(t.pos) as pos, min_by(t.text, t.pos) as text,
           case g.label_no {' '.join(f"when {i} then '{label}'" for i, label in enumerate(LABELS))} end as label
    from tokens t join gazetteer g on g.term = lower(t.text) group by t.id, g.term, g.label_no""",
)
def gazetteer_entities(spark, sf):
    names = F.array(*[F.lit(label) for label in LABELS])
    gazetteer = fx.derived(spark, sf, "gazetteer").select(
        "term", F.element_at(names, (F.col("label_no") + 1).cast("int")).alias("label")
    )
    return extract_entities(fx.derived(spark, sf, "articles", parallel=True), gazetteer=gazetteer).drop("id")


@query(
    "cluster_summary",
    fx.ctes("articles")
    + f""", titles as (
        select cluster_id, title, row_number() over (
            partition by cluster_id order by published_at desc nulls last, id) as position
        from articles where cluster_id is not null qualify position <= 15),
    spoken as (select cluster_id, position, unnest(list_distinct({WORDS_SQL.format('lower(title)')})) as word from titles),
    shared as (select cluster_id, word, count(*) as n from spoken group by all),
    weights as (select cluster_id, position, avg(n) as weight from spoken join shared using (cluster_id, word) group by all),
    ranked as (
        select t.cluster_id, t.title, row_number() over (
            partition by t.cluster_id order by round(coalesce(w.weight, 0), 9) desc, t.position) as place
        from titles t left join weights w on w.cluster_id = t.cluster_id and w.position = t.position)
    select cluster_id, string_agg(title, ' ' order by place) as summary from ranked where place <= 3 group by cluster_id
    """,
)
def cluster_summary(spark, sf):
    return summarize_clusters(fx.derived(spark, sf, "articles").where("cluster_id is not null"))


@query(
    "components",
    HASHES.replace("with articles", "with recursive articles")
    + """, edges as materialized (
        select b.id as a, min_by(a.id, cast(a.id as bigint)) as b
        from hashes a join hashes b on cast(a.id as bigint) < cast(b.id as bigint)
            and bit_count(xor(a.simhash, b.simhash)) <= 3
        group by b.id),
    links as (select a, b from edges union select b, a from edges),
    reach as (select a as node, a as seen from links union select r.node, e.b from reach r join links e on e.a = r.seen)
    select node, min(seen) as component from reach group by node
    """,
)
def near_copy_groups(spark, sf):
    """Groups of articles linked by near copies."""
    pairs = simhash_pairs(hashed_articles(spark, sf))
    return components(pairs.select(F.col("id").alias("a"), F.col("match_id").alias("b")))


@query("components_rounds", ORACLES["components"])
def near_copy_groups_in_rounds(spark, sf):
    """The same with the rounds, down to the last few edges."""
    pairs = simhash_pairs(hashed_articles(spark, sf))
    return components(pairs.select(F.col("id").alias("a"), F.col("match_id").alias("b")), finish_edges=5)


def stories_of_the_month(spark, sf, **tuning):
    """Stored and new vectors of the whole month, before any clustering."""
    articles = fx.derived(spark, sf, "articles").select("id", "title", "published_at", "ingested_at", "cluster_id")
    stored = fx.derived(spark, sf, "vectors").select("article_id", "embedding")
    fresh = fx.incoming_vectors(spark, sf).select("article_id", "embedding")
    origin = F.regexp_replace("article_id", "^n", "")
    arrived = fresh.select("article_id", origin.alias("id")).join(articles.drop("cluster_id"), "id")
    both = articles.drop("cluster_id").unionByName(arrived.drop("id").withColumnRenamed("article_id", "id"))
    none_yet = article_clusters(articles).limit(0)
    return cluster_stories(both, stored.unionByName(fresh), none_yet, fx.as_of(), hours=744, **tuning)


STORIES_SQL = (
    INCOMING.replace("with ", "with recursive ", 1)
    + """, vecs as (
        select article_id as id, cast(embedding as double[]) as v from vectors
        union all select article_id, cast(embedding as double[]) from fresh where substr(article_id, 2) in (select id from articles)),"""
    + DENSITY_SQL
    + "select id as article_id, sha256(min(id) over (partition by story)) as cluster_id from stories"
)


@query("cluster_stories", STORIES_SQL)
def clustered_stories(spark, sf):
    return stories_of_the_month(spark, sf)


@query("cluster_stories_cells", STORIES_SQL)
def clustered_stories_in_cells(spark, sf):
    """The same with limits that the small tables pass: the tree in rounds over cells, the hierarchy in slices
    (tests/test_vectors.py compares both)."""
    return stories_of_the_month(spark, sf, tree_block_rows=64, slice_edges=150)


@query(
    "build_clusters",
    fx.ctes("articles")
    + """select cluster_id as id, '' as summary, count(*) as article_count, substring(arg_min(title, place), 1, 200) as label
    from (select *, row_number() over (order by published_at nulls last, id) as place from articles)
    where cluster_id is not null group by cluster_id""",
)
def built_clusters(spark, sf):
    articles = fx.derived(spark, sf, "articles")
    return build_clusters(article_clusters(articles), articles)

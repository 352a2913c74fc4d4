"""Cosine search and duplicate removal by vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.functions.vectors import cosine
from newsloom.operators import vector_search as vs
from newsloom.operators.cluster import neighbour_edges
from newsloom.operators.lsh import Lsh
from newsloom.registry import ORACLES, query

COS = "list_cosine_similarity(cast({} as double[]), cast({} as double[]))"

INCOMING = (
    fx.ctes("vectors", "incoming")
    + """, fresh as (
        select article_id, kind, item_seq,
               cast(case kind when 0 then list_transform(base, lambda x: x * 2)
                    when 1 then list_transform(base, lambda x: -x)
                    else list_transform(list_zip(base, other), lambda p: p[1] + p[2]) end as float[]) as embedding
        from incoming)
    """
)
TOPICS = (
    fx.ctes("vectors")
    + """, query_vectors as (
        select concat('q', cast(label as varchar)) as query_id, list(cast(m as float) order by pos) as embedding
        from (select label, pos, avg(cast(x as double)) as m
              from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)
              group by label, pos)
        group by label)
    """
)


@query(
    "cosine",
    INCOMING
    + f"""select article_id, round({COS.format('f.embedding', 'i.base')}, 4) as score
    from fresh f join incoming i using (article_id)""",
)
def cosine_columns(spark, sf):
    """The column function: each new vector against the one it was made from."""
    made = fx.incoming_vectors(spark, sf)
    origin = fx.derived(spark, sf, "incoming").select("article_id", "base")
    joined = made.join(origin, "article_id")
    return joined.select("article_id", F.round(cosine(F.col("embedding"), F.col("base")), 4).alias("score"))


@query(
    "cosine_pairs",
    INCOMING
    + f""", pairs as (
        select f.article_id, v.article_id as match_id, {COS.format('f.embedding', 'v.embedding')} as score
        from fresh f, vectors v)
    select article_id, match_id, round(score, 4) as score from pairs where score >= 0.6
    qualify row_number() over (partition by article_id order by round(score, 12) desc, match_id) = 1""",
)
def cosine_pairs(spark, sf):
    found = vs.best_matches(fx.incoming_vectors(spark, sf), fx.derived(spark, sf, "vectors"), 0.6)
    return found.withColumn("score", F.round("score", 4))


@query(
    "dedup_vectors",
    INCOMING
    + f"""select article_id, kind from fresh f where not exists (
        select 1 from vectors v where {COS.format('f.embedding', 'v.embedding')} >= 0.95)""",
)
def deduped_by_vector(spark, sf):
    kept = vs.dedup_vectors(fx.incoming_vectors(spark, sf), fx.derived(spark, sf, "vectors"))
    return kept.select("article_id", "kind")


@query(
    "dedup_vectors_in_order",
    INCOMING
    + f""", fed as (select *, kind as batch_seq from fresh),
    one as (select * from fed where batch_seq = 0),
    two as (select * from fed f where batch_seq = 1 and not exists (
        select 1 from one o where {COS.format('f.embedding', 'o.embedding')} >= 0.7)),
    three as (select * from fed f where batch_seq = 2 and not exists (
        select 1 from (select * from one union all select * from two) o
        where {COS.format('f.embedding', 'o.embedding')} >= 0.7))
    select article_id, batch_seq from (select * from one union all select * from two union all select * from three)""",
)
def deduped_in_order(spark, sf):
    """Three feeds, one per kind, into an empty store at threshold 0.7."""
    fed = fx.incoming_vectors(spark, sf).withColumn("batch_seq", F.col("kind"))
    nothing = fx.derived(spark, sf, "vectors").limit(0)
    kept = vs.dedup_vectors_in_order(fed, nothing, 0.7)
    return kept.select("article_id", "batch_seq")


KNN = TOPICS + f""", scored as (
        select q.query_id, v.article_id, v.region, v.source_feed, v.published_at,
               {COS.format('q.embedding', 'v.embedding')} as score
        from query_vectors q, vectors v)
    """


@query(
    "knn_topk",
    KNN
    + """select query_id, article_id, round(score, 4) as score,
           row_number() over (partition by query_id order by round(score, 12) desc, article_id) as rank
    from scored where score >= 0 qualify rank <= 20""",
)
def knn_topk(spark, sf):
    found = vs.knn(fx.derived(spark, sf, "vectors"), fx.topic_vectors(spark, sf))
    return found.withColumn("score", F.round("score", 4))


@query(
    "search_filtered",
    KNN
    + """select query_id, article_id, round(score, 4) as score,
           row_number() over (partition by query_id order by round(score, 12) desc, article_id) as rank
    from scored where score >= 0.05 and region = 'europe' and source_feed = 'src3'
      and published_at >= timestamp '2024-01-05 00:00:00' qualify rank <= 20""",
)
def search_filtered(spark, sf):
    found = vs.knn(
        fx.derived(spark, sf, "vectors"),
        fx.topic_vectors(spark, sf),
        min_score=0.05,
        region="europe",
        source_feed="src3",
        since=F.lit("2024-01-05 00:00:00").cast("timestamp"),
    )
    return found.withColumn("score", F.round("score", 4))


# The same with limits that the small tables pass, so that the ways for large ones run.
BLOCKS = {"max_sent": 0, "block_rows": 50}


@query("knn_blocks", ORACLES["knn_topk"])
def knn_in_blocks(spark, sf):
    found = vs.knn(fx.derived(spark, sf, "vectors"), fx.topic_vectors(spark, sf), **BLOCKS)
    return found.withColumn("score", F.round("score", 4))


@query("cosine_blocks", ORACLES["cosine_pairs"])
def cosine_pairs_in_blocks(spark, sf):
    found = vs.best_matches(fx.incoming_vectors(spark, sf), fx.derived(spark, sf, "vectors"), 0.6, **BLOCKS)
    return found.withColumn("score", F.round("score", 4))


# Approximate search: true matches only, nine in ten of them at least (tests/test_vectors.py measures it).
@query("knn_lsh")
def knn_approximate(spark, sf):
    found = vs.knn(fx.derived(spark, sf, "vectors"), fx.topic_vectors(spark, sf), lsh=Lsh(likely=0.2))
    return found.withColumn("score", F.round("score", 4))


@query("cosine_lsh")
def cosine_pairs_approximate(spark, sf):
    found = vs.best_matches(fx.incoming_vectors(spark, sf), fx.derived(spark, sf, "vectors"), 0.6, lsh=Lsh())
    return found.withColumn("score", F.round("score", 4))


@query("dedup_vectors_rounds", ORACLES["dedup_vectors_in_order"])
def deduped_in_rounds(spark, sf):
    fed = fx.incoming_vectors(spark, sf).withColumn("batch_seq", F.col("kind"))
    kept = vs.dedup_vectors_in_order(fed, fx.derived(spark, sf, "vectors").limit(0), 0.7, finish_rows=10)
    return kept.select("article_id", "batch_seq")


# unit vectors, pair scores and ranks are each computed once
NEIGHBOURS = (
    fx.ctes("vectors")
    + """, units as materialized (
        select article_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u
        from (select article_id, cast(embedding as double[]) as v from vectors)),
    pairs as materialized (
        select a.article_id, b.article_id as neighbour_id, round(list_inner_product(a.u, b.u), 12) as score
        from units a join units b on a.article_id <> b.article_id),
    near as materialized (
        select article_id, neighbour_id, sqrt(greatest(2 - 2 * score, 0)) as distance,
               row_number() over (partition by article_id order by score desc, neighbour_id) as rank
        from pairs qualify rank <= 3),
    core as (select article_id, distance as core from near where rank = 3)
    """
)


@query(
    "reachability_edges",
    NEIGHBOURS
    + """select n.article_id, n.neighbour_id, n.rank, round(n.distance, 4) as distance, round(a.core, 4) as core,
           round(greatest(n.distance, a.core, b.core), 4) as reachability
    from near n join core a on a.article_id = n.article_id join core b on b.article_id = n.neighbour_id
    where n.rank <= 3""",
)
def reachability_edges(spark, sf):
    edges = neighbour_edges(fx.derived(spark, sf, "vectors"), 3)
    for c in ("distance", "core", "reachability"):
        edges = edges.withColumn(c, F.round(c, 4))
    return edges

"""Duplicate removal by URL and by SimHash."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixtures as fx
from newsloom.functions.hashing import hamming, simhash
from newsloom.functions.text import article_text
from newsloom.operators import dedup
from newsloom.registry import ORACLES, query
from newsloom.registry.sqlparts import simhash_sql
from newsloom.registry.storage import HISTORY

HASHES = fx.ctes("articles") + ", " + simhash_sql("articles", "title || ' ' || summary")


def hashed_articles(spark, sf):
    """id, ord and simhash of every article, in document order."""
    articles = fx.derived(spark, sf, "articles", parallel=True)
    return articles.select(
        "id",
        F.col("id").cast("bigint").alias("ord"),
        "source_url",
        "published_at",
        simhash(article_text(articles)).alias("simhash"),
    )


@query("simhash", HASHES + "select id, simhash from hashes")
def simhashes(spark, sf):
    return hashed_articles(spark, sf).select("id", "simhash")


@query(
    "hamming",
    HASHES
    + """select id, bit_count(xor(simhash, lag(simhash) over (order by cast(id as bigint)))) as distance from hashes""",
)
def hamming_to_previous(spark, sf):
    """Distance of each article's hash to that of the article before it, found by id."""
    hashed = hashed_articles(spark, sf).select("ord", "id", "simhash")
    before = hashed.select((F.col("ord") + 1).alias("ord"), F.col("simhash").alias("previous"))
    joined = hashed.join(before, "ord", "left")
    return joined.select("id", hamming(F.col("simhash"), F.col("previous")).alias("distance"))


@query(
    "dedup_url",
    fx.ctes("articles")
    + f"""select id, source_url from articles
    where not {HISTORY} and source_url not in (select source_url from articles where {HISTORY})
    qualify row_number() over (partition by source_url order by cast(id as bigint)) = 1""",
)
def deduped_by_url(spark, sf):
    articles = fx.derived(spark, sf, "articles").select(
        "id", "source_url", "published_at", F.col("id").cast("bigint").alias("ord")
    )
    kept = dedup.dedup_url(articles.where(f"not {HISTORY}"), articles.where(HISTORY))
    return kept.select("id", "source_url")


@query(
    "simhash_pairs",
    HASHES
    + """select b.id, min_by(a.id, cast(a.id as bigint)) as match_id,
           min_by(bit_count(xor(a.simhash, b.simhash)), cast(a.id as bigint)) as distance
    from hashes a join hashes b on cast(a.id as bigint) < cast(b.id as bigint)
        and bit_count(xor(a.simhash, b.simhash)) <= 3
    group by b.id""",
)
def near_articles(spark, sf):
    return dedup.simhash_pairs(hashed_articles(spark, sf))


# The sequential pass: one step per row in order, carrying the hashes kept so far.
GREEDY = """, numbered as materialized (
        select id, simhash, row_number() over (order by cast(id as bigint)) as i from fresh),
    steps as (
        select cast(0 as bigint) as i, (select coalesce(list(simhash), []) from stored) as seen, cast(null as varchar) as id
        union all
        select n.i,
               case when len(list_filter(s.seen, lambda k: bit_count(xor(k, n.simhash)) <= 3)) = 0
                    then list_append(s.seen, n.simhash) else s.seen end,
               case when len(list_filter(s.seen, lambda k: bit_count(xor(k, n.simhash)) <= 3)) = 0 then n.id end
        from steps s join numbered n on n.i = s.i + 1)
    select id from steps where id is not null"""


@query(
    "dedup_simhash",
    HASHES.replace("with articles", "with recursive articles")
    + ", fresh as (select id, simhash from hashes), stored as (select simhash from hashes where false)"
    + GREEDY,
)
def deduped_by_simhash(spark, sf):
    return dedup.dedup_simhash(hashed_articles(spark, sf)).select("id")


@query(
    "dedup_simhash_stored",
    HASHES.replace("with articles", "with recursive articles")
    + f""", fresh as (select h.id, h.simhash from hashes h join articles a on a.id = h.id where not {HISTORY}),
    stored as (select h.simhash from hashes h join articles a on a.id = h.id where {HISTORY})"""
    + GREEDY,
)
def deduped_against_stored(spark, sf):
    """The second half of the month against the hashes of the first."""
    hashed = hashed_articles(spark, sf)
    kept = dedup.dedup_simhash(hashed.where(f"not {HISTORY}"), hashed.where(HISTORY))
    return kept.select("id")


@query("dedup_simhash_rounds", ORACLES["dedup_simhash"])
def deduped_in_rounds(spark, sf):
    """The same pass with its rounds, down to the last few hashes."""
    return dedup.dedup_simhash(hashed_articles(spark, sf), finish_hashes=20).select("id")

"""One ingestion run: URL, SimHash, embedding, vector and entity stages in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import IDFModel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.config import Settings
from newsloom.functions.hashing import simhash
from newsloom.functions.text import article_text
from newsloom.operators.dedup import dedup_simhash, dedup_url
from newsloom.operators.embed import EmbedFn, embed_articles
from newsloom.operators.entities import EntityFn, extract_entities
from newsloom.operators.normalize import ARTICLE_COLUMNS, normalize_gdelt, normalize_rss
from newsloom.operators.reads import recent_simhashes
from newsloom.operators.stored_cells import StoredCells
from newsloom.operators.vector_search import dedup_vectors_in_order
from newsloom.session import cut_lineage, passing_tables, send_if_small
from newsloom.tables import ARTICLES, ENTITIES, INGESTION_LOG, VECTORS, NewsTables, conform

RSS, GDELT = 0, 1
MAX_SENT_FEEDS = 200_000
SOURCE_NAMES = {RSS: "rss", GDELT: "gdelt"}


@dataclass(frozen=True)
class Models:
    """Functions for embedding and entities; without them the defaults that need no model."""

    embed: EmbedFn | None = None
    idf: IDFModel | None = None
    entities: EntityFn | None = None
    gazetteer: DataFrame | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Ingested:
    """What a run adds to the tables, how many rows each stage left per source, and how many entities were found in these."""

    articles: DataFrame
    vectors: DataFrame
    entities: DataFrame
    log: DataFrame
    stage_counts: DataFrame
    entity_counts: DataFrame

    def added_to(self, tables: NewsTables) -> NewsTables:
        return tables.with_(
            **{
                name: getattr(tables, name).unionByName(
                    conform(getattr(self, part), schema).select(*getattr(tables, name).columns)
                )
                for name, part, schema in (
                    ("articles", "articles", ARTICLES),
                    ("vectors", "vectors", VECTORS),
                    ("entities", "entities", ENTITIES),
                    ("ingestion_log", "log", INGESTION_LOG),
                )
            }
        )


def arrivals(entries: DataFrame | None, records: DataFrame | None, feeds: DataFrame, as_of: Column) -> DataFrame:
    """Normalized articles of both sources with their place in the order of arrival.

    Feeds come in the order of their ids, API records after all feeds; payloads of one feed in the order
    of ``payload`` (landing time and file name) or ``payload_id``, if there is one.
    """
    parts = []
    if entries is not None:
        rss = normalize_rss(with_payload(entries), feeds.where("enabled"), as_of)
        parts.append(
            rss.select(*ARTICLE_COLUMNS, F.lit(RSS).alias("source_seq"), "feed_id", "payload", "item_seq")
        )
    if records is not None:
        gdelt = normalize_gdelt(with_payload(records), as_of)
        parts.append(
            gdelt.select(*ARTICLE_COLUMNS, F.lit(GDELT).alias("source_seq"), F.lit("").alias("feed_id"), "payload", "item_seq")
        )
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both


def with_payload(df: DataFrame) -> DataFrame:
    name = next((c for c in ("payload", "payload_id") if c in df.columns), None)
    return df.withColumn("payload", F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit(""))


def _batch_numbers(batch: DataFrame) -> DataFrame:
    """``batch_seq``: the feeds of the run numbered in order of source and feed id."""
    feeds = batch.select("source_seq", "feed_id").distinct()
    ranked = feeds.orderBy("source_seq", "feed_id").select(
        "source_seq", "feed_id", F.monotonically_increasing_id().alias("batch_seq")
    )
    # one feed may hold most rows, so the short list goes to the rows
    return batch.join(send_if_small(cut_lineage(ranked), MAX_SENT_FEEDS), ["source_seq", "feed_id"])


def _observed(df: DataFrame, stage: str, outlasting: bool = False) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """``df`` written once, and its rows per source, counted while they are written."""
    seen = Observation()
    counted = df.observe(seen, *[F.count_if(F.col("source_seq") == n).alias(name) for n, name in SOURCE_NAMES.items()])
    out = cut_lineage(counted, outlasting)
    return out, [(name, stage, rows) for name, rows in seen.get.items() if rows]


# Each stage removes the tables of the one before as soon as its own is written, so that the texts lie on disk twice at most.


def _new_by_url(batch: DataFrame, tables: NewsTables) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    with passing_tables(batch.sparkSession):
        batch, fetched = _observed(_batch_numbers(batch), "fetched")
        placed = batch.withColumn("ord", F.struct("source_seq", "batch_seq", "payload", "item_seq"))
        fresh, new = _observed(dedup_url(placed, tables.articles), "new_url", outlasting=True)
    return fresh, [*fetched, *new]


def _new_by_simhash(batch: DataFrame, tables: NewsTables, as_of: Column, settings: Settings) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    with passing_tables(batch.sparkSession):
        fresh, before = _new_by_url(batch, tables)
        hashes = fresh.select("id", "ord", simhash(article_text(fresh)).alias("simhash"))
        recent = recent_simhashes(tables.articles, as_of, settings.simhash_window_hours)
        unlike = dedup_simhash(hashes, recent, settings.simhash_threshold).select("id", "simhash")
        unlike, new = _observed(fresh.join(unlike, "id"), "new_simhash", outlasting=True)
    return unlike, [*before, *new]


def _new_by_vector(
    batch: DataFrame, tables: NewsTables, as_of: Column, models: Models, settings: Settings, cells: StoredCells | None
) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    with passing_tables(batch.sparkSession):
        unlike, before = _new_by_simhash(batch, tables, as_of, settings)
        with passing_tables(batch.sparkSession):
            embedded = embed_articles(
                unlike.select("id", "title", "summary", "batch_seq"),
                models.embed,
                settings.embedding_dim,
                settings.embed_max_chars,
                models.idf,
            )
            # read in every round of the comparison
            vectors = cut_lineage(embedded.select(F.col("id").alias("article_id"), "embedding", "batch_seq"))
            known = tables.vectors
            if cells is not None:
                known = cells.visited(known, vectors, settings.vector_dedup_threshold)
            kept = dedup_vectors_in_order(vectors, known, settings.vector_dedup_threshold)
            kept = cut_lineage(kept.select(F.col("article_id").alias("id"), "embedding"), outlasting=True)
        stored, new = _observed(unlike.join(kept, "id"), "stored", outlasting=True)
    return stored, [*before, *new]


def _counted_entities(entities: DataFrame, stored: DataFrame) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """``entities`` written once, and how many of them the articles of each source have."""
    written = cut_lineage(entities.select("id", "article_id", "text", "label"))
    source = stored.groupBy(F.col("id").alias("article_id")).agg(F.min("source_seq").alias("source_seq"))
    per_article = written.groupBy("article_id").agg(F.count("*").alias("rows"))
    found = per_article.join(source, "article_id").groupBy("source_seq").agg(F.sum("rows").alias("rows")).collect()
    return written, [(SOURCE_NAMES[r["source_seq"]], "entities", r["rows"]) for r in found]


def ingest_batch(
    batch: DataFrame,
    tables: NewsTables,
    as_of: Column,
    models: Models = Models(),
    settings: Settings = Settings(),
    cells: StoredCells | None = None,
) -> Ingested:
    """The rows a run stores, given ``arrivals`` and the tables so far. With ``cells`` only those of the
    stored vectors are read that can hold a match.

    Later feeds see what earlier ones stored. SimHash compares with the stored hashes of the
    last 48 hours and within the run; vectors with all stored ones and with earlier feeds. Entities are taken
    from what is left, written and counted in the run itself, like the other stages.
    """
    stored, stage_rows = _new_by_vector(batch, tables, as_of, models, settings, cells)
    entities, named = _counted_entities(extract_entities(stored, models.entities, models.gazetteer, settings.ner_max_chars), stored)
    # two sources and four stages at most
    counts, entity_counts = (
        stored.sparkSession.createDataFrame(rows, "source string, stage string, rows bigint")
        for rows in (stage_rows, named)
    )
    log = counts.groupBy("source").agg(
        as_of.alias("started_at"),
        as_of.alias("finished_at"),
        F.sum(F.when(F.col("stage") == "fetched", F.col("rows"))).alias("articles_fetched"),
        F.coalesce(F.sum(F.when(F.col("stage") == "stored", F.col("rows"))), F.lit(0)).alias("articles_stored"),
        F.lit(None).cast("string").alias("error"),
    )
    return Ingested(
        articles=stored.select(*ARTICLE_COLUMNS, "simhash"),
        vectors=stored.select(
            F.col("id").alias("article_id"), "embedding", "source_feed", "region", "published_at"
        ),
        entities=entities,
        log=log,
        stage_counts=counts,
        entity_counts=entity_counts,
    )

"""Models, the ingestion chain, the stream and the stored jobs."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.config import Settings
from newsloom.operators.embed import embed_articles, embed_text, fit_idf
from newsloom.operators.entities import extract_entities
from newsloom.operators.summarize import briefing_text, summarize_clusters
from newsloom.plans.briefing import NOTHING, topic_briefing
from newsloom.plans.headlines import latest_headlines
from newsloom.plans.ingest import Models, arrivals, ingest_batch
from newsloom.plans.jobs import run_cluster_job, run_retention_job
from newsloom.plans.region import news_by_region
from newsloom.plans.search import search_news
from newsloom.plans.trending import trending_topics
from newsloom.session import require_checkpoint_dir
from newsloom.sources.feeds import FeedConfigError, with_defaults
from newsloom.streaming.ingest import (
    cluster_stored,
    expire_stored,
    save_validators_stored,
    stream_ingest,
    sync_feeds_stored,
)
from newsloom.tables import NewsTables, init_tables, read_tables

NOW = "2024-01-31 00:00:00"


def as_of():
    return F.lit(NOW).cast("timestamp")


def letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"])


def articles(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, summary string, content string")


def test_embedding_function_sees_cut_text(spark):
    df = articles(spark, [("1", "aaa", "b" * 50, ""), ("2", "", None, "")])
    got = {r["id"]: r["embedding"] for r in embed_articles(df, letters, max_chars=10).collect()}
    assert got["1"][:3] == [3.0, 6.0, 0.0] and sum(got["2"]) == 0
    assert embed_articles(df.limit(0), letters).count() == 0


def test_default_embedding_is_stable_and_of_unit_length(spark):
    df = articles(spark, [("1", "Tax vote", "passes today", ""), ("2", "tax VOTE", "passes, today!", ""), ("3", "rain", "", "")])
    got = {r["id"]: np.array(r["embedding"]) for r in embed_articles(df, dim=64).collect()}
    assert np.allclose(got["1"], got["2"]) and np.isclose(np.linalg.norm(got["1"]), 1)
    assert got["1"] @ got["3"] < 0.5
    idf = fit_idf(df.withColumn("t", F.concat_ws(" ", "title", "summary")), "t", 64)
    assert embed_text(df, "title", dim=64, idf=idf).count() == 3


def test_entities_from_gazetteer_names_and_model(spark):
    df = articles(spark, [("1", "Paris talks", "", "Angela Merkel met paris mayor; New York and PARIS."), ("2", "x", "", "none")])
    gazetteer = spark.createDataFrame([("paris", "location"), ("new york", "location")], "term string, label string")
    got = extract_entities(df, gazetteer=gazetteer, max_words=2).collect()
    assert sorted((r["article_id"], r["text"], r["label"]) for r in got) == [("1", "New York", "location"), ("1", "Paris", "location")]
    names = {r["text"] for r in extract_entities(df).collect()}
    assert names == {"Angela Merkel", "New York"}

    def model(texts: pd.Series) -> pd.Series:
        found = [("Paris", "location", 0.9), ("paris", "location", 0.9), ("Paris", "person", 0.5), ("low", "event", 0.3), ("odd", "animal", 1.0)]
        return texts.map(lambda t: [{"text": x, "label": y, "score": s} for x, y, s in found])

    got = extract_entities(df.where("id = '1'"), fn=model).collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("Paris", "location"), ("Paris", "person")]
    assert len({r["id"] for r in got}) == 2


def test_summaries(spark):
    rows = [("c", f"a{i}", f"budget vote {i}", datetime(2024, 1, 30) - timedelta(hours=i)) for i in range(20)] + [
        ("c", "z", "unrelated", datetime(2024, 1, 30, 12))
    ]
    members = spark.createDataFrame(rows, "cluster_id string, id string, title string, published_at timestamp")
    assert summarize_clusters(members).first()["summary"] == "budget vote 0 budget vote 1 budget vote 2"
    seen = summarize_clusters(members, lambda s: s.map(lambda t: f" {len(t.splitlines())} {t.splitlines()[0]} "))
    assert seen.first()["summary"] == "15 unrelated"

    def fails(s: pd.Series) -> pd.Series:
        raise RuntimeError("down")

    assert summarize_clusters(members, fails).first()["summary"] == ""


def test_briefings_keep_topics_without_articles(spark):
    arts = spark.createDataFrame(
        [("1", "T1", "S1", "u1", "f", "europe", datetime(2024, 1, 30, 12)), ("2", "T2", "S2", "u2", "g", "asia", datetime(2024, 1, 1))],
        "id string, title string, summary string, source_url string, source_feed string, region string, published_at timestamp",
    )
    vectors = arts.select(
        F.col("id").alias("article_id"), F.array(F.lit(1.0), F.col("id").cast("double") - 1).cast("array<float>").alias("embedding"),
        "source_feed", "region", "published_at",
    )
    topics = spark.createDataFrame([("q", "near", [1.0, 0.0]), ("r", "far", [-1.0, 0.0])], "query_id string, topic string, embedding array<float>")
    entities = spark.createDataFrame([("1", "Bob"), ("1", "Amy")], "article_id string, text string")
    got = {r["query_id"]: r for r in topic_briefing(arts, vectors, topics, as_of(), entities=entities).collect()}
    assert (got["r"]["briefing"], got["r"]["article_count"], got["r"]["articles"]) == (NOTHING, 0, None)
    assert (got["q"]["article_count"], got["q"]["sources"]) == (1, ["f"])
    assert "T1" in got["q"]["briefing"] and "amy, bob" in got["q"]["briefing"]
    all_dates = {r["query_id"]: r for r in topic_briefing(arts, vectors, topics, as_of(), hours=None).collect()}
    assert all_dates["q"]["article_count"] == 2
    found = arts.withColumns({"query_id": F.lit("q"), "topic": F.lit("near"), "rank": F.col("id").cast("int")})
    text = briefing_text(found, fn=lambda s: s).first()["briefing"]
    assert text == "Topic: near\n\nTitle: T1\nSource: f\nSummary: S1\n\nTitle: T2\nSource: g\nSummary: S2"


FEED = "id string, name string, url string"
ENTRY = (
    "feed_id string, item_seq bigint, link string, title string, summary string, description string, "
    "content array<struct<value:string>>, published string, updated string, author string"
)
LONG = "The parliament adopted the annual budget after a long debate on taxes and energy prices. "


def feeds(spark):
    df = with_defaults(spark.createDataFrame([("f1", "One", "https://1.org/"), ("f2", "Two", "https://2.org/")], FEED))
    return df.withColumns({"etag": F.lit(""), "last_modified": F.lit("")})


def entries(spark, rows):
    return spark.createDataFrame([(f, i, u, t, s, "", None, None, None, None) for f, i, u, t, s in rows], ENTRY)


def test_chain_removes_duplicates_in_three_layers(spark):
    tables = NewsTables.empty(spark).with_(feeds=feeds(spark))
    rows = [
        ("f1", 0, "u1", "Budget", LONG * 3),
        ("f1", 1, "u1", "Same address", "other text entirely, about the harbour and its ships"),
        ("f1", 2, "u2", "Budget", LONG * 3),
        ("f1", 3, "u3", "Weather", "zzz sunny skies jumped over quick foxes zzz"),
        ("f2", 0, "u4", "Anagram", "zzz jumped skies sunny foxes quick over zzz Weather"),
        ("f2", 1, "u5", "", "no title"),
        ("off", 0, "u6", "Unknown feed", "x"),
    ]
    batch = arrivals(entries(spark, rows), None, tables.feeds, as_of())
    constant = Models(embed=lambda s: s.map(lambda t: [1.0, 0.0] if "zzz" in t else [0.0, 1.0]))
    first = ingest_batch(batch, tables, as_of(), constant)
    assert sorted(r["source_url"] for r in first.articles.collect()) == ["u1", "u3"]
    counts = {r["stage"]: r["rows"] for r in first.stage_counts.collect()}
    assert counts == {"fetched": 5, "new_url": 4, "new_simhash": 3, "stored": 2}
    log = first.log.first()
    assert (log["source"], log["articles_fetched"], log["articles_stored"], log["error"]) == ("rss", 5, 2, None)
    after = first.added_to(tables)
    again = ingest_batch(batch, after, as_of(), constant)
    assert again.articles.count() == 0 and again.vectors.count() == 0


def test_entities_are_found_in_the_run(spark):
    tables = NewsTables.empty(spark).with_(feeds=feeds(spark))
    rows = [
        ("f1", 0, "u1", "budget", "Anna Maria Lopez met John Smith in Paris; later John Smith left."),
        ("f2", 0, "u2", "harbour", "old ships lie there, said Peter Brown about them."),
        ("f2", 1, "u1", "known address", "Mary Jones is not asked."),
    ]
    lists = [("https://l/1", "a story of Jane Miller", None, None, None, None, "p", 0)]
    records = spark.createDataFrame(lists, "url string, title string, seendate string, sourcecountry string, language string, domain string, payload_id string, item_seq long")
    batch, small = arrivals(entries(spark, rows), records, tables.feeds, as_of()), Settings(embedding_dim=32)
    run = ingest_batch(batch, tables, as_of(), settings=small)
    assert {r["source"]: (r["stage"], r["rows"]) for r in run.entity_counts.collect()} == {"rss": ("entities", 3), "gdelt": ("entities", 1)}
    assert sorted(r["text"] for r in run.entities.collect()) == ["Anna Maria Lopez", "Jane Miller", "John Smith", "Peter Brown"]
    read = spark.sparkContext.accumulator(0)

    def names(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts.map(lambda t: [{"text": n, "label": "person", "score": 0.9} for n in ("John Smith", "Peter Brown", "Jane Miller") if n in t])

    # whoever asks for counts alone has had all that is stored read for names
    counts = ingest_batch(batch, tables, as_of(), Models(entities=names), small).entity_counts
    assert {r["source"]: r["rows"] for r in counts.collect()} == {"rss": 2, "gdelt": 1} and read.value == 3


def test_a_run_leaves_only_what_it_gives(spark):
    folder = Path(require_checkpoint_dir(spark).removeprefix("file:"))
    tables = NewsTables.empty(spark).with_(feeds=feeds(spark))
    rows = [("f1", i, f"u{i}", f"Story {i}", text_about(f"word{i}")) for i in range(4)]
    batch, before = arrivals(entries(spark, rows), None, tables.feeds, as_of()), set(folder.iterdir())
    run = ingest_batch(batch, tables, as_of(), settings=Settings(embedding_dim=32))
    # the stored articles with their vectors, and the entities
    assert len(set(folder.iterdir()) - before) == 2
    assert run.articles.count() == run.vectors.count() == 4


def test_result_does_not_depend_on_partitions(spark):
    tables = NewsTables.empty(spark).with_(feeds=feeds(spark))
    rows = [("f1" if i % 2 else "f2", i, f"u{i % 17}", f"Story {i % 5}", f"{LONG} number {i % 7} " * 2) for i in range(40)]
    df = entries(spark, rows)
    seen = set()
    for n in (1, 7):
        batch = arrivals(df.repartition(n), None, tables.feeds, as_of())
        got = ingest_batch(batch, tables, as_of(), settings=Settings(embedding_dim=32))
        seen.add(tuple(sorted(r["id"] for r in got.articles.collect())))
    assert len(seen) == 1


ITEM = "<item><title>{t}</title><link>{u}</link><description>{d}</description></item>"


def rss(items):
    return "<rss><channel>" + "".join(ITEM.format(t=t, u=u, d=d) for t, u, d in items) + "</channel></rss>"


def text_about(word):
    return " ".join(f"{word}{i} {word}" for i in range(40))


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "landing" / "rss").mkdir(parents=True)
    (tmp_path / "landing" / "gdelt").mkdir()
    return tmp_path


def test_stream_replay_clusters_and_retention(spark, landing):
    root, progress = str(landing / "store"), str(landing / "progress")
    source = landing / "landing"
    init_tables(spark, root, feeds(spark))

    def run():
        query = stream_ingest(spark, str(source), root, progress, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return {r["source_url"] for r in read_tables(spark, root).articles.collect()}

    (source / "rss" / "f1.1.xml").write_text(rss([("alpha", "u1", text_about("alpha")), ("beta", "u2", text_about("beta"))]))
    (source / "gdelt" / "a.json").write_text('{"articles":[{"url":"g1","title":"gamma delta epsilon zeta"},{"url":"u1","title":"omega"}]}')
    (source / "gdelt" / "b.json").write_text("<html>")
    assert run() == {"u1", "u2", "g1"}
    (source / "rss" / "f2.1.xml").write_text(rss([("beta", "u2", text_about("beta")), ("eta", "u3", text_about("eta"))]))
    assert run() == {"u1", "u2", "g1", "u3"}
    assert run() == {"u1", "u2", "g1", "u3"}
    tables = read_tables(spark, root)
    assert tables.articles.count() == tables.vectors.count() == 4
    log = {(r["batch"], r["source"]): (r["articles_fetched"], r["articles_stored"]) for r in tables.ingestion_log.collect()}
    assert log == {(0, "rss"): (2, 2), (0, "gdelt"): (2, 1), (1, "rss"): (2, 1)}

    now = datetime.now(timezone.utc)
    later = F.lit(str((now + timedelta(minutes=5)).replace(tzinfo=None))).cast("timestamp")
    links = tables.article_clusters
    assert news_by_region(tables.articles, later, "global", article_clusters=links).count() == 4
    assert news_by_region(tables.articles_with_cluster(), later, "global").count() == 4
    assert latest_headlines(tables.articles, tables.clusters, later, article_clusters=links).count() == 4
    assert trending_topics(tables.articles, tables.clusters, later, article_clusters=links).count() == 1
    asked = embed_text(spark.createDataFrame([("q", "alpha1 alpha")], "query_id string, topic string"), "topic")
    found = search_news(tables.articles, tables.vectors, asked, later, article_clusters=links).collect()
    assert found[0]["url"] == "u1"
    assert topic_briefing(tables.articles, tables.vectors, asked, later, hours=None).first()["article_count"] >= 1

    cluster_stored(spark, root, now, Settings(min_cluster_size=2))
    clustered = read_tables(spark, root)
    n = clustered.article_clusters.count()
    assert n == 0 or clustered.clusters.count() > 0
    assert expire_stored(spark, root, now) == []
    day = str(now.date())
    assert expire_stored(spark, root, now + timedelta(days=200)) in ([day], [str((now - timedelta(days=1)).date())])
    left = read_tables(spark, root)
    assert left.articles.isEmpty() and left.vectors.isEmpty() and left.clusters.isEmpty()
    assert not os.path.exists(f"{root}/articles/ingest_date={day}")


def test_stored_feed_list(spark, tmp_path):
    root = str(tmp_path / "store")
    init_tables(spark, root, feeds(spark))
    day = datetime(2024, 1, 1, tzinfo=timezone.utc)
    fetch = "feed_id string, fetched_at int, fetch_seq int, status int, etag_header string, last_modified_header string"
    save_validators_stored(spark, root, spark.createDataFrame([("f1", 1, 1, 200, "e1", None)], fetch))
    cfg = spark.createDataFrame([("f1", "Renamed", "https://1.org/"), ("f3", "Three", "https://3.org")], FEED)
    sync_feeds_stored(spark, root, cfg)
    got = {r["id"]: (r["name"], r["etag"], r["enabled"]) for r in read_tables(spark, root).feeds.collect()}
    assert got == {"f1": ("Renamed", "e1", True), "f2": ("Two", "", False), "f3": ("Three", "", True)}
    with pytest.raises(FeedConfigError):
        sync_feeds_stored(spark, root, cfg.limit(0))


def test_cluster_and_retention_jobs(spark):
    rng = np.random.default_rng(1)
    groups = {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1]}
    rows = [(f"{g}{i}", f"title {g}{i}", "s", "c", f"u{g}{i}", "f", "", "europe", "world", None, NOW, 0) for g in groups for i in range(4)]
    arts = spark.createDataFrame(
        rows,
        "id string, title string, summary string, content string, source_url string, source_feed string, author string, "
        "region string, category string, published_at string, ingested_at string, simhash bigint",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "ingested_at")})
    points = [(r[0], [float(x) for x in np.array(groups[r[0][0]]) + 0.02 * rng.normal(size=3)]) for r in rows]
    vectors = spark.createDataFrame(points, "article_id string, embedding array<float>").join(
        arts.select(F.col("id").alias("article_id"), "source_feed", "region", "published_at"), "article_id"
    )
    tables = NewsTables.empty(spark).with_(articles=arts, vectors=vectors)
    later = F.lit("2024-01-31 01:00:00").cast("timestamp")
    once = run_cluster_job(tables, later)
    assert sorted((r["label"], r["article_count"]) for r in once.clusters.collect()) == [(f"title {g}0", 4) for g in "abc"]
    assert once.article_clusters.count() == 12
    twice = run_cluster_job(once, later)
    assert sorted(twice.clusters.collect()) == sorted(once.clusters.collect())
    gone = run_retention_job(once, F.lit("2025-01-31 00:00:00").cast("timestamp"))
    assert gone.articles.isEmpty() and gone.clusters.isEmpty() and gone.article_clusters.isEmpty()

"""Results that must not depend on zones, clocks, batch sizes or the order of payloads."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_compact_date, parse_feed_date, utc_day
from newsloom.operators.dedup import dedup_simhash, dedup_url
from newsloom.operators.entities import gazetteer_mentions
from newsloom.operators.merge import without_known
from newsloom.operators.summarize import summarize_clusters
from newsloom.plans.ingest import Models, arrivals, ingest_batch
from newsloom.sources.feeds import with_defaults
from newsloom.sources.gdelt import read_gdelt_articles
from newsloom.sources.rss import parse_feed_payloads, read_feed_entries
from newsloom.streaming.ingest import expire_stored, process_payloads, reconcile_stored, sync_feeds_stored
from newsloom.tables import KEPT_VERSIONS, NewsTables, VersionMoved, init_tables, last_version, read_table, versions, write_part, write_version

NOW = 1706659200  # 2024-01-31 00:00:00 UTC
FEED = "id string, name string, url string"


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(request, spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def now():
    return F.timestamp_seconds(F.lit(NOW))


def feeds(spark):
    rows = [("f1", "One", "https://1.org/"), ("f2", "Two", "https://2.org/")]
    return with_defaults(spark.createDataFrame(rows, FEED)).withColumns({"etag": F.lit(""), "last_modified": F.lit("")})


def test_dates_in_any_session_zone(spark, zone):
    texts = {
        "Mon, 01 Jan 2024 00:00:00 GMT": 1704067200, "1 Jan 2024 01:00:00 +0100": 1704067200, "01 Jan 24 00:00": 1704067200,
        "2024-01-01": 1704067200, "2024-01-01T00:00:00": 1704067200, "2024-01-01 05:30:00+05:30": 1704067200,
        "2024-01-01T00:00:00Z": 1704067200, "20240101T000000": 1704067200, "nonsense": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", F.unix_seconds(parse_feed_date(F.col("t"))).alias("s")).collect()}
    assert got == texts
    compact = spark.createDataFrame([("20240101T000000Z",)], "t string").select(F.unix_seconds(parse_compact_date(F.col("t")))).first()[0]
    assert compact == 1704067200
    days = spark.range(1).select(utc_day(F.timestamp_seconds(F.lit(1704067199))).cast("string"), utc_day(now()).cast("string")).first()
    assert tuple(days) == ("2023-12-31", "2024-01-31")


def rss(title: str, url: str, text: str) -> str:
    return f"<rss><channel><item><title>{title}</title><link>{url}</link><description>{text}</description></item></channel></rss>"


@pytest.mark.parametrize("second", ["same words here", "other words altogether, nothing alike in them"])
def test_one_url_in_several_payloads_of_a_run(spark, second):
    payloads = [("f1", "1|f1.a.xml", rss("t", "https://u/1", "same words here")), ("f1", "2|f1.b.xml", rss("t", "https://u/1", second))]
    lists = [("p1", '{"articles":[{"url":"https://u/2","title":"some list title"}]}'), ("p2", '{"articles":[{"url":"https://u/2","title":"%s"}]}' % second)]
    entries = parse_feed_payloads(spark.createDataFrame(payloads, "feed_id string, payload string, body string"))
    records = read_gdelt_articles(spark.createDataFrame(lists, "payload_id string, body string"))
    tables = NewsTables.empty(spark).with_(feeds=feeds(spark))
    added = ingest_batch(arrivals(entries, records, tables.feeds, now()), tables, now())
    assert sorted(r.source_url for r in added.articles.collect()) == ["https://u/1", "https://u/2"]
    assert added.articles.where("source_url = 'https://u/1'").first().summary == "same words here"
    assert added.vectors.count() == 2


def test_rows_in_one_place_are_one(spark):
    rows = [("u", "i", 1, "x"), ("u", "i", 1, "y"), ("u", "i", 1, "x"), ("v", "j", 2, "z")]
    batch = spark.createDataFrame(rows, "source_url string, id string, ord int, text string")
    none = batch.limit(0)
    got = {tuple(sorted(map(tuple, dedup_url(batch.repartition(n), none).collect()))) for n in (1, 2, 4)}
    assert len(got) == 1 and len(got.pop()) == 2
    hashes = spark.createDataFrame([("i", 1, 5), ("i", 2**40 - 1, 6), ("j", 2**30 - 1, 7)], "id string, simhash long, ord int")
    assert sorted(r.id for r in dedup_simhash(hashes).collect()) == ["i", "j"]


@pytest.mark.parametrize("sent", [0, 100])
def test_known_keys(spark, sent):
    rows, known = spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), ("b",), ("c",)], "k string")
    assert {r.k for r in without_known(rows, known, "k", sent).collect()} == {"a", None}


def test_history_of_urls_is_not_shuffled(spark, tmp_path):
    spark.range(100_000).select(F.concat(F.lit("u"), "id").alias("k")).write.parquet(str(tmp_path / "known"))
    stored = spark.read.parquet(str(tmp_path / "known"))
    plan = without_known(spark.createDataFrame([("u1",), ("x",)], "k string"), stored, "k")._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, line in enumerate(plan.splitlines()) if "parquet" in line)
    above = [line for line in plan.splitlines()[:scan] if "Exchange" in line and "Broadcast" not in line]
    # only the few hits are grouped
    assert all("HashAggregate" in plan.splitlines()[plan.splitlines().index(line) + 1] for line in above)


def test_entities_have_one_rule_at_every_size(spark, monkeypatch):
    from newsloom.operators import entities

    texts = spark.createDataFrame([("1", "Alpha beta alpha ALPHA")], "article_id string, text string")
    terms = spark.createDataFrame([("alpha", "person")], "term string, label string")
    few = gazetteer_mentions(texts, terms).collect()
    monkeypatch.setattr(entities, "MAX_SENT_TERMS", 0)
    assert few == gazetteer_mentions(texts, terms).collect() and len(few) == 1


def test_a_failing_text_fails_alone(spark):
    def model(batch: pd.Series) -> pd.Series:
        if batch.str.contains("bad").any():
            raise ValueError
        return batch.str.upper()

    rows = [("a", "good one"), ("b", "bad"), ("c", "good two")]
    members = spark.createDataFrame(rows, "cluster_id string, title string").withColumns({"id": F.col("cluster_id"), "published_at": now()}).coalesce(1)
    got = {r.cluster_id: r.summary for r in summarize_clusters(members, model).collect()}
    assert got == {"a": "GOOD ONE", "b": "", "c": "GOOD TWO"}


def test_feed_files(spark, tmp_path):
    (tmp_path / "f1.2024-01-01.xml").write_text(rss("a", "u1", "x"))
    (tmp_path / "f2.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>b</title><link href="u2"/></entry></feed>')
    (tmp_path / "f3.x.y.xml").write_text("not xml")
    (tmp_path / "f4.xml").write_text("<rdf:RDF><channel/><item><title>c</title><link>u3</link></item><item><title>d</title><link>u4</link></item></rdf:RDF>")
    got = sorted((r.feed_id, r.item_seq, r.title, r.link) for r in read_feed_entries(spark, str(tmp_path)).collect())
    assert got == [("f1", 0, "a", "u1"), ("f2", 0, "b", "u2"), ("f4", 0, "c", "u3"), ("f4", 1, "d", "u4")]


def test_versions_are_numbered(spark, tmp_path):
    root = str(tmp_path / "store")
    init_tables(spark, root, feeds(spark))
    config = lambda name: spark.createDataFrame([("f1", name, "https://1.org/")], FEED)
    sync_feeds_stored(spark, root, config("Late"))
    sync_feeds_stored(spark, root, config("Early"))
    assert read_table(spark, root, "feeds").where("id = 'f1'").first().name == "Early"
    for n in range(4):
        sync_feeds_stored(spark, root, config(f"N{n}"))
    assert len(versions(spark, root, "feeds")) == KEPT_VERSIONS
    with pytest.raises(VersionMoved):
        write_version(read_table(spark, root, "feeds"), root, "feeds", last_version(spark, root, "feeds") - 1)


def stored(spark, root, articles: int, vectors: int, day: str) -> None:
    keys = {"ingest_date": F.lit(day).cast("date"), "batch": F.lit(0)}
    ids = spark.range(max(articles, vectors)).select(F.col("id").cast("string").alias("id"))
    empty = NewsTables.empty(spark)
    fill = lambda name, df: write_part(df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in getattr(empty, name).schema.fields]), root, name, **keys)
    if articles:
        fill("articles", ids.limit(articles))
    if vectors:
        fill("vectors", ids.limit(vectors).withColumnRenamed("id", "article_id"))


def test_every_run_leaves_its_row(spark, tmp_path):
    root = str(tmp_path / "store")
    init_tables(spark, root, feeds(spark))
    rows = [("rss", "f1.xml", rss("t", "u1", "words of the text")), ("gdelt", "a.json", "<html>")]
    payloads = spark.createDataFrame(rows, "source string, file_name string, body string").withColumn("landed_at", now())

    def broken(batch):
        raise ValueError("no model today")

    with pytest.raises(Exception):
        process_payloads(payloads, 0, root, Models(embed=broken))
    failed = read_table(spark, root, "ingestion_log").collect()
    assert sorted(r.source for r in failed) == ["gdelt", "rss"] and all("no model today" in r.error for r in failed)
    assert read_table(spark, root, "articles").isEmpty()
    process_payloads(payloads, 0, root)
    log = {r.source: (r.articles_fetched, r.articles_stored, r.error) for r in read_table(spark, root, "ingestion_log").collect()}
    assert log == {"rss": (1, 1, None), "gdelt": (0, 0, None)}


def test_audit_is_applied_to_the_store(spark, tmp_path):
    for n, (articles, vectors, action) in enumerate([(0, 3, "reset_vectors"), (3, 0, "clear_articles"), (2, 2, "none")]):
        root = str(tmp_path / f"store{n}")
        init_tables(spark, root, feeds(spark))
        stored(spark, root, articles, vectors, "2024-01-01")
        assert reconcile_stored(spark, root) == action
        left = (read_table(spark, root, "articles").count(), read_table(spark, root, "vectors").count())
        assert left == ((2, 2) if action == "none" else (0, 0))


def test_retention_finds_days_of_a_run_cut_short(spark, tmp_path):
    root = str(tmp_path / "store")
    init_tables(spark, root, feeds(spark))
    stored(spark, root, 0, 2, "2024-01-01")
    assert expire_stored(spark, root, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=400)) == ["2024-01-01"]
    assert read_table(spark, root, "vectors").isEmpty()

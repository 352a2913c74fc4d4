"""Merges, retention, audit and reads on small inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import merge, reads
from newsloom.operators.retention import apply_retention, audit_stores, reconcile_stores
from newsloom.plans.headlines import latest_headlines
from newsloom.plans.trending import trending_topics
from newsloom.tables import ARTICLES, CLUSTERS, NewsTables

NOW = datetime(2024, 1, 31)


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")

FEEDS = (
    "id string, name string, url string, region string, category string, etag string, last_modified string, enabled boolean"
)


def feed(i, url=None, etag="e", enabled=True, name="n"):
    return (i, name, url or f"https://{i}/", "global", "general", etag, "lm", enabled)


def config(spark, rows):
    return spark.createDataFrame(
        [(i, "cfg", url, "europe", "world", on) for i, url, on in rows],
        "id string, name string, url string, region string, category string, enabled boolean",
    )


def article(i, hours=1.0, published=1.0, **more):
    row = {
        "id": i, "title": f"t{i}", "summary": "s", "content": "c", "source_url": f"https://x/{i}", "source_feed": "f",
        "author": "", "region": "europe", "category": "world",
        "published_at": None if published is None else NOW - timedelta(hours=published),
        "ingested_at": NOW - timedelta(hours=hours), "simhash": 0,
    }
    return tuple((row | more)[f.name] for f in ARTICLES)


def cluster(i, n, hours=1.0):
    return (i, f"label {i}", "", n, NOW, NOW - timedelta(hours=hours))


def test_feed_merge(spark):
    stored = spark.createDataFrame(
        [feed("same"), feed("moved"), feed("gone"), feed("hex1", "https://adopt/"), feed("both", "https://both/")], FEEDS
    )
    cfg = config(
        spark,
        [("same", "https://same/", True), ("moved", "https://new/", True), ("adopt", "https://adopt/", True),
         ("new", "https://n/", False), ("both", "https://both/", True)],
    )
    once = merge.merge_feeds(stored, cfg)
    got = {r["id"]: (r["name"], r["url"], r["etag"], r["enabled"]) for r in once.collect()}
    assert got == {
        "same": ("cfg", "https://same/", "e", True), "moved": ("cfg", "https://new/", "", True),
        "gone": ("n", "https://gone/", "e", False), "adopt": ("cfg", "https://adopt/", "e", True),
        "new": ("cfg", "https://n/", "", False), "both": ("cfg", "https://both/", "e", True),
    }
    again = merge.merge_feeds(once, cfg)
    assert sorted(again.collect()) == sorted(once.collect())


def test_adoption_leaves_configured_ids_alone(spark):
    stored = spark.createDataFrame([feed("a", "https://shared/"), feed("b")], FEEDS)
    cfg = config(spark, [("a", "https://other/", True), ("c", "https://shared/", True)])
    got = {r["id"]: (r["url"], r["etag"], r["enabled"]) for r in merge.merge_feeds(stored, cfg).collect()}
    assert got == {"a": ("https://other/", "", True), "c": ("https://shared/", "", True), "b": ("https://b/", "e", False)}


def test_articles_are_unique_by_url(spark):
    old = spark.createDataFrame([article("1")], ARTICLES)
    new = spark.createDataFrame(
        [article("2", source_url="https://x/1"), article("3"), article("4", source_url="https://x/3")], ARTICLES
    )
    grown = merge.append_articles(old, new, ["id"])
    assert sorted(r["id"] for r in grown.collect()) == ["1", "3"]
    assert merge.append_articles(grown, new, ["id"]).count() == 2


def test_simhash_keeps_all_64_bits(spark, tmp_path):
    df = spark.createDataFrame([article("1", simhash=-(2**63)), article("2", simhash=-1)], ARTICLES)
    df.write.parquet(str(tmp_path / "a"))
    back = {r["id"]: r["simhash"] for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert back == {"1": -(2**63), "2": -1}


def test_cluster_upsert_keeps_creation(spark):
    old = spark.createDataFrame([("c", "old", "s", 2, NOW - timedelta(days=9), NOW - timedelta(days=9))], CLUSTERS)
    new = spark.createDataFrame([("c", "new", "", 5), ("d", "x", "", 1)], "id string, label string, summary string, article_count bigint")
    got = {r["id"]: r for r in merge.upsert_clusters(old, new, as_of()).collect()}
    assert (got["c"]["label"], got["c"]["article_count"], got["c"]["created_at"]) == ("new", 5, NOW - timedelta(days=9))
    assert got["c"]["updated_at"] == got["d"]["created_at"] == NOW


def tables(spark, articles, clusters=(), assigned=()):
    base = NewsTables.empty(spark)
    arts = spark.createDataFrame(list(articles), ARTICLES)
    return base.with_(
        articles=arts,
        entities=arts.select(F.col("id").alias("id"), F.col("id").alias("article_id"), F.lit("x").alias("text"), F.lit("person").alias("label")),
        vectors=arts.select(F.col("id").alias("article_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), "source_feed", "region", "published_at"),
        clusters=spark.createDataFrame(list(clusters), CLUSTERS),
        article_clusters=spark.createDataFrame(list(assigned), "article_id string, cluster_id string"),
    )


def test_retention(spark):
    day = 24
    before = tables(
        spark,
        [article("old", 200 * day), article("new", 1), article("edge", 179 * day)],
        [cluster("emptied", 1), cluster("partly", 2), cluster("never", 0)],
        [("old", "emptied"), ("old2", "partly"), ("new", "partly")],
    )
    after, deleted = apply_retention(before, as_of(), 180)
    assert [r["id"] for r in deleted.collect()] == ["old"]
    for name in ("articles", "entities", "vectors"):
        assert getattr(after, name).count() == 2
    assert [r["id"] for r in after.clusters.collect()] == ["partly"]
    quiet, none = apply_retention(before.with_(articles=before.articles.where("id = 'new'")), as_of(), 180)
    assert none.count() == 0 and quiet.clusters.count() == 3


def test_audit(spark):
    full = tables(spark, [article("1"), article("2")], [cluster("c", 1)], [("1", "c")])
    nothing = NewsTables.empty(spark)
    assert tuple(audit_stores(full.articles, full.vectors).first()) == (2, 0, 0, "none")
    assert audit_stores(full.articles, nothing.vectors).first()["action"] == "clear_articles"
    assert audit_stores(nothing.articles, full.vectors).first()["action"] == "reset_vectors"
    assert audit_stores(nothing.articles, nothing.vectors).first()["action"] == "none"
    cleared = reconcile_stores(full.with_(vectors=nothing.vectors))
    assert cleared.articles.isEmpty() and cleared.clusters.isEmpty() and cleared.entities.isEmpty()
    reset = reconcile_stores(nothing.with_(vectors=full.vectors))
    assert reset.vectors.isEmpty()


def test_recent_articles(spark):
    df = spark.createDataFrame(
        [article("a", 1, 5), article("b", 23, 1), article("c", 25, 1), article("d", 1, None), article("e", 1, 5, region="asia")],
        ARTICLES,
    )
    assert [r["id"] for r in reads.recent_articles(df, as_of()).collect()] == ["b", "a", "e", "d"]
    assert [r["id"] for r in reads.recent_articles(df, as_of(), limit=1).collect()] == ["b"]
    assert [r["id"] for r in reads.articles_by_region(df, as_of(), "asia").collect()] == ["e"]
    by_day = reads.recent_articles(df, F.lit("2024-01-31 01:00:00").cast("timestamp"), 24, day_granular=True)
    assert "c" not in [r["id"] for r in by_day.collect()] and by_day.count() == 4


def test_unclustered_and_top(spark):
    t = tables(spark, [article("a"), article("b"), article("c", 30)], [cluster("x", 3), cluster("y", 5), cluster("z", 9, 30)], [("a", "x")])
    assert [r["id"] for r in reads.unclustered_ids(t.articles, t.article_clusters, as_of()).collect()] == ["b"]
    assert [r["id"] for r in reads.top_clusters(t.clusters, as_of()).collect()] == ["y", "x"]
    assert reads.articles_by_ids(t.articles, t.articles.limit(0)).count() == 0


def test_headlines_limit_comes_before_category(spark):
    arts = [article(f"a{i}", published=i, category="sport") for i in range(7)] + [article("w", category="world")]
    assigned = [(f"a{i}", "big") for i in range(7)] + [("w", "small")]
    t = tables(spark, arts, [cluster("big", 7), cluster("small", 1)], assigned)
    with_cluster = t.articles_with_cluster()
    top = latest_headlines(with_cluster, t.clusters, as_of()).collect()
    assert [r["cluster_id"] for r in top] == ["big", "small"]
    assert [a["title"] for a in top[0]["articles"]] == [f"ta{i}" for i in range(5)]
    fallback = latest_headlines(with_cluster, t.clusters, as_of(), limit=1, category="world").collect()
    assert [(r["cluster_id"], r["headline"], r["article_count"]) for r in fallback] == [(None, "tw", 1)]
    both = latest_headlines(t.articles, t.clusters, as_of(), category="world", article_clusters=t.article_clusters).collect()
    assert [r["cluster_id"] for r in both] == ["small"]


def test_trending_falls_back_to_categories(spark):
    arts = [article(f"a{i}", published=i, category="" if i % 2 else "sport", region="" if i == 0 else "asia") for i in range(5)]
    t = tables(spark, arts)
    got = trending_topics(t.articles_with_cluster(), t.clusters, as_of()).collect()
    assert [(r["topic"], r["summary"], r["article_count"], r["regions"]) for r in got] == [
        ("sport news", "ta0", 3, ["asia"]), ("general news", "ta1", 2, ["asia"]),
    ]
    t = tables(spark, arts, [cluster("c", 5)], [(f"a{i}", "c") for i in range(5)])
    got = trending_topics(t.articles_with_cluster(), t.clusters, as_of()).collect()
    assert [(r["cluster_id"], r["sources"], r["regions"]) for r in got] == [("c", ["f"], ["asia"])]

"""The clustering job and the lookups on a store of several days."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.config import Settings
from newsloom.operators import reads, stored_cells
from newsloom.operators.vector_search import dedup_vectors
from newsloom.plans.briefing import topic_briefing
from newsloom.plans.headlines import latest_headlines
from newsloom.plans.search import found_articles, search_news
from newsloom.plans.trending import trending_topics
from newsloom.session import cut_lineage, passing_tables, require_checkpoint_dir
from newsloom.streaming import compact, ingest
from newsloom.tables import ARTICLES, FEEDS, VECTORS, VersionMoved, init_tables, last_version, read_table, read_tables, write_part, write_version

NOW = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)
SMALL = Settings(min_cluster_size=2)


def at(moment: datetime):
    return F.timestamp_seconds(F.lit(int(moment.timestamp())))


def store(spark, root: str) -> None:
    init_tables(spark, root, spark.createDataFrame([], FEEDS))


def add(spark, root: str, batch: int, groups: dict, moment: datetime) -> None:
    """Four articles around each of the given directions, stored at ``moment``."""
    rows, vectors = [], []
    for name, direction in groups.items():
        for i in range(4):
            key = f"{name}{i}"
            rows.append((key, f"title {key}", "s", "c", f"u{key}", "f", "", "europe", "world", None, None, 0))
            vectors.append((key, [float(x) + 0.01 * (i + j) for j, x in enumerate(direction)], "f", "europe", None))
    articles = spark.createDataFrame(rows, ARTICLES).withColumns({"published_at": at(moment), "ingested_at": at(moment)})
    keys = {"ingest_date": F.lit(str(moment.date())).cast("date"), "batch": F.lit(batch)}
    write_part(articles, root, "articles", **keys)
    write_part(spark.createDataFrame(vectors, VECTORS).withColumn("published_at", at(moment)), root, "vectors", **keys)


def assigned(spark, root: str) -> dict:
    return {r.article_id: r.cluster_id for r in read_table(spark, root, "article_clusters").collect()}


def counts(spark, root: str) -> dict:
    """Articles of each listed cluster."""
    links = read_table(spark, root, "article_clusters")
    return {r.id: r.n for r in read_table(spark, root, "clusters").join(links, F.col("id") == F.col("cluster_id"), "left").groupBy("id").agg(F.count("article_id").alias("n")).collect()}


def test_a_second_run_at_the_same_time_keeps_the_first_ones_assignments(spark, tmp_path):
    root = str(tmp_path)
    store(spark, root)
    add(spark, root, 0, {"a": (1, 0, 0), "b": (0, 1, 0)}, NOW - timedelta(hours=1))
    ingest.cluster_stored(spark, root, NOW, SMALL)
    first = assigned(spark, root)
    assert len(first) == 8
    add(spark, root, 1, {"c": (0, 0, 1), "d": (-1, 0, 0)}, NOW - timedelta(hours=1))
    ingest.cluster_stored(spark, root, NOW, SMALL)
    both = assigned(spark, root)
    assert len(both) == 16 and first.items() <= both.items()
    assert counts(spark, root) == {c: 4 for c in set(both.values())} and len(set(both.values())) == 4
    ingest.cluster_stored(spark, root, NOW, SMALL)
    assert assigned(spark, root) == both


def test_a_run_cut_short_leaves_no_empty_cluster(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store(spark, root)
    add(spark, root, 0, {"a": (1, 0, 0), "b": (0, 1, 0)}, NOW - timedelta(hours=1))

    def broken(*args, **keys):
        raise OSError("gone")

    monkeypatch.setattr(ingest, "write_part", broken)
    with pytest.raises(OSError, match="gone"):
        ingest.cluster_stored(spark, root, NOW, SMALL)
    monkeypatch.undo()
    assert not assigned(spark, root) and last_version(spark, root, "clusters") == 0
    # meanwhile more arrives, so that the next run may draw other clusters
    add(spark, root, 1, {"Z": (1, 0, 0.02)}, NOW - timedelta(hours=1))
    ingest.cluster_stored(spark, root, NOW, SMALL)
    found = assigned(spark, root)
    assert found and all(n > 0 for n in counts(spark, root).values())
    assert set(counts(spark, root)) == set(found.values())


def test_of_two_runs_at_once_one_is_stored(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store(spark, root)
    add(spark, root, 0, {"a": (1, 0, 0), "b": (0, 1, 0)}, NOW - timedelta(hours=1))
    plain = ingest.write_version

    def late(df, root, name, seen):
        """The other job writes its version after this one has looked, before it writes."""
        monkeypatch.setattr(ingest, "write_version", plain)
        ingest.cluster_stored(spark, root, NOW, SMALL)
        monkeypatch.setattr("newsloom.tables.last_version", lambda *_: seen)
        plain(df, root, name, seen)

    monkeypatch.setattr(ingest, "write_version", late)
    with pytest.raises(VersionMoved):
        ingest.cluster_stored(spark, root, NOW, SMALL)
    monkeypatch.undo()
    assert len(assigned(spark, root)) == 8 and all(n == 4 for n in counts(spark, root).values())
    assert last_version(spark, root, "clusters") == 0


def test_a_version_is_written_whole(spark, tmp_path):
    root = str(tmp_path)
    store(spark, root)
    seen = last_version(spark, root, "feeds")
    write_version(read_table(spark, root, "feeds"), root, "feeds", seen)
    with pytest.raises(VersionMoved):
        write_version(read_table(spark, root, "feeds"), root, "feeds", seen)
    assert last_version(spark, root, "feeds") == seen + 1
    assert not [p.name for p in (tmp_path / "feeds").iterdir() if p.name.startswith("_aside")]


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """A store of thirty days, two groups of articles on each, the last two days clustered."""
    root = str(tmp_path_factory.mktemp("days"))
    store(spark, root)
    for n in range(30):
        add(spark, root, n, {f"a{n}x": (1, n / 50, 0), f"b{n}x": (0, 1, n / 50)}, NOW - timedelta(days=n, hours=1))
    ingest.cluster_stored(spark, root, NOW, SMALL)
    return root


def scanned(df) -> dict:
    """The day filters of each table's scans in the printed plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found: dict = {}
    for scan in re.findall(r"Location: \w+ \[([^\]]*)\](.*?)(?=\n\n|\Z)", text, re.S):
        name = next((t for t in ("article_clusters", "articles", "vectors", "clusters", "entities") if f"/{t}" in scan[0]), None)
        if name in ("articles", "vectors", "article_clusters", "entities"):
            found.setdefault(name, []).append("ingest_date" in (re.findall(r"PartitionFilters: (.*)", scan[1]) or [""])[0])
    return found


def test_lookups_read_their_days_alone(spark, days):
    t = read_tables(spark, days)
    now = at(NOW)
    asked = spark.createDataFrame([("q", "topic", [1.0, 0.1, 0.0])], "query_id string, topic string, embedding array<float>")
    top = reads.top_clusters(t.clusters, now)
    members = reads.cluster_articles(t.articles, top, t.article_clusters)
    assert members.count() == 8
    plans = {
        "unclustered": reads.unclustered_ids(t.articles, t.article_clusters, now),
        "vectors": reads.in_window_days(t.vectors, now, 24),
        "members": members,
        "hits": found_articles(t.articles, t.vectors, asked, now, 5, 0.0),
        "assignments": reads.with_cluster(reads.within(t.articles, now, 24), t.article_clusters),
        "search": search_news(t.articles, t.vectors, asked, now, 5, article_clusters=t.article_clusters),
    }
    for name, df in plans.items():
        filters = scanned(df)
        for table, pruned in filters.items():
            assert all(pruned), (name, table)
        assert name == "vectors" or "articles" in filters, name


def test_pruned_answers_equal_unpruned_ones(spark, days):
    t = read_tables(spark, days)
    flat = {name: getattr(t, name).drop("ingest_date", "batch") for name in ("articles", "vectors", "article_clusters")}
    now = at(NOW)
    asked = spark.createDataFrame([("q", "topic", [1.0, 0.1, 0.0])], "query_id string, topic string, embedding array<float>")
    for fn in (latest_headlines, trending_topics):
        got = fn(t.articles, t.clusters, now, article_clusters=t.article_clusters).collect()
        assert got and got == fn(flat["articles"], t.clusters, now, article_clusters=flat["article_clusters"]).collect()
    got = search_news(t.articles, t.vectors, asked, now, 9, article_clusters=t.article_clusters).collect()
    assert len(got) == 9 and got == search_news(flat["articles"], flat["vectors"], asked, now, 9, article_clusters=flat["article_clusters"]).collect()
    got = topic_briefing(t.articles, t.vectors, asked, now, hours=None, entities=t.entities).collect()
    assert got == topic_briefing(flat["articles"], flat["vectors"], asked, now, hours=None, entities=t.entities.drop("ingest_date", "batch")).collect()


def test_fetch_outcomes_reach_the_log_and_the_validators(spark, tmp_path):
    import json

    landing, root, progress = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "progress")
    for name in ("rss", "gdelt", "fetches"):
        (landing / name).mkdir(parents=True)
    feeds = spark.createDataFrame([(f"f{i}", f"n{i}", f"https://{i}.org/", "global", "general", "old", "", True) for i in range(9)], FEEDS)
    init_tables(spark, root, feeds)
    outcome = lambda feed, status, seq, **more: json.dumps({"feed_id": feed, "fetched_at": "2024-01-31T10:00:00Z", "fetch_seq": seq, "status": status, **more})
    lines = [
        outcome("f0", 500, 0), outcome("f0", 200, 1, etag_header="new"), outcome("f1", 304, 0, etag_header="not taken"),
        outcome("f2", None, 0, error="timed out"), *[outcome(f"f{i}", 503, 0) for i in range(3, 9)], "not json", "",
    ]
    (landing / "fetches" / "a.json").write_text("\n".join(lines))

    def run():
        query = ingest.stream_ingest(spark, str(landing), root, progress, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    log = [(r.source, r.articles_fetched, r.articles_stored, r.error) for r in read_table(spark, root, "ingestion_log").collect()]
    said = "7 of 9 feeds failed: f2: timed out; f3: status 503; f4: status 503; f5: status 503; f6: status 503; and 2 more"
    assert log == [("rss", 0, 0, said)]
    assert {r.id: r.etag for r in read_table(spark, root, "feeds").collect()} == {"f0": "new"} | {f"f{i}": "old" for i in range(1, 9)}
    version = last_version(spark, root, "feeds")
    ingest.keep_validators(spark, root, spark.createDataFrame([("f0", NOW, 2, 200, "new", None)], "feed_id string, fetched_at timestamp, fetch_seq long, status int, etag_header string, last_modified_header string"))
    assert last_version(spark, root, "feeds") == version
    (landing / "fetches" / "b.json").write_text(outcome("f0", 304, 3))
    run()
    assert sorted((r.batch, r.error) for r in read_table(spark, root, "ingestion_log").collect()) == [(0, said), (1, None)]


def test_a_feed_list_that_moves_is_read_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    init_tables(spark, root, spark.createDataFrame([("f0", "n", "u", "", "", "old", "", True)], FEEDS))
    fetch = spark.createDataFrame([("f0", NOW, 2, 200, "new", None)], "feed_id string, fetched_at timestamp, fetch_seq long, status int, etag_header string, last_modified_header string")
    plain, calls = ingest.write_version, []

    def late(df, root, name, seen):
        calls.append(seen)
        if len(calls) == 1:
            plain(read_table(spark, root, name).withColumn("name", F.lit("renamed")), root, name, seen)
        plain(df, root, name, seen)

    monkeypatch.setattr(ingest, "write_version", late)
    ingest.keep_validators(spark, root, fetch)
    assert calls == [0, 1]
    assert [(r.name, r.etag) for r in read_table(spark, root, "feeds").collect()] == [("renamed", "new")]


def contents(spark, root: str) -> dict:
    t = read_tables(spark, root)
    return {name: sorted((tuple(r) for r in getattr(t, name).drop("batch", "cell").collect()), key=repr) for name in ("articles", "vectors", "article_clusters", "entities")}


def test_closed_days_in_one_piece(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store(spark, root)
    for n in range(12):
        add(spark, root, n, {f"a{n}x": (1, n, 0), f"b{n}x": (0, 1, n / 3)}, NOW - timedelta(days=n // 2, hours=1))
    ingest.cluster_stored(spark, root, NOW - timedelta(days=5), SMALL)
    before = contents(spark, root)
    removed = []
    monkeypatch.setattr(compact, "_remove", lambda spark, path: removed.append(path))
    done = compact.compact_stored(spark, root, NOW, cell_vectors=3)
    assert done == ["2024-01-26", "2024-01-27"] and removed
    assert contents(spark, root) == before  # the runs are still there and do not count
    monkeypatch.undo()
    assert compact.compact_stored(spark, root, NOW, cell_vectors=3) == []
    assert contents(spark, root) == before
    left = {p.name for p in (tmp_path / "vectors" / "ingest_date=2024-01-27").iterdir()}
    assert left == {"batch=-1"}
    # a later closed day reaches further out of the same cells
    first = stored_cells.stored_cells(spark, root)
    assert len(first.pivots) > 1
    assert compact.compact_stored(spark, root, NOW + timedelta(days=2), cell_vectors=3) == ["2024-01-28", "2024-01-29"]
    second = stored_cells.stored_cells(spark, root)
    assert np.allclose(first.pivots, second.pivots) and (second.reach >= first.reach - 1e-12).all()
    assert contents(spark, root) == before
    assert "2024-01-26" in ingest.expire_stored(spark, root, NOW + timedelta(days=178))
    assert read_tables(spark, root).articles.count() == len(before["articles"]) - 48


def test_search_lists_only_the_cells_it_visits(spark, tmp_path):
    root = str(tmp_path)
    store(spark, root)
    rng = np.random.default_rng(1)
    for n in range(6):
        add(spark, root, n, {f"{i}x{n}y": rng.normal(size=6).tolist() for i in range(20)}, NOW - timedelta(days=n, hours=1))
    compact.compact_stored(spark, root, NOW, cell_vectors=8)
    cells = stored_cells.stored_cells(spark, root)
    vectors = read_tables(spark, root).vectors
    # scaled copies of two stored vectors, and far ones
    some = vectors.orderBy("article_id").limit(2).select("article_id", F.transform("embedding", lambda x: x * 3).alias("embedding"))
    asked = some.unionByName(spark.createDataFrame([("far", [float(x) for x in -np.ones(6)])], some.schema))
    near = cells.visited(vectors, asked, 0.95)
    plan = near._jdf.queryExecution().toString()
    listed = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (?:IN|INSET) \(?([-\d, ]+)", plan)
    assert listed and "-1" in listed[1]
    n = len(listed[1].split(","))
    assert n - 1 < len(cells.pivots) / 2
    assert near.count() < vectors.count()
    assert sorted(dedup_vectors(asked, near).select("article_id").collect()) == sorted(dedup_vectors(asked, vectors).select("article_id").collect())
    for t in (0.5, 0.9, 0.95, 0.999):
        probes = spark.createDataFrame([(str(i), [float(x) for x in rng.normal(size=6)]) for i in range(40)], some.schema)
        exact = sorted(r.article_id for r in dedup_vectors(probes, vectors, t).collect())
        assert sorted(r.article_id for r in dedup_vectors(probes, cells.visited(vectors, probes, t), t).collect()) == exact


def test_jobs_leave_no_tables_behind(spark, tmp_path):
    from pathlib import Path

    root, folder = str(tmp_path), Path(require_checkpoint_dir(spark).removeprefix("file:"))
    store(spark, root)
    before = set(folder.iterdir())
    add(spark, root, 0, {"a": (1, 0, 0), "b": (0, 1, 0)}, NOW - timedelta(days=9))
    ingest.cluster_stored(spark, root, NOW - timedelta(days=9) + timedelta(hours=1), SMALL)
    assert len(assigned(spark, root)) == 8
    compact.compact_stored(spark, root, NOW)
    assert set(folder.iterdir()) == before
    with pytest.raises(ZeroDivisionError):
        with passing_tables(spark):
            cut_lineage(spark.range(3))
            assert set(folder.iterdir()) != before
            1 / 0
    assert set(folder.iterdir()) == before
    assert cut_lineage(spark.range(3)).count() == 3

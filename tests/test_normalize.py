"""Text, dates, sources and normalization on small inputs."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_compact_date, parse_feed_date, since
from newsloom.functions.regions import country_region
from newsloom.functions.text import clean_html, iso_or_empty, strip_text, text_hash
from newsloom.operators.normalize import normalize_gdelt, normalize_rss
from newsloom.sources.feeds import FeedConfigError, load_feeds, normalize_url, select_feeds, validate_feeds
from newsloom.sources.gdelt import read_gdelt_articles, select_recent_gdelt
from newsloom.sources.rss import parse_feed_payloads, read_feed_entries, resolve_fetches

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def column(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_html(spark):
    got = column(
        spark, clean_html, ["<p>Hello <b>world</b></p>", " a  b \x1c c\x85", "x &amp; y", "<b> </b>", "1 < 2"]
    )
    assert got == ["Hello world", "a b c", "x &amp; y", "", "1 < 2"]
    assert column(spark, strip_text, ["  a b\t"]) == ["a b"]


def test_text_hash(spark):
    assert column(spark, text_hash, ["abc"])[0].startswith("ba7816bf")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mon, 01 Jan 2024 10:20:30 GMT", datetime(2024, 1, 1, 10, 20, 30)),
        ("1 Jan 2024 10:20:30 -0530", datetime(2024, 1, 1, 15, 50, 30)),
        ("Mon, 1 jan 2024 10:20 EST", datetime(2024, 1, 1, 15, 20)),
        ("01 January 24 10:20:30 PDT", datetime(2024, 1, 1, 17, 20, 30)),
        ("Fri, 05 Mar 1999 00:00:00", datetime(1999, 3, 5)),
        ("Fri, 05 Mar 99 00:00:00 XYZ", datetime(1999, 3, 5)),
        ("2024-01-15T00:00:00+02:00", datetime(2024, 1, 14, 22)),
        ("2024-01-15T10:20:30Z", datetime(2024, 1, 15, 10, 20, 30)),
        ("2024-01-15", datetime(2024, 1, 15)),
        ("20240115T102030", datetime(2024, 1, 15, 10, 20, 30)),
        ("2024", None),
        ("not a date", None),
        ("32 Jan 2024 10:00:00 GMT", None),
        ("", None),
        (None, None),
    ],
)
def test_feed_dates(spark, text, expected):
    got = column(spark, lambda c: parse_feed_date(c).cast("timestamp_ntz"), [text])
    assert got == [expected]


def test_compact_dates(spark):
    got = column(
        spark,
        lambda c: parse_compact_date(c).cast("timestamp_ntz"),
        ["20240115T102030Z", "20240115T102030", "20240115", "20241315T000000Z", None],
    )
    day = datetime(2024, 1, 15, 10, 20, 30)
    assert got == [day, day, None, None, None]


def test_windows(spark):
    row = spark.range(1).select(
        since(as_of(), 30).cast("timestamp_ntz").alias("exact"),
        since(as_of(), 30, day_granular=True).cast("timestamp_ntz").alias("day"),
        iso_or_empty(as_of()).alias("iso"),
        iso_or_empty(F.lit(None).cast("timestamp")).alias("none"),
    ).first()
    assert tuple(row) == (datetime(2024, 1, 29, 18), datetime(2024, 1, 29), "2024-01-31T00:00:00+00:00", "")


def test_regions(spark):
    assert column(spark, country_region, ["France", "egypt", "Narnia", "", None]) == [
        "europe", "middle_east", "global", "global", "global",
    ]


FEED = "id string, name string, region string, category string"
ENTRY = (
    "feed_id string, item_seq bigint, link string, title string, summary string, description string, "
    "content array<struct<value:string>>, published string, updated string, author string"
)


def test_rss_entries_become_articles(spark):
    feeds = spark.createDataFrame([("f", "Feed", "europe", "world")], FEED)
    entries = spark.createDataFrame(
        [
            ("f", 0, " https://x/1 ", "<b>T</b>", "<p>S</p>", "D", [("<i>C</i>",)], "Mon, 01 Jan 2024 00:00:00 GMT", None, "A"),
            ("f", 1, "https://x/2", "T2", "", "D2", None, None, "2024-01-02", None),
            ("f", 2, "  ", "no link", "", "", None, None, None, None),
            ("f", 3, "https://x/3", "<b> </b>", "", "", None, None, None, None),
            ("f", 4, None, "null link", "", "", None, None, None, None),
        ],
        ENTRY,
    )
    got = {r["item_seq"]: r for r in normalize_rss(entries, feeds, as_of()).collect()}
    assert set(got) == {0, 1}
    assert (got[0]["title"], got[0]["summary"], got[0]["content"], got[0]["author"]) == ("T", "S", "C", "A")
    assert (got[0]["source_url"], got[0]["source_feed"], got[0]["region"]) == ("https://x/1", "Feed", "europe")
    assert (got[1]["summary"], got[1]["content"], got[1]["author"]) == ("D2", "D2", "")
    assert got[1]["published_at"] == datetime(2024, 1, 2)


def test_gdelt_payloads(spark):
    good = (
        '{"articles":[{"url":" https://g/1 ","title":" One <b> ","seendate":"20240130T235900Z","sourcecountry":"Japan",'
        '"language":"English","domain":"g"},{"url":"https://g/2","title":"Two","language":"French"},'
        '{"url":"","title":"x"},{"title":"no url"}]}'
    )
    raw = spark.createDataFrame(
        [(1, good, 200), (2, "", 200), (3, "<html>", 200), (4, "{}", 200), (5, good, 500)],
        "payload_id int, body string, status int",
    )
    records = read_gdelt_articles(raw)
    assert records.count() == 4
    articles = {r["source_url"]: r for r in normalize_gdelt(records, as_of()).collect()}
    assert set(articles) == {"https://g/1", "https://g/2"}
    one = articles["https://g/1"]
    assert (one["title"], one["summary"], one["content"]) == ("One <b>",) * 3
    assert (one["author"], one["region"], one["category"], one["source_feed"]) == ("g", "asia", "general", "gdelt")
    assert (articles["https://g/2"]["region"], articles["https://g/2"]["published_at"]) == ("global", None)
    assert [r["url"].strip() for r in select_recent_gdelt(records, as_of()).collect()] == ["https://g/1"]
    assert select_recent_gdelt(records, as_of(), minutes=0.5).count() == 0


ITEM = "<item><title>{0}</title><link>https://x/{0}</link><description>&lt;p&gt;d&lt;/p&gt;</description></item>"


def test_xml_payloads_and_files(spark, tmp_path):
    body = "<rss><channel><title>c</title>" + ITEM.format(1) + ITEM.format(2) + "</channel></rss>"
    rows = parse_feed_payloads(
        spark.createDataFrame([("a", body), ("b", "not xml"), ("c", None)], "feed_id string, body string")
    ).collect()
    assert [(r["feed_id"], r["item_seq"], r["title"], r["description"]) for r in rows] == [
        ("a", 0, "1", "<p>d</p>"), ("a", 1, "2", "<p>d</p>"),
    ]
    (tmp_path / "bbc.xml").write_text(body)
    (tmp_path / "broken.xml").write_text("oops")
    from_files = read_feed_entries(spark, str(tmp_path)).collect()
    assert sorted((r["feed_id"], r["link"]) for r in from_files) == [("bbc", "https://x/1"), ("bbc", "https://x/2")]


def test_fetch_outcomes(spark):
    feeds = spark.createDataFrame(
        [(f"f{i}", "n", f"https://{i}/", "global", "general", "old", "lm", i != 4) for i in range(5)],
        "id string, name string, url string, region string, category string, etag string, last_modified string, enabled boolean",
    )
    assert select_feeds(feeds).count() == 4 and select_feeds(feeds, False).count() == 5
    fetches = spark.createDataFrame(
        [
            ("f0", 1, 0, 304, "x", "x"), ("f0", 2, 0, 200, "new", None), ("f1", 1, 0, 304, "x", "x"),
            ("f2", 1, 0, 500, "x", "x"), ("f3", 1, 0, None, None, None),
        ],
        "feed_id string, fetched_at int, fetch_seq int, status int, etag_header string, last_modified_header string",
    )
    got = {r["id"]: (r["etag"], r["last_modified"], r["fetched_ok"]) for r in resolve_fetches(fetches, feeds).collect()}
    kept = ("old", "lm", False)
    assert got == {"f0": ("new", "", True), "f1": kept, "f2": kept, "f3": kept, "f4": kept}


CONFIG = "id string, name string, url string"


def test_feed_config_rules(spark):
    rows = [
        ("ok", "A", "https://a.example.com"), ("ok", "B", "https://b.example.com/"),
        ("dupurl", "C", "HTTPS://A.example.com:443/"), ("Bad ID!", "D", "https://d.example.com/"),
        ("nourl", "E", "not-a-url"), ("noname", "", "https://e.example.com/"), ("miss", "F", None),
        ("ftp", "G", "ftp://g.example.com/"),
    ]
    got = {(r["id"], r["url"], r["rule"]) for r in validate_feeds(spark.createDataFrame(rows, CONFIG)).collect()}
    assert got == {
        ("ok", None, "duplicate_id"), (None, "https://a.example.com/", "duplicate_url"),
        ("Bad ID!", "https://d.example.com/", "bad_id"), ("nourl", "not-a-url", "bad_url"),
        ("ftp", "ftp://g.example.com/", "bad_url"), ("noname", "https://e.example.com/", "empty_name"),
        ("miss", None, "missing_field"),
    }


def test_feed_config_load(spark):
    good = spark.createDataFrame([("a", "A", "https://A.example.com")], CONFIG)
    row = load_feeds(good).first()
    assert (row["url"], row["region"], row["category"], row["enabled"]) == ("https://a.example.com/", "global", "general", True)
    with pytest.raises(FeedConfigError, match="empty_file"):
        load_feeds(good.limit(0))
    with pytest.raises(FeedConfigError, match="bad_id"):
        load_feeds(spark.createDataFrame([("-a", "A", "https://a.example.com")], CONFIG))


def test_url_forms(spark):
    assert column(spark, normalize_url, ["http://X.org:80", "https://x.org?q=1", "https://x.org:8443/A", "x.org"]) == [
        "http://x.org/", "https://x.org/?q=1", "https://x.org:8443/A", None,
    ]


def test_distinct_entities_sort_apart(spark):
    """The sort by which the first spelling is found lies behind a shuffle of its own, away from the task that made the rows."""
    from newsloom.operators.entities import distinct_entities

    raw = spark.createDataFrame([("a", 2, "Rome", "location"), ("a", 1, "ROME", "location"), ("a", 3, "rome", "person")], "article_id string, pos int, text string, label string")
    got = distinct_entities(raw)
    assert sorted((r.text, r.pos) for r in got.collect()) == [("ROME", 1), ("rome", 3)]
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()

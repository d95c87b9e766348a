"""Feed bodies of every kind, malformed ones quarantined."""

from pyspark.sql import functions as F

from sift.sources import feeds
from sift.sources import registry as rg

RSS = ('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title>'
       '<item><title> A &amp; B </title><link>http://a/1</link><dc:creator>Bob</dc:creator>'
       '<pubDate>Mon, 16 Mar 2026 10:00:00 GMT</pubDate><description><![CDATA[<p>hi</p>]]></description></item>'
       '<item><title>B</title><link>http://a/2</link><author>al</author><description>' + "x" * 600 +
       '</description></item></channel></rss>')
ATOM = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="http://www.youtube.com/xml/schemas/2015">'
        '<entry><title>T</title><link rel="self" href="http://s"/><link href="http://alt"/>'
        '<author><name>N</name></author><updated>2026-03-16T10:00:00Z</updated><content>C</content></entry>'
        '<entry><title>V</title><link rel="self" href="http://s2"/><yt:videoId>abc</yt:videoId></entry></feed>')
RDF = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">'
       '<item><title>R</title><link>http://r</link></item></rdf:RDF>')
EMPTY_RSS = '<rss version="2.0"><channel><title>none</title></channel></rss>'
BODIES = [("f1", RSS), ("f2", ATOM), ("f3", RDF), ("f4", "<rss><channel><item><title>broken"), ("f5", "plain text"),
          ("f6", ""), ("f7", EMPTY_RSS)]


def _items(spark):
    snaps = spark.createDataFrame([(u, 0, b) for u, b in BODIES], "feed_url string, snapshot_ord int, body string")
    parsed = feeds.parse_snapshots(snaps)
    return parsed, feeds.snapshot_items(parsed, ["feed_url"])


def test_formats(spark):
    parsed, _ = _items(spark)
    fmt = {r.feed_url: r.format for r in parsed.select("feed_url", "format").collect()}
    assert fmt == {"f1": "rss", "f2": "atom", "f3": "rdf", "f4": "bad", "f5": "bad", "f6": "bad", "f7": "empty"}


def test_items(spark):
    _, items = _items(spark)
    got = {(r.feed_url, r.item_pos): r for r in items.collect()}
    a = got[("f1", 0)]
    assert (a.title, a.url, a.author, a.date, a.summary) == ("A & B", "http://a/1", "Bob",
                                                             "Mon, 16 Mar 2026 10:00:00 GMT", "<p>hi</p>")
    b = got[("f1", 1)]
    assert b.author == "al" and len(b.summary) == 500 and b.summary.endswith("...")
    t = got[("f2", 0)]
    assert (t.url, t.author, t.date, t.summary) == ("http://alt", "N", "2026-03-16T10:00:00Z", "C")
    assert got[("f2", 1)].url == "https://www.youtube.com/watch?v=abc"
    assert got[("f3", 0)].title == "R"
    assert len(got) == 5


def test_ingest_and_health(spark):
    reg = spark.createDataFrame([("s1", "One", None, "f1", "1"), ("s2", "Two", None, "f2", "3b"),
                                 ("s3", "Three", None, "f4", "2"), ("s4", "Four", None, None, "4"),
                                 ("s5", "Five", None, "f9", "5")], "slug string, name string, site_url string, feed_url string, tier string")
    snaps = spark.createDataFrame([(u, 0, b) for u, b in BODIES], "feed_url string, snapshot_ord int, body string")
    items, bad = feeds.ingest(snaps, reg, "30 days", "2026-03-20 00:00:00")
    got = sorted((r.source_name, r.title) for r in items.collect())
    assert got == [("One", "A & B"), ("One", "B"), ("Two", "T"), ("Two", "V")]
    assert [r.feed_url for r in bad.collect()] == ["f4"]
    items2, _ = feeds.ingest(snaps, reg, "1 day", "2026-03-20 00:00:00", tiers=["1"])
    assert sorted(r.title for r in items2.collect()) == ["B"]          # dated one too old, undated kept
    counted = feeds.parse_snapshots(snaps)
    counted = counted.select("feed_url", "snapshot_ord", "body", feeds.item_counts(counted).alias("n_items"))
    health = {r.name: (r.status, r.n_items) for r in rg.feed_health(reg, counted).collect()}
    assert health == {"One": ("alive", 2), "Two": ("alive", 2), "Three": ("dead", None),
                      "Four": ("no_feed", None), "Five": ("dead", None)}


def test_listing_and_tiers(spark):
    reg = spark.createDataFrame([("s1", "One", "f1", "1"), ("s2", "Two", "", "3b"), ("s3", "Three", None, "2")],
                                "slug string, name string, feed_url string, tier string")
    lines = {r.slug: r.line for r in rg.listing(reg).collect()}
    assert lines["s2"] == "[Tier 3b] Two: (no feed — WebSearch fallback)"
    assert [r.slug for r in rg.listing(reg, only_no_feed=True, only_has_feed=True).collect()] == ["s2", "s3"]
    assert rg.parse_tiers(" 1, 3b ") == ["1", "3b"]
    assert sorted(r.slug for r in rg.filter_tiers(reg, ["1", "3b"]).collect()) == ["s1", "s2"]


def test_first_author_and_prefixed_atom(spark):
    rss = ('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>p</title><link>http://p</link>'
           '<dc:creator>First</dc:creator><dc:creator>Second</dc:creator></item><item><title>q</title><author>x</author>'
           '<author>y</author></item></channel></rss>')
    atom = ('<?xml version="1.0"?><!-- c --><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>t</a:title><a:entry><a:title>E</a:title>'
            '<a:link href="http://e"/><a:author><a:name>One</a:name></a:author><a:author><a:name>Two</a:name></a:author>'
            '<a:updated>2026-03-16T10:00:00Z</a:updated></a:entry></a:feed>')
    snaps = spark.createDataFrame([("r", 0, rss), ("a", 0, atom)], "feed_url string, snapshot_ord int, body string")
    parsed = feeds.parse_snapshots(snaps)
    assert {r.feed_url: r.format for r in parsed.collect()} == {"r": "rss", "a": "atom"}
    got = {(r.feed_url, r.item_pos): r for r in feeds.snapshot_items(parsed, ["feed_url"]).collect()}
    assert [got[("r", i)].author for i in (0, 1)] == ["First", "x"]
    e = got[("a", 0)]
    assert (e.title, e.url, e.author, e.date) == ("E", "http://e", "One", "2026-03-16T10:00:00Z")


def test_feed_without_items_is_quarantined(spark):
    reg = spark.createDataFrame([("s7", "Seven", None, "f7", "1"), ("s1", "One", None, "f1", "1")],
                                "slug string, name string, site_url string, feed_url string, tier string")
    snaps = spark.createDataFrame([(u, 0, b) for u, b in BODIES], "feed_url string, snapshot_ord int, body string")
    _, bad = feeds.ingest(snaps, reg, "30 days", "2026-03-20 00:00:00")
    assert [(r.feed_url, r.reason, r.body) for r in bad.collect()] == [("f7", "empty", EMPTY_RSS)]

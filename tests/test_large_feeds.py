"""Large feed files by split (A3, A4), the prose registry (A1, D4) and the applied boost (D3)."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sift.operators import rules
from sift.sources import feeds, registry


def _folder(spark):
    return tempfile.mkdtemp(prefix="sift-feeds-", dir=spark.sparkContext.getCheckpointDir().replace("file:", ""))


def _rss(n, rdf=False):
    rng = random.Random(n)
    item = lambda i: (f'<item rdf:about="u{i}">' if rdf else rng.choice(["<item>", "<item >", '<item x="1">'])) + (
        f"\n <title> T{i} &amp; é </title><link>https://x/{i}</link><pubDate>2026-01-01</pubDate>"
        f"<dc:creator>c{i}</dc:creator><author>a</author><description>{'words ' * rng.randint(0, 150)}<![CDATA[<b>{i}</b>]]></description></item>\n")
    items = "".join(map(item, range(n)))
    if rdf:
        return f'<rdf:RDF xmlns="http://purl.org/rss/1.0/"><channel><title>t</title></channel>{items}</rdf:RDF>'
    return f'<?xml version="1.0"?>\n<rss version="2.0"><channel><title>feed</title>{items}<image/></channel></rss>\n'


def _atom(n, prefix=""):
    entry = lambda i: (f"<{prefix}entry><{prefix}title>E{i}</{prefix}title><{prefix}link href='https://y/{i}'/><{prefix}author><{prefix}name>n</{prefix}name></{prefix}author>"  # noqa: E731
                       f"<{prefix}updated>2026-01-01T00:00:00Z</{prefix}updated><{prefix}summary>{'s ' * (i % 50)}{i}</{prefix}summary></{prefix}entry>\n")
    ns = f' xmlns:{prefix[:-1]}="http://www.w3.org/2005/Atom"' if prefix else ' xmlns="http://www.w3.org/2005/Atom"'
    return f"<{prefix}feed{ns}><{prefix}title>f</{prefix}title>{''.join(map(entry, range(n)))}</{prefix}feed>"


@pytest.mark.parametrize("text,tag", [(_rss(700), "item"), (_rss(300, rdf=True), "item"), (_atom(600), "entry"), (_atom(600, "a:"), "a:entry"), (_rss(0), "item")])
def test_large_path_equals_the_small_one(spark, text, tag):
    path = f"{_folder(spark)}/feed.xml"
    open(path, "w").write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        items, bad = feeds.read_large(spark, path, tag)
        got = sorted(map(tuple, items.drop("file_path").collect()), key=lambda r: r[1])
        tasks = spark.read.option("lineSep", f"</{tag}>").text(path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    small = feeds.snapshot_items(feeds.parse_snapshots(spark.createDataFrame([(text,)], "body string")), [])
    want = sorted(map(tuple, small.select("format", "item_pos", *feeds.ITEM_COLS).collect()), key=lambda r: r[1])
    assert got == want and bad.count() == 0
    assert tasks >= max(1, os.path.getsize(path) // 20_000)


def test_broken_items_are_set_aside_with_their_place(spark):
    folder = _folder(spark)
    open(f"{folder}/a.xml", "w").write("<rss><channel><item><title>0</title></item><item><title>1</item><item><title>2</title></item></channel></rss>")
    open(f"{folder}/b.xml", "w").write("<rss><channel><item><title>b0</title></item></channel>")
    items, bad = feeds.read_large(spark, folder)
    assert sorted((os.path.basename(r.file_path), r.item_pos, r.title) for r in items.collect()) == [("a.xml", 0, "0"), ("a.xml", 2, "2"), ("b.xml", 0, "b0")]
    assert [(os.path.basename(r.file_path), r.item_pos) for r in bad.collect()] == [("a.xml", 1)]


PROSE = """# Guide
- outside (no.example)

### Tier 1: Labs (main)
- Alpha Blog (alpha.com/blog) — models, agents (and more)
- Beta (beta.ai, YouTube) — x
- Gamma Fan (NVIDIA) — embodied agents

### Tier 3b: Many in one
- Hub: r/One, r/Two
- arXiv cs.AI, cs.CL (arxiv.org/list/cs.AI/recent)
- News Tech (when accessible), Crunch (crunch.com), Plain

## Rules
- not a source (no.example)
"""


def test_prose_registry(spark):
    path = f"{_folder(spark)}/guide.md"
    for text in (PROSE, PROSE.replace("\n", "\r\n")):
        open(path, "w", newline="").write(text)
        got = sorted((r.tier, r.name, r.site_url) for r in registry.read_registry_prose(spark, path).collect())
        assert got == sorted([
            ("1", "Alpha Blog", "https://alpha.com/blog"), ("1", "Beta", "https://beta.ai"), ("1", "Gamma Fan", None),
            ("3b", "Hub r/One", None), ("3b", "Hub r/Two", None), ("3b", "arXiv cs.AI", "https://arxiv.org/list/cs.AI/recent"),
            ("3b", "cs.CL", "https://arxiv.org/list/cs.AI/recent"), ("3b", "News Tech", None), ("3b", "Crunch", "https://crunch.com"), ("3b", "Plain", None)])


def test_boost_raises_and_judges_again(spark):
    items = spark.createDataFrame([(1, 3.2, "FAIL"), (2, 4.2, "PASS"), (3, 4.9, "MUST READ"), (4, None, None), (5, 3.2, "FAIL")], "story int, weighted double, verdict string")
    boosts = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.5), (5, 0.0)], "story int, boost double")
    got = {r.story: (r.unboosted, r.weighted, r.verdict) for r in rules.boosted(items, boosts, "story").collect()}
    assert got == {1: (3.2, 3.7, "PASS"), 2: (4.2, 4.7, "MUST READ"), 3: (4.9, 5.0, "MUST READ"), 4: (None, None, None), 5: (3.2, 3.2, "FAIL")}
    assert rules.boosted(items, boosts.where(F.lit(False)), "story").where("weighted != unboosted").count() == 0

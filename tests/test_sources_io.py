"""A1 registry document reader and A14 JSON sink."""

import json
import os
import uuid

from sift.sources import archive as ar
from sift.sources import registry as rg


def _scratch(spark):
    d = spark.sparkContext.getCheckpointDir().replace("file:", "") + f"/io-{uuid.uuid4().hex}"
    os.makedirs(d)
    return d


def test_registry_document(spark):
    doc = {"sources": [
        {"slug": "a", "name": "Alpha", "site_url": "https://a.test/", "feed_url": "https://a.test/rss", "tier": "1"},
        {"slug": "b", "name": "Beta", "site_url": None, "feed_url": None, "tier": "3b", "extra": 5},
    ]}
    path = _scratch(spark) + "/feeds.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    reg = rg.read_registry_json(spark, path)
    rows = {r.slug: r for r in reg.collect()}
    assert set(rows) == {"a", "b"} and rows["b"].tier == "3b" and rows["b"].feed_url is None
    assert [r.slug for r in rg.filter_tiers(reg, rg.parse_tiers("3b")).collect()] == ["b"]


def test_json_lines_sink_round_trip(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 2.5)], "id int, s string, w double")
    lines = [json.loads(r.json) for r in ar.to_json_lines(df).orderBy("json").collect()]
    assert lines == [{"id": 1, "s": "x"}, {"id": 2, "s": "y", "w": 2.5}]
    out = _scratch(spark) + "/items"
    df.write.mode("overwrite").json(out)
    back = spark.read.schema("id int, s string, w double").json(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))

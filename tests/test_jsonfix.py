"""Recovery paths on the hand-made texts."""

import json

from sift.sources import jsonfix as jf

TEXTS = [
    '[{"title":"a","url":"u","source_tier":"1","source_name":"s"}]',
    '{"items":[{"title":"b","url":"u"}],"meta":{"scanned":5,"sweep_num":2}}',
    'Here you go:\n[{"title":"c","url":"u","source_tier":"1","source_name":"s"}]',
    '[{"title":"He said "hi" there","url":"u","source_tier":"1","source_name":"s"}]',
    '[{"title":"d","url":"u"},{"title":"e","url":"v"},{"title":"f","ur... [TRUNCATED 300 chars]',
    '{"items":[{"title":"g","url":"u"},{"title":"h"…[TRUNCATED',
    '[{"title":"i"},{"title":"j","u...[TRUNCATED',
    '[{"title":"k"},{"title":"l… [TRUNCATED',
    "no json here",
    '{"items": [{"title": null, "url": "x", "source_tier": "1", "source_name": "s"}]}',
]


def test_escape_stray_quotes():
    fixed = jf.escape_stray_quotes('[{"t":"He said "hi" there","a":"b\\"c"}]')
    assert json.loads(fixed) == [{"t": 'He said "hi" there', "a": 'b"c'}]
    assert jf.escape_stray_quotes('{"a": "x"}') == '{"a": "x"}'


def test_recover_paths(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "msg_id int, raw string")
    rec = {r.msg_id: r for r in jf.recover(df).collect()}
    assert [rec[i].outcome for i in range(len(TEXTS))] == [
        "clean", "clean", "trimmed", "quotes", "trimmed", "trimmed", "trimmed", "trimmed", "failed", "clean"]
    assert [m["title"] for m in rec[4]["items"]] == ["d", "e"]
    assert [m["title"] for m in rec[5]["items"]] == ["g"]
    assert rec[3]["items"][0]["title"] == 'He said "hi" there'
    assert rec[1].meta.scanned == 5


def test_strict_counts_present_null(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "msg_id int, raw string")
    strict = jf.items_of(jf.recover(df), strict=True).collect()
    assert sorted(r.msg_id for r in strict) == [0, 2, 3, 9]      # msg 9 has title present but null


def test_stats_and_unwrap(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "msg_id int, raw string")
    rec = jf.recover(df)
    st = {r.outcome: (r.n_texts, r.n_items, r.n_dropped) for r in jf.recovery_stats(rec).collect()}
    assert st["failed"] == (1, 0, 0) and st["quotes"] == (1, 1, 0)
    u = {r.msg_id: r for r in jf.unwrap(rec, scanned=None, sweep_num=7).collect()}
    assert u[1].scanned == 5 and u[1].sweep_num == 7 and u[0].scanned == 0


def test_trailing_text_is_not_clean(spark):
    texts = ['[{"title":"a"}] and more', '[{"title":"a"}]  ', '{"items": []} }', '[1] [2]', '1] x [2', '  {"a": 1}\n']
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, raw string")
    got = [r[0] for r in df.select(jf.is_json(df.raw)).orderBy("msg_id").collect()]
    expected = []
    for t in texts:
        try:
            json.loads(t)
            expected.append(True)
        except ValueError:
            expected.append(False)
    assert got == expected == [False, True, False, False, False, True]


def test_texts_that_the_standard_parser_accepts(spark):
    texts = ['[{"title":"a"}, "x", 3, null, [1]]', '[{"title":"a","title":"b"}]', '[{"score":NaN,"title":"c"},{"v":-Infinity}]',
             '{"items":[{"title":"d"}],"meta":{"scanned":"12","sweep_num":"3"}}', '{"items":[{"title":"e"}],"meta":{"scanned":"many"}}',
             "['a']", '{"items":{"a":1}}', '{"items":[],"meta":7}']
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, raw string")
    rec = {r.msg_id: r for r in jf.recover(df).collect()}
    assert [rec[i].outcome for i in range(8)] == ["clean"] * 5 + ["failed"] + ["clean"] * 2
    assert [i and i["title"] for i in rec[0]["items"]] == ["a", None, None, None, None] and len(rec[0]["items"]) == 5
    assert rec[1]["items"] == [{"title": "b"}]
    title = jf.items_of(jf.recover(df)).where("msg_id = 1").selectExpr("item['title'] AS t", "size(item) AS n").first()
    assert tuple(title) == ("b", 1)
    assert [i.get("title") for i in rec[2]["items"]] == ["c", None]
    assert (rec[3].meta.scanned, rec[3].meta.sweep_num, rec[4].meta.scanned) == (12, 3, None)
    assert (rec[5].reason, rec[6]["items"], rec[7].meta) == ("unreadable", [], None)
    kept = jf.items_of(jf.recover(df)).where("msg_id = 0").orderBy("item_pos").collect()
    assert [r.item_pos for r in kept] == [0, 1, 2, 3, 4] and not any(r.complete for r in kept)


def test_a_large_valid_array_is_whole(spark):
    """Many small items, more text than a VARIANT holds."""
    df = spark.range(1).selectExpr("0 AS msg_id", """concat('[', array_join(transform(sequence(1, 1300000),
        i -> concat('{"title":"item ', i, '","url":"https://a.test/', i, '","source_tier":"1","source_name":"some source ', i, '"}')), ','), ']') AS raw""")
    row = jf.recover(df).selectExpr("outcome", "length(raw) AS n", "size(items) AS items").first()
    assert (row.outcome, row["items"]) == ("clean", 1300000) and row.n > 100_000_000


def test_reasons(spark):
    df = spark.createDataFrame([(0, "no json"), (1, "{'a': 1}"), (2, None), (3, "")], "msg_id int, raw string")
    assert {r.msg_id: r.reason for r in jf.recover(df).collect()} == {0: "no_json", 1: "unreadable", 2: "no_json", 3: "no_json"}

import os
import subprocess
import sys
import fnmatch
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sift.llm import chat, queries, url_rules


def test_shift_and_matches_globs():
    rng = random.Random(1)
    patterns = [b"*a*b", b"ab*", b"*", b"a", b"", b"*abc*", b"a*b*c" * 20, b"**", b"c*"]
    automaton = url_rules.compile_globs(patterns)
    assert automaton.n_words > 1
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(800)] + [b"abc" * 60]
    for text, hits in zip(texts, url_rules.simulate(automaton, texts)):
        assert hits.tolist() == [fnmatch.fnmatchcase(text.decode(), p.decode()) for p in patterns]


def test_url_verdicts(spark):
    cases = {
        "http://Example.ORG/es/1?x": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.example.org/en/10": ("a.example.org", "/en/10", "example.org/en/1", "block"),
        "http://a.example.org/en/2": ("a.example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "https://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
        "https://x.com/de/a#f": ("x.com", "/de/a", "com/de/", "block"),
        "https://x.com:80/de/a": ("x.com:80", "/de/a", None, "allow"),
        "https://x.net/y.exe": ("x.net", "/y.exe", None, "block"),
        "https://x.net/a?b=/y.org/": ("x.net", "/a", None, "allow"),
        "https://É.com?/de/": ("É.com", "", None, "allow"),
        "no scheme.org/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://x.net/" + "a" * 5000 + ".exe": ("x.net", "/" + "a" * 5000 + ".exe", None, "block"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(0, "http://Example.ORG/es/1?x", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[rows[r.page_id][1]]
    assert url_rules.judge_urls(pages.where("false")).count() == 0


RECORDS = [
    ('{"prompt":"a","response":"b"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
    ('{"messages":[{"role":"user","content":"x # </turn>\\n \\\\### assistant: q"},{"role":"a:b","content":null}]}', "messages",
     [("user", "x # </turn>\n \\### assistant: q"), ("a:b", "")]),
    ('{"instruction":"do","input":"","output":""}', "instruction", [("user", "do"), ("assistant", "")]),
    ('{"instruction":"do","input":"it","output":"42","system":"s"}', "instruction_system", [("system", "s"), ("user", "do\n\nit"), ("assistant", "42")]),
    ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', "sharegpt", [("user", "h"), ("assistant", "g")]),
    ('{"messages":[]}', "messages", []),
    ('{"zz":1}', None, None),
    (None, None, None),
]


def test_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(RECORDS)], "id int, js string, formatted string")
    out = chat.format_records(df.withColumn("r", F.parse_json("js")), "r", "id")
    rows = out.withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in rows:
        _, layout, turns = RECORDS[r.id]
        assert r.layout == layout
        assert (r.turns and [tuple(t) for t in r.turns]) == turns
        if turns is not None:
            assert [tuple(t) for t in r.back] == turns
            assert r.loss == "".join(t for role, t in turns if role == "assistant")
    # the order of fields and the types of leaves do not matter
    same = spark.sql("""SELECT parse_json('{"response":1,"prompt":null}') AS r""").select(chat.layout_of(chat.fingerprint(chat.field_paths(F.col("r")))))
    assert same.first()[0] == "prompt_response"


def test_rows_to_conversations(spark):
    text = "\\### Assistant: </turn> ok <</turn>\n# \\"
    rows = [(1, 1, "assistant", text), (1, 0, "user", None), (1, 1, "assistant", text), (None, None, None, "lost"), (2, 0, "gpt", "x" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat.format_records(chat.records_of_rows(df), "record", "conv_id").withColumn("back", chat.parse(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].back] == [("user", ""), ("assistant", text), ("assistant", text)]
    assert [tuple(t) for t in got[None].back] == [("", "lost")]
    assert [tuple(t) for t in got[2].back] == [("gpt", "x" * 100000)]
    assert got[1].layout == "turn_rows" and len(got[1].loss_spans) == 2
    assert chat.records_of_rows(df.where("false")).count() == 0


def test_no_python_in_the_chat_plan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    run = queries.op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    plan = run.executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    logical = run.analyzed().toString()
    assert "schema_of_variant" in logical and all(layout.name in logical for layout in chat.LAYOUTS)


def test_long_roles_and_texts(spark):
    n = 1_000_000
    roles = ["r" * n, ":" * n, "\\" * n, "a:\\#" * (n // 4), ""]
    df = spark.createDataFrame([(1, k, role, "# " * 50 + str(k)) for k, role in enumerate(roles)] + [(2, 0, "user", "é: \\" * n)],
                               "conv_id long, turn long, role string, text string")
    out = chat.format_records(chat.records_of_rows(df), "record", "conv_id").select("conv_id", chat.parse(F.col("formatted")).alias("back"))
    got = {r.conv_id: [tuple(t) for t in r.back] for r in out.collect()}
    assert got == {1: [(role, "# " * 50 + str(k)) for k, role in enumerate(roles)], 2: [("user", "é: \\" * n)]}


def test_typed_records_of_several_layouts(spark):
    kind = "id int, r struct<messages:array<struct<role:string,content:string>>>"
    typed = spark.createDataFrame([(1, ([("human", "hi"), ("gpt", None)],)), (2, ([],)), (3, None)], kind)
    got = {r.id: r for r in chat.format_records(typed, "r", "id").collect()}
    assert got[1].layout == got[2].layout == "messages" and got[3].layout is None and got[3].turns is None
    assert [tuple(t) for t in got[1].turns] == [("user", "hi"), ("assistant", "")] and got[2].turns == []
    typed = spark.createDataFrame([(1, ("q", "a", "c"))], "id int, r struct<question:string,answer:string,context:string>")
    row = chat.format_records(typed, "r", "id").first()
    assert row.layout == "question" and [tuple(t) for t in row.turns] == [("user", "c\n\nq"), ("assistant", "a")]
    other = spark.createDataFrame([(1, ("q",))], "id int, r struct<zz:string>")
    assert chat.format_records(other, "r", "id").first().turns is None


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_agrees(spark, name):
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, base)
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in frame.select(*names).collect())


def test_pipeline_against_its_parts(spark):
    from tokenizers import Tokenizer

    from sift.llm import mixing, quality
    from tests_llm_brute import brute_components, brute_keep

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    good = quality.judge([(r["text"] or "").encode() for r in rows], quality.RepeatLimits())["kept"]
    rows = brute_keep([r for r, k in zip(rows, good) if k])
    firsts = {i for i, c in brute_components([(r["doc_id"], r["text"]) for r in rows]) if i == c}
    rows = [r for r in rows if r["doc_id"] in firsts]
    mixed = mixing.mix(spark.createDataFrame(rows, docs.schema), copy_col=None)
    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(r.text.encode()).hexdigest())
                  for r in mixed.collect())
    got = sorted((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, base).collect())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "bpe_encoding"]


def test_workers_need_no_copy_of_the_repository(tmp_path):
    """Executors get the task functions by value: the driver alone has the package on its path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op1_repetition_rules", "op2_bpe_automaton", "op3_license_scan", "op5_suffix_dedup", "op7_exact_dedup", "op8_grammar_files",
             "op9_url_rules", "op11_importance_resampling", "op12_source_divergence"]
    script = f"""
import sys
sys.path.insert(0, {root!r})
from sift.session import build_session
from sift.llm import queries
spark = build_session("local[2]", 2, app_name="by-value")
for name in {names!r}:
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]

import gc
import math
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sift.llm import bpe, grammar, licenses, mixing, quality

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=600):
    rng = random.Random(0)
    for k in range(n):
        size = rng.randint(0, 40)
        if k % 5 == 0:
            s = "".join(chr(rng.choice([rng.randint(1, 0x5FF), rng.randint(1, 0x10FFFF)])) for _ in range(size))
        elif k % 5 == 1:
            s = "".join(rng.choice("abcdetTHh 'S\n\t ''lld  ") for _ in range(size))
        elif k % 5 == 2:
            s = "".join(rng.choice("the aning ΣσςİıÉéͅİK") for _ in range(size))
        elif k % 5 == 3:
            s = rng.choice("abeÃÂ -=_*.1") * rng.randint(1, 300)
        else:
            s = "".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endof", " ", "a", "\x1c", "\x85", "１", "²", "ⅷ"]) for _ in range(size))
        yield re.sub("[\ud800-\udfff]", "", s)


def test_automaton_encodes_as_the_library():
    library, coder = Tokenizer.from_file(BYTES), bpe.ByteLevelCodec(BYTES)
    for text in odd_texts():
        ids = coder.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_automaton_accepts_only_what_merging_makes():
    # a small alphabet with merges that overlap, against merging by rank
    labels = {i: bytes([97 + i]) for i in range(3)}
    merges, rng = [], random.Random(3)
    while len(merges) < 12:
        a, b = rng.choice(sorted(labels)), rng.choice(sorted(labels))
        if labels[a] + labels[b] not in labels.values():
            labels[len(labels)] = labels[a] + labels[b]
            merges.append((a, b, len(labels) - 1))
    automaton = bpe.MergeAutomaton(labels, merges)
    for _ in range(400):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        ids = [c - 97 for c in word]
        for a, b, c in merges:
            i = 0
            while i + 1 < len(ids):
                if ids[i:i + 2] == [a, b]:
                    ids[i:i + 2] = [c]
                i += 1
        assert automaton.encode(word) == ids


def test_round_trip_over_documents(documents, corpus, nothing):
    library = Tokenizer.from_file(BYTES)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(documents, BYTES).collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in corpus)
    assert bpe.encode_decode(nothing, BYTES).count() == 0


def test_workers_let_go_of_a_coder_that_a_task_does_not_use():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    held = weakref.ref(bpe.codec(BYTES))
    assert [b.num_rows for b in bpe.RoundTrip(BYTES)(iter([batch]))] == [1] and held() is bpe.codec(BYTES)
    assert [b.num_rows for b in quality.Judge(quality.RepeatLimits())(iter([batch]))] == [1]
    gc.collect()
    assert held() is None


def test_word_tokenizer_encodes_as_the_library():
    library, coder = Tokenizer.from_file(WORDS), grammar.WordTokenizer(WORDS)
    texts = list(odd_texts()) + ["a" + chr(c) + "b" for c in range(1, 0x3000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_a_block_are_cut_in_a_few_steps_for_all_texts(monkeypatch):
    rng = random.Random(9)
    library, coder = Tokenizer.from_file(WORDS), grammar.WordTokenizer(WORDS)
    alphabet = ["'", "'", "'s", "'RE", "'ll", "'v", "ve", "s", "T", "l", "é", "ſ", "7", "٣", ".", "-", " ", "\n", "\u00a0", "\u2003", "\x1c", "\x85", "漢", "𝒜", "e\u0301"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)] + ["'", "'s", "a'", "'r", "x'l", "", " "]
    calls, cut = [], coder._cut
    monkeypatch.setattr(coder, "_cut", lambda *args: calls.append(1) or cut(*args))
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(calls) == 1
    assert [ids.tolist() for ids in coder.encode(["", " "])] == [[], []] and coder.encode([]) == []


def test_lookup_of_pairs_that_share_a_bucket(monkeypatch):
    rng = np.random.default_rng(3)
    ids, starts = rng.integers(0, 12, 4000).astype(np.uint32), np.array([0, 1000, 1000, 4000])
    plain = grammar.pack(ids, starts, 12)
    monkeypatch.setattr(grammar, "_bucket", lambda keys, bits: (keys % np.uint64(7)).astype(np.int32))
    shared = grammar.Grammar(grammar.pack(ids, starts, 12))
    assert shared.expand(shared.symbols).tolist() == ids.tolist()
    assert len(shared.rules) == len(grammar.Grammar(plain).rules)


def test_grammar_decodes_any_stretch():
    rng = random.Random(2)
    for _ in range(40):
        docs = [np.array([rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(0, 200))], np.uint32) for _ in range(6)]
        starts = np.cumsum([0] + [len(d) for d in docs])
        shard = grammar.Grammar(grammar.pack(np.concatenate(docs), starts, 10))
        for k, doc in enumerate(docs):
            a = rng.randint(0, len(doc))
            b = rng.randint(a, len(doc))
            assert shard.read_ids(k, a, b).tolist() == doc[a:b].tolist()
        assert len(shard.symbols) < len(np.concatenate(docs)) or len(shard.rules) == 0


def test_grammar_rounds_count_only_live_places(monkeypatch):
    rng = np.random.default_rng(5)
    passages = [rng.integers(0, 20000, 64).astype(np.uint32) for _ in range(40)]
    docs = [np.concatenate([passages[rng.integers(0, 40)], rng.integers(0, 20000, 300).astype(np.uint32)]) for _ in range(400)]
    ids, starts = np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs])
    counted, frequent = [], grammar._frequent_pairs
    monkeypatch.setattr(grammar, "_frequent_pairs", lambda keys, *rest: counted.append(len(keys)) or frequent(keys, *rest))
    shard = grammar.Grammar(grammar.pack(ids, starts, 20000))
    assert shard.expand(shard.symbols).tolist() == ids.tolist()
    assert len(counted) > 4 and sum(counted) < 2 * len(ids)


def test_word_table_is_renewed(monkeypatch):
    monkeypatch.setattr(grammar, "WORD_TABLE", 3)
    library, coder = Tokenizer.from_file(WORDS), grammar.WordTokenizer(WORDS)
    for text in ["one two three four five", "five six", "one \x01two\x7f", "é one", ""]:
        assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_in_id_order(documents, corpus, nothing):
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, t, _ in sorted(corpus, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [grammar.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = grammar.round_trip(documents, WORDS, shard_ids=500).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert grammar.round_trip(nothing, WORDS).count() == 0


def brute_quality(text):
    data = (text or "").encode()
    words = data.split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return (len(words), sum(len(w.decode()) for w in words), sum(data.decode().count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_quality_counts(documents, corpus, nothing):
    got = quality.quality(documents).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) \
        == Counter((i, *brute_quality(t)) for i, t, _ in corpus)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality(nothing).count() == 0


def test_longest_repeat_and_limits():
    words = [b"a%d" % i for i in range(900)]
    long = words + words[:101]
    short = words + words[:100]
    verdict = quality.judge([b" ".join(long), b" ".join(short), b"x " * 60], quality.RepeatLimits())
    assert verdict["longest_repeat"].tolist() == [101, 100, 59]
    assert verdict["kept"].tolist() == [False, True, False]
    assert verdict["covered_words"].tolist() == [202, 200, 60]


def fold_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    passage, copies = rng.integers(0, 900, 2000), 6
    ids = np.concatenate([passage] * copies).astype(np.uint32)
    symbols, docs, rules, lengths = grammar.compress(ids, np.arange(copies + 1) * len(passage), 900)
    assert len(symbols) == copies and len(set(symbols.tolist())) == 1 and lengths[symbols[0] - 900] == len(passage)
    ids = rng.integers(0, 30, 5000).astype(np.uint32)
    symbols, docs, rules, lengths = grammar.compress(ids, np.array([0, 5000]), 30)
    times = Counter(zip(symbols.tolist(), symbols[1:].tolist()))
    assert max(times.values()) < grammar.MIN_COUNT


def test_license_places(spark, nothing):
    rng = random.Random(4)
    vocabulary = sorted({w for t in licenses.BASE for w in t.words}) + [b"x"]
    rows = [(0, None), (1, ""), (2, "Under the MIT-License; under_the mit license"), (3, "déjà under the mit license")]
    rows += [(i, " ".join(rng.choice(vocabulary).decode() for _ in range(rng.randint(0, 80)))) for i in range(4, 60)]
    rows.append((60, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = fold_words(text)
        places = [(k, t.label) for t in licenses.BASE for k in range(len(words)) if tuple(words[k:k + len(t.words)]) == t.words]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | set()
        assert 0 <= r.score <= 1
    assert got[60].labels == "mit" and got[60].n_base == 0
    assert licenses.scan(nothing).count() == 0


def test_license_notice_with_altered_rare_words(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    rows = [(0, notice.replace("permission is hereby granted", "consent is now given"))]
    rows += [(i, notice) for i in range(1, 21)] + [(i, "other words") for i in range(21, 221)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [r.labels for r in (got[0], got[1], got[21])] == ["mit", "mit", ""] and 0.8 <= got[0].score < got[1].score


def brute_licenses(rows, templates):
    """n_base places, labels and best score: every template at every start, IDFs from all texts."""
    held = Counter(w for _, text in rows for w in set(fold_words(text)))
    idf = {w: 1 + math.log((len(rows) + 1) / (held[w] + 1)) for t in templates for w in t.words}
    out = {}
    for i, text in rows:
        words, found = fold_words(text), []
        for t in templates:
            a, b = t.key
            for start in range(-len(t.words), len(words)):
                if start + a >= 0 and tuple(words[start + a:start + b]) == t.words[a:b]:
                    there = sum(idf[w] for k, w in enumerate(t.words) if 0 <= start + k < len(words) and words[start + k] == w)
                    score = 1.0 if t.base else there / sum(idf[w] for w in t.words)
                    if score >= t.least - 1e-12:
                        found.append((t.label, score, t.base))
        out[i] = (sum(x[2] for x in found), ",".join(sorted({x[0] for x in found})), max((x[1] for x in found), default=0.0))
    return out


def test_license_labels_and_scores_against_brute_force(spark):
    rng = random.Random(9)
    notices = [" ".join(w.decode() for w in t.words) for t in licenses.NOTICES]
    rows = [(0, None), (1, "")]
    for i in range(2, 160):
        words = rng.choice(notices).split()
        for _ in range(rng.choice([0, 1, 3, len(words) // 8, len(words) // 4])):
            words[rng.randrange(len(words))] = rng.choice(["x", "license", "software", "the", "Ünïcode"])
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), "inserted")     # what stands behind is out of place
        words = words[rng.choice([0, 0, 1, 9]):]
        lead = [rng.choice(["the", "software", "free", "of", "charge", "copy"]) for _ in range(rng.randint(0, 20))]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(lead + [w.title() for w in words]) + rng.choice(["", " under the MIT license", " CC-BY-NC"])))
    frame = spark.createDataFrame([(i, t, "s", 1.0, 0) for i, t in rows], "doc_id long, text string, labels string, score double, n_words int")
    got = {r.doc_id: (r.n_base, r.labels, r.score) for r in licenses.scan(frame.repartition(3)).collect()}
    want = brute_licenses(rows, licenses.BASE + licenses.NOTICES)
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 1e-9 for i in want)
    assert len({x[1] for x in want.values()}) > 10 and sum(0 < x[2] < 1 for x in want.values()) > 10


def test_license_notice_that_every_text_holds(spark):
    rows = [(i, "permission is hereby granted free of charge to any person obtaining a copy of this software") for i in range(5)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.labels, r.score) for r in got} == {("mit", 1.0)}


def test_mixture_follows_the_rates(spark, nothing, monkeypatch):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 20) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 100 = 1 THEN NULL ELSE 'b' END AS source")
    weights = {"a": 0.25, "b": 0.75}
    rows = mixing.mix(docs, weights=weights, repeats=2.0).collect()
    by = Counter(r.source for r in rows)
    assert by[None] == 0
    assert abs(by["a"] - 3000) < 5 * 3000 ** 0.5 and abs(by["b"] - 9000) < 5 * 9000 ** 0.5
    copies = Counter(r.doc_id for r in rows)
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted((i, k) for i, n in copies.items() for k in range(n))
    counts = Counter(copies.get(i, 0) for i in range(0, 6000, 3))  # rate 1.5
    assert abs(counts[0] / 2000 - 0.2231) < 0.05 and abs(counts[1] / 2000 - 0.3347) < 0.06
    again = mixing.mix(docs.repartition(7), weights=weights, repeats=2.0).collect()
    assert Counter(rows) == Counter(again)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)        # many sources: joined by source and salt
    salted = mixing.mix(docs, weights=weights, repeats=2.0)
    assert "BroadcastHashJoin" not in str(salted._jdf.queryExecution().optimizedPlan()) and [tuple(r) for r in salted.collect()] == [tuple(r) for r in rows]
    assert mixing.mix(nothing).count() == 0


def test_high_rates_are_split(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "'t' AS text", "IF(id < 2, 'rare', 'rest') AS source", "1 AS copy")
    rows = mixing.mix(docs, weights={"rare": 10.0, "rest": 0.0}, repeats=10.0)
    assert rows.columns == docs.columns
    assert abs(rows.count() - 400) < 5 * 20
    assert rows.where(F.col("source") == "rest").count() == 0
    assert mixing.mix(docs.withColumn("source", F.lit(None).cast("string"))).count() > 0


@pytest.mark.parametrize("rate", [0.3, 4.0, 64.0])
def test_cumulative_distribution(spark, rate):
    import math
    docs = spark.createDataFrame([(0, "x" * 10, "a")], "doc_id long, text string, source string")
    row = mixing.source_rates(docs, repeats=rate).first()
    assert row.rate == pytest.approx(rate)
    for k, value in enumerate(row.cdf[:30]):
        assert value == pytest.approx(sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k + 1)), rel=1e-9)

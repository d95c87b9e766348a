"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.llm import divergence, importance, pii

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, bucket int, row string, term string, context string, rank int"


def table(spark, rows, partitions=3):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "r", "t", "c", 9) for r in rows], SCHEMA).repartition(partitions)


def low(text):
    return (text or "").encode().lower().decode()


# --- 11 ---------------------------------------------------------------------------------------------

def features(text):
    w = WORDS.findall(low(text))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resample(docs, target, percent=25):
    def histogram(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    s, t = histogram(x for _, x in docs), histogram(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s_all + 10000) / ((s[i] + 1) * (t_all + 10000)))) for i in range(10000)]
    out, open_rows = [], []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if n >= 20:
            open_rows.append(row)
    open_rows.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, row in enumerate(open_rows[:percent * len(open_rows) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_against_brute_force(spark, corpus):
    docs = table(spark, [(i, t, "en", s) for i, t, s in corpus])
    target = [t for _, t, _ in corpus[8:20]] + [None, ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, importance.resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == brute_resample([(i, t) for i, t, _ in corpus], target)
    assert sum(r[4] is not None for r in got) > 5


def test_resampling_of_nothing(spark, corpus):
    bench = spark.createDataFrame([], "text string")
    assert importance.resample(table(spark, [], 1), bench).count() == 0
    rows = [(i, t) for i, t, _ in corpus]
    got = importance.resample(table(spark, [(*r, "en", "s") for r in rows]), bench).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, [])


def test_features_of_long_texts_and_odd_words():
    rng = random.Random(1)
    texts = ["x" * 300 + " y" + "z" * 70_000 + " end", "a,b;c" * 50_000, "", "é" * 200 + "-ß", "A\x00B\x7fC", " ".join(str(rng.random()) for _ in range(300_000))]
    found = importance.Features()
    for text in texts:
        n, bucket = 0, []
        for words, _, b in found.of([text.encode()]):
            n += int(words.sum())
            bucket += b.tolist()
        count, want = features(text)
        assert n == count
        assert Counter(bucket) == Counter(zlib.crc32(f.encode()) % 10000 for f in want)


def test_crc_of_joined_strings():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 700]))) for _ in range(300)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    joined = importance.Crc().join(first, second, np.array([len(p[1]) for p in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# --- 12 ---------------------------------------------------------------------------------------------

def brute_divergence(rows, min_docs=10, top=10):
    held, seen, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERMS.findall(low(text))
        held[lang, source].update(terms)
        seen.update((lang, t) for t in set(terms))
    out = []
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = sorted((t for (x, t), n in seen.items() if x == lang and n >= min_docs), key=str.encode)
        mine = [g for g in groups if g[0] == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p, q = shares(held[lang, source]), shares(sum((held[g] for g in mine), Counter()))
        pairs = [(sum(apart(p[t], o[t]) for t in kept), other) for _, other in mine if other != source for o in [shares(held[lang, other])]]
        terms = [(apart(p[t], q[t]), t) for t in kept if held[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    words = ["der", "Haus", "été", "日本", "🙂x", "x" * 17, "y" * 40, "pneumonoultramicroscopic", "ab", "abcdefgh", "abcdefghi", "q" * 16, "zz"]
    rows = []
    for i in range(160):
        source = "hot" if i % 3 else f"s{i % 7}"
        lang = ["en", "de", None, "fr"][i % 4 if i < 150 else 3]
        rows.append((i, " ".join(rng.choice(words[: 4 + i % 10]) + rng.choice(["", ",", "1", "\x00", "\x7f"]) for _ in range(rng.randint(0, 30))), lang, source))
    return rows + [(200, None, "en", None), (201, "", "xx", "only"), (202, "der " * 9, "yy", "a"), (203, "haus", "yy", "b"), (203, "haus", "yy", "b")]


@pytest.mark.parametrize("piece", [500_000, 3])
def test_divergence_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(divergence, "SLICE", piece)          # many slices give the same sums
    rows = audit_rows()
    got = divergence.divergence(table(spark, rows)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute_divergence([r[1:] for r in rows])


def test_divergence_of_nothing(spark):
    assert divergence.divergence(table(spark, [], 1)).count() == 0


def test_terms_of_a_block_and_of_a_long_text(monkeypatch):
    rng = random.Random(4)
    words = ["a", "bb", "Cc", "éa", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "w" * 33, "w" * 100, "日" * 50]
    texts = ["", " 1 2 "] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    group = np.array([rng.randrange(3) for _ in texts])
    of, term, n, docs = divergence.count_terms([t.encode() for t in texts], group)
    got = {(g, t): (k, d) for g, t, k, d in zip(of.tolist(), term.to_pylist(), n.tolist(), docs.tolist())}
    want = defaultdict(lambda: [0, 0])
    for t, g in zip(texts, group.tolist()):
        for w, k in Counter(TERMS.findall(low(t))).items():
            want[g, w][0] += k
            want[g, w][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == len(of)
    monkeypatch.setattr(divergence, "BLOCK", 50)
    long = " ".join(texts)
    _, term, n, docs = divergence._count_long(long.encode())
    assert dict(zip(term.to_pylist(), n.tolist())) == Counter(TERMS.findall(low(long))) and set(docs.tolist()) == {1}


def test_shares_are_exact_for_large_counts():
    count = np.array([0, 7, 10 ** 12, 10 ** 14], np.int64)
    total = np.array([10 ** 14 + 10 ** 9], np.int64)
    assert divergence._shares(count, total).tolist() == [1 + 10 ** 9 * (int(c) + 2) // int(total[0]) for c in count]


# --- 13 ---------------------------------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, hit):
    digits = [int(c) for c in hit if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def seeds(text):
    return [(k, m.start(), m.end()) for k, (kind, rule) in enumerate(KINDS) for m in re.finditer(rule, text or "") if passes(kind, m[0])]


def odd_personal_texts():
    rng = random.Random(6)
    bits = ["a@b.c", "@", ".", "a.b@c.d_e@f.g", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111112",
            "4111-1111-1111-1111 2", "+1 (743) 555-3824", "+12345", "++4930 123456789", " ", "\n", "é", "🙂", "-", "日本", "99999999999999999999", "12345678901234"]
    for _ in range(400):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
    yield from (None, "", "a" * 2_000, "1" * 2_000, "a@b" + ".c" * 20_000, "1.2.3.4 " * 3_000, "a1" * 1_000 + "@", "+" * 20_000, "0" * 2_000 + ".0.0.0")


def test_seeds_against_brute_force(spark):
    texts = list(odd_personal_texts())
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], 4)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.seeds] for r in pii.occurrences(docs).select("doc_id", "seeds").collect()}
    for i, text in enumerate(texts):
        assert got[i] == seeds(text), text[:80]


def test_seeds_of_very_long_runs(spark):
    n = 1_000_000
    texts = ["a" * n, "1" * n, "a@b" + ".c" * n, "a1" * n + "@", "+" * n, "0" * n + ".0.0.0", "1-" * n, "+1" + " " * n + "2"]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], 4)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.seeds] for r in pii.occurrences(docs).select("doc_id", "seeds").collect()}
    assert got == {i: [] for i in range(len(texts))} | {2: [(0, 0, 2 * n + 3)], 5: [(1, 0, n + 6)]}


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(8)
    rows = [f"please call on +1 (743) 555-38{i:02d} or write" for i in range(9)] + [f"x dial number +1 (743) 555-39{i:02d}." for i in range(4)]
    rows += ["please call on 555-0137 soon", "we call on 555-0138, ok"]               # trusted: nine phones, two candidates
    rows += ["he did ring desk 555-0137", "to ring desk 555-0138", "do ring desk 555-0144"]
    rows += [f"in the 2{i:03d} of {rng.random():.3f}" for i in range(30)] + ["in the +1 (743) 555-4000", "in the 1.2.3.4", "in the a@b.de"]
    rows += ["in the house of the man"] * 20 + [None, "", "5550139 call on", "call on"]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    found = {i: [(s.kind, s.text) for s in r.found] for i, r in out.items() if r.found}
    at = {t: i for i, t in enumerate(rows)}
    assert found == {at["please call on 555-0137 soon"]: [(3, "555-0137")], at["we call on 555-0138, ok"]: [(3, "555-0138")]}
    # in the second round two of the three instances behind "ring desk" are trusted
    loose = pii.find(docs, pii.Bootstrap(min_score=500_000)).collect()
    assert {r.doc_id for r in loose if r.found} == set(found) | {at[t] for t in ("he did ring desk 555-0137", "to ring desk 555-0138", "do ring desk 555-0144")}
    for r in loose:
        for s in r.found:
            assert rows[r.doc_id][s.start:s.end] == s.text


def test_places_count_all_words(spark):
    docs = table(spark, [(0, "A b c a b  d", "", ""), (1, "a b", "", ""), (2, None, "", ""), (3, "x a b\nc", "", "")])
    wide = spark.createDataFrame([("a b", 1), ("b c", 1), ("b a", 1)], "context string, n long")
    assert {r.context: r.places for r in pii.places(docs, wide).collect()} == {"a b": 3, "b c": 1}


def test_personal_data_of_nothing(spark):
    assert pii.find(table(spark, [], 1)).count() == 0


def test_running_sums(spark):
    sizes = [[], [5], list(range(10)), [3] * 1000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s array<long>")
    got = {r.i: r.t for r in df.select("i", pii.sums_before(F.col("s")).alias("t")).collect()}
    assert [got[i] for i in range(len(sizes))] == [[sum(s[:k]) for k in range(len(s))] for s in sizes]

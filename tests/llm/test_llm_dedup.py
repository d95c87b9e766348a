import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sift.llm import exact_dedup, jaccard_join, suffix_dedup
from sift.llm.bitmap import BITS
from sift.llm.components import components
from sift.llm.suffix import Suffixes, suffix_sort

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return (text or "").encode().translate(UPPER)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup_matches_grouping(documents, corpus, fan_in):
    groups = defaultdict(list)
    for doc_id, text, _ in corpus:
        groups[folded(text)].append(doc_id)
    got = exact_dedup.exact_dedup(documents, fan_in=fan_in).collect()
    assert len(got) == len(corpus)
    want = Counter((i, max(ids), len(ids), hashlib.sha256(t).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_whole_rows_once(documents, corpus):
    rows = exact_dedup.kept_documents(documents).collect()
    assert rows[0].asDict().keys() == documents.limit(1).collect()[0].asDict().keys()
    assert sorted(folded(r.text) for r in rows) == sorted({folded(t) for _, t, _ in corpus})


def test_null_ids_rank_last(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = [(str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()]
    assert sorted(g for g in got if g[1] == 3) == [("3", 3, 3, True), ("None", 3, 3, False), ("None", 3, 3, False)]
    assert sum(g[3] for g in got) == 2
    assert exact_dedup.kept_documents(rows).count() == 2


def brute_spans(texts, width=200):
    seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("options", [{}, {"pieces_a_shard": 1, "shard_bytes": 2000}])
def test_suffix_dedup_matches_brute_force(documents, corpus, options):
    want = Counter((i, *w) for (i, _, _), w in zip(corpus, brute_spans([(t or "").encode() for _, t, _ in corpus])))
    got = suffix_dedup.suffix_dedup(documents, with_text=True, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 101, 3000, dtype=np.uint8))
    whole = {(a, piece) for _, a, piece, _ in _all_pieces(text)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 512)
    windows = lambda pieces: {a + k for a, p in pieces for k in range(len(p) - 199)}
    blocks = list(suffix_dedup._segments([text], 512))
    starts = [at + k for block in blocks for _, at, part in block for k in range(len(part) - 199)]
    assert sorted(starts) == list(range(len(text) - 199)) == sorted(windows(whole))


def _all_pieces(text):
    class Any(dict):
        def get(self, key, default=None):
            return {"mark": key}

    block = next(suffix_dedup._segments([text]))
    _, first, last, mark, _, _ = suffix_dedup._block_anchors(block)
    return [(0, int(a), text[a:b + 200], m) for a, b, m in zip(first, last, mark)]


def test_suffix_array_and_common_prefixes():
    text = b"mississippi banana mississippi"
    symbols = np.frombuffer(text, np.uint8).astype(np.int64)
    s: Suffixes = suffix_sort(symbols, np.full(len(text), len(text)))
    assert s.array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lengths = s.common_prefix(s.array[:-1], s.array[1:])
    for i, j, n in zip(s.array, s.array[1:], lengths):
        assert text[i:i + n] == text[j:j + n] and text[i + n:i + n + 1] != text[j + n:j + n + 1]


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = folded(text).split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = top(rows[x][0]), top(rows[y][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), top(i)) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("leaf,pivots,least", [(64, 8, 64), (3, 2, 2)])
def test_jaccard_join_matches_brute_force(documents, corpus, leaf, pivots, least, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", least)
    got = jaccard_join.jaccard_join(documents, leaf=leaf, pivots=pivots).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(i, t) for i, t, _ in corpus])


def brute_links(rows):
    """How many other sets each row's set is linked to."""
    sets = []
    for _, text in rows:
        w = folded(text).split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    linked = {s: sum(1 for t in set(sets) if s and t and s != t and 100 * len(s & t) >= 80 * len(s | t)) for s in set(sets)}
    return sorted((i, linked[s]) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("leaf,pivots,group", [(64, 8, 1024), (64, 8, 20), (3, 2, 4)])
def test_links_inside_large_regions_are_complete(spark, leaf, pivots, group, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = np.random.default_rng(3)
    rows = []
    for family in range(3):         # near copies of passages that share their first half; some members are farther off
        words = [f"p{k}" for k in range(30)] + [f"q{family}_{k}" for k in range(30)]
        for k in range(45):
            own = list(words)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                own[at] = f"x{rng.integers(0, 6)}"
            rows.append((len(rows), " ".join(own)))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf, pivots=pivots).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == brute_links(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


@pytest.mark.parametrize("leaf", [256, 16])
def test_components_get_forests_not_all_links(spark, leaf, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    for family in range(2):
        for _ in range(60):
            own = [f"q{family}_{k}" for k in range(160)]
            own[rng.integers(0, 160)] = f"x{rng.integers(0, 40)}"
            rows.append((len(rows), " ".join(own)))
    edges, plain = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda links: edges.append(links.distinct().count()) or plain(links))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == brute_links(rows)
    assert {r.doc_id: r.component_id for r in got} == {i: 60 * (i // 60) for i in range(120)}
    assert max(edges) < 1500 < sum(r.n_links for r in got) / 2      # links grow with the square of a family


def test_overlapping_regions_of_near_copies_take_few_pairs(spark, monkeypatch):
    rng, rows = np.random.default_rng(6), []
    for _ in range(150):
        own = [f"q{k}" for k in range(120)]
        own[rng.integers(0, 120)] = f"x{rng.integers(0, 40)}"
        rows.append((len(rows), " ".join(own)))
    taken, plain = [], jaccard_join.JaccardJoin._distances
    monkeypatch.setattr(jaccard_join.JaccardJoin, "_distances", lambda self, pairs, *rest: taken.append(pairs.count()) or plain(self, pairs, *rest))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), leaf=32).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == brute_links(rows)
    assert {r.component_id for r in got} == {0}
    assert sum(taken) < 6 * len(rows)       # each of some 20 regions has nearly all of them


def test_sets_travel_as_texts_where_those_are_shorter():
    class Every:
        value = np.full(1 << (BITS - 6), -1, np.int64).view(np.uint64)

    rng = np.random.default_rng(8)
    own = [f"q{k}" for k in rng.integers(0, 300, 200)]
    texts = [" ".join(own), " ".join(["x", *own[1:]]), "same same " * 400, "One two", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5), pa.int64()), "text": texts})
    whole, short = (pa.Table.from_batches(list(jaccard_join._WholeSets(Every, s)(iter([batch])))).slice(0, 4) for s in (False, True))
    assert whole.column("words").null_count == 4 and short.column("words").to_pylist() == [*(t.encode() for t in texts[:2]), None, b"One two"]
    assert [len(s) for s in short.column("shingles").to_pylist()] == [0, 0, 1, 0]
    assert short.nbytes < 0.7 * whole.nbytes
    nodes = whole.column("node").to_pylist()
    pairs = pa.table({"a": [nodes[0], nodes[0], nodes[2]], "b": [nodes[1], nodes[2], nodes[3]]})
    far = [jaccard_join._block_distances(pairs, sets, 0.2) for sets in (whole, short)]
    assert far[0].equals(far[1]) and 0 < far[0].column("distance")[0].as_py() < 0.2


def test_tasks_of_many_batches(documents, corpus, short_batches):
    got = jaccard_join.jaccard_join(documents, leaf=8, pivots=4).collect()
    rows = [(i, t) for i, t, _ in corpus]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert sorted((r.doc_id, r.n_links) for r in got) == brute_links(rows)


def test_near_dedup_of_many_batches(spark, documents, corpus, short_batches):
    kept = corpus_pipeline.drop_near_copies(spark, documents, "")
    want = {i for i, _, c in brute_components([(i, t) for i, t, _ in corpus]) if i == c}
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == want


def test_rows_told_twice_share_no_pivot_with_themselves(spark, documents, corpus, monkeypatch):
    rows = [(i, t) for i, t, _ in corpus]
    made, plain = defaultdict(list), jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: made[name].append(kept := plain(df, name)) or kept)
    got = jaccard_join.jaccard_join(documents.unionByName(documents)).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == brute_links(rows + rows)
    (shared,), (members,) = made["shared-pivots"], made["region-members"]
    assert members.groupBy("pivot").count().where("count > 1").count() == shared.count() == members.select("pivot").distinct().count() > 0


def test_one_of_each_keeps_the_smallest(documents, corpus):
    want = {i for i, _, c in brute_components([(i, t) for i, t, _ in corpus]) if i == c}
    assert {r.doc_id for r in jaccard_join.one_of_each(documents).collect()} == want


def test_one_id_on_two_texts_keeps_the_links_of_both(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(5, a), (5, b), (3, b), (9, a + " tail")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_join(documents).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == [(3, 26, 3, 0), (5, 26, 3, 0), (5, 26, 5, 1), (9, 27, 5, 1)]
    assert sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(documents).collect()) == [(3, b), (5, a)]


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 120).selectExpr("id AS a", "id - 1 AS b").unionByName(spark.range(1).selectExpr("500 AS a", "400 AS b"))
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 120)}, 500: 400}


def test_empty_tables(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.kept_documents(nothing).count() == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    assert jaccard_join.jaccard_join(nothing).count() == 0

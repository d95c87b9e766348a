"""exact near-copy links, long chains, groups with a very common shingle."""

from pyspark.sql import functions as F

from sift.operators import stories
from sift.operators.components import components
from sift.plans.story_plans import q_best_per_story


def _groups(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    return {r.id: r.story_id for r in stories.story_groups(df, "id", "text").collect()}


def _words(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def test_threshold_is_exact(spark):
    # n words make n - 4 shingles; k new words at the end replace k shingles of each side
    base = _words("a", 40)                                  # 36 shingles
    texts = {1: base, 2: base[:36] + _words("b", 4),        # 32 common of 40: exactly 0.8
             3: base[5:] + _words("c", 5), 4: _words("d", 3), 5: _words("d", 3) + ["e"], 6: []}
    got = _groups(spark, {k: " ".join(v) for k, v in texts.items()})
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_null_texts_are_their_own_stories(spark):
    assert _groups(spark, {1: None, 2: "a b", 3: None, 4: "a b", 5: ""}) == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}


def test_copies_and_a_shared_passage(spark):
    passage = " ".join(_words("p", 30))
    texts = {i: passage + " " + " ".join(_words(f"own{i}x", 20 + i)) for i in range(45)}   # no two are near copies
    texts |= {100 + i: texts[3] for i in range(40)} | {200 + i: texts[4] + f" end{i}" for i in range(40)}
    got = _groups(spark, texts)
    assert all(got[i] == i for i in range(45))
    assert all(got[100 + i] == 3 and got[200 + i] == 4 for i in range(40))


def test_large_group_without_links(spark):
    """Texts of one very common shingle each and little else: the group is large and few are alike."""
    common = "one two three four five"
    texts = {i: common + f" x{i} y{i % 4}" for i in range(60)}
    got = _groups(spark, texts)
    assert all(got[i] == i for i in range(60))


def test_chain_of_two_hundred_is_one_component(spark):
    links = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 200)}


def test_large_groups_against_brute_force(spark):
    """Groups far over the size that is paired directly, with chains of near copies through them."""
    import random
    rng = random.Random(7)
    common = _words("c", 12)
    texts, bases = {}, [common + _words(f"b{k}x", 28) for k in range(12)]
    for i in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 4)}"
        texts[i] = words
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    story = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if story[a] < story[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    old, new = story[b], story[a]
                    story.update({k: new for k, v in story.items() if v == old})
                    changed = True
    assert _groups(spark, {i: " ".join(w) for i, w in texts.items()}) == story
    assert 1 < len(set(story.values())) < 150


def test_shingles_stay_where_the_texts_are(spark, monkeypatch):
    """Shuffled are the few pivots of each set and the sets of candidates, never every shingle."""
    import sift.llm.jaccard_join as join
    regions, members = [], join.JaccardJoin._members
    monkeypatch.setattr(join.JaccardJoin, "_members", lambda self, rows, *rest: regions.append(rows) or members(self, rows, *rest))
    texts = {i: " ".join(_words(f"t{i}x", 104)) for i in range(20)} | {50: "T3x0, " + " ".join(_words("t3x", 104)[1:]) + "!"}
    got = _groups(spark, texts)
    assert got == {i: i for i in range(20)} | {50: 3}
    assert regions[0].agg(F.max(F.size("first"))).first()[0] == 21       # of 100


def test_wordless_texts_and_one_id_on_two_texts(spark):
    a, b = " ".join(_words("a", 30)), " ".join(_words("b", 30))
    df = spark.createDataFrame([(1, "..."), (2, "!!"), (3, "..."), (None, a), (5, a), (5, b), (9, b + " tail")], "id long, text string")
    got = {(r.id, r.story_id) for r in stories.story_groups(df, "id", "text").collect()}
    assert got == {(1, 1), (2, 2), (3, 1), (None, 5), (5, 5), (9, 5)}


def _near_copies(families, members):
    """Members of a family differ in their last word; id % families is the family."""
    return {i: " ".join(_words(f"f{i % families}x", 60) + [f"own{i}"]) for i in range(families * members)}


def test_tasks_of_many_batches(spark, short_batches):
    texts = _near_copies(7, 9) | {100 + i: " ".join(_words(f"alone{i}x", 30)) for i in range(20)}
    assert _groups(spark, texts) == {i: i % 7 if i < 100 else i for i in texts}


def test_best_item_of_each_story_of_many_batches(spark, tmp_path, short_batches):
    texts = _near_copies(5, 8)
    tables = {"documents": ([(i, t, f"src{i % 4}") for i, t in texts.items()], "doc_id long, text string, source string"),
              "benchmark": ([(0, texts[2]), (1, "a passage of its own")], "item_id long, text string"),
              "pages": ([(i, f"https://site.example/{i}") for i in range(3)], "page_id long, url string"),
              "supplier": ([(1, "one", 0, 1.0), (2, "two", 4, 1.0), (3, "three", 9, 1.0)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    def rank(i):    # primary: suppliers 1 and 3 (tier 1); then the weighted score, then the smallest id
        r, q, n, a, s = (1 + x % 5 for x in (i, i // 5, i // 25, i // 125, i * 7 // 3))
        return i % 4 in (1, 3), round((1.5 * r + q + 1.5 * n + a + s) / 6, 2), -i

    best = {f: max((i for i in texts if i % 5 == f), key=rank) for f in range(5)}
    got = q_best_per_story(spark, str(tmp_path)).collect()
    assert {(r.story_id, r.doc_id, r.is_primary, r.n_items) for r in got} == {(-1 if f == 2 else f, i, rank(i)[0], 8) for f, i in best.items()}

"""Jaccard metric-space join of shingle sets, exact.

Jaccard distance is a metric, so regions around pivots can be joined one by
one, if each region also holds the sets just outside it that a member can
reach.  Two kinds of pivots are used, in this order.

*Shingles as pivots.*  Between texts nearly all distances are 1, and a document
pivot says nothing about texts that share nothing with it.  The first regions
are therefore those of one-shingle sets: s is at distance 1 - 1/|x| from the
sets x that hold s and at 1 from all others.  A set's nearest such pivots are
its own shingles, all at one distance; a fixed order (``frequent`` ones last,
then by hash) breaks the tie.  A set within distance 1 - t of x lacks at most
|x| - ceil(t |x|) of x's shingles, so the window that replicates x reaches over
its first |x| - ceil(t |x|) + 1 pivots: two linked sets always meet in a region.

*Documents as pivots.*  A region with more than ``LEAF`` members is divided
around up to ``PIVOTS`` of them.  Exact distances from all members to the
pivots are taken; a member goes to the cell of its nearest pivot, and by the
triangle inequality into every other cell whose pivot is at most twice the link
distance farther.  The pivots leave their cells.  Cells that hold at most half
the pairs of their region replace it, and those over ``LEAF`` are divided again;
otherwise pivots do not tell the members apart, and the region stays whole.

All pairs of such a leaf are compared, whatever is known of their components, so
links are complete.  A task takes two groups of a leaf's members and counts the
common shingles of all their pairs at once as a product of incidence matrices.
It returns each member's number of links and a spanning forest, not the links,
which grow with the square of a group of near copies.  A pair that meets more
than once counts in one place: in a small region or against a pivot if it met
there, else in the first leaf that both are in.

Pairs of a region with at most ``LEAF`` members are taken one by one if their
sizes allow a link and if they share enough of their pivots: with the window
full, |x| - ceil(t |x|) + 1 - (|x| - needed overlap).  They are checked on their
whole sets.

A set travels as its text where that is shorter, and is made again where it is compared.

Equal sets are one node from the start, so copies cost one row each.  Frequent
shingles come from counts over all texts (shingles met twice or more in a block
of texts, summed); they only set the order.  They number at most ``2 ** 20``,
because their least count is the number of all shingles over that.

Defined cases: a null or wordless text has an empty set, links with nothing and
is its own component; fewer than five words make one shingle; rows with one id
and different texts are linked by their own texts each; a row with a null id takes part in equal sets only and
has the component of that set (null if no other row has it); extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.arrow import BLOCK_BYTES, blocks, release
from sift.llm.bitmap import bitmap, maybe
from sift.llm.components import components
from sift.llm.scratch import free_name, stage
from sift.llm.shingles import shingle_sets

#: Link when 100 * intersection >= 80 * union.
PERCENT = 80
#: Members of a region whose pairs are taken directly.
LEAF = 256
#: Document pivots of a larger region.
PIVOTS = 32
#: Shingles of the sets that one block of pairs holds, more or less (a longer set is there whole).
BLOCK_SHINGLES = 1 << 20
#: Members and shingles, more or less, of a group; a task compares two groups of a leaf.
GROUP = 1024
GROUP_SHINGLES = 1 << 18
#: Values that one product of incidence matrices covers.
PRODUCT = 2048
FREQUENT_BOUND = 1 << 20
LEAST_FREQUENT = 64


def window(n: int, percent: int = PERCENT) -> int:
    """How many of its n pivots, in order, a set is replicated to."""
    return n - -(-percent * n // 100) + 1


class _Frequent:
    """Texts to (shingle, texts): those in two texts or more of a block; shingle null: all shingles."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, texts in blocks(batches, limit=2 * BLOCK_BYTES):
            sets = list(shingle_sets(texts))
            found, times = np.unique(np.concatenate(sets), return_counts=True)
            total += int(times.sum())
            often = times >= 2
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], names=["shingle", "texts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["shingle", "texts"])


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that come last in the order."""
    counted = stage(texts.select("text").mapInArrow(_Frequent(), "shingle long, texts long")
                         .groupBy("shingle").agg(F.sum("texts").alias("texts"))
                         .where(f"shingle IS NULL OR texts >= {LEAST_FREQUENT}"), "shingle-counts")
    total = counted.where("shingle IS NULL").agg(F.sum("texts")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // FREQUENT_BOUND))
    found = counted.where(F.col("shingle").isNotNull() & (F.col("texts") >= least)).select("shingle").toArrow()
    return np.sort(found.column("shingle").to_numpy().view(np.uint64))


def _set_hash(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


class _Sets:
    """(doc_id, text, text_hash) to (doc_id, text_hash, set_hash, n, first): ``first`` are the pivots that the set is replicated to."""

    def __init__(self, frequent, percent: int, with_first: bool):
        self.frequent, self.percent, self.with_first = frequent, percent, with_first

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = self.frequent.value if self.with_first else None
        for batch, texts in blocks(batches):
            hashes, sizes, first = [], [], []
            for one in shingle_sets(texts):
                hashes.append(_set_hash(one))
                sizes.append(len(one))
                if self.with_first:
                    if len(frequent) and len(one):
                        last = frequent[np.minimum(np.searchsorted(frequent, one), len(frequent) - 1)] == one
                        if last.any():
                            one = np.concatenate([one[~last], one[last]])
                    first.append(one[:window(len(one), self.percent)] if len(one) else one)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())]
            if self.with_first:
                ends = np.cumsum([0] + [len(f) for f in first]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set_hash", "n", "first"][:len(columns)])


class _Sifted:
    """The rows whose key, in the first column, is certainly not (or, with ``may``, may be) in the bitmap."""

    def __init__(self, keys, may: bool):
        self.keys, self.may = keys, may

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = self.keys.value
        for batch in batches:
            yield batch.filter(pa.array(maybe(words, batch.column(0).to_numpy()) == self.may))
        release()


class _Members:
    """(doc_id, node, n, first) to (pivot, node, n) for pivots that the bitmap does not exclude; with ``copies``, of rows that are no further copy."""

    def __init__(self, shared, copies=None):
        self.shared, self.copies = shared, copies

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = self.shared.value
        for batch in batches:
            if self.copies is not None:
                batch = batch.filter(pa.array(~maybe(self.copies.value, batch.column(0).to_numpy())))
            lists = batch.column(3)
            pivots = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            take = maybe(words, pivots)
            rows = pa.array(owner[take])
            yield pa.RecordBatch.from_arrays([pa.array(pivots[take]), batch.column(1).take(rows), batch.column(2).take(rows)],
                                             names=["pivot", "node", "n"])
        release()


class _WholeSets:
    """(doc_id, text) to (node, shingles, words) for ids that the bitmap does not exclude; a node is a set's hash.

    With ``short`` a set that takes more bytes than its text is given by the text, as ``words``.
    """

    def __init__(self, wanted, short: bool):
        self.wanted, self.short = wanted, short

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = self.wanted.value
        for batch in batches:
            ids = batch.column(0).drop_null() if batch.column(0).null_count else batch.column(0)
            batch = batch.filter(batch.column(0).is_valid()) if batch.column(0).null_count else batch
            batch = batch.filter(pa.array(maybe(wanted, ids.to_numpy())))
            for part, texts in blocks(iter([batch])):
                sets = list(shingle_sets(texts))
                nodes = pa.array([_set_hash(s) for s in sets], pa.int64())
                words = [t if self.short and len(t) < s.nbytes else None for t, s in zip(texts, sets)]
                sets = [s if w is None else s[:0] for w, s in zip(words, sets)]
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([nodes, lists, pa.array(words, pa.binary())], names=["node", "shingles", "words"])


def _joining(top: dict[int, int], a: list[int], b: list[int]) -> list[bool]:
    """Which of the edges join two parts of the graph so far; ``top`` points from a node to another of its part."""

    def part(node: int) -> int:
        above = top.setdefault(node, node)
        while above != node:
            top[node] = top[above]
            node, above = top[node], top[top[node]]
        return node

    joins = []
    for i, j in zip(a, b):
        i, j = part(i), part(j)
        joins.append(i != j)
        top[max(i, j)] = min(i, j)
    return joins


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to a spanning forest of the task's edges."""
    top: dict[int, int] = {}
    for batch in batches:
        yield batch.filter(pa.array(_joining(top, batch.column(0).to_pylist(), batch.column(1).to_pylist()), pa.bool_()))


def _pair_distances(reach: float):
    """A block's pairs and sets to (a, b, distance, tree); the ``tree`` pairs span all within ``reach``."""
    return lambda pairs, sets: _block_distances(pairs, sets, reach)


def _block_distances(pairs: pa.Table, sets: pa.Table, reach: float) -> pa.Table:
    held: dict[int, np.ndarray] = {}
    shingles = sets.column("shingles").combine_chunks()
    if len(shingles):
        values, bounds = shingles.flatten().to_numpy(), np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())])
        for k, node in enumerate(sets.column("node").to_pylist()):
            held[node] = values[bounds[k]:bounds[k + 1]]
        for part, texts in blocks(iter(sets.filter(pc.is_valid(sets.column("words"))).to_batches()), text="words"):
            held.update(zip(part.column("node").to_pylist(), (s.view(np.int64) for s in shingle_sets(texts))))
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    distance = np.ones(len(a))
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = held[i], held[j]
        common = len(np.intersect1d(x, y, assume_unique=True))
        distance[k] = 1 - common / (len(x) + len(y) - common)
    held.clear()
    release()
    near = distance <= reach
    tree = np.zeros(len(a), bool)
    tree[near] = _joining({}, a[near].tolist(), b[near].tolist())
    return pa.table({"a": a, "b": b, "distance": distance, "tree": tree})


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each list of x has in common with each list of y; lists hold no value twice."""
    counts = np.zeros((len(x), len(y)), np.float32)
    sides = [(np.concatenate([*lists, np.zeros(0, np.int64)]), np.repeat(np.arange(len(lists)), np.array([len(v) for v in lists], np.int64)))
             for lists in (x, y)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner in sides:
        at = np.searchsorted(both, values)
        held = at < len(both)
        held[held] = both[at[held]] == values[held]
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], owner[held][order]))
    for start in range(0, len(both), PRODUCT):
        matrices = []
        for (at, owner), lists in zip(placed, (x, y)):
            low, high = np.searchsorted(at, [start, start + PRODUCT])
            matrix = np.zeros((len(lists), min(PRODUCT, len(both) - start)), np.float32)
            matrix[owner[low:high], at[low:high] - start] = 1
            matrices.append(matrix)
        counts += matrices[0] @ matrices[1].T
    return counts


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, other) for every other row of each connected part of a symmetric matrix."""
    left = near.any(axis=1)
    for first in np.flatnonzero(left):
        if not left[first]:
            continue
        left[first] = False
        edge = np.array([first])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & left)
            left[edge] = False
            yield from ((first, k) for k in edge)


def _compare(percent: int):
    """Members of two groups of a leaf to (a, b, times): a has ``times`` links counted here (b null), or a and b are in one component."""

    def compare(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell")[0].as_py()
        nodes, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        rows = rows.take(pa.array(at))
        lists = {}
        for name in ("shingles", "small", "leaves", "within", "led"):
            column = rows.column(name).combine_chunks()
            values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
            lists[name] = np.split(values, ends[:-1])
        # regions where a pair has been taken already: small ones, and leaves that come first
        before = [np.concatenate([small, leaves[leaves < cell]]) for small, leaves in zip(lists["small"], lists["leaves"])]
        size = np.array([len(v) for v in lists["shingles"]])
        group = rows.column("group").to_numpy()
        one = group == rows.column("low")[0].as_py()
        same = bool(one.all()) and rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        i = np.flatnonzero(one)
        j = i if same else np.flatnonzero(~one)
        pick = lambda of, rows: [of[k] for k in rows]
        common = _common(pick(lists["shingles"], i), pick(lists["shingles"], j))
        links = 100 * common >= percent * (size[i][:, None] + size[j][None, :] - common)
        if same:
            np.fill_diagonal(links, False)
        near = np.zeros((len(nodes), len(nodes)), bool)
        near[np.ix_(i, j)] = links
        near |= near.T
        met = _common(pick(before, i), pick(before, j))
        met += _common(pick(lists["led"], i), pick(lists["within"], j))
        met += _common(pick(lists["within"], i), pick(lists["led"], j))
        links &= met == 0
        times = np.zeros(len(nodes), np.int64)
        times[i] += links.sum(axis=1)
        if not same:
            times[j] += links.sum(axis=0)
        forest = np.array(list(_forest(near)), np.int64).reshape(-1, 2)
        counted = np.flatnonzero(times)
        none = lambda n: [None] * n
        out = pa.table({"a": pa.array(np.concatenate([nodes[counted], nodes[forest[:, 0]]])),
                        "b": pa.array(none(len(counted)) + nodes[forest[:, 1]].tolist(), pa.int64()),
                        "times": pa.array(times[counted].tolist() + none(len(forest)), pa.int64())})
        release()
        return out

    return compare


def _size_allows(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes in all columns of a staged table, one after the other."""
    return reduce(DataFrame.unionByName, [pairs.select(F.col(c).alias("node")) for c in pairs.columns])


class JaccardJoin:
    """One run over ``documents``; ``labels`` after ``run()``."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, percent: int, leaf: int, pivots: int):
        self.spark = documents.sparkSession
        self.texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.percent, self.leaf, self.pivots = percent, leaf, pivots
        self.limit = 1 - percent / 100 + 1e-9
        self.reach = F.lit(self.limit)

    def run(self) -> DataFrame:
        """doc_id, text_hash, n_shingles, component_id, n_links."""
        sc = self.spark.sparkContext
        frequent = sc.broadcast(frequent_shingles(self.texts))
        texts = self.texts.withColumn("text_hash", F.xxhash64("text"))
        sets = stage(texts.mapInArrow(_Sets(frequent, self.percent, True),
                                      "doc_id long, text_hash long, set_hash long, n long, first array<long>"), "shingle-pivots")
        # a node is a class of equal sets, ``least`` its smallest id
        self.nodes = nodes = stage(sets.where("set_hash IS NOT NULL").groupBy("set_hash", "n").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "set-classes")
        # ids of further copies, and those that a class has in more rows than one
        copies = (sets.where("doc_id IS NOT NULL").select("doc_id", "set_hash", "n").join(nodes.where("rows > 1"), ["set_hash", "n"])
                      .groupBy("doc_id", "set_hash").agg(F.bool_or(F.col("doc_id") != F.col("least")).alias("further"), F.count(F.lit(1)).alias("rows")))
        copies = stage(copies.where("further OR rows > 1").select("doc_id", "set_hash", "further"), "set-copies")
        # rows that the bitmap clears need no join; only the others, with their pivots, are shuffled and written
        copy = sc.broadcast(bitmap(copies, "doc_id"))
        rows = sets.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_hash", "n", "first")
        kind = "doc_id long, set_hash long, n long, first array<long>"
        checked = rows.mapInArrow(_Sifted(copy, True), kind).join(copies.where("further"), ["doc_id", "set_hash"], "left_anti")
        checked = stage(checked.dropDuplicates(["doc_id", "set_hash"]), "checked-rows")
        members = self._members(rows, checked, copy)
        counted = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
        over = stage(counted.where(F.col("size") > self.leaf).select("pivot"), "large-pivots")
        # as with copies: only rows that may be in a large region are joined
        may = sc.broadcast(bitmap(over, "pivot"))
        doubtful = members.mapInArrow(_Sifted(may, True), members.schema)
        large = stage(doubtful.join(over, "pivot").select(F.col("pivot").alias("cell"), "node", "n"), "large-regions")
        small = members.mapInArrow(_Sifted(may, False), members.schema).unionByName(doubtful.join(over, "pivot", "left_anti"))
        found, inside = self._divide(large, members, over)
        candidates = self._small_pairs(small, large)
        need = F.floor((4 * (F.col("na") + F.col("nb")) + 8) / 9) if self.percent == 80 else F.ceil(
            self.percent * (F.col("na") + F.col("nb")) / (100 + self.percent))
        floor_of = lambda n: F.floor((100 - self.percent) * n / 100) + 1 - n + need
        enough = F.col("shared") >= F.least(floor_of(F.col("na")), floor_of(F.col("nb")))
        pairs = stage(candidates.where(_size_allows(F.col("na"), F.col("nb"), self.percent) & enough).select("a", "b", "tag"), "candidate-pairs")
        # components need no more edges than nodes: pairs of one region meet in one task, which passes a spanning forest on
        spanning = pairs.repartition("tag").select("a", "b").mapInArrow(_spanning, "a long, b long")
        pairs = pairs.select("a", "b")
        links = self._distances(pairs, self._whole_sets(pairs, True), spanning).where(F.col("distance") <= self.reach).select("a", "b", "tree")
        links = stage(self._once(links.unionByName(found)), "links")
        tree, links = links.where("tree").select("a", "b"), links.select("a", "b")
        self.labels = components(tree.unionByName(inside.where("b IS NOT NULL").select("a", "b")))
        ends = _ends(links).groupBy("node").agg(F.count(F.lit(1)).alias("times"))
        ends = ends.unionByName(inside.where("b IS NULL").select(F.col("a").alias("node"), "times"))
        degree = ends.groupBy("node").agg(F.sum("times").alias("n_links"))
        linked = self.labels.unionByName(self.labels.select(F.col("component").alias("node"), "component").distinct())
        least = (linked.join(nodes.select(F.col("set_hash").alias("node"), "least"), "node")
                       .groupBy("component").agg(F.min("least").alias("smallest")))
        linked = linked.join(least, "component").select(F.col("node").alias("set_hash"), "smallest")
        rows = sets.select("doc_id", "text_hash", "set_hash", "n").join(nodes, ["set_hash", "n"], "left")
        return (rows.join(linked, "set_hash", "left").join(degree.withColumnRenamed("node", "set_hash"), "set_hash", "left")
                .select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.coalesce("smallest", "least")).alias("component_id"),
                        F.coalesce("n_links", F.lit(0)).alias("n_links")))

    def _once(self, links: DataFrame) -> DataFrame:
        """Each link (a, b) once, a ``tree`` one if any of its rows is."""
        return links.groupBy("a", "b").agg(F.bool_or("tree").alias("tree"))

    def _members(self, rows: DataFrame, checked: DataFrame, copy) -> DataFrame:
        """(pivot, node, n) of all pivots with two nodes or more.

        ``rows`` that the bitmap ``copy`` clears and the ``checked`` ones stand for their classes.  A task runs
        one Python worker: a second one in its chain would stand beside it with its own memory.
        """
        kind = "doc_id long, set_hash long, n long, first array<long>"
        named = rows.mapInArrow(_Sifted(copy, False), kind).unionByName(checked.select("doc_id", "set_hash", "n", "first"))
        # a class has one row here, and a row each pivot once
        shared = (named.select(F.explode("first").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("nodes"))
                       .where("nodes > 1").select("pivot"))
        shared = stage(shared, "shared-pivots")
        may = self.spark.sparkContext.broadcast(bitmap(shared, "pivot"))
        out = "pivot long, node long, n long"
        found = rows.mapInArrow(_Members(may, copy), out).unionByName(
            checked.select("doc_id", "set_hash", "n", "first").mapInArrow(_Members(may), out))
        return stage(found.join(shared, "pivot").distinct(), "region-members")

    def _small_pairs(self, small: DataFrame, large: DataFrame) -> DataFrame:
        """(a, b, na, nb, shared, tag) from the regions with at most ``leaf`` members; the tag is one region of the pair."""
        # how many of a node's regions are large: pairs may share up to that many besides those counted here
        large_of = large.groupBy(F.col("node").alias("large_node")).agg(F.count(F.lit(1)).alias("more"))
        small = (small.join(large_of, F.col("node") == F.col("large_node"), "left")
                      .select("pivot", F.struct("node", "n", F.coalesce("more", F.lit(0)).alias("more")).alias("m")))
        # a list has at most ``leaf`` members; regions with equal members are one, counted
        lists = small.groupBy("pivot").agg(F.sort_array(F.collect_list("m")).alias("ms")).groupBy("ms").agg(
            F.count(F.lit(1)).alias("times"), F.min("pivot").alias("tag"))
        after = F.transform("ms", lambda x, i: F.transform(
            F.filter(F.slice(F.col("ms"), i + 2, F.size("ms")), lambda y: _size_allows(x["n"], y["n"], self.percent)),
            lambda y: F.struct(x.alias("x"), y.alias("y"))))
        pairs = lists.select(F.explode(F.flatten(after)).alias("p"), "times", "tag")
        return (pairs.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.sum("times").alias("times"), F.min("tag").alias("tag"))
                     .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"),
                             (F.col("times") + F.least("x.more", "y.more")).alias("shared"), "tag"))

    def _whole_sets(self, pairs: DataFrame, short: bool = False) -> DataFrame:
        """(node, shingles, words) of the nodes in the columns of a staged table (and of a few others)."""
        ids = stage(_ends(pairs).distinct(), "paired-nodes")
        ids = ids.join(self.nodes.select(F.col("set_hash").alias("node"), "least"), "node")
        wanted = self.spark.sparkContext.broadcast(bitmap(ids, "least"))
        return self.texts.mapInArrow(_WholeSets(wanted, short), "node long, shingles array<long>, words binary")

    def _distances(self, pairs: DataFrame, sets: DataFrame, spanning: DataFrame) -> DataFrame:
        """(a, b, distance, tree) on whole ``sets``; ``pairs`` is a staged table, ``spanning`` has edges with the same components.

        Pairs are dealt to blocks so that a set travels once, not once per pair: a block is a
        component of the graph of pairs, or, where the sets of one are more than ``BLOCK_SHINGLES``,
        a pair of groups of them.
        """
        ids = _ends(pairs).distinct()
        clusters = stage(ids.join(components(spanning), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
                            .join(self.nodes.select(F.col("set_hash").alias("node"), "n"), "node"), "pair-clusters")
        groups = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("groups"))
        group = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
        # a set's place is known before the set is read, so it travels to its node's place and from there to its blocks
        side = stage(clusters.join(groups, "cluster").select("node", "cluster", group.alias("group"), "groups"), "pair-sides")
        placed = sets.join(side, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        # columns of its own, as both sides of the cogroup come from one table
        placed = placed.select(F.col("cluster").alias("place"), F.least("group", "other").alias("one"), F.greatest("group", "other").alias("two"),
                               "node", "shingles", "words")
        of_a = side.select(F.col("node").alias("a"), "cluster", F.col("group").alias("ga"))
        of_b = side.select(F.col("node").alias("b"), F.col("group").alias("gb"))
        dealt = (pairs.join(of_a, "a").join(of_b, "b")
                      .select("cluster", F.least("ga", "gb").alias("low"), F.greatest("ga", "gb").alias("high"), "a", "b"))
        return (dealt.groupBy("cluster", "low", "high").cogroup(placed.groupBy("place", "one", "two"))
                     .applyInArrow(_pair_distances(self.limit), "a long, b long, distance double, tree boolean"))

    def _divide(self, large: DataFrame, members: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links (a, b, tree) found around document pivots, and (a, b, times) from the leaves (see ``_compare``)."""
        none = self.spark.createDataFrame([], "a long, b long, times long")
        if large.isEmpty():
            return none.select("a", "b", F.lit(False).alias("tree")), none
        sets = stage(self._whole_sets(large.select("node")).join(large.select("node").distinct(), "node"), "large-sets")
        cells = large.join(self._different(large).select("cell"), "cell")
        links, leaves, within, led = [], [], [], []
        while not (cells := stage(cells, "cells")).isEmpty():
            cells, probed, dense, led_dense, union = self._dense(cells, sets)
            links.append(probed)
            within.append(dense)
            led.append(led_dense)
            leaves.append(union)
            if cells.isEmpty():
                break
            # the same nodes are pivots of regions that overlap, so a pair with a pivot is taken once
            slot = F.pmod(F.xxhash64("node"), F.lit(self.pivots))
            pivots = stage(cells.groupBy("cell", slot.alias("slot")).agg(F.min("node").alias("pivot")).select("cell", "pivot"), "pivots")
            within.append(cells.select("cell", "node"))
            led.append(pivots.select("cell", F.col("pivot").alias("node")))
            reached = cells.join(pivots, "cell").where("node != pivot")
            low, high = F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
            # all of a region are paired with its first pivot
            first = pivots.groupBy("cell").agg(F.min("pivot").alias("b"))
            star = cells.join(first, "cell").select(F.col("node").alias("a"), "b")
            known = stage(self._distances(stage(reached.select(low, high).distinct(), "pivot-pairs"), sets, star), "pivot-distances")
            links.append(known.where(F.col("distance") <= self.reach).select("a", "b", "tree"))
            # a pivot has been compared with the whole region and leaves it
            placed = (reached.join(led[-1], ["cell", "node"], "left_anti").select("cell", "node", "n", "pivot", low, high)
                             .join(known, ["a", "b"]).select("cell", "node", "n", "pivot", "distance"))
            placed = stage(placed, "placed")
            nearest = placed.groupBy("cell", "node").agg(F.min("distance").alias("near"))
            spread = stage(placed.join(nearest, ["cell", "node"]).where(F.col("distance") <= F.col("near") + 2 * self.reach)
                                 .select(F.col("cell").alias("region"), F.xxhash64("cell", "pivot").alias("cell"), "node", "n"), "spread")
            kept = stage(self._different(spread), "different-cells")
            whole = placed.select("cell", "node", "n").distinct()
            regions = whole.groupBy(F.col("cell").alias("region")).agg(F.count(F.lit(1)).alias("size"))
            parts = kept.groupBy("region").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
            stay = stage(regions.join(parts, "region").where(2 * F.col("pairs") > F.col("size") * F.col("size")).select("region"), "undivided")
            leaves.append(whole.join(stay.withColumnRenamed("region", "cell"), "cell"))
            spread = spread.join(kept.select("cell", "size"), "cell").join(stay, "region", "left_anti")
            leaves.append(spread.where(F.col("size") <= self.leaf).select("cell", "node", "n"))
            cells = spread.where(F.col("size") > self.leaf).select("cell", "node", "n")
        of = lambda frames: reduce(DataFrame.unionByName, frames)
        return stage(self._once(of(links)), "pivot-links"), stage(self._compared(of(leaves), members, over, of(within), of(led), sets), "leaf-links")

    def _dense(self, cells: DataFrame, sets: DataFrame) -> tuple[DataFrame, ...]:
        """Cells that may be divided; then links (a, b, tree) to first pivots, and of dense cells the members, first pivots and leaves.

        A cell is dense if those within twice the link distance of its first pivot, who are in that
        pivot's part wherever they are nearest, hold over half of its pairs: no further pivot can divide
        it.  Near copies meet in many cells with almost the same members; dense cells around one pivot
        are one leaf, if their union has no more pairs than they have together.
        """
        first = stage(cells.groupBy("cell").agg(F.min("node").alias("pivot")), "first-pivots")
        low, high = F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
        reached = cells.join(first, "cell").where("node != pivot").select("cell", "node", "n", "pivot", low, high)
        pairs = stage(reached.select("a", "b").distinct(), "first-pairs")
        known = stage(self._distances(pairs, sets, pairs), "first-distances")
        near = F.sum((F.col("distance") <= 2 * self.reach).cast("long"))
        sizes = reached.join(known, ["a", "b"]).groupBy("cell").agg(F.count(F.lit(1)).alias("size"), near.alias("near"))
        dense = stage(sizes.where(2 * F.col("near") * F.col("near") > F.col("size") * F.col("size")).join(first, "cell")
                           .select("cell", "size", "pivot"), "dense-cells")
        apart = dense.groupBy("pivot").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"), F.min("cell").alias("leaf"))
        members = stage(reached.select("cell", "node", "n").join(dense.select("cell", "pivot"), "cell"), "dense-members")
        whole = members.select("pivot", "node").distinct().groupBy("pivot").agg(F.count(F.lit(1)).alias("all"))
        one = apart.join(whole, "pivot").where(F.col("all") * F.col("all") <= F.col("pairs")).select("pivot", "leaf")
        union = members.join(one, "pivot", "left").select(F.coalesce("leaf", "cell").alias("cell"), "node", "n").distinct()
        return (stage(cells.join(dense, "cell", "left_anti"), "cells"), known.where(F.col("distance") <= self.reach).select("a", "b", "tree"),
                cells.join(dense, "cell", "left_semi").select("cell", "node"), dense.select("cell", F.col("pivot").alias("node")), union)

    def _different(self, cells: DataFrame) -> DataFrame:
        """The cells of two members or more with their sizes (and regions); of cells with equal members one is enough."""
        region = [c for c in cells.columns if c == "region"]
        return (cells.groupBy(*region, "cell").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
                     .where("size > 1").groupBy("size", "mark").agg(F.min(F.struct("cell", *region)).alias("one")).select("size", "one.*"))

    def _compared(self, leaves: DataFrame, members: DataFrame, over: DataFrame, within: DataFrame, led: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, times) from all pairs of each leaf."""
        leaves = stage(leaves, "leaves")
        inside = leaves.select("node").distinct()
        may = self.spark.sparkContext.broadcast(bitmap(leaves, "node"))
        small = members.select("node", "pivot")
        small = small.mapInArrow(_Sifted(may, True), small.schema).join(over, "pivot", "left_anti").withColumnRenamed("pivot", "cell")
        for name, regions in (("small", small), ("leaves", leaves), ("within", within), ("led", led)):
            listed = regions.groupBy("node").agg(F.collect_set("cell").alias(name))
            inside = inside.join(listed, "node", "left").withColumn(name, F.coalesce(name, F.array().cast("array<long>")))
        inside = stage(inside.join(sets.select("node", "shingles").dropDuplicates(["node"]), "node"), "leaf-sets")
        groups = leaves.groupBy("cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("groups"))
        group = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
        dealt = (leaves.join(groups, "cell").withColumn("group", group)
                       .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
                       .select("cell", F.least("group", "other").alias("low"), F.greatest("group", "other").alias("high"), "group", "node"))
        return dealt.join(inside, "node").groupBy("cell", "low", "high").applyInArrow(_compare(self.percent), "a long, b long, times long")


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                 leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (links of its class to other classes)."""
    return JaccardJoin(documents, id_col, text_col, percent, leaf, pivots).run().drop("text_hash")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose id is their component's smallest, with all their columns."""
    joined = stage(JaccardJoin(documents, id_col, text_col, PERCENT, LEAF, PIVOTS).run(), "components")
    key, text = free_name(documents, "__component"), free_name(documents, "__text")
    dropped = (joined.where("doc_id IS NOT NULL AND component_id != doc_id")
                     .select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct())
    same = (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(text))
    return documents.join(dropped, same, "left_anti")

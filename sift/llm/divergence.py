"""Source divergence audit: how far the word shares of a language's sources are apart.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased.  A task
counts the terms of a block of texts in numpy: terms of up to 8 bytes are packed
into one uint64 word, those of up to 16 bytes into two, in big-endian order, so
equal words are equal terms.  The words are radix-sorted by their 16-bit digits
(a stable sort of 16-bit numbers is numpy's radix sort), and equal neighbours
counted as runs.  Longer terms are sorted as byte strings in buckets of like
length.  Spark adds the runs of all blocks by (lang, source, term).

Each language keeps the terms that at least ``min_docs`` of its documents hold.
With V of them, a group's share of a term is ``1 + floor(10^9 * (count + 2) / (N + 2V))``,
N being the sum of the group's counts, and two shares p and q are
``floor((p - q)^2 / (p + q))`` apart.  All arithmetic is in whole numbers (the
quotient is taken in two steps, which holds up to N = 2 * 10^14).  Pairs of
sources are compared with matrices, terms by sources, of one bounded slice of
the terms at a time; slices are dealt by a hash of the term, so neither a
language nor a source is one task.  A matrix has at most ``SIDE`` sources a side.

Defined cases: a null or empty text has no terms but its (lang, source) group is
there; a null lang or source is the empty text; a language without kept terms
has value 0 for all pairs and no term rows; a language with one source has no
pairs; repeated rows are documents of their own; ties go by the item's bytes; a
very long text is counted in chunks and is one document; other columns are
ignored; with no documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.arrow import blocks, chunks
from sift.llm.scratch import stage

MIN_DOCS = 10
TOP_TERMS = 10
#: Bytes of text that are counted together.
BLOCK = 4 << 20
#: (term, source) counts that one slice of the terms holds, about.
SLICE = 500_000
#: Sources on one side of a matrix, and terms of one matrix.
SIDE, DEPTH = 128, 4096
SCALE = 1_000_000_000
_STEPS = (31_250, 32_000)     # their product is SCALE

_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_FIRST = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(9)], np.uint64)   # the first n bytes


def terms_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the terms in bytes."""
    edge = np.diff(np.concatenate([[False], _TERM[data], [False]]).astype(np.int8))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows of unsigned words, the most significant word first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """The terms as ``words`` big-endian uint64 words, zeros behind their end."""
    window = np.lib.stride_tricks.sliding_window_view(data, 8 * words)
    packed = window[start].view(">u8").astype(np.uint64)
    return [packed[:, k] & _FIRST[np.clip(size - 8 * k, 0, 8)] for k in range(words)]


def _byte_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The terms as byte strings of one width (a term holds no zero byte)."""
    width = int(size.max())
    cell = np.zeros((len(start), width), np.uint8)
    row = np.repeat(np.arange(len(start)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    cell[row, place] = data[np.repeat(start, size) + place]
    return cell.view(f"S{width}").ravel()


def _runs(order: np.ndarray, parts: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows the first of each run of equal ones, the run's rows and its documents."""
    new = np.zeros(len(order), bool)
    new[0] = True
    for part in parts:
        ranked = part[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    other = new.copy()
    ranked = doc[order]
    other[1:] |= ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other.astype(np.int64), at)


def count_terms(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a block of texts: group, term, occurrences and documents of each term of each group."""
    data = np.frombuffer(b"\n".join(texts).lower() + bytes(16), np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, size = terms_of(data)
    doc = np.searchsorted(begin, start, "right") - 1
    of = group[doc]
    firsts, counts, docs = [], [], []

    def add(rows: np.ndarray, order: np.ndarray, parts: list[np.ndarray]) -> None:
        first, n, held = _runs(order, parts, doc[rows])
        firsts.append(rows[first])
        counts.append(n)
        docs.append(held)

    for words, (least, most) in enumerate(((1, 8), (9, 16)), 1):
        rows = np.flatnonzero((size >= least) & (size <= most))
        if len(rows):
            parts = [of[rows].astype(np.uint32), *_packed(data, start[rows], size[rows], words)]
            add(rows, radix_order(parts), parts)
    long = np.flatnonzero(size > 16)
    width = np.frexp(size[long] - 0.5)[1]          # buckets up to 32, 64, 128, ... bytes
    for w in np.unique(width):
        rows = long[width == w]
        parts = [of[rows], _byte_strings(data, start[rows], size[rows])]
        add(rows, np.lexsort((parts[1], parts[0])), parts)
    if not firsts:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(firsts)
    ends = np.concatenate([[0], np.cumsum(size[first])])
    held = np.arange(ends[-1]) + np.repeat(start[first] - ends[:-1], size[first])
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[held]))
    return of[first], terms.cast(pa.string()), np.concatenate(counts).astype(np.int64), np.concatenate(docs)


def _count_long(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``count_terms`` of one text, in chunks."""
    tables = []
    for chunk in chunks(text, BLOCK):
        _, term, n, _ = count_terms([chunk], np.zeros(1, np.int64))
        tables.append(pa.table({"term": term, "n": n}))
    total = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")])
    one = np.ones(total.num_rows, np.int64)
    return 0 * one, total.column("term").combine_chunks(), total.column("n_sum").to_numpy(), one


class _Terms:
    """Documents (lang, source, text) to (lang, source, term, n, n_docs)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=BLOCK):
            names: dict[tuple, int] = {}
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            group = np.array([names.setdefault(pair, len(names)) for pair in pairs], np.int64)
            if len(texts) == 1 and len(texts[0]) > BLOCK:
                of, term, n, docs = _count_long(texts[0])
            else:
                of, term, n, docs = count_terms(texts, group)
            lang, source = (pa.array([pair[k] for pair in names], pa.string()) for k in (0, 1))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), term, pa.array(n), pa.array(docs)],
                                             names=["lang", "source", "term", "n", "n_docs"])


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), exactly."""
    scaled = (count + 2) * _STEPS[0]
    return 1 + scaled // total * _STEPS[1] + scaled % total * _STEPS[1] // total


def _share(count: str, total: str) -> str:
    """The same in SQL."""
    scaled = f"(({count} + 2) * {_STEPS[0]})"
    return f"(1 + {scaled} DIV {total} * {_STEPS[1]} + {scaled} % {total} * {_STEPS[1]} DIV {total})"


def _pair_sums(terms: pa.Table, sources: pa.Table) -> pa.Table:
    """The values of all pairs of a language's sources over one slice of its terms."""
    sources = sources.sort_by("source")
    name, total = sources.column("source").combine_chunks(), sources.column("total").to_numpy()
    held = terms.column("held").combine_chunks()
    entries = held.flatten()
    row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    column = pc.index_in(entries.field("source"), value_set=name).to_numpy(zero_copy_only=False).astype(np.int64)
    n = entries.field("n").to_numpy(zero_copy_only=False)

    def shares(first: int, at: int, depth: int) -> np.ndarray:
        mine = (row >= at) & (row < at + depth) & (column >= first) & (column < first + SIDE)
        matrix = np.zeros((depth, len(total[first:first + SIDE])), np.int64)
        matrix[row[mine] - at, column[mine] - first] = n[mine]
        return _shares(matrix, total[first:first + SIDE])

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(total), SIDE):
        for j in range(i, len(total), SIDE):
            sums = np.zeros((len(total[i:i + SIDE]), len(total[j:j + SIDE])), np.int64)
            for at in range(0, len(held), DEPTH):
                depth = min(DEPTH, len(held) - at)
                p = shares(i, at, depth)
                q = p if i == j else shares(j, at, depth)
                for a in range(p.shape[1]):
                    own = p[:, a:a + 1]
                    sums[a] += ((own - q) ** 2 // (own + q)).sum(axis=0)
            a, b = np.nonzero(np.ones_like(sums))
            less = a + i < b + j
            out.append(((a + i)[less], (b + j)[less], sums[a[less], b[less]]))
    a, b, value = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    lang = sources.column("lang").combine_chunks()[:1].take(pa.array(np.zeros(len(a), np.int64))) if len(a) else pa.array([], pa.string())
    return pa.table({"lang": lang, "a": name.take(pa.array(a)), "b": name.take(pa.array(b)), "value": value})


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, lang_col: str = "lang",
               source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): the sources and the terms each group is furthest from."""
    empty = F.lit("")
    docs = documents.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
                            F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.col(text_col).alias("text"))
    counts = (docs.mapInArrow(_Terms(), "lang string, source string, term string, n long, n_docs long")
                  .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))
    # a term's list has an entry for each source of its language at most
    kept = stage(counts.groupBy("lang", "term")
                       .agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("held"))
                       .where(F.col("n_docs") >= min_docs).drop("n_docs"), "terms")
    entries = kept.select("lang", "term", "n_lang", F.inline("held"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("all_n"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = stage(docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
                       .select("lang", "source", (F.coalesce("own_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"),
                               (F.coalesce("all_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("all_total")), "groups")

    p, q = F.expr(_share("n", "total")), F.expr(_share("n_lang", "all_total"))
    apart = F.expr("(p - q) * (p - q) DIV (p + q)")
    furthest = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    by_term = (entries.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
                      .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value"))
                      .withColumn("rank", F.row_number().over(furthest)).where(F.col("rank") <= top_terms))

    held = kept.agg(F.sum(F.size("held"))).first()[0] or 0
    slices = -(-held // SLICE) or 1
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(slices).cast("long")).alias("slice"), "held")
    sides = groups.select("lang", "source", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    sums = (dealt.groupBy("lang", "slice").cogroup(sides.groupBy("lang", "slice"))
                 .applyInArrow(_pair_sums, "lang string, a string, b string, value long")
                 .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    by_pair = (sums.select("lang", "value", F.inline(both))
                   .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
                   .withColumn("rank", F.row_number().over(furthest)))
    return by_pair.unionByName(by_term)

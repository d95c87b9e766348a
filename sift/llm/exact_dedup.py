"""Exact dedup by a tree-merge of sorted digest runs.

Every scan partition turns its texts into a sorted run of digests with one
entry per different text.  The runs are then merged in rounds: in round r,
``FAN_IN`` neighbouring nodes exchange their runs, each digest slice of a node
goes to one task, and that task merges the sorted entries and keeps for every
text the identifier that stays and the number of rows.  The number of slices
of a node grows by ``FAN_IN`` a round, so a task's share stays level up to the
root.  On the way down the root's decision is joined to the entries of the
leaves, and from there, by (run, digest), to the rows.  A text held by a third
of all rows is one entry per run before anything is shuffled, and its rows are
found run by run, so no key gathers them.

Only digests move; the texts never leave their scan task.  A text's key is its
SHA-256 and, as verification at each level, a second digest of another family
with the byte length: entries merge only when all three agree.

Defined cases: a null text counts as empty; a null id ranks below every other
id; of rows with equal text and equal id exactly one is kept; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sift.llm.arrow import blocks
from sift.llm.scratch import free_name, stage

#: Runs that meet in one node of the tree.
FAN_IN = 8
#: Digest slices of a leaf run; a node of round r has FAN_IN ** r times as many.
LEAF_SLICES = 32

LEAF = "doc_id long, run long, row long, digest binary, proof long, n_bytes long"
ENTRY = "run long, digest binary, proof long, n_bytes long, keep_id long, keep_row long, size long"
_LEAF_ARROW = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("row", pa.int64()),
                         ("digest", pa.binary()), ("proof", pa.int64()), ("n_bytes", pa.int64())])
_ENTRY_ARROW = pa.schema([("run", pa.int64()), ("digest", pa.binary()), ("proof", pa.int64()), ("n_bytes", pa.int64()),
                          ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("size", pa.int64())])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, row = TaskContext.get().partitionId(), 0
    for batch, texts in blocks(batches):
        # bytes.lower() changes A-Z alone, which is the normalisation asked for
        texts = [t.lower() for t in texts]
        proof = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts), "<i8")
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(n, run, np.int64)),
             pa.array((np.int64(run) << 32) + np.arange(row, row + n)),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(proof),
             pa.array([len(t) for t in texts], pa.int64())], schema=_LEAF_ARROW)
        row += n


class _Entry:
    """The entry that is being merged; a later entry with the same key adds to it."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.rows: list[tuple] = []

    def add(self, key: tuple, keep_id: int | None, keep_row: int, size: int) -> None:
        if key != self.key:
            self.flush()
            self.key, self.best, self.size = key, (keep_id, keep_row), 0
        elif _outranks((keep_id, keep_row), self.best):
            self.best = (keep_id, keep_row)
        self.size += size

    def flush(self) -> None:
        if self.key is not None:
            self.rows.append((*self.key, *self.best, self.size))
        self.key = None

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_ENTRY_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY_ARROW)], schema=_ENTRY_ARROW)


def _outranks(a: tuple, b: tuple) -> bool:
    """The larger id stays; of equal ids the first row."""
    if a[0] == b[0]:
        return a[1] < b[1]
    return b[0] is None or (a[0] is not None and a[0] > b[0])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over entries sorted by key; equal neighbours become one entry."""
    merged = _Entry()
    for batch in batches:
        for run, digest, proof, n_bytes, keep_id, keep_row, size in zip(*(c.to_pylist() for c in batch.columns)):
            merged.add((run, digest, proof, n_bytes), keep_id, keep_row, size)
        yield merged.take()
    merged.flush()
    yield merged.take()


def _slice(n: int):
    """The digest's slice among n equal ranges of its first four bytes."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.floor(head * n / (1 << 32))


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One entry per different text, from the entries of ``n_runs`` sorted runs."""
    slices = LEAF_SLICES
    while n_runs > 1:
        slices *= fan_in
        n_runs = -(-n_runs // fan_in)
        runs = (runs.withColumn("run", F.floor(F.col("run") / fan_in))
                    .withColumn("slice", _slice(slices))
                    .repartition("run", "slice")
                    .sortWithinPartitions("run", "digest", "proof", "n_bytes")
                    .drop("slice").mapInArrow(_merge, ENTRY))
    return runs


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``documents``: doc_id, row, keep_id, group_size, kept, text_sha256, n_bytes.

    ``row`` numbers the rows in scan order and tells rows of equal id apart.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    leaves = stage(texts.mapInArrow(_digest_rows, LEAF), "digest-leaves")
    entries = (leaves.selectExpr("run", "digest", "proof", "n_bytes", "doc_id AS keep_id", "row AS keep_row", "1L AS size"))
    # a leaf's own merge is map-side: equal rows of one run meet before the first exchange
    leaf_entries = stage(
        entries.groupBy("run", "digest", "proof", "n_bytes")
        .agg(F.max(F.struct(F.col("keep_id"), (-F.col("keep_row")).alias("back"))).alias("best"), F.sum("size").alias("size"))
        .selectExpr("run", "digest", "proof", "n_bytes", "best.keep_id", "-best.back AS keep_row", "size"), "digest-runs")
    n_runs = (leaf_entries.agg(F.max("run")).first()[0] or 0) + 1
    root = tree_merge(leaf_entries, n_runs, fan_in).select("digest", "proof", "n_bytes", "keep_id", "keep_row", F.col("size").alias("group_size"))
    decided = leaf_entries.select("run", "digest", "proof", "n_bytes").join(root, ["digest", "proof", "n_bytes"])
    return (leaves.join(decided, ["run", "digest", "proof", "n_bytes"])
                  .select("doc_id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                          F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes"))


def kept_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns; one row for each different text."""
    verdict = exact_dedup(documents, id_col, text_col)
    key = free_name(documents, "__text_key")
    # an id can stand on several rows with different texts, so a kept row is found by id and digest
    keep = verdict.where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias(key))
    digest = F.sha2(_ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    order = free_name(documents, "__text_order")
    one = Window.partitionBy(key).orderBy(key)
    return (documents.withColumn(key, _row_key(F.col(id_col).cast("long"), digest))
                     .join(keep, key, "left_semi")
                     .withColumn(order, F.row_number().over(one)).where(F.col(order) == 1)
                     .drop(key, order))


def _row_key(doc_id, digest):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ascii_lower(column):
    return F.translate(column, _UPPER, _UPPER.lower())

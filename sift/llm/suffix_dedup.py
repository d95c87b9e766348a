"""Suffix-array dedup of byte strings: every byte under a repeated 200-byte string goes.

A window is 200 bytes of one text.  Sorting every suffix of the corpus against
every other would need each suffix's 200 bytes in the place it sorts to, so the
text is first routed by content.  Every window chooses an anchor inside it
(``anchors``); equal windows choose equal anchors, so only windows whose anchor
occurs twice can be repeated, and equal windows always meet under one anchor.

1. Anchors of all texts are counted; those found twice or more are kept.
2. The windows that chose one anchor position are neighbours; the bytes that
   they cover are a piece.  Equal pieces are added up (map-side first), so a
   text copied a thousand times is one piece of weight 1000.
3. Pieces are dealt to shards by anchor.  A shard sorts all suffixes of its
   pieces by Larsson-Sadakane refinement and takes Kasai common prefixes.
   Neighbours that share 200 bytes are one class; its windows are repeated if
   it has two members or a member of weight two.  The only piece of an anchor
   needs no sorting if it has weight two.
4. An anchor with more than ``PIECES`` different pieces is split over several
   shards.  Each writes its classes of windows as a sorted run of 128-bit
   fingerprints; runs are merged by binary search, and a class found in two
   runs is repeated in both.
5. The repeated windows go back to the texts, where their spans are united.

Step 1 only sets aside text that cannot repeat.  Pieces carry whole windows, so
the result is exact.  Hash keys: anchors and text keys have 64 bits and can
only add candidates when they collide; a piece is known by anchor and 64-bit
hash together, a window of a split anchor by anchor and 128 bits.

Defined cases: a null text is empty; a text shorter than the window has no
windows; repeated rows are copies of each other; a null id is an id like any
other; texts longer than ``SEGMENT`` are cut, overlapping by a window less one
byte, so that no window is lost; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.anchors import WINDOW, anchors, words_at
from sift.llm.arrow import blocks
from sift.llm.bitmap import bitmap, maybe
from sift.llm.scratch import stage
from sift.llm.suffix import covered, kasai, suffix_sort

#: Bytes of a long text that are looked at together.
SEGMENT = 4 << 20
#: Bytes of texts whose anchors are sought together: their arrays stay in the processor's cache.
ANCHOR_BLOCK = 1 << 16
#: Different pieces of one anchor that one shard sorts together.
PIECES = 1024
#: Bytes of pieces in one suffix array.
SHARD_BYTES = 1 << 20


def _segments(texts: list[bytes], segment: int = SEGMENT) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in blocks; windows start in exactly one segment."""
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), segment):
            part = text[at:at + segment + WINDOW - 1]
            if block and size + len(part) > segment + WINDOW:
                yield block
                block, size = [], 0
            block.append((number, at, part))
            size += len(part)
    if block:
        yield block


def _block_anchors(block: list[tuple[int, int, bytes]]):
    """Joined bytes, and of each anchor: first and last start in them, hash, index of its segment, segment bounds."""
    data = np.frombuffer(b"".join(part for _, _, part in block), np.uint8)
    size = np.array([len(part) for _, _, part in block], np.int64)
    stop = np.cumsum(size)
    _, first, last, mark = anchors(data, np.repeat(stop, size))
    return data, first, last, mark, np.searchsorted(stop, first, side="right"), stop - size


class _Marks:
    """(key, text) to (mark, key), a row for each anchor; with a bitmap, only for those it does not exclude."""

    def __init__(self, wanted=None):
        self.wanted = wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=ANCHOR_BLOCK):
            keys = batch.column(0).to_numpy()
            for block in _segments(texts):
                _, _, _, mark, segment, _ = _block_anchors(block)
                if self.wanted is not None and len(mark):
                    take = maybe(self.wanted.value, mark)
                    mark, segment = mark[take], segment[take]
                owner = np.array([number for number, _, _ in block], np.int64)[segment] if len(mark) else segment
                yield pa.RecordBatch.from_arrays([pa.array(mark.astype(np.int64)), pa.array(keys[owner].astype(np.int64))],
                                                 names=["mark", "key"])


def _pieces_of(texts: list[bytes], wanted: list[list[dict]]) -> Iterator[tuple[int, int, bytes, dict]]:
    """(text, start, piece, entry) of every piece whose mark is among the text's wanted entries."""
    for block in _segments(texts):
        data, first, last, mark, segment, begin = _block_anchors(block)
        raw = data.tobytes()
        # only marks that some text of the block wants are looked at one by one
        some = np.array(list({entry["mark"] for number in {number for number, _, _ in block} for entry in wanted[number]}), np.int64)
        near = np.isin(mark.view(np.int64), some)
        first, last, mark, segment = first[near], last[near], mark[near], segment[near]
        cuts = np.searchsorted(segment, np.arange(len(block) + 1)).tolist()
        for k, (number, offset, _) in enumerate(block):
            entries = {entry["mark"]: entry for entry in wanted[number]}
            own = slice(cuts[k], cuts[k + 1])
            for m, a, b in zip(mark[own].tolist(), first[own].tolist(), last[own].tolist()):
                entry = entries.get(m)
                if entry is not None:
                    yield number, a - int(begin[k]) + offset, raw[a:b + WINDOW], entry


def _piece_hash(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece) - (1 << 63)


class _Rows:
    """(key, doc_id, text, wanted) to (mark, split, splits, piece_hash, key, doc_id, at), a row for each piece."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=ANCHOR_BLOCK):
            rows = []
            for number, at, piece, entry in _pieces_of(texts, batch.column(3).to_pylist()):
                print_ = _piece_hash(piece)
                rows.append((entry["mark"], print_ % entry["splits"], entry["splits"], print_, number, at))
            mark, split, splits, print_, number, at = zip(*rows) if rows else [()] * 6
            number = pa.array(number, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark, pa.int64()), pa.array(split, pa.int32()), pa.array(splits, pa.int32()), pa.array(print_, pa.int64()),
                 batch.column(0).take(number), batch.column(1).take(number), pa.array(at, pa.int64())],
                names=["mark", "split", "splits", "piece_hash", "key", "doc_id", "at"])


class _Pieces:
    """(key, doc_id, text, wanted) to (mark, split, splits, piece_hash, weight, piece), each wanted piece once."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=ANCHOR_BLOCK):
            lists = batch.column(3).to_pylist()
            pieces = [{(e["mark"], e["piece_hash"]): e for e in entries} for entries in lists]
            rows = []
            for number, _, piece, entry in _pieces_of(texts, lists):
                chosen = pieces[number].pop((entry["mark"], _piece_hash(piece)), None)
                if chosen is not None:
                    rows.append((chosen["mark"], chosen["split"], chosen["splits"], chosen["piece_hash"], chosen["weight"], piece))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["mark", "split", "splits", "piece_hash", "weight", "piece"])


def repeated_windows(pieces: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the pieces, in order: is it repeated; its class; and where each piece's windows begin.

    A window counts once for each row its piece stands for.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    stop = np.cumsum(size)
    begin = stop - size
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.repeat(stop, size)
    owner = np.repeat(np.arange(len(pieces)), size)
    # seven bytes and how many of them there are: a suffix that ends sorts before those that go on
    left = end - np.arange(len(data))
    short = np.flatnonzero(left < 7)
    head = words_at(data) & ~np.uint64(0xFF)
    head[short] &= ~((np.uint64(1) << (8 * (8 - left[short])).astype(np.uint64)) - np.uint64(1))
    keys = head | np.minimum(left, 7).astype(np.uint64)
    # sorted to the pieces' ends, equal suffixes by position: the order that Kasai's scan relies on
    suffixes = suffix_sort(keys, end, start_depth=7, depth=int(size.max()), keep_levels=False)
    common = kasai(suffixes, data, begin, WINDOW)
    whole = np.arange(len(data)) + WINDOW <= end
    # suffixes that share a window stand next to each other; the array without the other suffixes keeps that
    slots = np.flatnonzero(whole[suffixes.array])
    fresh = common < WINDOW
    fresh[:1] = True
    group = np.cumsum(fresh) - 1
    kind = group[slots]
    place = suffixes.array[slots]
    weight = np.bincount(kind, weights=weights[owner[place]], minlength=len(data))
    is_repeated, window_class = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    is_repeated[place] = weight[kind] >= 2
    window_class[place] = kind
    first = np.concatenate([[0], np.cumsum(size - WINDOW + 1)])
    return is_repeated[whole], window_class[whole], first


def _runs(flags: np.ndarray) -> list[int]:
    """Start and end (inclusive) of each run of set flags, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


class _Shard:
    """Pieces sorted by (mark, split) to (mark, slice, split, piece_hash, runs, at, open, high, low).

    One row per piece has ``runs``, its repeated windows as start and end.  For an anchor that
    is split over shards, more rows have the fingerprints of its windows: ``at``, whether the
    window is not repeated so far, and two halves of the fingerprint.
    """

    def __init__(self, shard_bytes: int):
        self.shard_bytes = shard_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key and size >= self.shard_bytes:
                    yield self._sort(held)
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[5])
        if held:
            yield self._sort(held)

    @staticmethod
    def _sort(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (mark, split, splits, piece_hash, weight, piece) of whole (mark, split) groups, sorted."""
        out, announced = [], set()
        # an anchor whose only piece stands for two rows or more repeats all of it: nothing to compare
        alone = [row[2] == 1 and row[4] >= 2 and (k == 0 or rows[k - 1][0] != row[0]) and (k + 1 == len(rows) or rows[k + 1][0] != row[0])
                 for k, row in enumerate(rows)]
        for row, one in zip(rows, alone):
            if one:
                out.append((row[0], 0, row[1], row[3], [0, len(row[5]) - WINDOW], None, None, None, None))
        rows = [row for row, one in zip(rows, alone) if not one]
        if rows:
            repeated, window_class, first = repeated_windows([row[5] for row in rows], np.array([row[4] for row in rows], np.float64))
        for k, (mark, split, splits, piece_hash, _, piece) in enumerate(rows):
            flags = repeated[first[k]:first[k + 1]]
            out.append((mark, 0, split, piece_hash, _runs(flags), None, None, None, None))
            if splits > 1:
                for at, kind in enumerate(window_class[first[k]:first[k + 1]].tolist()):
                    # a class is announced once, but each window that is not repeated yet must be found again
                    if kind not in announced or not flags[at]:
                        announced.add(kind)
                        print_ = hashlib.blake2b(piece[at:at + WINDOW], digest_size=16).digest()
                        high = int.from_bytes(print_[:8], "big", signed=True)
                        out.append((mark, 1 + high % SLICES, split, piece_hash, None, at, not flags[at], high,
                                    int.from_bytes(print_[8:], "big", signed=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WINDOWS)], schema=_WINDOWS)


#: Ranges of fingerprints that a split anchor's runs are merged by.
SLICES = 64
_WINDOWS = pa.schema([("mark", pa.int64()), ("slice", pa.int32()), ("split", pa.int32()), ("piece_hash", pa.int64()),
                      ("runs", pa.list_(pa.int32())), ("at", pa.int32()), ("open", pa.bool_()), ("high", pa.int64()),
                      ("low", pa.int64())])


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mark, slice): runs pass; the prints of a slice are merged over its shards.

    Each shard's prints are a sorted run.  A print is looked up in the merged runs by binary search;
    the entries found tell how many shards have it, and in two its open windows are repeated.
    """
    names = ["mark", "piece_hash", "runs"]
    held: list[pa.RecordBatch] = []
    for batch in batches:
        passed = batch.filter(pc.equal(batch.column(1), 0))
        yield passed.select(names)
        prints = batch.filter(pc.not_equal(batch.column(1), 0))
        if prints.num_rows:
            held.append(prints)
        if len(held) > 1 and not _same_slice(held):
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.rec.fromarrays([table.column(n).to_numpy() for n in ("mark", "slice")])
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield _repeated_again(table.slice(0, last))
            held = table.slice(last).to_batches()
    if held:
        yield _repeated_again(pa.Table.from_batches(held))


def _same_slice(held: list[pa.RecordBatch]) -> bool:
    first, last = held[0], held[-1]
    return all(first.column(n)[0] == last.column(n)[last.num_rows - 1] for n in (0, 1))


def _repeated_again(prints: pa.Table) -> pa.RecordBatch:
    column = {n: prints.column(n).to_numpy() for n in ("mark", "piece_hash", "split", "at", "open", "high", "low")}
    key = np.rec.fromarrays([column["mark"], column["high"], column["low"]])
    runs = [np.unique(key[column["split"] == s]) for s in np.unique(column["split"])]
    merged = np.sort(np.concatenate(runs), kind="stable")
    found = np.searchsorted(merged, key, side="right") - np.searchsorted(merged, key, side="left")
    again = column["open"].astype(bool) & (found >= 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(column["mark"][again]), pa.array(column["piece_hash"][again]),
         pa.array([[a, a] for a in column["at"][again].tolist()], pa.list_(pa.int32()))], names=["mark", "piece_hash", "runs"])


class _Cut:
    """(doc_id, text, runs) to the kept bytes."""

    def __init__(self, with_text: bool):
        self.with_text = with_text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            rows = []
            for text, own in zip(texts, spans):
                kept, removed, n_spans = text, 0, 0
                if own:
                    own = np.array(own, np.int64).reshape(-1, 2)
                    gone = covered(own[:, 0], own[:, 1] - own[:, 0] + WINDOW, len(text))
                    removed, n_spans = int(gone.sum()), len(_runs(gone)) // 2
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if self.with_text else None))
            n_bytes, removed, n_spans, digest, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _text_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                 pieces_a_shard: int = PIECES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, null unless ``with_text``)."""
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    texts = documents.select(_text_key(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    # anchors found twice or more, back to their texts
    marks = texts.select("key", "text").mapInArrow(_Marks(), "mark long, key long").select("mark")
    repeated = stage(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                          .select("mark", F.ceil(F.col("n") / pieces_a_shard).cast("int").alias("splits")), "anchor-counts")
    may = documents.sparkSession.sparkContext.broadcast(bitmap(repeated, "mark"))
    marks = texts.select("key", "text").mapInArrow(_Marks(may), "mark long, key long")
    wanted = stage(marks.join(repeated, "mark").groupBy(F.col("key").alias("want_key"))
                        .agg(F.collect_set(F.struct("mark", "splits")).alias("wanted")), "repeated-anchors")

    # from here on one plan: the three joins with the texts share one exchange of them
    rows = (texts.join(wanted, F.col("key") == F.col("want_key")).select("key", "doc_id", "text", "wanted")
                 .mapInArrow(_Rows(), f"mark long, split int, splits int, piece_hash long, key long, doc_id {kind}, at long"))
    chosen = (rows.groupBy("mark", "split", "splits", "piece_hash")
                  .agg(F.min("key").alias("want_key"), F.count(F.lit(1)).alias("weight"))
                  .groupBy("want_key").agg(F.collect_list(F.struct("mark", "split", "splits", "piece_hash", "weight")).alias("wanted")))
    # rows that repeat one key are one text; a piece is fetched from one of them
    fetched = (texts.join(chosen, F.col("key") == F.col("want_key")).select("key", "doc_id", "text", "wanted")
                    .mapInArrow(_Pieces(), "mark long, split int, splits int, piece_hash long, weight long, piece binary"))
    windows = (fetched.repartition("mark", "split").sortWithinPartitions("mark", "split", "piece_hash")
                      .mapInArrow(_Shard(shard_bytes), "mark long, slice int, split int, piece_hash long, runs array<int>, "
                                                       "at int, open boolean, high long, low long")
                      .repartition("mark", "slice").sortWithinPartitions("mark", "slice")
                      .mapInArrow(_merge_runs, "mark long, piece_hash long, runs array<int>")
                      .where(F.size("runs") > 0).withColumnsRenamed({"mark": "window_mark", "piece_hash": "window_hash"}))

    # back to the texts
    placed = (rows.join(windows, (F.col("mark") == F.col("window_mark")) & (F.col("piece_hash") == F.col("window_hash")))
                  .select(F.col("key").alias("span_key"), F.col("doc_id").alias("span_doc"),
                          F.transform("runs", lambda r: r + F.col("at")).alias("runs")))
    spans = placed.groupBy("span_key", "span_doc").agg(F.flatten(F.collect_list("runs")).alias("spans"))
    cut = (texts.join(spans, (F.col("key") == F.col("span_key")) & F.col("doc_id").eqNullSafe(F.col("span_doc")), "left")
                .select("doc_id", "text", "spans"))
    return cut.mapInArrow(_Cut(with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Importance resampling towards a target text distribution, by hashed word windows.

Words are found by an untrained pre-tokenizer of the tokenizers library (a
Regex Split over the text with A-Z lower-cased), which returns each word with
its offsets.  Consecutive offset pairs make windows of two words; the words
and the windows, joined by one space, are the features, and the CRC-32 of a
feature's bytes modulo ``buckets`` its bucket.  Two histograms, one of all
documents and one of all target texts, give a gain for each bucket, the log of
the ratio of its smoothed shares; a document's weight is the mean gain of its
features.  With a Gumbel number drawn from its id, the highest scores are a
sample without replacement in proportion to the importance weights.

The words of a distinct white-space piece are looked up in a table of bounded
size, so the library sees each piece of a block once; white space never stands
inside a word.  CRC-32 is linear: that of two joined strings is that of the
first moved on by the second's length, xor that of the second.

What reaches the driver are the two histograms, at most ``buckets`` rows each.
The texts are read once and never shuffled; the buckets of their features, two
bytes each, are written to the shared folder and read for the histogram and
for the weights.  Ranks come from a range-partitioned sort and the prefix
sums of its partitions, never from one task.

Defined cases: a null or empty text has no words, weight 0 and is not drawn;
very long texts are read in chunks of ``CHUNK`` bytes that end behind a word,
windows across them included; repeated rows are documents of their own, equal
scores go to the smaller id, then to the smaller n_features and weight, and
wholly equal rows take neighbouring ranks; a null id counts as empty in the
draw and is last among ties; with no documents the result is empty, with no target texts all gains are those of an
empty histogram; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from sift.llm.arrow import blocks, chunks
from sift.llm.scratch import stage
from sift.operators.rank import dense_order

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: A long text is cut behind the first separator after so many bytes.
CHUNK = 2 << 20
#: The same for a piece without white space.
PIECE = 1 << 16
#: Distinct pieces kept between blocks.
KEPT_PIECES = 600_000
#: Longest word whose CRC step is kept as a table for all blocks.
TABLED = 64


@dataclass(frozen=True)
class Draw:
    """Parameters of the draw."""

    percent: int = 25
    min_words: int = 20
    seed: int = 7


def _step(size: int) -> np.ndarray:
    """CRC-32 moved on by ``size`` bytes, as a table for each of its four bytes: a linear map."""
    zeros = bytes(size)
    none = zlib.crc32(zeros)
    table = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        value = np.uint32(zlib.crc32(zeros, 1 << bit) ^ none)
        byte, place = divmod(bit, 8)
        table[byte, 1 << place:2 << place] = table[byte, :1 << place] ^ value
    return table


class Crc:
    """CRC-32 of joined strings from the CRCs of their parts."""

    def __init__(self):
        self.tables = np.stack([_step(size) for size in range(TABLED)])

    def join(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC of each first string followed by the second, of ``size`` bytes."""
        out = np.empty(len(first), np.uint32)
        short = size < TABLED
        a, n = first[short], size[short]
        out[short] = (self.tables[n, 0, a & 255] ^ self.tables[n, 1, (a >> 8) & 255]
                      ^ self.tables[n, 2, (a >> 16) & 255] ^ self.tables[n, 3, a >> 24])
        for i in np.flatnonzero(~short):
            step, value = _step(int(size[i])), int(first[i])
            out[i] = step[0, value & 255] ^ step[1, (value >> 8) & 255] ^ step[2, (value >> 16) & 255] ^ step[3, value >> 24]
        return out ^ second


class _Numbers(dict):
    """Pieces numbered as they come; ``new`` has those whose words are not known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Features:
    """Texts to the buckets of their words and two-word windows."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.crc = Crc()
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Numbers()
        self.ends = np.zeros(1, np.int64)               # of each piece's words in the two arrays below
        self.word_crc = np.zeros(0, np.uint32)
        self.word_size = np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Pre-tokenize pieces in one string; the offsets tell whose words they are."""
        text = [p.decode("utf-8", "replace") for p in new]
        starts = np.cumsum([0] + [len(t) + 1 for t in text])
        found = self.split.pre_tokenize_str("\n".join(text))
        words = [w.encode() for w, _ in found]
        at = np.fromiter((offsets[0] for _, offsets in found), np.int64, len(found))
        counts = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(new))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts[:len(new)])])
        self.word_crc = np.concatenate([self.word_crc, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))])
        self.word_size = np.concatenate([self.word_size, np.fromiter(map(len, words), np.int64, len(words))])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; CRC and size of all words in order."""
        if len(self.pieces) > KEPT_PIECES:
            self._forget()
        parts = [[p for x in t.lower().split() for p in chunks(x, PIECE)] if len(t) > PIECE else t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        pieces = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if self.pieces.new:
            self._learn(self.pieces.new)
            self.pieces.new = []
        held = self.ends[pieces + 1] - self.ends[pieces]
        text = np.repeat(np.arange(len(texts)), sizes)
        n_words = np.bincount(text, held, len(texts)).astype(np.int64)
        # the words of piece after piece: each piece's first word, and so on from there
        first = np.cumsum(held) - held
        words = np.arange(int(held.sum())) + np.repeat(self.ends[pieces] - first, held)
        return n_words, self.word_crc[words], self.word_size[words]

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words of each text, text of each feature, bucket of each feature), in one part or, for one long text, several."""
        parts = [texts] if len(texts) > 1 else [[c] for t in texts for c in chunks(t, CHUNK)]
        space = np.uint32(zlib.crc32(b" "))
        last = None
        for part in parts:
            n_words, crc, size = self.words(part)
            text = np.repeat(np.arange(len(part)), n_words)
            left, right, right_size, of = crc[:-1], crc[1:], size[1:], text[1:]
            same = text[1:] == text[:-1]
            left, right, right_size, of = left[same], right[same], right_size[same], of[same]
            if last is not None and len(crc):     # the window across two chunks
                left, right, right_size = np.append(left, last), np.append(right, crc[0]), np.append(right_size, size[0])
                of = np.append(of, 0)
            spaced = self.crc.join(left, np.full(len(left), space), np.ones(len(left), np.int64))
            windows = self.crc.join(spaced, right, right_size)
            if len(parts) > 1 and len(crc):
                last = crc[-1]
            yield n_words, np.concatenate([text, of]), np.concatenate([crc, windows]).astype(np.int64) % self.buckets


class _Buckets:
    """Documents to (doc_id, n_words, buckets): the features' buckets as little-endian numbers."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, kind = Features(self.buckets), _kind(self.buckets)
        for batch, texts in blocks(batches):
            n_words, parts = np.zeros(len(texts), np.int64), []
            for words, text, bucket in features.of(texts):
                n_words += words
                parts.append((text, bucket.astype(kind)))
            text, bucket = (np.concatenate(x) for x in zip(*parts))
            bucket = bucket[np.argsort(text, kind="stable")] if len(texts) > 1 else bucket
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int64) * kind.itemsize
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(bucket)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), cells.cast(pa.binary())],
                                             names=["doc_id", "n_words", "buckets"])


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _cells(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows of a batch, and how many each row has."""
    column = batch.column(batch.schema.get_field_index("buckets"))
    bounds = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64,
                           count=column.offset + len(column) + 1)[column.offset:]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return held.view(kind), np.diff(bounds).astype(np.int64) // kind.itemsize


class _Histogram:
    """Rows of buckets to (bucket, features), once for each bucket of a task."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(self.buckets, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch, _kind(self.buckets))[0], minlength=self.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


class _Weights:
    """Rows of buckets to (doc_id, n_words, n_features, weight)."""

    def __init__(self, gains: np.ndarray):
        self.gains = gains

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n = _cells(batch, _kind(len(self.gains)))
            sums = np.concatenate([[0], np.cumsum(self.gains[bucket])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])


def bucketed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets) of (doc_id, text): the buckets of a text's features as one binary value."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(_Buckets(buckets), f"doc_id {kind}, n_words long, buckets binary")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; the aggregate has at most ``buckets`` rows."""
    counted = (rows.select("buckets").mapInArrow(_Histogram(buckets), "bucket long, n long")
                   .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def gains(all_documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) for each bucket."""
    buckets = len(target)
    s_all, t_all = int(all_documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
                     for s, t in zip(all_documents.tolist(), target.tolist())], np.int64)


def resample(documents: DataFrame, target: DataFrame, draw: Draw = Draw(), buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null if it is not drawn)."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = stage(bucketed(texts, buckets), "buckets")
    wanted = bucketed(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), buckets)
    gain = gains(histogram(rows, buckets), histogram(wanted, buckets))
    weighed = rows.mapInArrow(_Weights(gain), f"doc_id {kind}, n_words long, n_features long, weight long")
    mark = F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long"))
    out = ["doc_id", "n_features", "weight", "score"]
    # documents below the least number of words come after all others and take no part in the quota
    ordered = dense_order(scored.withColumn("_small", F.coalesce(F.col("n_words") < draw.min_words, F.lit(True))),
                          "_small", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", out_col="_ord")
    quota = ordered.agg(F.expr(f"count_if(NOT _small) * {int(draw.percent)} DIV 100")).scalar()
    return ordered.select(*out, F.when(F.col("_ord") <= quota, F.col("_ord")).alias("rank"))

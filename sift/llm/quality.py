"""Quality rules on whole texts, with suffix-array repetition.

The words of a block of texts become integer symbols; one suffix array over all
of them (a suffix ends with its text, and only suffixes of one text are
compared) gives the common prefixes of neighbouring suffixes.  The longest
common prefix of a suffix with either neighbour is the longest string there
that the text holds twice; taken together these are the maximal repeated
substrings, the intervals of the common-prefix array.  Their spans are united.
A text is rejected when the union of spans of ``min_words`` words or more
covers more than ``max_covered`` of its words, or when a repeat is longer than
``max_longest`` words.

Base rules: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PERCENT``
percent of the words inside five-word windows found twice or more.  A window
occurs twice exactly when its suffix shares five words with a neighbour, so
that number comes from the same array.

Defined cases: a null text has no words and fails the base; rows are judged one
by one, so ties and repeated rows do not matter; a very long text is a block of
its own; extra columns are ignored by ``quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.arrow import BLOCK_BYTES, blocks
from sift.llm.suffix import covered, suffix_sort

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Bytes of text under one suffix array: its ranks and keys take several times as much memory.
BLOCK = BLOCK_BYTES // 2

_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, longest_repeat long, covered_words long")


@dataclass(frozen=True)
class RepeatLimits:
    min_words: int = 10
    max_covered: float = 0.20
    max_longest: int = 100


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set positions in each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _bounds(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int64)


def word_symbols(words: list[list[bytes]]) -> np.ndarray:
    """Words as integers, equal for equal words of the block."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    total = sum(map(len, words))
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, total)


def longest_repeats(symbols: np.ndarray, bounds: np.ndarray, at_least: int = WINDOW) -> np.ndarray:
    """For each position, the length of the longest string from there that its text holds twice (0 if under ``at_least``)."""
    repeat = np.zeros(len(symbols), np.int64)
    if len(symbols) < 2:
        return repeat
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    suffixes = suffix_sort(text * (int(symbols.max()) + 1) + symbols, bounds[1:][text])
    # the deepest level that is still at or below the least length tells which neighbours can matter
    gate = max((level for level in suffixes.levels if level[0] <= at_least), key=lambda level: level[0])[1]
    i, j = suffixes.array[:-1], suffixes.array[1:]
    near = gate[i] == gate[j]
    i, j = i[near], j[near]
    length = suffixes.common_prefix(i, j)
    long = length >= at_least
    np.maximum.at(repeat, i[long], length[long])
    np.maximum.at(repeat, j[long], length[long])
    return repeat


def judge(texts: list[bytes], limits: RepeatLimits) -> dict[str, np.ndarray]:
    """The rules' columns for a block of texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = _bounds([len(t) for t in texts])
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    words = [t.split() for t in texts]  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    n_words = np.array([len(w) for w in words], np.int64)
    bounds = _bounds(n_words)
    repeat = longest_repeats(word_symbols(words), bounds)
    starts = np.flatnonzero(repeat >= WINDOW)
    n_repeat = _per_text(covered(starts, repeat[starts], len(repeat)), bounds)
    starts = np.flatnonzero(repeat >= limits.min_words)
    n_covered = _per_text(covered(starts, repeat[starts], len(repeat)), bounds)
    longest = np.zeros(len(texts), np.int64)
    if len(repeat):
        some = n_words > 0
        longest[some] = np.maximum.reduceat(repeat, bounds[:-1][some])
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        # every byte outside white space belongs to a word; continuation bytes are not code points of their own
        "word_chars": _per_text(~space[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": _per_text(symbol[data], at),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (n_covered <= limits.max_covered * n_words) & (longest <= limits.max_longest),
        "longest_repeat": longest,
        "covered_words": n_covered,
    }


class Judge:
    """Arrow batches whose last column is ``text``: the other columns and the rules' columns."""

    def __init__(self, limits: RepeatLimits):
        self.limits = limits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=BLOCK):
            verdict = judge(texts, self.limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, verdict.values())], names=["doc_id", *verdict])


def quality(documents: DataFrame, limits: RepeatLimits = RepeatLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts, base_failed, kept, longest_repeat, covered_words."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(Judge(limits), f"doc_id {kind}, {_SCHEMA}")


class Sieve:
    """Arrow batches of whole rows: those whose text passes."""

    def __init__(self, limits: RepeatLimits, text_col: str):
        self.limits, self.text_col = limits, text_col

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, self.text_col, BLOCK):
            yield batch.filter(pa.array(judge(texts, self.limits)["kept"]))


def keep_good(documents: DataFrame, limits: RepeatLimits = RepeatLimits(), text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text passes, with all their columns."""
    return documents.mapInArrow(Sieve(limits, text_col), documents.schema)

"""Token-id files, compressed by Re-Pair, with random access.

Documents are laid out in ascending id order (a range partitioning, then a sort
inside each partition).  Each task encodes its texts with the tokenizers
library and writes shards of about ``SHARD_IDS`` ids.  A shard is a grammar:
rounds of Re-Pair count all neighbouring pairs, turn the frequent ones into
nonterminals and replace them, until no pair is found ``MIN_COUNT`` times.  A
round takes every frequent pair, most frequent first, that cannot
overlap one already taken, so one pass over the ids serves many pairs.  Pairs
never cross a document's end.  A pair of old symbols never gets more frequent, so
a round counts only places that the last one found in full buckets or changed.

The file is a Parquet table (its commit protocol survives lost executors), one
row per shard: part, shard, doc_ids, n_ids, and the grammar's bytes::

    magic "RPR1" | n_docs n_terminals n_rules n_symbols  (4 x u64)
    rules   n_rules x 2 x u32      left and right symbol; symbols from n_terminals on are rules
    lengths n_rules x u32          ids that the rule expands to
    docs    (n_docs + 1) x u64     first symbol of each document
    ids     (n_docs + 1) x u64     first id of each document, counted from the shard's start
    symbols n_symbols x u32

``read_ids`` decodes any stretch of a document by skipping whole symbols by
their expansion lengths.

Defined cases: a null text is empty and has only the end id; a null document id
comes first; rows with equal ids follow each other, ordered by text; a very
long text is a shard of its own; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from sift.llm.arrow import blocks, once, single
from sift.llm.bpe import byte_alphabet, char_runs
from sift.llm.scratch import stage

END_ID = 2
SHARD_IDS = 1 << 20
#: A rule takes 12 bytes (two symbols and a length) and saves 4 wherever it stands: from 4 places on the file shrinks.
MIN_COUNT = 4
MAGIC = b"RPR1"
#: Entries of a worker's word table before a new one is started (memory bound).
WORD_TABLE = 1 << 18

#: Kinds of characters, contractions with one letter and with two.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_ONE, _TWO = np.array([ord(c) for c in "stmd"], np.uint32), [tuple(map(ord, pair)) for pair in ("re", "ve", "ll")]

FILE = "part int, shard int, doc_ids array<long>, n_ids long, grammar binary"


def _limit(text: str) -> int:
    """The first plane's end if all code points lie below it, else the end of all."""
    return 0x10000 if len(text.encode("utf-16-le")) == 2 * len(text) else 0x110000


class _Words(dict):
    """Each word's ids as bytes; ``old`` is the table that was full before, from which words still in use are taken over."""

    def __init__(self, tokenize: Callable, packed: list[bytes], letters: dict, old: dict):
        self.tokenize, self.packed, self.letters, self.old = tokenize, packed, letters, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # a word is normalised and cut already: only the library's model is left to apply
            # (printable ASCII stands for itself in the byte alphabet)
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            packed = self.packed
            ids = b"".join([packed[token.id] for token in self.tokenize(letters)])
        self[word] = ids
        return ids


class WordTokenizer:
    """A tokenizer file whose normaliser is NFC, one space for white space and lower case.

    The library encodes each different word once; a text is cut into words as
    the file's pre-tokenizer cuts it.  Texts on which that could differ (special
    tokens in them, code points unknown to Python, lower-casing that undoes NFC) go
    to the library whole.
    """

    def __init__(self, path: str):
        # Spark runs a task per core; the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letters = {byte: letter for letter, byte in byte_alphabet().items()}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        packed = [struct.pack("=I", i) for i in range(self.size)]
        self.new_words = partial(_Words, self.library.model.tokenize, packed, self.letters)
        self.words = self.new_words({})

    @staticmethod
    @once
    def _kinds() -> np.ndarray:
        """Each code point's kind, by the library's own regular expressions."""
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_SPACE, r"\s"), (_DIGIT, r"\p{N}"), (_LETTER, r"\p{L}")):
            for run in char_runs(pattern):
                kinds[ord(run[0]):ord(run[-1]) + 1] = kind
        return kinds

    @staticmethod
    @once
    def _unknown(limit: int) -> re.Pattern:
        """Code points that Python's tables do not have; the library's may be newer."""
        runs = groupby(range(limit), lambda c: unicodedata.category(chr(c)) == "Cn")
        spans = (list(run) for unknown, run in runs if unknown)
        return re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in spans) + "]")

    def _normal(self, text: str) -> str | None:
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return text.lower()
        # the library lower-cases character by character, so a final sigma is an ordinary one
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self._unknown(_limit(text)).search(text) or not unicodedata.is_normalized("NFC", low):
            return None
        return low

    def _cut(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The words of all texts, and where each text's words begin (and the last one's end).

        Words are contractions, runs of letters, single digits and runs of other
        characters, as the file's pre-tokenizer takes them from left to right.
        """
        data = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        kind = self._kinds()[data]
        starts = np.ones(len(data), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        kept = kind != _SPACE
        starts &= kept
        # an apostrophe that is a run by itself takes the letters of a contraction; what letters follow are a word
        quote = np.flatnonzero(data[:-1] == ord("'"))
        quote = quote[starts[quote]]
        first, second = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        takes = np.isin(first, _ONE).astype(np.int64)
        for a, b in _TWO:
            takes[(first == a) & (second == b) & (quote + 2 < len(data))] = 2
        quote, takes = quote[takes > 0], takes[takes > 0]
        starts[quote + 1] = False
        after = quote + takes + 1
        after = after[after < len(data)]
        starts[after[kind[after] == _LETTER]] = True
        # each word gets a space before it
        kept = np.flatnonzero(kept)
        place = np.cumsum(starts[kept].view(np.uint8) + np.uint8(1), dtype=np.int64)
        spaced = np.full(int(place[-1]) if len(place) else 0, 0x20, np.uint32)
        spaced[place - 1] = data[kept]
        ends = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = np.searchsorted(np.flatnonzero(starts), ends)
        return spaced.tobytes().decode("utf-32-le").split(" ")[1:], bounds.tolist()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        normal = [self._normal(t) for t in texts]
        words, bounds = self._cut([t for t in normal if t is not None])
        if len(self.words) > WORD_TABLE:
            self.words.old = {}
            self.words = self.new_words(self.words)
        get, spans = self.words.__getitem__, zip(bounds[:-1], bounds[1:])
        return [np.frombuffer(b"".join(map(get, words[slice(*next(spans))])), np.uint32) if low is not None
                else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                for t, low in zip(texts, normal)]

    @property
    def size(self) -> int:
        return self.library.get_vocab_size()


@single
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed >>= np.uint64(64 - bits)
    return mixed.astype(np.int32)


def _frequent_pairs(keys: np.ndarray, least: int) -> np.ndarray:
    """Keys found ``least`` times or more, most frequent first."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    often = times >= least
    found, times = keys[first[often]], times[often]
    return found[np.argsort(-times, kind="stable")]


def _compatible(pairs: np.ndarray) -> np.ndarray:
    """The pairs, in order, that cannot overlap an earlier one: no symbol both begins one and ends another."""
    first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    n = int(max(first.max(), second.max())) + 1 if len(pairs) else 0
    begins, ends, taken = bytearray(n), bytearray(n), []
    for number, (a, b) in enumerate(zip(first.tolist(), second.tolist())):
        if ends[a] or begins[b]:
            continue
        begins[a] = ends[b] = 1
        taken.append(number)
    return pairs[taken]


def compress(ids: np.ndarray, starts: np.ndarray, n_terminals: int,
             least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each document and the end, rules, expansion lengths)."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[starts[1:][starts[1:] > 0] - 1] = True
    last[-1:] = True
    # replaced symbols stay in place; each one left knows its neighbours
    after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
    live, left = ~last, np.ones(len(symbols), bool)
    rules: list[np.ndarray] = []
    first = n_terminals
    while True:
        places = np.flatnonzero(live)
        keys = symbols[places].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= symbols[after[places]]
        bits = min(20, max(8, len(places).bit_length()))
        bucket = _bucket(keys, bits)
        # counts by hash bucket are upper bounds: places in small buckets need no exact count, now or later
        full = (np.bincount(bucket, minlength=1 << bits) >= least)[bucket]
        live[places] = full
        full = np.flatnonzero(full)
        places, keys, bucket = places[full], keys[full], bucket[full]
        pairs = _compatible(_frequent_pairs(keys, least))
        if not len(pairs):
            break
        # a key is compared with the pair that its bucket names, and searched for only where a bucket has several
        own = _bucket(pairs, bits)
        named = np.full(1 << bits, -1, np.int32)
        named[own] = np.arange(len(pairs))
        rule = named[bucket]
        near = np.flatnonzero(rule >= 0)
        rule, wanted = rule[near], keys[near]
        hidden = np.flatnonzero(named[own] != np.arange(len(pairs)))
        if len(hidden):
            several = np.zeros(1 << bits, bool)
            several[own[hidden]] = True
            again = np.flatnonzero(several[bucket[near]])
            order = np.argsort(pairs)
            rule[again] = order[np.minimum(np.searchsorted(pairs[order], wanted[again]), len(pairs) - 1)]
        same = pairs[rule] == wanted
        at, rule = places[near[same]], rule[same]
        double = symbols[at] == symbols[after[at]]
        if double.any():
            # in a run of one symbol, every other pair is taken, from the run's start
            d = at[double]
            begin = np.concatenate([[True], after[d[:-1]] != d[1:]])
            run = np.maximum.accumulate(np.where(begin, np.arange(len(d)), 0))
            drop = np.zeros(len(at), bool)
            drop[double] = (np.arange(len(d)) - run) % 2 == 1
            at, rule = at[~drop], rule[~drop]
        symbols[at] = (first + rule).astype(np.uint32)
        gone = after[at]
        left[gone] = live[gone] = False
        last[at] = last[gone]
        after[at] = after[gone]
        inner = after[at] < len(symbols)
        before[after[at[inner]]] = at[inner]
        changed = np.concatenate([at, before[at]])
        changed = changed[changed >= 0]
        live[changed] = ~last[changed]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        first += len(pairs)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    symbols, last = symbols[left], last[left]
    # documents that hold an id end at the marked symbols; an empty one starts where the next does
    ends = np.zeros(len(starts), np.int64)
    filled = np.flatnonzero(np.diff(starts) > 0)
    ends[filled + 1] = np.flatnonzero(last) + 1
    lengths = np.ones(n_terminals + len(table), np.int64)
    done = n_terminals
    for new in rules:
        lengths[done:done + len(new)] = lengths[new].sum(axis=1)
        done += len(new)
    return symbols, np.maximum.accumulate(ends), table, lengths[n_terminals:].astype(np.uint32)


def pack(ids: np.ndarray, starts: np.ndarray, n_terminals: int) -> bytes:
    symbols, docs, rules, lengths = compress(ids, starts, n_terminals)
    head = struct.pack("<4Q", len(starts) - 1, n_terminals, len(rules), len(symbols))
    return b"".join([MAGIC, head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), docs.astype("<u8").tobytes(),
                     starts.astype("<u8").tobytes(), symbols.astype("<u4").tobytes()])


class Grammar:
    """A shard's bytes, read without copying."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token grammar")
        n_docs, self.n_terminals, n_rules, n_symbols = struct.unpack_from("<4Q", data, 4)
        at = 4 + 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.docs, self.starts = take("<u8", n_docs + 1), take("<u8", n_docs + 1)
        self.symbols = take("<u4", n_symbols)
        self.sizes = np.concatenate([np.ones(self.n_terminals, np.int64), self.lengths])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols: each knows its place, and a pass opens only the rules that are left."""
        size = self.sizes[symbols]
        place = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.uint32)
        while True:
            rule = symbols >= self.n_terminals
            ids[place[~rule]] = symbols[~rule]
            if not rule.any():
                return ids
            place, pairs = place[rule], self.rules[symbols[rule] - self.n_terminals]
            place = np.concatenate([place, place + self.sizes[pairs[:, 0]]])
            symbols = np.concatenate([pairs[:, 0], pairs[:, 1]])

    def read_ids(self, doc: int, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of one document, opening only the symbols that hold them."""
        symbols = self.symbols[self.docs[doc]:self.docs[doc + 1]]
        stop = np.cumsum(self.sizes[symbols])
        first, last = np.searchsorted(stop, begin, side="right"), np.searchsorted(stop, end, side="left") + 1
        skipped = int(stop[first - 1]) if first else 0
        return self.expand(symbols[first:last])[begin - skipped:max(begin, end) - skipped]


class Writer:
    """Arrow batches of (doc_id, text) in id order to rows of the file."""

    def __init__(self, path: str, end_id: int, shard_ids: int):
        self.path, self.end_id, self.shard_ids = path, end_id, shard_ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = tokenizer(self.path), TaskContext.get().partitionId(), 0
        end = np.array([self.end_id], np.uint32)
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0
        for batch, texts in blocks(batches, coder=coder):
            encoded = coder.encode([t.decode() for t in texts])
            for doc_id, one in zip(batch.column(0).to_pylist(), encoded):
                ids.append(np.concatenate([one, end]))
                doc_ids.append(doc_id)
                held += len(one) + 1
                if held >= self.shard_ids:
                    yield self._row(part, shard, doc_ids, ids, coder.size)
                    shard, ids, doc_ids, held = shard + 1, [], [], 0
        if doc_ids:
            yield self._row(part, shard, doc_ids, ids, coder.size)

    @staticmethod
    def _row(part: int, shard: int, doc_ids: list, ids: list[np.ndarray], n_terminals: int) -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(i) for i in ids])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
             pa.array([int(starts[-1])], pa.int64()), pa.array([pack(np.concatenate(ids), starts, n_terminals)], pa.binary())],
            names=["part", "shard", "doc_ids", "n_ids", "grammar"])


def write_tokens(documents: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The file's rows; ``path`` is a tokenizer JSON file."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
                 .mapInArrow(Writer(path, end_id, shard_ids), FILE))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, doc_ids, data in zip(*(batch.column(n).to_pylist() for n in ("part", "shard", "doc_ids", "grammar"))):
            grammar = Grammar(data)
            ids = grammar.expand(grammar.symbols).astype("<u4")
            starts = grammar.starts.astype(np.int64)
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(doc_ids, pa.int64()),
                 pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_back(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the file."""
    sizes = file.select("part", "shard", "n_ids")
    # the running total over parts has one row per part; that over shards runs inside each part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.join(parts, "part").select("part", "shard", (F.col("part_start") + F.coalesce(inside, F.lit(0))).alias("shard_start"))
    rows = file.select("part", "shard", "doc_ids", "grammar").mapInArrow(
        _read, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return (rows.join(shards, ["part", "shard"])
                .select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(documents: DataFrame, path: str, **options) -> DataFrame:
    """Write the file to the shared folder and read every document back from it."""
    return read_back(stage(write_tokens(documents, path, **options), "token-grammar"))

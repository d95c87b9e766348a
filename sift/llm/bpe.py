"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton accepts exactly the token sequences that BPE produces.  It starts
as one state with an arc per byte, and every merge ``a b -> c``, in rank order,
is a gadget applied to it:

* the state that ``a`` arcs enter is split: arcs labelled ``a`` now enter a
  copy that has no ``b`` arc, so the pair cannot stand unmerged any more;
* wherever an ``a`` arc led to a state with a ``b`` arc, a ``c`` arc is added
  that enters the state the ``b`` arc entered.

All arcs with one label enter one state, so a state is named by its label and
the automaton has one state per token.  Written out, its table would have
(tokens)^2 arcs, nearly all of them present; what is stored is what the gadgets
did: the arcs taken away from each copy with the time (``removed``) and what
each state was copied from and when (``lineage``).  ``step`` reads a transition
from that and keeps it in a table, so encoding is a walk through table lookups:
from the left, the longest token whose arc exists, stepping back when a branch
ends.  The accepted path of a word is unique.  Decoding emits the labels (byte
strings) of the arcs.

Words are pre-split as the byte-level tokenizer files ask: special tokens
first, then letters, digits, other characters and white space.  Character
classes are asked of the tokenizers library, so both follow one Unicode version.

Defined cases: a null text is encoded as an empty one; special tokens inside a
text become their ids, as in the file's default; very long words are walked
with an explicit stack; a merge whose pair can never stand side by side adds no
arc.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from sift.llm.arrow import blocks, once, single

#: Entries in a worker's table of encoded words before a new one is started (memory bound, not a limit on input).
WORD_TABLE = 1 << 17

_FOREVER = 1 << 60
_TOKEN = 256


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + i): b for i, b in enumerate(spare)})
    return letters


@once
def char_runs(pattern: str) -> tuple[str, ...]:
    """The runs of code points that match, by the tokenizers library's own regular expressions (its Unicode version)."""
    cut = Split(Regex(pattern + "+"), "removed", invert=True)
    # the library keeps offsets of every character, so it is asked a slice at a time
    slices = ("".join(map(chr, range(at, at + (1 << 11)))) for at in range(0, 0x110000, 1 << 11) if not 0xD800 <= at < 0xE000)
    return tuple(run for part in slices for run, _ in cut.pre_tokenize_str(part))


def char_class(pattern: str, limit: int = 0x110000) -> str:
    """The inside of a character class with the code points below ``limit`` that have a Unicode property."""
    ends = ((ord(run[0]), min(ord(run[-1]), limit - 1)) for run in char_runs(pattern))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends if a < limit)


@once
def word_pattern(limit: int = 0x110000) -> re.Pattern:
    """The byte-level pre-split: contractions, letters, digits, other runs (each with one space before), white space.

    For texts with no code point from ``limit`` on; ``re`` tests small classes through a bitmap and long ones range by range.
    """
    letter, digit, space = (char_class(p, limit) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+")


def presplit(text: str) -> list[str]:
    if text.isascii():
        return word_pattern(0x80).findall(text)
    # as many UTF-16 units as characters: no code point above the first plane
    basic = len(text.encode("utf-16-le")) == 2 * len(text)
    return word_pattern(0x10000 if basic else 0x110000).findall(text)


class MergeAutomaton:
    """Tokens are ids; ``labels[id]`` are a token's bytes; merges are (a, b, c) ids in rank order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.removed: dict[int, dict[int, int]] = {}
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.lineage: dict[int, list[tuple[int, int]]] = {}
        merged = {c for _, _, c in merges}
        if len(merged) != len(merges):
            raise ValueError("two merges make the same token")
        self.tokens: dict[bytes, int] = {}
        for token, label in labels.items():
            if token not in merged:
                self.lineage[token] = [(token, _FOREVER)]
                self.tokens[label] = token
        self.table: dict[int, bool] = {}
        for time, (a, b, c) in enumerate(merges):
            self._gadget(time, a, b, c)
        self.table.clear()  # what it has was true at an earlier time
        self.arcs: dict = {}      # the labels as a trie: byte -> node, and under _TOKEN the label's token
        for label, token in self.tokens.items():
            node = self.arcs
            for byte in label:
                node = node.setdefault(byte, {})
            node[_TOKEN] = token

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        alive = a in self.lineage and b in self.lineage
        if not alive or not self._has_arc(a, b):
            return
        # the state that c enters is the one b entered so far: b's, as it was at this time
        self.lineage[c] = [(c, _FOREVER)] + [(x, min(until, time)) for x, until in self.lineage[b]]
        self.removed.setdefault(a, {})[b] = time
        self.left[c], self.born[c] = a, time
        self.tokens[self.labels[c]] = c

    def _has_arc(self, state: int, token: int) -> bool:
        """Does the state that ``state`` arcs enter have an arc for ``token``?

        The arc was taken away if, in the state's lineage, the token itself was
        removed, or the token its arc was derived from was removed before that.
        """
        until = _FOREVER
        while True:
            for ancestor, copied in self.lineage[state]:
                gone = self.removed.get(ancestor)
                if gone is not None:
                    time = gone.get(token, _FOREVER)
                    if time < copied and time <= until and time < _FOREVER:
                        return False
            if token not in self.left:
                return True
            token, until = self.left[token], self.born[token]

    def step(self, state: int, token: int) -> bool:
        key = state << 32 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 8 * WORD_TABLE:
                self.table.clear()
            known = self.table[key] = self._has_arc(state, token)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The one accepted path that spells the word."""
        whole = self.tokens.get(word)
        if whole is not None or not word:
            return [whole] if word else []
        end, step = len(word), self.step
        path: list[tuple[int, int]] = []                                   # (token, where it ends)
        options = [self._labels_at(word, 0)]                               # those not tried yet, longest last
        dead: set[tuple[int, int]] = set()
        while options:
            state = path[-1][0] if path else None
            tried = options[-1]
            while tried:
                arc = tried.pop()
                if (state is None or step(state, arc[0])) and arc not in dead:
                    path.append(arc)
                    if arc[1] == end:
                        return [token for token, _ in path]
                    options.append(self._labels_at(word, arc[1]))
                    break
            else:
                options.pop()
                if path:
                    dead.add(path.pop())
        raise ValueError(f"no tokens spell {word!r}")

    def _labels_at(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(token, end) of every label that stands in the word at ``at``, shortest first."""
        node, found = self.arcs, []
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            token = node.get(_TOKEN)
            if token is not None:
                found.append((token, i + 1))
        return found


class ByteLevelCodec:
    """A byte-level BPE tokenizer file (JSON) as an automaton with its pre-split and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        labels = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = labels | {i: s.encode() for s, i in self.special.items()}
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._words = _WordTable(self.automaton)

    def encode(self, text: str) -> np.ndarray:
        words = self._words.__getitem__
        if self._cut is None or self._cut.search(text) is None:
            return np.frombuffer(b"".join(map(words, presplit(text))), np.int32)
        packed: list[bytes] = []
        for part in self._cut.split(text):
            if part in self.special:
                packed.append(np.int32(self.special[part]).tobytes())
            else:
                packed.extend(map(words, presplit(part)))
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids.tolist()))


class _WordTable(dict):
    """Encoded words (ids as packed int32), filled by the automaton.

    A full table becomes the old one, from which words still in use are taken over.
    """

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.automaton.encode(word.encode()), np.int32).tobytes()
        if len(word) < 64:
            if len(self) >= WORD_TABLE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@single
def codec(path: str) -> ByteLevelCodec:
    """One compiled automaton per worker process, as long as its tasks encode."""
    return ByteLevelCodec(path)


class RoundTrip:
    """Arrow batches of (doc_id, text) to (doc_id, ids, decoded)."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(self.path)
        for batch, texts in blocks(batches, coder=coder):
            ids = [coder.encode(t.decode()) for t in texts]
            decoded = [coder.decode(i) for i in ids]
            ends = np.cumsum([0] + [len(i) for i in ids], dtype=np.int64).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(decoded, pa.binary()).cast(pa.string())],
                names=["doc_id", "ids", "decoded"])


def encode_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every text; ``tokenizer`` is the path of a byte-level BPE JSON file."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(RoundTrip(tokenizer), f"doc_id {kind}, ids array<int>, decoded string")

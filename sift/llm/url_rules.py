"""URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

Every glob rule becomes a run of bits, one per character; ``*`` sets a
self-loop on the bit before it.  All rules are packed into as many 64-bit
words as they need, and one step per byte moves all states of all rules at
once: ``state = ((state << 1 | start) & accepts[byte]) | (state & loops)``,
the shift carrying from word to word.  numpy runs the step over all URLs of a
block together, so the cost follows the longest URL of a block, not the number
of rules.  Patterns match the whole canonical URL: its lower-cased host with a
dot before it, the byte 0xFF (which no UTF-8 text contains), then the path.

A domain rule ``host/path`` fits its host, all subdomains, and paths that start
with its path; it is the glob ``*.host<FF>path*``.  The longest fitting domain
rule decides.  Where none fits, the wildcard rules do: the first of them, in
the order given, that fits blocks the URL; otherwise it is allowed.

Defined cases: a null URL, or one without ``://``, has empty host and path and
is allowed by the method; an empty table gives an empty result; rows with equal
URLs are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.arrow import BLOCK_BYTES, blocks

SEPARATOR = b"\xff"

#: (action, host, path); the longest that fits wins.
DOMAIN_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
                ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Globs over host and path, ``*`` for any run of bytes; each blocks.
WILDCARD_RULES = (("*spam-*", "*"), ("*.cheap-*", "*"), ("*casino*", "*"), ("*", "*/wp-login*"), ("*", "*.exe"),
                  ("*", "*/cgi-bin/*"), ("*", "*/../*"))


@dataclass(frozen=True)
class Automaton:
    accepts: np.ndarray   # 256 x words: bits whose character the byte is
    start: np.ndarray     # words: first bits of the patterns (alive before the first byte only)
    loops: np.ndarray     # words: bits that stay while any byte passes
    final: np.ndarray     # (pattern, 2): word and shift of each pattern's last bit
    n_words: int


def compile_globs(patterns: list[bytes]) -> Automaton:
    """Pack the globs into multiword masks; each pattern has a leading bit that stands for "nothing read yet"."""
    bits = sum(1 + len(p.replace(b"*", b"")) for p in patterns)
    n_words = max(1, -(-bits // 64))
    accepts = np.zeros((256, n_words), np.uint64)
    start, loops = np.zeros(n_words, np.uint64), np.zeros(n_words, np.uint64)
    final, at = [], 0

    def put(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    for pattern in patterns:
        put(start, at)
        for char in pattern:
            if char == ord("*"):
                put(loops, at)
            else:
                at += 1
                put(accepts[char], at)
        final.append((at // 64, at % 64))
        at += 1
    return Automaton(accepts, start, loops, np.array(final, np.int64).reshape(-1, 2), n_words)


def simulate(automaton: Automaton, texts: list[bytes]) -> np.ndarray:
    """(text, pattern) matrix: does the whole text match the pattern?"""
    n = len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-length, kind="stable")          # the texts still being read stay in front
    data = np.frombuffer(b"".join(texts), np.uint8) if n else np.zeros(0, np.uint8)
    begin = (np.cumsum(length) - length)[order]
    length = length[order]
    state = np.tile(automaton.start, (n, 1))
    one, last = np.uint64(1), np.uint64(63)
    for step in range(int(length[0]) if n else 0):
        alive = int(np.searchsorted(-length, -step, side="left"))
        now = state[:alive]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> last
        state[:alive] = (moved & automaton.accepts[data[begin[:alive] + step]]) | (now & automaton.loops)
    word, shift = automaton.final[:, 0], automaton.final[:, 1].astype(np.uint64)
    hits = np.zeros((n, len(word)), bool)
    hits[order] = (state[:, word] >> shift) & one != 0
    return hits


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    mark = -1 if url is None else url.find(b"://")
    if mark < 0:
        return b"", b""
    rest = url[mark + 3:]
    for end in (b"#", b"?"):
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


class UrlJudge:
    """Compiles both rule sets into one automaton; called with Arrow batches of (id, url)."""

    def __init__(self, domain_rules=DOMAIN_RULES, wildcard_rules=WILDCARD_RULES):
        self.domain_rules, self.wildcard_rules = tuple(domain_rules), tuple(wildcard_rules)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain = [(action, host + path, b"*." + host.encode() + SEPARATOR + path.encode() + b"*")
                  for action, host, path in self.domain_rules]
        domain.sort(key=lambda r: -len(r[1]))
        wild = [host.encode() + SEPARATOR + path.encode() for host, path in self.wildcard_rules]
        automaton = compile_globs([r[2] for r in domain] + wild)
        names = [r[1] for r in domain] + [None] * (len(wild) + 1)
        verdicts = [r[0] for r in domain] + ["block"] * len(wild) + ["allow"]
        pattern = [None] * len(domain) + [h + p for h, p in self.wildcard_rules] + [None]
        # a state is a few words a URL, so blocks are kept to a quarter of the usual bytes
        for batch, urls in blocks(batches, "url", BLOCK_BYTES // 4):
            parts = [split_url(u) for u in urls]
            hits = simulate(automaton, [b"." + h + SEPARATOR + p for h, p in parts])
            known = np.array([u != b"" for u in urls]) & np.array([b"://" in u for u in urls])
            hits[~known] = False
            first = np.where(hits.any(axis=1), hits.argmax(axis=1), len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.decode() for h, _ in parts], pa.string()),
                 pa.array([p.decode() for _, p in parts], pa.string()),
                 pa.array([names[i] for i in first], pa.string()), pa.array([verdicts[i] for i in first], pa.string()),
                 pa.array([pattern[i] for i in first], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "wildcard"])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               domain_rules=DOMAIN_RULES, wildcard_rules=WILDCARD_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, wildcard (the blocking glob, if one decided)."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(UrlJudge(domain_rules, wildcard_rules),
                           f"page_id {kind}, host string, path string, rule string, verdict string, wildcard string")

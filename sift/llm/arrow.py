"""Small helpers for Arrow-batched tasks: whole texts as bytes, in bounded blocks."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: Bytes of text that one numpy pass looks at together (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20
#: Rows of a batch that are turned into Python values at a time.
ROWS = 256
#: ASCII other than letters and digits: never inside a word, nor inside a multi-byte character.
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def texts_of(column: pa.Array, null: bytes | None = b"") -> list[bytes]:
    """The UTF-8 bytes of each value; a null becomes ``null``."""
    values = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
    return [null if v is None else v for v in values]


def once(make: Callable) -> Callable:
    """Keep a function's results for the life of the process: a task function that travels by value
    comes anew with each task, a loaded tokenizer need not."""
    name = f"{make.__module__}.{make.__qualname__}"

    @wraps(make)
    def get(*args):
        held = vars(sys).setdefault("_sift_once", {})
        if (name, args) not in held:
            held[name, args] = make(*args)
        return held[name, args]
    return get


def single(make: Callable) -> Callable:
    """Like ``once`` for results of many megabytes: of all such a process keeps the last one only,
    and tasks that do not work with it let it go (``blocks``)."""
    name = f"{make.__module__}.{make.__qualname__}"

    @wraps(make)
    def get(*args):
        held = vars(sys).get("_sift_single")
        if held is None or held[0] != (name, args):
            vars(sys).pop("_sift_single", None)
            held = vars(sys)["_sift_single"] = (name, args), make(*args)
        return held[1]
    return get


def _let_go(but: object) -> None:
    held = vars(sys).get("_sift_single")
    if held is not None and held[1] is not but:
        del vars(sys)["_sift_single"], held
        release()


def release() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = BLOCK_BYTES, coder: object = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text (one row at least), and their texts.

    ``coder`` is the ``single`` result that the task works with; another one that the worker has kept goes.
    """
    _let_go(coder)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        values: list[bytes] = []
        for at in range(0, batch.num_rows, ROWS):
            for i, value in enumerate(texts_of(column.slice(at, ROWS)), at):
                if values and size + len(value) > limit:
                    yield batch.slice(start, i - start), values
                    start, size, values = i, 0, []
                values.append(value)
                size += len(value)
        if values:
            yield batch.slice(start, len(values)), values
    release()


def chunks(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes, each but the last ending with a separator of words."""
    at = 0
    while len(text) - at > limit:
        found = _SEPARATOR.search(text, at + limit)
        if found is None:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:] if at else text

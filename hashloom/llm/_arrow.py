"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def rows(batches: Iterable[pa.RecordBatch], n: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``n`` rows, so that what an operator holds as Python objects stays small."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, and a lone surrogate (which valid columns never hold) becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")

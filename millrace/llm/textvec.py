"""Vectorised work on the texts of an Arrow column: words and their hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is worked on alone.
BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.Generator(np.random.PCG64(20240602)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _lookup(lower: bool, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint8)
    if lower:
        codes[65:91] += 32
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    return codes, apart


SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: All ASCII bytes but letters and digits.
PUNCTUATION_BYTES = bytes(b for b in range(128) if not chr(b).isalnum())
BY_SPACE = _lookup(True, SPACE_BYTES)
BY_PUNCTUATION = _lookup(True, PUNCTUATION_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i under n."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins, with the end last; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_blocks(bounds: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``limit`` bytes of text, or of one row, and of at most 60,000 rows."""
    _, bounds = column_bytes(batch.column(text_at))
    for i, j in row_blocks(bounds, limit):
        for a in range(i, j, 60_000):
            yield batch.slice(a, min(j - a, 60_000))


def word_hashes(data: np.ndarray, bounds: np.ndarray, kind=BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of consecutive texts: hash, row, first byte and end. Words never cross texts."""
    codes, apart = kind
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = ~apart[data]
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    begins[bounds[bounds < n]] = True
    ends[bounds[bounds > 0] - 1] = True
    begins[1:] |= ~own[:-1]
    ends[:-1] |= ~own[1:]
    first, end = np.flatnonzero(own & begins), np.flatnonzero(own & ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[codes[data]] * up, out=total[1:])
    h = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
    return h, np.searchsorted(bounds, first, "right") - 1, first, end


def ngram_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total += words[at + j] * _STEPS[j]
    return mix(total + np.uint64(n)), at

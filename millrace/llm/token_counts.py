"""Token counts of document sections by character offsets of tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import column_bytes

#: Fixed value: the pattern that splits text before the merges of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of the whole text, and each token's characters as first and end. Tokens that share the bytes of one
    character all span that character."""
    encoding, sizes = _encoder(path, pattern)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    if not len(ids):
        return ids, ids, ids
    return ids, char[ends - sizes[ids]], char[ends - 1] + 1


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary. Sections are adjacent intervals given by
    their first characters, ascending and from 0; the join of tokens and intervals is one binary search each.

    A token that crosses goes whole to one section: by "first" to that of its first character, by "last" to that of its
    last, by "most" to the one with most of its characters, the earliest if several have."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, end - 1, "right") - 1
    crosses = a != b
    if rule == "last":
        return b, crosses
    if rule == "most":
        a = a.copy()
        for i in np.flatnonzero(crosses):
            cuts = np.concatenate(([first[i]], starts[a[i] + 1 : b[i] + 1], [end[i]]))
            a[i] += int(np.argmax(np.diff(cuts)))
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return a, crosses


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", path: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """Tokens of every line of every document, each document encoded once and whole.

    Returns one row for each line: doc_id, section int (from 0), char_start, char_end long, n_tokens long (allocated by
    ``rule``, see attribute()), n_crossing long (of these, the tokens that cross a boundary). The n_tokens of a document
    add up to its token count. A null or empty text has one empty section without tokens. Repeated rows and null ids
    give rows each; other columns are not read. An empty table gives an empty result.

    Nothing is shuffled; ``path`` is the vocabulary file, present on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, section int, char_start long, char_end long, n_tokens long, n_crossing long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, parts = batch.column(1), [], []
            data, bounds = column_bytes(texts)
            for i in range(batch.num_rows):
                text = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                raw = data[bounds[i] : bounds[i + 1]]
                char = np.cumsum((raw & 0xC0) != 0x80)
                starts = np.concatenate(([0], char[raw == 10])).astype(np.int64)
                size = int(char[-1]) if len(char) else 0
                _, first, end = token_spans(text, path, pattern)
                at, crosses = attribute(first, end, starts, rule)
                n = len(starts)
                counts = np.bincount(at, minlength=n), np.bincount(at[crosses], minlength=n)
                rows.append(np.full(n, i))
                parts.append((np.arange(n, dtype=np.int32), starts, np.append(starts[1:], size), *counts))
            if rows:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                arrays = [ids, pa.array(cols[0], pa.int32()), *(pa.array(c.astype(np.int64)) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return source.mapInArrow(work, schema)

"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .textvec import BY_PUNCTUATION, column_bytes, mix, ngram_hashes, row_blocks, word_hashes

_MODULUS, _RADIX = (1 << 61) - 1, 1_000_003


def _rolling(tokens: Sequence[int], free: Sequence[bool], s: int) -> Iterator[tuple[int, int]]:
    """Position and Karp-Rabin hash of every run of s free tokens."""
    lead, h, run = pow(_RADIX, s - 1, _MODULUS), 0, 0
    for i, x in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        if run >= s:
            h -= tokens[i - s] * lead
        h, run = (h * _RADIX + x) % _MODULUS, run + 1
        if run >= s:
            yield i - s + 1, h


def tiles(pattern: Sequence[int], text: Sequence[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping matches (in pattern, in text, length) of at least min_match tokens, the longest
    that is left each time, of equally long ones the first in the pattern and then in the text, in whatever order they
    stand in the text. Matches are searched at a length that falls as they get rarer; a search that meets one over twice as
    long begins again at that length. Of a match whose end has been marked meanwhile, what stands before counts again."""
    p_free, t_free = [True] * len(pattern), [True] * len(text)
    out: list[tuple[int, int, int]] = []
    s = min(len(pattern), len(text), max(min_match, 20))

    def length(i: int, j: int, most: int) -> int:
        k = 0
        while k < most and pattern[i + k] == text[j + k] and p_free[i + k] and t_free[j + k]:
            k += 1
        return k

    while s >= min_match:
        seeds = defaultdict(list)
        for i, h in _rolling(text, t_free, s):
            seeds[h].append(i)
        found, longest = [], 0
        for i, h in _rolling(pattern, p_free, s):
            for j in seeds.get(h, ()):
                k = length(i, j, min(len(pattern) - i, len(text) - j))
                if k >= s:
                    found.append((-k, i, j))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        heapq.heapify(found)
        while found:
            k, i, j = heapq.heappop(found)
            free = length(i, j, -k)
            if free == -k:
                p_free[i : i + free] = [False] * free
                t_free[j : j + free] = [False] * free
                out.append((i, j, free))
            elif free >= s:
                heapq.heappush(found, (-free, i, j))
        s = min_match if min_match < s <= 2 * min_match else s // 2 if s > min_match else 0
    return out


class _Index:
    """A block of test items: their tokens by hash, and their seeds."""

    #: Seed hits that are worked on at once.
    CHUNK = 1 << 21

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        texts = pa.array([x for _, x in items], pa.string())
        data, bounds = column_bytes(texts)
        words, row, _, _ = word_hashes(data, bounds, BY_PUNCTUATION)
        self.ids = [k for k, _ in items]
        self.rank = np.empty(len(items), np.int64)
        self.rank[sorted(range(len(items)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))] = np.arange(len(items))
        size = np.bincount(row, minlength=len(items))
        self.starts, self.all = np.concatenate(([0], np.cumsum(size))), words
        self.least = np.minimum(min_match, size)
        self.sizes = np.unique(self.least[size > 0]).tolist()
        seeds, at = [], []
        for n in self.sizes:
            own = np.flatnonzero(self.least[row] == n)
            h, j = ngram_hashes(words[own], row[own], n)
            seeds.append(h), at.append(own[j])
        h, at = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((seeds, np.uint64), (at, np.int64)))
        order = np.argsort(h, kind="stable")
        self.h, at = h[order], at[order]
        self.item = row[at]
        self.at = at - self.starts[self.item]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def words(self, item: int) -> np.ndarray:
        return self.all[self.starts[item] : self.starts[item + 1]]

    def hits(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each row with seeds: the row, the items, and the share of an item's tokens that seeds of the row cover; the
        most covered items first, of equal ones those of smaller ids."""
        found = [np.zeros(0, np.int64)]
        width = int(np.diff(self.starts).max(initial=0)) + 1
        for n in self.sizes:
            g, at = ngram_hashes(words, row, n)
            near = np.flatnonzero(self.maybe[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            # a document's seeds once each: a repeated one covers the same tokens
            _, once = np.unique(mix(g[near] ^ mix(row[at[near]].astype(np.uint64))), return_index=True)
            near = near[once]
            lo, hi = np.searchsorted(self.h, g[near], "left"), np.searchsorted(self.h, g[near], "right")
            near, lo, many = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(many)
            a = 0
            while a < len(near):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + self.CHUNK, "right")))
                k = np.repeat(lo[a:b] - (ends[a:b] - many[a:b]), many[a:b]) + np.arange(ends[a] - many[a], ends[b - 1])
                own = np.repeat(row[at[near[a:b]]], many[a:b])
                right = self.least[self.item[k]] == n
                found.append(((own * len(self.ids) + self.item[k]) * width + self.at[k])[right])
                a = b
        places = np.unique(np.concatenate(found))
        if not len(places):
            return
        pair, at = places // width, places % width
        n = self.least[pair % len(self.ids)]
        last = np.append(pair[1:] != pair[:-1], True)
        step = np.where(last, n, np.minimum(n, np.append(at[1:] - at[:-1], 0)))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        rows, items, covered = pair[first] // len(self.ids), pair[first] % len(self.ids), np.add.reduceat(step, first)
        share = covered / np.diff(self.starts)[items]
        order = np.lexsort((self.rank[items], -share, rows))
        rows, items, share = rows[order], items[order], share[order]
        for a, b in pairwise([*np.flatnonzero(np.append(True, rows[1:] != rows[:-1])).tolist(), len(rows)]):
            yield int(rows[a]), items[a:b], share[a:b]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for k, text in benchmark.select(F.col(item_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((k, text))
        size += len(text)
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.5,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """All columns of ``docs`` with what each document holds of the test items (columns so named are replaced):
    contaminated boolean (``coverage`` reached for some item), coverage double (the largest share of an item's tokens
    that tiles cover), item_id long (that item; the smallest of several; null without tiles), n_items long (items that
    reach ``coverage``).

    Tokens are runs of ASCII letters and digits and all non-ASCII characters, with A-Z lower-cased. Tiles have at least
    ``min_match`` tokens (all tokens of a shorter item) and count wherever they stand, so that reordered passages add up.
    Null, empty and token-free texts and items match nothing. Repeated rows, ids and items are treated each on their own.
    Empty tables give an empty result, or documents without matches.

    The test items are the stated query set. They go to the executors in blocks of at most ``block_chars`` characters;
    each block is a further narrow pass over the documents, and nothing is shuffled.
    """
    new = StructType(
        [StructField("contaminated", BooleanType()), StructField("coverage", DoubleType()), StructField("item_id", LongType()), StructField("n_items", LongType())]
    )
    kept = [c for c in docs.columns if c not in new.names]
    out = docs.select(*kept, F.lit(False).alias("contaminated"), F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_items"))
    schema = StructType([*docs.select(*kept).schema.fields, *new.fields])
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        out = out.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(items), kept.index(text_col), min_match, coverage), schema)
    return out


#: The indexes of the blocks that this worker met last, by the names that go along with them.
_KNOWN: dict[tuple[str, int], _Index] = {}


def _index_of(items, name: str, min_match: int) -> _Index:
    if (name, min_match) not in _KNOWN:
        if len(_KNOWN) >= 2:
            _KNOWN.clear()
        _KNOWN[name, min_match] = _Index(items.value, min_match)
    return _KNOWN[name, min_match]


def _matcher(items, text_at: int, min_match: int, coverage: float):
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(items, name, min_match)
        for batch in batches:
            cols = batch.schema.names
            best = batch.column(cols.index("coverage")).to_pylist()
            which = batch.column(cols.index("item_id")).to_pylist()
            many = batch.column(cols.index("n_items")).to_pylist()
            data, bounds = column_bytes(batch.column(text_at))
            for i, j in row_blocks(bounds):
                own = bounds[i : j + 1] - bounds[i]
                words, row, _, _ = word_hashes(data[bounds[i] : bounds[j]], own, BY_PUNCTUATION)
                for r, found, bounds_of in index.hits(words, row):
                    at = i + r
                    text = words[np.searchsorted(row, r, "left") : np.searchsorted(row, r, "right")].tolist()
                    for k, bound in zip(found.tolist(), bounds_of.tolist(), strict=True):
                        better = lambda share, at=at, k=k: share > best[at] or share == best[at] > 0 and index.ids[k] is not None and (which[at] is None or index.ids[k] < which[at])
                        if bound < coverage and not better(bound):
                            break  # tiles consist of seeds, and the bounds fall
                        pattern = index.words(k)
                        share = sum(x[2] for x in tiles(pattern.tolist(), text, int(index.least[k]))) / len(pattern)
                        many[at] += share >= coverage
                        if better(share):
                            best[at], which[at] = share, index.ids[k]
            found = [pa.array([b >= coverage and b > 0 for b in best], pa.bool_()), pa.array(best, pa.float64()), pa.array(which, pa.int64()), pa.array(many, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols) - 4], *found], names=cols)

    return work

"""Language-model scores from a probabilistic suffix tree over words.

The tree's symbols are the words met ``min_word`` times, the end of a document, and classes of the other words by their
last two bytes. A context is a run of up to ``order`` symbols, read backwards from the symbol that it stands before. It is
a node if it is met ``min_context`` times and what follows it diverges from what its longest node suffix predicts by more
than the description of that costs (a test on the gain in log likelihood). In a node's distribution a symbol that
followed twice or more keeps its count less a discount; all else goes to the suffix's prediction:

    P(x | c) = max(n(x) - discount, 0) / n + rest / n * P(x | longest node suffix of c)

where symbols that followed once count to the rest, so that a document's own words don't predict themselves. The root is
the add-one estimate. A symbol is scored in the longest node that ends what stands before it, and a word of a class takes
its share of the class by its own add-one count.

The tree is never brought together. The subtree of all contexts that end in one symbol is grown in the one bucket to
which all places after that symbol go, and the places are scored there. Places go as packed columns, a row for each
bucket and block of documents; the sums for the documents come back the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save, settled
from .textvec import column_bytes, mix, powers, row_blocks, word_hashes

#: Bits of a filter, whatever the corpus: one that is full takes rarer words for symbols of their own, no more.
FILTER_BITS = 27
#: Places that a block of documents holds, if it isn't one document; and that a bucket holds on average. A symbol with
#: more places than that has them dealt to several buckets by the symbol before it.
BLOCK_PLACES = 3 << 17
BUCKET_PLACES = 3 << 17

# Symbols: no symbol (before a document's begin), the end, words by falling frequency, classes from CLASSES on, and other
# words by their hash with the top bit set.
_NONE, _END, _WORDS, _CLASSES, _TOP = 0, 1, 2, 1 << 23, np.uint64(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class (the last two bytes, A-Z lower-cased) and row of every word."""
    h, row, first, end = word_hashes(data, bounds)
    if not len(h):
        return h.view(np.int64), np.zeros(0, np.int64), row
    lower = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.int64)
    return h.view(np.int64), lower(data[end - 1]) | np.where(end - first > 1, lower(data[end - 2]) << 8, 0), row


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    spot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return spot, table[spot] == keys


class Filter:
    """A set of 64-bit keys by some of their bits: every key of the set is in it, and some others are."""

    def __init__(self, keys: DataFrame, name: str):
        """keys: distributed; at most 2 ** FILTER_BITS / 64 cells come to the driver."""
        self.cells = np.zeros((1 << FILTER_BITS) // 64, np.int64)
        low = F.col(name).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        bit = F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
        found = keys.select(F.shiftright(low, 6).alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy()

    def hits(self, keys: np.ndarray) -> np.ndarray:
        return (self.cells[(keys & ((1 << FILTER_BITS) - 1)) >> 6] >> (keys & 63)) & 1 == 1


@dataclass
class Vocabulary:
    """often, counts, symbol: sorted hashes of the broadcast words, their counts, and their symbols; own: the filter of further words that are symbols; named: the classes that are symbols of their own, the others go together;
    words, classes: root probabilities by symbol; other: that of each further word; met: counts by symbol."""

    often: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    own: Filter
    named: np.ndarray
    words: np.ndarray
    classes: np.ndarray
    other: float
    ends: int
    mass: float

    def symbols(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each word, its place in ``often`` and whether it is there, and whether it is a further word."""
        spot, near = _lookup(self.often, h)
        sym = np.where(near, self.symbol[spot] if len(self.symbol) else 0, 0).astype(np.uint64)
        far = ~near & self.own.hits(h)
        by_class = ~near & ~far
        sym[by_class] = (_CLASSES + np.where(self.named[tail[by_class]], tail[by_class] + 1, 0)).astype(np.uint64)
        sym[far] = h[far].view(np.uint64) | _TOP
        return sym, spot, near, far

    def root(self, sym: np.ndarray) -> np.ndarray:
        out = np.full(len(sym), self.other)
        near, kind = sym < np.uint64(len(self.words)), (sym >= np.uint64(_CLASSES)) & (sym < np.uint64(_CLASSES + len(self.classes)))
        out[near] = self.words[sym[near].astype(np.int64)]
        out[kind] = self.classes[sym[kind].astype(np.int64) - _CLASSES]
        return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64-bit integers as compressed byte planes: small numbers take few bytes."""
    planes = np.stack([c.astype(np.uint64, copy=False) for c in columns]).view(np.uint8).reshape(len(columns), -1, 8)
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)), asbytes=True)


def _unpack(data: bytes, columns: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=columns * n * 8), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.uint64).reshape(columns, n)


def _apart(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the sign in the lowest bit, so that small ones of either sign are small numbers."""
    step = np.diff(x.astype(np.int64), prepend=0)
    return ((step << 1) ^ (step >> 63)).view(np.uint64)


def _together(x: np.ndarray) -> np.ndarray:
    """What _apart() was given."""
    return np.cumsum((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64))


def contexts(seq: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For each place of documents' symbols the one before it, the one before that and so on; an end before the first."""
    out = []
    for k in range(1, order + 1):
        c = np.zeros(len(seq), np.uint64)
        c[k:] = seq[:-k]
        c[place == k - 1] = _END
        c[place < k - 1] = _NONE
        out.append(c)
    return out


def grow(before: list[np.ndarray], after: np.ndarray, weights: list[np.ndarray], root: np.ndarray, min_context: int, gain: float, discount: float) -> tuple[np.ndarray, int]:
    """log10 of the probability of each place's symbol by the tree over that by the root, and the number of nodes.

    before: for each place the symbols before it, the nearest first; weights: how often each place was met in training, as
    far as it counts for contexts of one symbol, of two and so on; root: the root's probability of the place's symbol.
    """
    p, nodes = root.copy(), 0
    run = np.zeros(len(after), np.uint64)
    for c, weight in zip(before, weights, strict=True):
        run = mix((run ^ mix(c + _STEP)) * _STEP)
        at = np.flatnonzero(c != _NONE)
        if not len(at):
            break
        _, first, pair = np.unique(mix((run[at] ^ mix(after[at] + _STEP)) * _STEP), return_index=True, return_inverse=True)
        n = np.bincount(pair, weight[at], len(first))
        own, suffix = run[at[first]], p[at[first]]
        _, ctx = np.unique(own, return_inverse=True)
        total = np.bincount(ctx, n)
        kept = n >= 2
        seen = np.bincount(ctx[kept], n[kept], len(total))
        kinds = np.bincount(ctx[kept], minlength=len(total))
        single, left = total - seen, np.maximum(1 - np.bincount(ctx[kept], suffix[kept], len(total)), 1e-9)
        safe = np.maximum(total, 1.0)
        won = np.bincount(ctx[kept], n[kept] * np.log(n[kept] / (safe[ctx[kept]] * suffix[kept])), len(total))
        won = won + np.where(single > 0, single * np.log(np.maximum(single, 1) / (safe * left)), 0)
        node = (total >= min_context) & (kinds > 0) & (won > 0.5 * (kinds + (single > 0)) * np.log(safe) + gain)
        nodes += int(node.sum())
        rest = (single + discount * kinds) / safe
        now = np.where(kept, n - discount, 0) / safe[ctx] + rest[ctx] * suffix
        p[at] = np.where(node[ctx], now, suffix)[pair]
    return np.log10(p / root), nodes


def _count_words(texts: DataFrame) -> DataFrame:
    """h, class and n of every word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(0))
            keys, tails, counts = [], [], []
            for i, j in row_blocks(bounds):
                h, tail, _ = _words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                key, at, n = np.unique(h, return_index=True, return_counts=True)
                keys.append(key), tails.append(tail[at]), counts.append(n)
            if keys:
                key, tail, n = (np.concatenate(x) for x in (keys, tails, counts))
                own, at, back = np.unique(key, return_index=True, return_inverse=True)
                n = np.bincount(back, n, len(own)).astype(np.int64)
                for a in range(0, len(own), 100_000):
                    cut = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(own[cut]), pa.array(tail[at][cut].astype(np.int32)), pa.array(n[cut])], names=["h", "tail", "n"])

    return texts.mapInArrow(work, "h long, tail int, n long")


def _own(words: DataFrame, filter_) -> DataFrame:
    """words with own: whether the filter lets a word through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = filter_.value.hits(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hits)], names=["tail", "n", "own"])

    return words.select("h", "tail", "n").mapInArrow(work, "tail int, n long, own boolean")


def _vocabulary(words: DataFrame, ends: int, min_word: int, broadcast_words: int) -> Vocabulary:
    """To the driver come the words to broadcast, a filter of fixed size, and counts of 65,536 classes."""
    steps = [min_word << j for j in range(41)]
    met = words.agg(*(F.count(F.when(F.col("n") >= c, 1)) for c in steps)).first()
    often_from = next(c for c, k in zip(steps, met, strict=True) if k <= broadcast_words)
    found = words.select("h", "n").where(F.col("n") >= often_from).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    sort = np.argsort(h)
    h, n = h[sort], n[sort]
    ranked = np.lexsort((h, -n))
    symbol = np.zeros(len(h), np.uint64)
    symbol[ranked] = np.arange(len(ranked), dtype=np.uint64) + np.uint64(_WORDS)
    rare = words.where(F.col("n") < often_from)
    own = Filter(rare.where(F.col("n") >= min_word), "h")
    sums = {True: np.zeros((1 << 16, 2)), False: np.zeros((1 << 16, 2))}
    for t, o, c, k in _own(rare, words.sparkSession.sparkContext.broadcast(own)).groupBy("tail", "own").agg(F.sum("n"), F.count("*")).collect():
        sums[o][t] = c, k
    named = sums[False][:, 0] >= min_word
    further, kinds = sums[True].sum(0)
    mass = float(n.sum() + len(n) + further + kinds + sums[False].sum() + ends + 1 + named.sum() + 2)
    classes = np.zeros((1 << 16) + 1)
    classes[1:][named] = (sums[False][named].sum(1) + 1) / mass
    classes[0] = (sums[False][~named].sum() + 1) / mass
    probs = np.concatenate(([0.0, (ends + 1) / mass], (n[ranked] + 1) / mass))
    return Vocabulary(h, n, symbol, own, named, probs, classes, float((further + kinds + 1) / (kinds + 1) / mass), ends, mass)


class _Router:
    """Which bucket a place goes to: that of the symbol before it; of a frequent one, that of the two symbols before it."""

    def __init__(self, vocabulary: Vocabulary, buckets: int, places: int):
        met = np.concatenate((vocabulary.words, vocabulary.classes)) * vocabulary.mass
        ids = np.concatenate((np.arange(len(vocabulary.words)), _CLASSES + np.arange(len(vocabulary.classes)))).astype(np.uint64)
        hot = met > places
        self.hot, self.parts, self.buckets = ids[hot], np.ceil(met[hot] / places).astype(np.uint64), buckets

    def bucket(self, route: np.ndarray) -> np.ndarray:
        return ((route >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def is_hot(self, c: np.ndarray) -> np.ndarray:
        return _lookup(self.hot, c)[1]

    def route(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        out, (spot, hit) = mix(c1), _lookup(self.hot, c1)
        if hit.any():
            out[hit] = mix(out[hit] + np.uint64(1) + mix(c2[hit]) % self.parts[spot[hit]])
        return out

    def all_of(self, c1: int) -> np.ndarray:
        """The buckets of all places after a frequent symbol."""
        parts = self.parts[np.searchsorted(self.hot, np.uint64(c1))]
        return np.unique(self.bucket(mix(mix(np.array([c1], np.uint64)) + np.uint64(1) + np.arange(parts, dtype=np.uint64))))


def _sequences(batches: Iterator[pa.RecordBatch], v: Vocabulary, places: int) -> Iterator[dict]:
    """Blocks of documents: doc_id and learns, symbols and word hashes with each document's end last, where documents
    begin, and what the broadcast words tell of a document; further: places of words that aren't broadcast."""
    logs_of = np.log10(np.append(v.counts, 0) + 1.0)
    end_log = float(np.log10(v.ends + 1))
    held: list[dict] = []
    size = 0

    def flush() -> dict:
        out = {k: np.concatenate([x[k] for x in held]) for k in held[0] if k != "doc_id"}
        out["doc_id"] = pa.concat_arrays([x["doc_id"] for x in held])
        held.clear()
        return out

    for batch in batches:
        data, bounds = column_bytes(batch.column(1))
        learns = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in row_blocks(bounds):
            h, tail, row = _words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            docs = j - i
            sym, spot, near, further = v.symbols(h, tail)
            at = np.arange(len(h)) + row
            seq, hashes, apart = np.full(len(h) + docs, _END, np.uint64), np.zeros(len(h) + docs, np.uint64), np.zeros(len(h) + docs, np.uint8)
            seq[at], hashes[at], apart[at] = sym, h.view(np.uint64), np.where(near, 0, 1 + further)
            known = np.bincount(row, near, docs).astype(np.int64) + (v.ends > 0)
            logs = np.bincount(row, np.where(near, logs_of[spot], 0.0), docs) + end_log
            held.append({"doc_id": batch.column(0).slice(i, docs), "learns": learns[i:j], "seq": seq, "hashes": hashes, "apart": apart, "n": np.bincount(row, minlength=docs) + 1, "known": known, "logs": logs})
            size += len(seq)
            if size >= places:
                yield flush()
                size = 0
    if held:
        yield flush()


_SHIPPED = "bucket long, block long, kind int, rep long, n_tokens long, known long, logs double, rooted double, data binary"
_BACK = "block long, kind int, rep long, n_tokens long, known long, logs double, rooted double, data binary"
_DOCUMENTS, _PLACES, _RARE, _HOT = range(4)


def _rows(kind: int, bucket: list, block, n: list, data: list, id_type: pa.DataType) -> pa.RecordBatch:
    k = len(data)
    none = lambda t: pa.nulls(k, t)
    cols = {"bucket": pa.array(bucket, pa.int64()), "block": pa.array(block, pa.int64()), "kind": pa.array([kind] * k, pa.int32()), "rep": none(pa.int64()), "n_tokens": pa.array(n, pa.int64())}
    cols |= {"known": none(pa.int64()), "logs": none(pa.float64()), "rooted": none(pa.float64()), "data": pa.array(data, pa.binary()), "doc_id": none(id_type)}
    return pa.RecordBatch.from_pydict(cols)


def _ship(v, router, order: int, places: int):
    """A row for each document, and one for each bucket with the places, and the rare words, that go there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, way = v.value, router.value
        rare_root = float(np.log10(vocabulary.other * vocabulary.mass))
        block = TaskContext.get().partitionId() << 32
        for held in _sequences(batches, vocabulary, places):
            seq, n, docs = held["seq"], held["n"], len(held["n"])
            starts = np.concatenate(([0], np.cumsum(n)))[:-1]
            doc = np.repeat(np.arange(docs), n)
            place = np.arange(len(seq)) - starts[doc]
            # documents of the same words are one, with the number of those that are learnt from
            same = np.add.reduceat(mix(held["hashes"]) * powers(int(n.max()) + 1)[0][place + 1], starts) + n.astype(np.uint64)
            _, first, rep = np.unique(same, return_index=True, return_inverse=True)
            weight = np.bincount(rep, held["learns"], len(first)).astype(np.uint64)
            further = np.bincount(doc, held["apart"] == 2, docs)
            cols = {"bucket": np.full(docs, int(way.bucket(mix(np.array([block], np.uint64)))[0])), "block": np.full(docs, block), "kind": np.full(docs, _DOCUMENTS, np.int32), "rep": rep, "n_tokens": n, "known": held["known"], "logs": held["logs"], "rooted": held["logs"] + further * rare_root}
            yield pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in cols.items()} | {"data": pa.nulls(docs, pa.binary()), "doc_id": held["doc_id"]})
            lone = np.zeros(docs, bool)
            lone[first] = True
            before = contexts(seq, place, order)
            at = np.flatnonzero(lone[doc])
            route = way.route(before[0][at], before[1][at] if order > 1 else seq[at])
            rare = np.flatnonzero(lone[doc] & (held["apart"] > 0))
            for kind, spots, ways in ((_PLACES, at, route), (_RARE, rare, mix(held["hashes"][rare]))):
                sort = np.argsort(ways, kind="stable")
                spots, bucket = spots[sort], way.bucket(ways[sort])
                own = rep[doc[spots]].astype(np.uint64)
                columns = [c[spots] for c in before] + [seq[spots], own] if kind == _PLACES else [held["hashes"][spots], own << np.uint64(1) | (held["apart"][spots] == 2)]
                columns.append(weight[rep[doc[spots]]])
                cut = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
                out: tuple[list, list, list] = ([], [], [])
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    parts = [c[a:b] for c in columns]
                    parts[-2] = _apart(parts[-2])
                    out[0].append(bucket[a]), out[1].append(b - a), out[2].append(_pack(*parts))
                for a in range(0, len(out[0]), 256):
                    cut_ = slice(a, a + 256)
                    yield _rows(kind, out[0][cut_], [block] * len(out[0][cut_]), out[1][cut_], out[2][cut_], held["doc_id"].type)
            block += 1

    return work


def _hot_counts(texts: DataFrame, v, router, places: int) -> DataFrame:
    """The symbols after the frequent ones, in documents that are learnt from, with their numbers: for each block, frequent
    symbol and one of as many parts as that has buckets, a row of packed columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _sequences(batches, v.value, places):
            seq, n = held["seq"], held["n"]
            starts = np.concatenate(([0], np.cumsum(n)))[:-1]
            before = contexts(seq, np.arange(len(seq)) - np.repeat(starts, n), 1)[0]
            spot, hit = _lookup(router.value.hot, before)
            at = np.flatnonzero(hit)
            _, first, n = np.unique(mix((before[at] ^ mix(seq[at] + _STEP)) * _STEP), return_index=True, return_counts=True)
            spot, x = spot[at[first]], seq[at[first]]
            part = (mix(x) % router.value.parts[spot]).astype(np.int64)
            sort = np.lexsort((part, spot))
            spot, part, x, n = spot[sort], part[sort], x[sort], n[sort]
            cut = [*np.flatnonzero(np.diff(spot, prepend=-1).astype(bool) | np.diff(part, prepend=-1).astype(bool)).tolist(), len(spot)]
            rows = [(int(spot[a]), int(part[a]), b - a, _pack(x[a:b], n[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 256], strict=True)], names=["spot", "part", "n", "data"])

    return texts.mapInArrow(work, "spot long, part long, n long, data binary")


def suffix_tree_scores(
    docs: DataFrame,
    learns: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    min_word: int = 10,
    min_context: int = 2,
    gain: float = 10.0,
    discount: float = 0.75,
    broadcast_words: int = 4_000_000,
    block_places: int = BLOCK_PLACES,
    bucket_places: int = BUCKET_PLACES,
) -> DataFrame:
    """Scores of all documents by the tree that grows from those where ``learns`` is true (null: false).

    One row for every input row: doc_id, n_tokens, n_known, train_tokens long, base_score, score double. base_score adds
    log10((c + 1) / (N + V + 1)) over the words and the end; score is the tree's log10 probability of the whole document,
    where a word not met in training counts as the unknown word of its class. A null or empty text is an end only.
    Repeated rows score alike; null ids are ids like any other; an empty table gives an empty result; other columns are
    not read.

    Words and contexts count from absolute numbers on, so the tree grows with the corpus. Broadcast are the words met
    ``min_word`` times, or, if those are more than ``broadcast_words``, twice as often, four times and so on; a filter of
    16 MB; and counts of 65,536 classes. Further words met ``min_word`` times are symbols as well; the tree's root takes
    their mean probability for each of them. A place in a text goes to the bucket of the symbol before it; for a symbol with more places than
    ``bucket_places``, to one of several by the symbol before that, and what follows the symbol anywhere is counted ahead.

    A task holds about ``bucket_places`` or ``block_places`` at 400 bytes each. Rows are one for each block and bucket, so
    both should be as large as a task's memory lets once a row holds few places: 64 million each for 100 TB.
    """
    if not 1 <= order <= 4:
        raise ValueError("order not from 1 to 4")
    if not 0 <= broadcast_words < _CLASSES - _WORDS:
        raise ValueError("broadcast_words not from 0 to 8 million")
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    source = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns")))
    training = source.where("learns")
    words = save(_count_words(training.select("text")).groupBy("h", "tail").agg(F.sum("n").alias("n")), "lm-words")
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    tokens, distinct = total + ends, types + (ends > 0)
    vocabulary = _vocabulary(words, ends, min_word, broadcast_words)
    discard(words)
    v = broadcast(vocabulary)
    router = broadcast(way := _Router(vocabulary, max(1, -(-tokens // bucket_places)), bucket_places))

    id_type = source.schema["doc_id"].dataType.simpleString()
    shipped = source.mapInArrow(_ship(v, router, order, block_places), f"{_SHIPPED}, doc_id {id_type}")
    if len(way.hot):
        hot = _hot_counts(training, v, router, block_places).groupBy("spot", "part").applyInArrow(_deliver(router, spark_type(source, "doc_id")), f"{_SHIPPED}, doc_id {id_type}")
        shipped = shipped.unionByName(hot)

    def score(table: pa.Table) -> pa.Table:
        return _score_bucket(table, v.value, router.value, order, min_context, gain, discount)

    back = shipped.groupBy("bucket").applyInArrow(score, f"{_BACK}, doc_id {id_type}")
    base, mass = float(np.log10(tokens + distinct + 1)), float(np.log10(vocabulary.mass))
    out = back.groupBy("block").applyInArrow(_sum_up, f"doc_id {id_type}, n_tokens long, n_known long, logs double, rooted double")
    return out.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("rooted") - F.col("n_tokens") * F.lit(mass)).alias("score"),
    )


def spark_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _deliver(router, id_type: pa.DataType):
    """What follows a frequent symbol, added up, to all buckets of its places."""

    def work(table: pa.Table) -> pa.Table:
        c = int(router.value.hot[table.column("spot")[0].as_py()])
        x, n = np.concatenate([_unpack(d.as_py(), 2, k.as_py()) for d, k in zip(table.column("data"), table.column("n"), strict=True)], axis=1)
        x, back = np.unique(x, return_inverse=True)
        n = np.bincount(back, n.astype(np.float64)).astype(np.uint64)
        data, buckets = _pack(np.full(len(x), c, np.uint64), x, n), router.value.all_of(c).tolist()
        return pa.Table.from_batches([_rows(_HOT, buckets, [None] * len(buckets), [len(x)] * len(buckets), [data] * len(buckets), id_type)])

    return work


def _score_bucket(table: pa.Table, v: Vocabulary, way: _Router, order: int, min_context: int, gain: float, discount: float) -> pa.Table:
    """Grows the subtrees of a bucket's symbols and scores its places; counts its rare words. Documents pass."""
    kind = table.column("kind").to_numpy()
    n, block, data = table.column("n_tokens").to_numpy(), table.column("block"), table.column("data")
    id_type = table.schema.field("doc_id").type
    out = [table.filter(pa.array(kind == _DOCUMENTS)).drop_columns(["bucket"])]

    def parts(which: int, columns: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        rows = np.flatnonzero(kind == which).tolist()
        ends = np.concatenate(([0], np.cumsum(n[rows]))).astype(np.int64)
        out = np.empty((columns, ends[-1]), np.uint64)
        for i, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            out[:, a:b] = _unpack(data[i].as_py(), columns, b - a)
        return rows, out, ends

    def send(which: int, rows: list[int], packed: list[bytes], sizes: list[int]) -> None:
        if rows:
            found = pa.Table.from_batches([_rows(which, [0] * len(rows), block.take(rows).to_pylist(), sizes, packed, id_type)])
            out.append(found.drop_columns(["bucket"]))

    rows, places, ends = parts(_PLACES, order + 3)
    _, hot, _ = parts(_HOT, 3)
    if rows:
        before, after, weight = list(places[:order]), places[order], places[order + 2].astype(np.float64)
        near = weight
        if hot.shape[1]:  # counted ahead
            none = np.zeros(hot.shape[1], np.uint64)
            near = np.concatenate((np.where(way.is_hot(before[0]), 0, weight), hot[2]))
            before = [np.concatenate((c, none if k else hot[0])) for k, c in enumerate(before)]
            after, weight = np.concatenate((after, hot[1])), np.concatenate((weight, none))
        won, _ = grow(before, after, [near] + [weight] * (order - 1), v.root(after), min_context, gain, discount)
        del before, after, weight, near
        packed, sizes = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            rep, back = np.unique(_together(places[order + 1, a:b]), return_inverse=True)
            gains = np.bincount(back, won[a:b]).astype(np.float32).view(np.uint32)
            packed.append(_pack(_apart(rep), gains))
            sizes.append(len(rep))
        send(_PLACES, rows, packed, sizes)

    rows, words, ends = parts(_RARE, 3)
    if rows:
        _, back = np.unique(words[0], return_inverse=True)
        counts = np.bincount(back, words[2].astype(np.float64)).astype(np.uint64)[back]
        send(_RARE, rows, [_pack(words[1, a:b], counts[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.diff(ends).tolist())
    return pa.concat_tables(out)


def _sum_up(table: pa.Table) -> pa.Table:
    """A block's documents with the sums that come back from the buckets."""
    kind, sizes, data = table.column("kind").to_numpy(), table.column("n_tokens").to_numpy(), table.column("data")
    docs = table.filter(pa.array(kind == _DOCUMENTS))
    rep, n = docs.column("rep").to_numpy(), docs.column("n_tokens").to_numpy()
    reps = int(rep.max()) + 1 if len(rep) else 0
    known, logs, rooted = np.zeros(reps, np.int64), np.zeros(reps), np.zeros(reps)
    for i in np.flatnonzero(kind == _PLACES).tolist():
        own, gains = _unpack(data[i].as_py(), 2, int(sizes[i]))
        rooted[_together(own)] += gains.astype(np.uint32).view(np.float32)
    for i in np.flatnonzero(kind == _RARE).tolist():
        own, counts = _unpack(data[i].as_py(), 2, int(sizes[i]))
        own = _together(own)
        further, own = (own & 1) == 1, own >> 1
        known += np.bincount(own, counts > 0, reps).astype(np.int64)
        more = np.log10(counts + 1.0)
        logs += np.bincount(own, more, reps)
        rooted += np.bincount(own, np.where(further, 0.0, more), reps)
    cols = [docs.column("doc_id"), pa.array(n), *(pa.array(docs.column(k).to_numpy() + x[rep]) for k, x in (("known", known), ("logs", logs), ("rooted", rooted)))]
    return pa.Table.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "logs", "rooted"])


def in_fold(key: Column, modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % modulus == rest

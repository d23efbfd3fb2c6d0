"""A byte-level convolutional network, in numpy, that scores documents for quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import order_key
from .textvec import column_bytes, row_blocks

#: Half a chunk. A chunk is two neighbouring cells, so chunks overlap by half and cover the whole document.
CELL = 256
WIDTH = 4  # bytes that a filter sees
ROW = CELL + WIDTH - 1  # a cell and what its last filters see of the next
PAD = 256  # what stands behind a document's end


@dataclass
class Network:
    """table: what each filter adds for each byte at each of its places; bias of the filters; weights of the pooled
    features, the largest and then the mean over a document's chunks; the last bias."""

    table: np.ndarray  # WIDTH, 257, filters
    bias: np.ndarray
    weights: np.ndarray
    last: np.ndarray

    @property
    def filters(self) -> int:
        return self.table.shape[2]


def cells(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents as rows of ROW byte codes, CELL of their own and the first of the next row's, each document padded and from a
    row of its own; the first row of each, with the number of rows last."""
    sizes = np.diff(bounds)
    rows = -(-(sizes + WIDTH - 1) // CELL)
    starts = np.concatenate(([0], np.cumsum(rows)))
    out = np.full(int(starts[-1]) * CELL, PAD, np.int16)
    at = np.arange(len(data)) + np.repeat(starts[:-1] * CELL - bounds[:-1], sizes)
    out[at] = data
    out = out.reshape(-1, CELL)
    ahead = np.full((len(out), WIDTH - 1), PAD, np.int16)
    ahead[:-1] = out[1:, : WIDTH - 1]
    ahead[starts[1:] - 1] = PAD
    return np.concatenate((out, ahead), 1), starts


def responses(net: Network, codes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each cell, and, if asked for, where it is."""
    out = np.empty((len(codes), net.filters), np.float32)
    where = np.empty((len(codes), net.filters), np.int64) if places else None
    step = 128
    total, part = (np.empty((step * CELL, net.filters), np.float32) for _ in range(2))
    for i in range(0, len(codes), step):
        n = min(step, len(codes) - i)
        for j in range(WIDTH):
            np.take(net.table[j], codes[i : i + n, j : j + CELL].ravel(), axis=0, out=(part if j else total)[: n * CELL], mode="clip")
            if j:
                total[: n * CELL] += part[: n * CELL]
        cut = total[: n * CELL].reshape(n, CELL, net.filters)
        if places:
            at = cut.argmax(1)
            where[i : i + n] = at + (np.arange(i, i + n) * ROW)[:, None]
            out[i : i + n] = np.take_along_axis(cut, at[:, None], 1)[:, 0]
        else:
            cut.max(1, out=out[i : i + n])
    return out, where


def _chunks(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right cell of every chunk (the same in a document of one cell), and the first chunk of each document."""
    n = np.maximum(np.diff(starts) - 1, 1)
    first = np.concatenate(([0], np.cumsum(n)))
    left = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], n)
    return left, np.minimum(left + 1, np.repeat(starts[1:] - 1, n)), first


def features(net: Network, codes: np.ndarray, starts: np.ndarray, places: bool = False):
    """Pooled features of each document; with places also what training needs."""
    cell, where = responses(net, codes, places)
    left, right, first = _chunks(starts)
    pooled = np.maximum(cell[left], cell[right])
    act = np.maximum(pooled + net.bias, 0)
    top = np.maximum.reduceat(act, first[:-1])
    mean = np.add.reduceat(act, first[:-1]) / np.diff(first)[:, None].astype(np.float32)
    both = np.concatenate((top, mean), 1)
    if not places:
        return both
    spot = np.where(cell[left] >= cell[right], where[left], where[right])
    return both, act, top, spot, first


def score(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each document."""
    codes, starts = cells(data, bounds)
    z = features(net, codes, starts) @ net.weights + net.last
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def train(texts: list[bytes], labels: np.ndarray, *, filters: int = 32, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 1) -> Network:
    """Fit by Adam on the log loss. Without both labels, the network answers with their share."""
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.normal(0, 0.3, (WIDTH, 257, filters)).astype(np.float32)
    table[:, PAD] = 0
    share = (float(np.sum(labels)) + 1) / (len(labels) + 2)
    net = Network(table, np.full(filters, -0.5, np.float32), np.zeros(2 * filters, np.float32), np.array(np.log(share / (1 - share)), np.float32))
    if len(set(labels.tolist())) < 2:
        return net
    net.weights = rng.normal(0, 0.1, 2 * filters).astype(np.float32)
    params = [net.table, net.bias, net.weights, net.last]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    steps, total = 0, epochs * -(-len(texts) // batch)
    made = []
    for t in texts:
        codes, starts = cells(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        made.append(codes)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            own = order[b : b + batch]
            codes = np.concatenate([made[i] for i in own])
            starts = np.concatenate(([0], np.cumsum([len(made[i]) for i in own])))
            x, act, top, spot, first = features(net, codes, starts, True)
            p = 1 / (1 + np.exp(-(x @ net.weights + net.last)))
            dz = ((p - labels[own]) / len(own)).astype(np.float32)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(own)), n)
            dact = (dz[:, None] * net.weights[filters:] / n[:, None])[doc]
            lead = act == top[doc]  # the largest of several chunks takes the gradient; ties share it
            ties = np.add.reduceat(lead, first[:-1], dtype=np.float32)[doc]
            dact += lead * (dz[:, None] * net.weights[:filters])[doc] / ties
            dpre = (dact * (act > 0)).astype(np.float32)
            dtable = np.zeros_like(net.table)
            flat = codes.ravel()
            r, f = np.nonzero(dpre)
            for j in range(WIDTH):
                np.add.at(dtable[j], (flat[spot[r, f] + j], f), dpre[r, f])
            dtable[:, PAD] = 0
            grads = [dtable + 1e-5 * net.table, dpre.sum(0), x.T @ dz + 1e-4 * net.weights, dz.sum()]
            steps += 1
            now = rate * min(1.0, 2 * (1 - steps / (total + 1)))
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= now * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def in_fold(key: Column, modulus: int = 5) -> Column:
    """Whether a row is held out: the CRC-32 of its id as text divides by ``modulus``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % modulus == 0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 5,
    max_rows: int = 4000,
    seed: int = 1,
) -> Network:
    """Train on the whole texts of at most ``max_rows`` labelled documents outside the held-out fold, those first by a hash
    of their ids. Null ids, labels and documents without a label are not used; a null text is empty; of rows that share an
    id, each counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~in_fold(F.col(id_col), modulus))
    known = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).orderBy(order_key(F.col(id_col)), "label").limit(max_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    chosen = docs.select(F.col(id_col).alias("doc_id"), text.alias("b")).join(F.broadcast(known), "doc_id")  # max_rows rows at most
    rows = sorted((r["doc_id"], r["label"], bytes(r["b"])) for r in chosen.collect())
    return train([b for _, _, b in rows], np.array([x for _, x, _ in rows], np.float32), seed=seed)


def quality_scores(docs: DataFrame, net: Network, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``score_col`` double, the network's probability of label 1 for the whole text.

    Nothing but the text's bytes enters the score. A null text scores as an empty one, which has a score too. Repeated
    rows score alike; an empty table gives an empty result. Nothing is shuffled; the network, of a fixed size, is
    broadcast.
    """
    kept = [c for c in docs.columns if c != score_col]
    at, shared = kept.index(text_col), docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(at))
            parts = [score(shared.value, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in row_blocks(bounds)]
            out = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*kept, score_col])

    return docs.select(*kept).mapInArrow(work, StructType([*docs.select(*kept).schema.fields, StructField(score_col, DoubleType())]))

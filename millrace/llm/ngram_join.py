"""Jaccard join of word n-gram sets by prefix trees.

1. Each document becomes a set of n-gram hashes. The first part of each set, in hash order, goes to buckets that find
   which of its members another set holds too. By the prefix principle, a set with a partner must share a given number
   of them; only sets that do go on.
2. The equal ones among these sets are collapsed. All members are then counted, and members found in one set only are
   taken out, as they add to no overlap. The global order is: rarest first, then by hash.
3. Sets that share a member of their prefixes in that order fall into one neighbourhood, a superset of linked groups.
4. Each neighbourhood is joined by a prefix tree: sets that begin alike share the work on what they share, and a subtree
   is left as soon as what remains of either side cannot reach the overlap needed, or all in it is linked already.

Links are exact for the hashes; all n-grams of all documents take part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save, text_bytes
from .components import connected_components
from .textvec import column_bytes, mix, ngram_hashes, row_blocks, slices, word_hashes

#: Sets that a task joins in one tree; a larger neighbourhood is joined in blocks of so many.
TREE_SETS = 512
#: Bytes of text whose members make up one bucket on the average.
BUCKET_BYTES = 7_000_000


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct n-grams of each text, ordered by both; a text of fewer words has them all as one."""
    words, row, _, _ = word_hashes(data, bounds)
    g, at = ngram_hashes(words, row, n)
    rows = [row[at]]
    parts = [g]
    count = np.bincount(row, minlength=len(bounds) - 1)
    for k in range(1, n):
        few = np.flatnonzero(count[row] == k)
        h, at = ngram_hashes(words[few], row[few], k)
        parts.append(h)
        rows.append(row[few][at])
    g, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return row[new], g[new]


def _signature(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set, and two sums that together name it."""
    size = np.bincount(row, minlength=rows)
    some = size > 0
    begin = (np.cumsum(size) - size)[some]
    sums = []
    for add in (1, 2):
        out = np.zeros(rows, np.uint64)
        if len(begin):
            out[some] = np.add.reduceat(mix(g + np.uint64(add * 0x5851F42D4C957F2D)), begin)
        sums.append(out.view(np.int64))
    return size, *sums


def _need(size, percent: int):
    """The overlap that a set of this size has with any partner, at least."""
    return -(-(size * percent) // 100)


def _extra(size):
    """Members by which prefixes are longer than needed, and which a pair must therefore share."""
    return 1 + size // 10


def _find(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Two kinds of rows: documents (rid, doc_id, size, s1, s2, least, own) and, for each batch and bucket, the members
    of the batch's prefixes (bucket, base, members, owners): 32 bits of each distinct member, and the document in the
    batch that holds it, or 65,535 if several do. ``own`` counts a document's prefix members that are of the latter."""
    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, s1 long, s2 long, least long, own long, bucket long, base long, members binary, owners binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, 1, 1 << 23):
                data, bounds = column_bytes(batch.column(1))
                sizes, firsts, seconds, members, owners = [], [], [], [], []
                for i, j in row_blocks(bounds):
                    row, g = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n)
                    size, s1, s2 = _signature(row, g, j - i)
                    place = np.arange(len(g)) - (np.cumsum(size) - size)[row]
                    early = place < (size - _need(size, percent) + _extra(size))[row]
                    members.append(g[early]), owners.append((row[early] + i).astype(np.uint16))
                    sizes.append(size), firsts.append(s1), seconds.append(s2)
                size = np.concatenate(sizes)
                g, owner = np.concatenate(members), np.concatenate(owners)
                order = np.argsort(g, kind="stable")
                g, owner = g[order], owner[order]
                new = np.ones(len(g), bool)
                new[1:] = g[1:] != g[:-1]
                many = np.diff(np.append(np.flatnonzero(new), len(g))) > 1
                shared = np.repeat(many, np.diff(np.append(np.flatnonzero(new), len(g))))
                own = np.bincount(owner[shared], minlength=len(size))
                g, owner = g[new], np.where(many, np.uint16(65535), owner[new])
                bucket = ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(g) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(g))[: len(cuts)]
                low32 = g.astype(np.uint32)
                k, b = len(size), len(cuts)
                longs = lambda x: pa.array(np.concatenate((x, np.zeros(b, np.int64))), pa.int64(), mask=np.arange(k + b) >= k)
                tail = lambda x, kind: pa.array([None] * k + x, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        longs(base + np.arange(k)),
                        pa.concat_arrays([batch.column(0), pa.nulls(b, batch.column(0).type)]),
                        longs(size),
                        longs(np.concatenate(firsts)),
                        longs(np.concatenate(seconds)),
                        longs(_extra(_need(size, percent))),
                        longs(own),
                        tail([int(x) for x in bucket[cuts]], pa.int64()),
                        tail([base] * b, pa.int64()),
                        tail([low32[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()),
                        tail([owner[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()),
                    ],
                    names=["rid", "doc_id", "size", "s1", "s2", "least", "own", "bucket", "base", "members", "owners"],
                )
                base += k

    return docs.mapInArrow(work, schema)


def _met(table: pa.Table) -> pa.Table:
    """Of a bucket: the document of each member that another batch holds too, a row for each such member."""
    members = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("members")]
    owners = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("owners")])
    base = np.repeat(table.column("base").to_numpy(), [len(x) for x in members])
    _, at, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    hit = (count[at] > 1) & (owners != 65535)
    return pa.table({"rid": pa.array(base[hit] + owners[hit], pa.int64())})


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(0))
            for i, j in row_blocks(bounds):
                row, g = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n)
                size, s1, s2 = _signature(row, g, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(size, pa.int64()), lists], names=["s1", "s2", "size", "members"])

    return docs.mapInArrow(work, "s1 long, s2 long, size long, members array<long>")


class _Node:
    __slots__ = ("label", "kids", "least", "most", "longest", "ends", "label_of", "uniform")

    def __init__(self, label, least, most, longest, ends, label_of):
        self.label, self.kids, self.ends = label, {}, ends
        self.least, self.most, self.longest = least, most, longest  # set sizes below, and the longest list of members
        self.label_of, self.uniform = label_of, True  # one set below; whether all below were in its component when added


def tree_links(sets: list[tuple[int, int, list[int]]], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked: for any two sets whose Jaccard index reaches percent / 100, a path of returned
    links or of ``known`` components. sets: an id, the set's size, and its shared members in the global order (ascending)."""
    up = list(range(len(sets)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if known is not None:
        first: dict[int, int] = {}
        for i, c in enumerate(known):
            up[i] = first.setdefault(c, i)
    root, out = _Node([], 1 << 62, 0, 0, [], 0), []
    for x in sorted(range(len(sets)), key=lambda i: sets[i][1]):
        _, size, ranks = sets[x]
        holds = set(ranks)
        small, large = size * percent, size * 100
        stack = [(root, 0, 0)] if root.kids else []
        while stack:
            node, overlap, depth = stack.pop()
            if node is not root and node.uniform and find(node.label_of) == find(x):
                continue
            if node.most * 100 < small or node.least * percent > large:
                continue
            need = -(-percent * (size + node.least) // (100 + percent))
            label, dead = node.label, False
            for k in range(0, len(label), 16):
                piece = label[k : k + 16]
                depth += len(piece)
                overlap += sum(r in holds for r in piece)
                if overlap + min(len(ranks) - bisect_right(ranks, piece[-1]), node.longest - depth) < need:
                    dead = True
                    break
            if dead:
                continue
            for y in node.ends:
                if overlap * (100 + percent) >= percent * (size + sets[y][1]) and find(x) != find(y):
                    up[find(x)] = find(y)
                    out.append((sets[x][0], sets[y][0]))
            stack.extend((kid, overlap, depth) for kid in node.kids.values())
        _insert(root, ranks, x, size, find)
    return out


def _insert(root: _Node, ranks: list[int], x: int, size: int, find) -> None:
    node, at = root, 0
    while True:
        node.least, node.most, node.longest = min(node.least, size), max(node.most, size), max(node.longest, len(ranks))
        if node.uniform and find(node.label_of) != find(x):
            node.uniform = False
        if at == len(ranks):
            node.ends.append(x)
            return
        kid = node.kids.get(ranks[at])
        if kid is None:
            node.kids[ranks[at]] = _Node(ranks[at:], size, size, len(ranks), [x], x)
            return
        same, limit = 0, min(len(kid.label), len(ranks) - at)
        while same < limit and kid.label[same] == ranks[at + same]:
            same += 1
        if same < len(kid.label):
            upper = _Node(kid.label[:same], kid.least, kid.most, kid.longest, [], kid.label_of)
            upper.uniform = kid.uniform
            upper.kids[kid.label[same]] = kid
            kid.label = kid.label[same:]
            node.kids[ranks[at]] = upper
            kid = upper
        node, at = kid, at + same


def _joined(groups: DataFrame, percent: int) -> DataFrame:
    """groups: near, i, j (a group), nid, size, freqs, members, known. The links of each group."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = pdf["members"].tolist()
        sizes = [len(x) for x in lists]
        keys = np.stack((np.concatenate(pdf["freqs"].tolist()), np.concatenate(lists)), 1)
        _, rank = np.unique(keys, axis=0, return_inverse=True)
        parts = np.split(rank.ravel(), np.cumsum(sizes)[:-1])
        sets = [(int(k), int(s), np.sort(r).tolist()) for k, s, r in zip(pdf["nid"], pdf["size"], parts, strict=True)]
        return pd.DataFrame(tree_links(sets, percent, pdf["known"].tolist()), columns=["a", "b"], dtype="int64")

    return groups.groupBy("near", "i", "j").applyInPandas(work, "a long, b long")


def _near(sets: DataFrame, percent: int) -> DataFrame:
    """near for each set that shares a member of its prefix with another."""
    early = sets.withColumn("left", F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("members")))
    early = early.select("nid", F.explode(F.expr("slice(members, 1, cast(left as int))")).alias("member"))
    heads = early.groupBy("member").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).where("a < z").select("member", "a")
    edges = early.join(save(heads, "heads"), "member").select("a", F.col("nid").alias("b")).where("a < b").distinct()
    return connected_components(edges).select(F.col("node").alias("nid"), F.col("component").alias("near"))


def _blocks(near: DataFrame, sets: DataFrame, within: bool) -> DataFrame:
    """Groups of at most about 2 * TREE_SETS sets: the blocks of each neighbourhood, or all pairs of its blocks. near: nid,
    near and known. These short rows are dealt by neighbourhood; the sets join them by nid, so a large neighbourhood
    is no one task's load."""
    sizes = save(near.groupBy("near").agg(F.ceil(F.count("*") / TREE_SETS).cast("int").alias("blocks")), "near-sizes")
    cut = near.join(sizes, "near").withColumn("i", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    if within:
        cut = cut.withColumn("j", F.col("i"))
    else:
        cut = cut.withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)"))).where("blocks = 1 or k <> i")
        cut = cut.withColumn("j", F.greatest("i", "k")).withColumn("i", F.least("i", "k"))
    return cut.select("near", "i", "j", "nid", "known").join(sets, "nid")


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets (nid, size, freqs, members) in neighbourhoods (nid, near): in blocks first; in a neighbourhood
    of several blocks, then among one set of each component found, and last among all sets of neighbourhoods that still
    have several components."""
    near = near.withColumn("known", F.col("nid"))
    links = save(_joined(_blocks(near, sets, True), percent), "links")
    large = near.groupBy("near").count().where(F.col("count") > TREE_SETS).select("near")
    if large.isEmpty():
        return links
    rest = save(near.join(large, "near", "left_semi"), "large")

    def known(links: DataFrame) -> DataFrame:
        found = connected_components(links).select(F.col("node").alias("nid"), "component")
        out = rest.drop("known").join(found, "nid", "left").withColumn("known", F.coalesce("component", "nid")).drop("component")
        return save(out, "known")

    heads = known(links).where("nid = known")
    links = save(links.unionAll(_joined(_blocks(heads, sets, False), percent)), "links")
    apart = known(links)
    several = apart.groupBy("near").agg(F.min("known").alias("p"), F.max("known").alias("q")).where("p < q").select("near")
    apart = apart.join(several, "near", "left_semi")
    return links.unionAll(_joined(_blocks(apart, sets, False), percent))


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups: documents are linked when the Jaccard index of their sets of word n-grams reaches
    ``percent`` / 100, and links are followed.

    Returns one row for every input row: doc_id, n_shingles long, component_id (the smallest id that links reach). Words
    are runs of anything but ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased. A text of fewer than ``n`` words has them all
    as its one n-gram; a null, empty or word-free text has an empty set, which is linked with nothing. Equal sets are
    linked, so repeated rows are. Null ids are passed over when the smallest id is sought. An empty table gives an empty
    result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(32, text_bytes(source) // BUCKET_BYTES)
    found = save(_find(source, n, percent, buckets), "ngram-find")
    members = found.where("bucket is not null").select("bucket", "base", "members", "owners")
    met = members.groupBy("bucket").applyInArrow(_met, "rid long").groupBy("rid").agg(F.count("*").alias("met"))
    rows = found.where("rid is not null").select("rid", "doc_id", "size", "s1", "s2", "least", "own")
    alive = rows.join(met, "rid", "left").where("size > 0 and own + coalesce(met, 0) >= least")
    alive = save(alive.select("doc_id").distinct().withColumnRenamed("doc_id", "alive_id"), "alive")

    # the ids grow with the corpus, so this join is a shuffle at every size
    texts = source.join(alive.hint("merge"), F.col("doc_id").eqNullSafe(F.col("alive_id")), "left_semi").select("text")
    sets = _sets(texts, n).where("size > 0").groupBy("s1", "s2", "size").agg(F.first("members").alias("members"))
    sets = save(sets.withColumn("nid", F.monotonically_increasing_id()), "sets")
    each = sets.select("nid", "size", F.explode("members").alias("member"))
    counts = save(each.groupBy("member").agg(F.count("*").alias("freq")).where("freq > 1"), "member-counts")
    ordered = each.join(counts, "member").groupBy("nid", "size").agg(F.sort_array(F.collect_list(F.struct("freq", "member"))).alias("m"))
    ordered = ordered.where(F.size("m") >= F.ceil(F.col("size") * percent / 100))
    ordered = save(ordered.select("nid", "size", F.col("m.freq").alias("freqs"), F.col("m.member").alias("members")), "ordered")
    discard(counts)
    near = save(_near(ordered, percent), "near")
    links = save(_links(near, ordered, percent), "all-links")
    parts = connected_components(links).withColumnRenamed("node", "nid")
    named = save(sets.select("nid", "s1", "s2").join(parts, "nid", "left").select("s1", "s2", F.coalesce("component", "nid").alias("part")), "parts")

    out = save(rows.where("size > 0").select("doc_id", "size", "s1", "s2").join(named, ["s1", "s2"], "left").select("doc_id", "size", "part"), "ngram-rows")
    least = save(out.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least_id")), "least")
    linked = out.where("part is not null").join(least, "part").select("doc_id", F.col("size").alias("n_shingles"), F.col("least_id").alias("component_id"))
    alone = rows.where("size = 0").select("doc_id", "size").unionAll(out.where("part is null").select("doc_id", "size"))
    return linked.unionAll(alone.select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))

"""Removal of every byte that a repeated substring covers, by suffix arrays.

A substring of ``length`` bytes is a window. Each window has an anchor, the least hash of the 16-byte strings that begin
in its first REACH bytes, which equal windows have at the same place. Windows in a row that share an anchor make a run.

1. Runs whose anchors are followed by the same bytes, as far as all their windows go (the core), may share windows.
   Counted over the corpus, most cores are found once, and their runs drop out. A run that is found twice as a whole is
   repeated in all its windows.
2. What is left are runs that share a core with a different run: around the ends of repeated passages. They are
   gathered by core and written as strings in which the core is one symbol, so that a window of bytes is a window of
   REACH symbols. A suffix array of these strings, built by grouping (see suffix_array), puts equal windows side by side.
3. Documents lose the bytes that their repeated windows cover.

All bytes of all texts take part; windows are judged on the input. Bytes under a core's hash of 64 bits are not compared
again; two cores that differ are taken for one with probability 2 ** -64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save, text_bytes
from .suffix_array import suffix_array
from .textvec import _BYTES, BLOCK_BYTES, column_bytes, mix, powers, row_blocks, slices

REACH = 64  # bytes among which a window's anchor is chosen
GRAM = 16  # bytes that are hashed to choose it
GROUP_RUNS = 1000  # runs that one suffix array takes, about
BUCKET_BYTES = 3_500_000  # of text, whose cores make up one bucket's rows on the average
HOT_RUNS = 3_000  # runs of one core beyond which its windows are counted by digest, spread over all tasks


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of consecutive texts: each run's row, first and last window, anchor, and hashes of its core and of all its bytes."""
    n, reach = len(data), REACH
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64(0xFFFFFFFF)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of several
    span = 1
    while span * 2 <= reach:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < reach:
        least = np.minimum(least[: len(least) - reach + span], least[reach - span :])
    at = np.arange(min(len(least), n - length + 1))
    row = np.searchsorted(bounds, at, "right") - 1
    whole = at + length <= bounds[row + 1]
    anchor = (least[: len(at)][whole] & low).astype(np.int64)
    at, row = at[whole], row[whole]
    if not len(at):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    lo, hi, a = at[new], at[np.append(new[1:], len(at)) - 1], anchor[new]
    core = mix((total[a + length - reach + 1] - total[a]) * down[a])
    shape = ((hi - lo) * reach + a - lo).astype(np.uint64)
    return row[new], lo, hi, a, core, mix((total[hi + length] - total[lo]) * down[lo] + mix(shape))


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """Blocks of rows, with their runs (rows and bytes count within the block). A document too long for a block has its
    runs cut where its pieces meet; they are pieced together here."""
    for i, j in row_blocks(bounds):
        a, b = int(bounds[i]), int(bounds[j])
        if b - a <= 4 * BLOCK_BYTES:
            yield i, j, _runs(data[a:b], bounds[i : j + 1] - a, length)
            continue
        parts = []
        for s in range(a, b - length + 1, BLOCK_BYTES):
            e = min(s + BLOCK_BYTES + length - 1, b)
            row, lo, hi, anchor, core, ext = _runs(data[s:e], np.array([0, e - s]), length)
            parts.append((row, lo + s - a, hi + s - a, anchor + s - a, core, ext))
        yield i, j, tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _offer(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Documents (rid, doc_id, t1, t2, sure, mixed): their runs, by number, that are found twice in the batch, and those
    of cores with three or more different runs in it. And for each batch and bucket of cores, of each other core up to two
    different runs: cores (32 bits), exts, owners (document in the batch), orders (number of the run), flags (1: found
    twice; 2: the core has more runs than these)."""
    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, sure binary, mixed binary, bucket long, base long, cores binary, exts binary, owners binary, orders binary, flags binary"
    names = ["rid", "doc_id", "t1", "t2", "sure", "mixed", "bucket", "base", "cores", "exts", "owners", "orders", "flags"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, 1, 1 << 23):
                data, bounds = column_bytes(batch.column(1))
                parts = []
                for i, _, (row, _, _, _, core, ext) in runs(data, bounds, length):
                    count = np.bincount(row) if len(row) else np.zeros(0, np.int64)
                    parts.append((row + i, np.arange(len(row)) - (np.cumsum(count) - count)[row], core, ext))
                row, nth, core, ext = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((ext, core))
                row, nth, core, ext = row[order], nth[order], core[order], ext[order]
                new_core = np.append(True, core[1:] != core[:-1])[: len(core)]
                new_ext = new_core | np.append(True, ext[1:] != ext[:-1])[: len(core)]
                which = np.cumsum(new_ext) - 1
                twice = np.bincount(which)[which] > 1 if len(core) else new_ext
                of_core = np.cumsum(new_core) - 1
                kinds = np.bincount(of_core, new_ext)[of_core] if len(core) else new_ext
                head = np.flatnonzero(new_core)
                rank = which - which[head][of_core] if len(core) else which  # of its kind within the core
                many = kinds > 2
                sent = new_ext & (rank < 2)
                # of cores with many runs, every kind goes to the suffix arrays, once from each batch
                mixed = new_ext & many
                b = ((core >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                s = np.flatnonzero(sent)
                cuts = np.flatnonzero(np.append(True, b[s][1:] != b[s][:-1])) if len(s) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(s))[: len(cuts)]
                cols = (
                    core[s].astype(np.uint32),
                    ext[s],
                    row[s].astype(np.uint16),
                    nth[s].astype(np.uint32),
                    (twice[s] + 2 * many[s]).astype(np.uint8),
                )
                k, m = batch.num_rows, len(cuts)
                lists = []
                for mask in (twice, mixed):
                    r, x = row[mask], nth[mask].astype(np.uint32)
                    sort = np.argsort(r, kind="stable")
                    edge = np.searchsorted(r[sort], np.arange(k + 1))
                    x = x[sort]
                    lists.append([x[p:q].tobytes() if q > p else None for p, q in zip(edge[:-1], edge[1:], strict=True)])
                longs = lambda x: pa.array(np.concatenate((x, np.zeros(m, np.int64))), pa.int64(), mask=np.arange(k + m) >= k)
                pad = lambda x: pa.concat_arrays([x, pa.nulls(m, x.type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        longs(base + np.arange(k)),
                        *(pad(batch.column(c)) for c in (0, 2, 3)),
                        *(pad(pa.array(x, pa.binary())) for x in lists),
                        pa.array([None] * k + [int(x) for x in b[s][cuts]], pa.int64()),
                        pa.array([None] * k + [base] * m, pa.int64()),
                        *(pa.array([None] * k + [c[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()) for c in cols),
                    ],
                    names=names,
                )
                base += k

    return docs.mapInArrow(work, schema)


def _decide(table: pa.Table) -> pa.Table:
    """Of a bucket: the runs that are repeated (sure) and those that the suffix arrays need (mixed), by document."""
    take = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
    cores = take("cores", np.uint32)
    base = np.repeat(table.column("base").to_numpy(), [len(x) for x in cores])
    core, ext = np.concatenate(cores), np.concatenate(take("exts", np.uint64))
    rid = base + np.concatenate(take("owners", np.uint16))
    nth, flag = np.concatenate(take("orders", np.uint32)), np.concatenate(take("flags", np.uint8))
    order = np.lexsort((ext, core))
    core, ext, rid, nth, flag = core[order], ext[order], rid[order], nth[order], flag[order]
    new_core = np.append(True, core[1:] != core[:-1])
    new_ext = new_core | np.append(True, ext[1:] != ext[:-1])
    which, of_core = np.cumsum(new_ext) - 1, np.cumsum(new_core) - 1
    sure = (np.bincount(which)[which] > 1) | (flag & 1 > 0)
    several = (np.bincount(of_core, new_ext)[of_core] > 1) | (np.bincount(of_core, flag & 2)[of_core] > 0)
    # a repeated run stands for all its equals; one that nothing equals stands for itself
    mixed = several & (new_ext | ~sure)
    kept = (sure & (flag & 1 == 0)) | mixed
    rid, nth, code = rid[kept], nth[kept], (sure[kept] + 2 * mixed[kept]).astype(np.uint32)
    order = np.argsort(rid, kind="stable")
    rid, packed = rid[order], (nth[order].astype(np.uint64) << np.uint64(2) | code[order]).astype(np.uint64)
    own, cuts = np.unique(rid, return_index=True)
    ends = np.append(cuts[1:], len(rid))[: len(cuts)]
    return pa.table({"rid": pa.array(own, pa.int64()), "found": pa.array([packed[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})


def _cover(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [lo, hi) as maximal intervals; those that touch are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return lo[new], hi[np.append(new[1:], len(lo)) - 1]


def _cut(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    edges = np.concatenate(([0], np.stack((lo, hi), 1).ravel(), [len(raw)])).tolist()
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _apply(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc_id, text, sure, mixed, found. For each: did, raw bytes, the intervals that sure runs cover, and its runs
    for the suffix arrays as structs of core, first window, sure, and the bytes before and behind the core."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"did long, doc_id {kind}, raw binary, los array<long>, his array<long>, open boolean, parts array<struct<core: long, lo: long, sure: boolean, head: binary, tail: binary>>"
    part = pa.struct([("core", pa.int64()), ("lo", pa.int64()), ("sure", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary())])
    inner = length - REACH + 1

    def ints(column: pa.Array, kind) -> list[np.ndarray]:
        return [np.unique(np.concatenate([np.frombuffer(x, kind) for x in (v if isinstance(v, list) else [v]) if x] or [np.zeros(0, kind)])) for v in column.to_pylist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        did = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, 1, 1 << 22)):
            data, bounds = column_bytes(batch.column(1))
            own_sure, own_mixed, found = ints(batch.column(2), np.uint32), ints(batch.column(3), np.uint32), ints(batch.column(4), np.uint64)
            los, his, opens, parts = [], [], [], []
            busy = np.array([len(a) + len(b) + len(c) > 0 for a, b, c in zip(own_sure, own_mixed, found, strict=True)], bool)
            for r in range(batch.num_rows):
                if not busy[r]:
                    los.append([]), his.append([]), opens.append(False), parts.append([])
                    continue
                raw = data[bounds[r] : bounds[r + 1]]
                (_, _, (_, lo, hi, anchor, core, _)), *_ = runs(raw, np.array([0, len(raw)]), length)
                nth, code = (found[r] >> np.uint64(2)).astype(np.int64), (found[r] & np.uint64(3)).astype(np.int64)
                sure, mixed = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
                sure[own_sure[r]] = True
                mixed[own_mixed[r]] = True
                sure[nth[code & 1 > 0]] = True
                mixed[nth[code & 2 > 0]] = True
                a, b = _cover(lo[sure], hi[sure] + length)
                los.append(a.tolist()), his.append(b.tolist())
                opens.append(bool((mixed & ~sure).any()))
                text = raw.tobytes()
                parts.append(
                    [
                        (int(core[x].view(np.int64)), int(lo[x]), bool(sure[x]), text[lo[x] : anchor[x]], text[anchor[x] + inner : hi[x] + length])
                        for x in np.flatnonzero(mixed)
                    ]
                )
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(did + np.arange(n)),
                    batch.column(0),
                    pa.array([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    pa.array(los, pa.list_(pa.int64())),
                    pa.array(his, pa.list_(pa.int64())),
                    pa.array(opens, pa.bool_()),
                    pa.array([[dict(zip(part.names, x, strict=True)) for x in own] for own in parts], pa.list_(part)),
                ],
                names=["did", "doc_id", "raw", "los", "his", "open", "parts"],
            )
            did += n

    return docs.mapInArrow(work, schema)


def repeated_windows(table: pa.Table) -> pa.Table:
    """Of a group of runs: for each that isn't sure, its windows that occur elsewhere in the group, as intervals.

    The strings of the runs, each behind a separator of its own, make one text; the separators are its smallest symbols,
    so no match crosses them. Equal windows follow one another in its suffix array."""
    n = table.num_rows
    heads, tails = ([np.frombuffer(x.as_py(), np.uint8) for x in table.column(c)] for c in ("head", "tail"))
    _, core = np.unique(table.column("core").to_numpy(), return_inverse=True)
    sizes = np.array([len(a) + len(b) + 1 for a, b in zip(heads, tails, strict=True)])
    starts = np.cumsum(sizes + 1) - sizes - 1  # of the separators
    text = np.concatenate([x for i in range(n) for x in ([n - i], heads[i] + np.int64(n + 1), [n + 257 + core[i]], tails[i] + np.int64(n + 1))] + [[0]])
    sa = np.array(suffix_array(text))
    run = np.searchsorted(starts, sa, "right") - 1
    offset = sa - starts[run] - 1
    whole = (offset >= 0) & (offset + REACH <= sizes[run])
    sa, run, offset = sa[whole], run[whole], offset[whole]
    equal = np.zeros(len(sa) + 1, bool)
    step = np.arange(REACH)
    for a in range(1, len(sa), 10_000):
        b = min(a + 10_000, len(sa))
        equal[a:b] = (text[sa[a:b, None] + step] == text[sa[a - 1 : b - 1, None] + step]).all(1)
    sure = np.array(table.column("sure").to_pylist(), bool)
    hit = (equal[:-1] | equal[1:]) & ~sure[run]
    lo = table.column("lo").to_numpy()[run[hit]] + offset[hit]
    return pa.table({"did": pa.array(table.column("did").to_numpy()[run[hit]], pa.int64()), "window": pa.array(lo, pa.int64())})


def _intervals(table: pa.Table) -> pa.Table:
    """repeated_windows() with consecutive windows joined."""
    found = repeated_windows(table)
    did, at = found.column("did").to_numpy(), found.column("window").to_numpy()
    order = np.lexsort((at, did))
    did, at = did[order], at[order]
    new = np.flatnonzero(np.append(True, (did[1:] != did[:-1]) | (at[1:] > at[:-1] + 1))) if len(did) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(did)) - 1
    return pa.table({"did": pa.array(did[new], pa.int64()), "lo": pa.array(at[new], pa.int64()), "hi": pa.array(at[last], pa.int64())} if len(new) else {k: pa.array([], pa.int64()) for k in ("did", "lo", "hi")})


def _digests(parts: DataFrame) -> DataFrame:
    """The windows of hot cores, one row each, by digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                text = r["head"] + b"|" + r["tail"]
                n = len(text) - REACH + 1
                key = r["core"].to_bytes(8, "little", signed=True)
                d = [hashlib.blake2b(text[i : i + REACH], digest_size=16, key=key + (len(r["head"]) - i).to_bytes(8, "little", signed=True)).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.binary()), pa.array([r["did"]] * n, pa.int64()), pa.array([r["lo"] + i for i in range(n)], pa.int64()), pa.array([r["sure"]] * n, pa.bool_())],
                    names=["digest", "did", "window", "sure"],
                )

    return parts.mapInArrow(work, "digest binary, did long, window long, sure boolean")


def _finish(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc_id, raw, los, his (covered already), more (structs lo, hi of repeated windows)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            out = []
            for raw, los, his, more in zip(*(batch.column(c).to_pylist() for c in ("raw", "los", "his", "more")), strict=True):
                lo = np.array([*los, *(x["lo"] for x in more or ())], np.int64)
                hi = np.array([*his, *(x["hi"] + length for x in more or ())], np.int64)
                lo, hi = _cover(lo, hi)
                out.append((len(raw), int((hi - lo).sum()), len(lo), _cut(raw, lo, hi)))
            sizes, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return docs.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Remove each byte that lies in a string of ``length`` bytes which also starts at another place of the corpus, the
    same document included, with overlaps.

    Returns one row for every input row: doc_id, n_bytes (of the UTF-8 text), n_removed, n_spans (maximal removed runs)
    long, kept binary (the other bytes in their order; a cut may fall within a character). A null text counts as empty;
    texts of under ``length`` bytes lose nothing. Repeated rows repeat each other's strings, so they lose all bytes from
    ``length`` on. Null ids are ids like any other; an empty table gives an empty result. Other columns are not read.

    The texts are shuffled once; from then on only documents with mixed runs move. A core that more than HOT_RUNS runs
    share has its windows counted by 128-bit digests instead of a suffix array, which no task would hold.
    """
    if length < REACH + GRAM:
        raise ValueError(f"length must be at least {REACH + GRAM}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(text)).alias("text"))
    source = source.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    buckets = max(32, text_bytes(source) // BUCKET_BYTES)
    offers = save(_offer(source, length, buckets), "runs")
    found = offers.where("bucket is not null").select("bucket", "base", "cores", "exts", "owners", "orders", "flags")
    found = found.groupBy("bucket").applyInArrow(_decide, "rid long, found binary").groupBy("rid").agg(F.collect_list("found").alias("found"))
    own = offers.where("rid is not null").select("rid", "doc_id", "t1", "t2", "sure", "mixed").join(found, "rid", "left")
    own = own.where("sure is not null or mixed is not null or found is not null")
    # rows that share id and text are alike in all that follows
    hits = own.groupBy("doc_id", "t1", "t2").agg(
        F.collect_set("sure").alias("sure"), F.collect_set("mixed").alias("mixed"), F.flatten(F.collect_set("found")).alias("found")
    )
    hits = save(hits.withColumnRenamed("doc_id", "hit_id"), "hits")
    discard(offers)
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (source["t1"] == hits["t1"]) & (source["t2"] == hits["t2"])
    both = source.join(hits, on, "left").select("doc_id", "text", "sure", "mixed", "found")
    state = save(_apply(both, length), "runs-applied")

    parts = state.where("size(parts) > 0").select("did", F.explode("parts").alias("p")).select("did", "p.*")
    counts = parts.groupBy("core").count().where(f"count > {HOT_RUNS}").select("core")
    hot = save(counts, "hot-cores")
    some = not hot.isEmpty()
    cold = parts.join(hot, "core", "left_anti") if some else parts
    groups = max(1, parts.count() // GROUP_RUNS)
    # by count: a suffix array takes a second for few bytes, so Spark's merging of small partitions would leave few tasks
    tasks = max(1, groups // max(4, groups // 20_000))
    met = cold.withColumn("g", F.pmod(F.xxhash64("core"), F.lit(groups))).repartition(tasks, "g").groupBy("g").applyInArrow(_intervals, "did long, lo long, hi long")
    if some:
        windows = save(_digests(parts.join(hot, "core")), "hot-windows")
        twice = save(windows.groupBy("digest").count().where("count > 1").select("digest"), "hot-digests")
        more = windows.where("not sure").join(twice, "digest").select("did", F.col("window").alias("lo"), F.col("window").alias("hi"))
        met = met.unionAll(more)
    met = save(met.groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("more")), "met")
    closed = state.where("not open").select("doc_id", "raw", "los", "his", F.lit(None).cast("array<struct<lo: long, hi: long>>").alias("more"))
    opened = state.where("open").join(met, "did", "left").select("doc_id", "raw", "los", "his", "more")
    return _finish(closed, length).unionAll(_finish(opened, length))

"""Mixing sources to target weights in fixed-length token blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_DIGITS, order_key, save
from .textvec import mix as scramble

#: A token is a run of anything but these characters.
TOKEN = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Tokens to take from each source: ``share`` of all tokens by weight, at most ``most`` times a source's own, the
    excess going to the other sources by weight until none is above."""
    limits = [most * s for s in sizes]
    out, open_, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > limits[i]]
        for i in over or open_:
            out[i] = limits[i] if over else rest * weights[i] / total
        if not over:
            break
        rest -= sum(limits[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draw(slots: Sequence[int], shards: int, seed: int | list[int]) -> np.ndarray:
    """Slots of each source in each output shard: multinomial draws with the sources' open slots as weights. What a draw
    has beyond a source's open slots is drawn again among the others, so that the shards add up to ``slots``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    for k in range(shards):
        need = int(left.sum()) // (shards - k)
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1 chosen by key: a Feistel network over the next power of four, walked on
    until it comes back under n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for r in range(4):
            left, right = right, left ^ (scramble(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & mask)
        return left << half | right

    out = once(x.astype(np.uint64))
    while (away := out >= np.uint64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


@dataclass
class Mix:
    """rows: each document as struct ``row`` with source_no, size and begin (its first token's place in its source).
    slots: out_shard, source_no, block, one row for each block that the mix takes. sources: source, source_no, weight,
    source_size, blocks, target and slots of each."""

    rows: DataFrame
    slots: DataFrame
    sources: DataFrame
    block_tokens: int

    def pieces(self) -> DataFrame:
        """The parts of documents that lie in one block, with the times that the block is taken: source_no, begin,
        first and end (tokens of the document), times."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        size = self.block_tokens
        parts = self.rows.where("size > 0").select(
            "source_no", "begin", "size", F.explode(F.expr(f"sequence(begin div {size}, (begin + size - 1) div {size})")).alias("block")
        )
        first, end = F.greatest(F.lit(0), F.col("block") * size - F.col("begin")), F.least("size", (F.col("block") + 1) * size - F.col("begin"))
        return parts.join(times, ["source_no", "block"]).select("source_no", "begin", first.alias("first"), end.alias("end"), "times")

    def taken(self) -> DataFrame:
        """rows with ``taken``: the tokens of each document that the mix takes, repeats counted."""
        sums = self.pieces().groupBy("source_no", "begin").agg(F.sum(F.expr("(end - first) * times")).alias("taken"))
        # a document with tokens has its begin to itself
        some = self.rows.where("size > 0").join(sums, ["source_no", "begin"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        none = self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return some.unionByName(none)


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_tokens: int = 128,
    out_shards: int = 64,
    max_sources: int = 10_000,
    seed: int = 1,
    keep: Sequence[str] | None = None,
) -> Mix:
    """Plan a mix of all documents; ``keep`` names the columns that ``row`` holds (all, if not given).

    The documents of a source, in an order fixed by their ids, form one stream of tokens, cut into blocks of
    ``block_tokens`` (the last may be shorter). Source i of the sources in code point order (null, itself a source, comes
    last) weighs weights[i % len(weights)]. The slots of a source, as many as its target has blocks, are spread over
    ``out_shards`` by multinomial draws; slot i takes block permute(i % blocks) of the source, so every block is taken
    floor or ceil of slots / blocks times and never over ``most``.

    A null or token-free text has size 0 and is never taken. Repeated rows are documents of their own. A null id is an
    id like any other. An empty table gives an empty mix. The same documents always give the same mix.

    Only the totals of up to ``max_sources`` sources come to the driver. Of more sources, targets and slots are computed in
    tables, the slots in groups of ``max_sources`` sources. Running sums go by source and 4,096 hash buckets, so that a
    source with a third of all rows spreads over as many tasks.
    """
    rows = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"),
        F.col(id_col).alias("id"),
        order_key(F.col(id_col)).alias("place"),
    )
    return _plan(rows, weights, share, most, block_tokens, out_shards, max_sources, seed)


def _deal(numbers: np.ndarray, slots: np.ndarray, blocks: np.ndarray, shards: int, seed: int | list[int]) -> pd.DataFrame:
    """Runs of at most a million slots: of each shard and source, the first slot, their number, and the source's blocks."""
    counts, step = draw(slots, shards, seed), 1_000_000
    k, i = np.nonzero(counts)
    first = (np.cumsum(counts, axis=0) - counts)[k, i]
    many = counts[k, i]
    cuts = -(-many // step)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    k, i, first, many = (np.repeat(x, cuts) for x in (k, i, first, many))
    return pd.DataFrame({"out_shard": k, "source_no": numbers[i], "first": first + nth * step, "n": np.minimum(step, many - nth * step), "blocks": blocks[i]})


_SOURCES = "source string, source_no int, weight double, source_size long, blocks long, target double, slots long"
_RUNS = "out_shard int, source_no int, first long, n long, blocks long"


def _few_sources(spark, found, weights, share, most, block_tokens, out_shards, seed) -> tuple[DataFrame, DataFrame]:
    """The sources and their runs, from the list of all sources."""
    found = sorted(((r["source"], int(r["n"])) for r in found), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [n for _, n in found]
    own = [float(weights[i % len(weights)]) for i in range(len(found))]
    goal = targets(sizes, own, share, most)
    blocks = [-(-n // block_tokens) for n in sizes]
    slots = [round(t * b / n) if n else 0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
    table = [(s, i, w, n, b, t, k) for i, ((s, n), w, b, t, k) in enumerate(zip(found, own, blocks, goal, slots, strict=True))]
    runs = _deal(np.arange(len(found)), np.array(slots, np.int64), np.array(blocks, np.int64), out_shards, seed)
    return spark.createDataFrame(table, _SOURCES), spark.createDataFrame(runs, _RUNS)


def _many_sources(per: DataFrame, weights, share, most, block_tokens, out_shards, group, seed) -> tuple[DataFrame, DataFrame]:
    """The same, as tables, from a row for each source (source, n). The targets stop at a level, the tokens for a weight of
    1, that rises while sources are above their limits: one aggregate a round. Slots are drawn for ``group`` sources at a
    time, so a shard's counts are the sum of the groups' multinomial draws."""
    spark = per.sparkSession
    placed = save(per.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    part, nth = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = spark.createDataFrame([(p, sum(n for _, n in sizes[:j])) for j, (p, _) in enumerate(sizes)], "part int, start long")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    table = placed.select("source", "n", part.alias("part"), nth.alias("nth")).join(F.broadcast(starts), "part")
    table = table.select("source", (F.col("start") + F.col("nth")).cast("int").alias("source_no"), F.col("n").alias("source_size"))
    table = table.withColumn("weight", F.get(cycle, F.col("source_no") % len(weights))).withColumn("most", F.col("source_size") * float(most))

    level, capped = 0.0, -1
    while True:
        above, some = F.col("weight") * level > F.col("most"), F.col("source_size") > 0
        row = table.where(some).agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.sum("source_size")
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (share * float(row[3]) - row[1]) / row[2]
    table = table.withColumn("blocks", F.expr(f"(source_size + {block_tokens - 1}) div {block_tokens}"))
    table = table.withColumn("target", F.when(F.col("source_size") > 0, F.least("most", F.col("weight") * level)).otherwise(0.0))
    slots = F.when(F.col("source_size") > 0, F.bround(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sources = save(table.select("source", "source_no", "weight", "source_size", "blocks", "target", slots.alias("slots")), "mix-targets")

    def deal(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("source_no")
        return _deal(*(own[c].to_numpy() for c in ("source_no", "slots", "blocks")), out_shards, [seed, int(key[0])])

    runs = sources.where("slots > 0").select("source_no", "slots", "blocks").groupBy(F.expr(f"source_no div {group}").alias("part")).applyInPandas(deal, _RUNS)
    # a group's runs come from one task, and each grows to as many slots as a run has
    tasks = max(spark.sparkContext.defaultParallelism, sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0] // 1_000_000)
    return sources, runs.repartition(tasks, "out_shard", "source_no", "first")


def _plan(rows: DataFrame, weights, share, most, block_tokens, out_shards, max_sources, seed) -> Mix:
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = save(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    per = sums.groupBy("source").agg(F.sum("n").alias("n"))
    found = per.limit(max_sources + 1).collect()
    few = len(found) <= max_sources
    if few:
        sources, runs = _few_sources(spark, found, weights, share, most, block_tokens, out_shards, seed)
    else:
        sources, runs = _many_sources(per, weights, share, most, block_tokens, out_shards, max_sources, seed)

    numbers = sources.select(F.col("source").alias("s"), "source_no")
    numbers = F.broadcast(numbers) if few else numbers
    number = lambda df: df.join(numbers, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = number(sums).select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_no", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = number(rows).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_no", "bucket"])
    placed = save(placed.select("row", "source_no", "size", (F.col("start") + F.col("inner")).alias("begin")), "mix-placed")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, i, r, n, b in batch.itertuples(index=False):
                at = permute(np.arange(r, r + n) % b, b, seed * 1_000_003 + i)
                yield pd.DataFrame({"out_shard": np.int32(k), "source_no": np.int32(i), "block": at})

    taken = runs.mapInPandas(fill, "out_shard int, source_no int, block long")
    return Mix(placed, taken, sources, block_tokens)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: pass r holds the tokens of each document whose blocks are
    taken r times or more, so a document gives a row for each pass that takes some of it. A pass that takes all keeps
    the text as it is; else the taken tokens follow in their order, a space between them. ``size_col``, if it exists, is
    set to the new number of characters. Options and special cases are those of plan_mix()."""
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    parts = plan.pieces().groupBy("source_no", "begin").agg(F.sort_array(F.collect_list(F.struct("first", "end", "times"))).alias("parts"))
    rows = plan.rows.where("size > 0").join(parts, ["source_no", "begin"])
    rows = rows.withColumn("pass", F.explode(F.expr("sequence(1L, array_max(transform(parts, p -> p.times)))")))
    rows = rows.withColumn("parts", F.expr("filter(parts, p -> p.times >= pass)"))
    text = F.col(f"row.`{text_col}`")
    rows = rows.withColumn("whole", F.expr("aggregate(parts, 0L, (n, p) -> n + p.end - p.first) = size"))
    rows = rows.withColumn("tokens", F.when(~F.col("whole"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))))
    cut = F.expr("array_join(flatten(transform(parts, p -> slice(tokens, cast(p.first + 1 as int), cast(p.end - p.first as int)))), ' ')")
    rows = rows.withColumn("text", F.when(F.col("whole"), text).otherwise(cut))
    out = []
    for c in docs.columns:
        new = F.col("text") if c == text_col else F.char_length("text").cast("long") if c == size_col else F.col(f"row.`{c}`")
        out.append(new.alias(c))
    return rows.select(*out)

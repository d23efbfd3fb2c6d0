"""Weighted rendezvous sharding with gapless slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_DIGITS, order_key


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, of 0 to len(weights) - 1, that wins the key: each draws an exponential time with its weight as rate, from
    a hash of key and shard alone, and the earliest wins. Adding a shard, or raising a weight, moves keys only there."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    shards = F.array(*(F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)))
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def drawn(x: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", name, x["s"].cast("string"))), 1, 13), 16, 10).cast("long")
        return F.struct((-F.log((bits + 1) / F.lit(2.0**52)) / x["w"]).alias("t"), x["s"].alias("s"))

    return F.array_min(F.transform(shards, drawn))["s"]


def shard(docs: DataFrame, *, id_col: str = "doc_id", weights: Sequence[float] = (1.0,) * 40, ties: Sequence[str] = ()) -> DataFrame:
    """All columns of ``docs`` with shard int and slot long (columns so named are replaced).

    A row's shard depends on its id and the weights only, so equal ids share a shard. Slots count from 0 within each
    shard without gaps, by a hash of the id, then the id, then ``ties``; rows alike in all of these may swap slots.
    A null id is a key like any other. An empty table gives an empty result.

    Slots come from row numbers within 4,096 hash buckets of each shard and the buckets' offsets. The rows are dealt by
    shard and bucket already, so the join with the offsets moves those only.
    """
    key, kept = F.col(id_col), [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*kept).alias("row"), rendezvous(key, weights).alias("shard"), order_key(key).alias("place"))
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", *(F.col(f"row.`{c}`") for c in (id_col, *ties)))
    rows = rows.withColumn("nth", F.row_number().over(within)).join(offsets, ["shard", "bucket"])
    return rows.select("row.*", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))

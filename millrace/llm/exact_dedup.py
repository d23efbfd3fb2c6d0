"""Exact deduplication by deterministic block naming.

Normalised texts are cut into fixed-size blocks. The distinct blocks are sorted and get integer names; then adjacent
pairs of names are named again, level by level, until each document has one name. Names are given to distinct values,
never to digests of them, so two documents share an identity exactly if their bytes are equal.

Rows are followed by (id, SHA-256 of the normalised text), so that repeated ids stay apart; the digest never decides
equality of two documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, save, text_or_empty


def _names(values: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Integer names of the distinct rows: sorted within each partition, numbered, and written, so that they never change."""
    named = values.select(*cols).distinct().sortWithinPartitions(*cols)
    return save(named.withColumn("name", F.monotonically_increasing_id()), name)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    size = int(block_bytes)
    # explode() makes a column of the normalised text; a plain alias would be worked out again for every block
    base = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(ascii_lower(text_or_empty(text_col)).cast("binary"))).alias("b"))
    cut = f"transform(sequence(0, cast(greatest(ceil(octet_length(b) / {size}) - 1, 0) as int)), i -> substring(b, i * {size} + 1, {size}))"
    return base.withColumn("blocks", F.expr(cut))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z, and keep the row with the largest id of each group.

    Returns one row for every input row: doc_id, keep_id, group_size, kept, text_sha256. A null text counts as empty;
    empty texts form a group. Of rows that repeat the largest id, one is kept. A null id is smaller than any other; a
    group of null ids only has a null keep_id and keeps one row. An empty table gives an empty result. Other columns
    are not read, whatever their names.

    Cost: the texts are shuffled once, after map-side removal of repeated blocks; all later shuffles carry integers.
    """
    cut = _blocks(docs, id_col, text_col, block_bytes)
    names = _names(cut.select(F.explode("blocks").alias("block")), ["block"], "block-names")
    refs = save(
        cut.select("doc_id", F.unhex(F.sha2("b", 256)).alias("sha"), F.posexplode("blocks").alias("idx", "block"))
        .select("doc_id", "sha", "idx", F.xxhash64("block").alias("h")),
        "block-refs",
    )
    # A reference finds its block's name by a 64-bit hash if no two distinct blocks share one, and by its bytes otherwise.
    by_hash = names.select(F.xxhash64("block").alias("h"), "name")
    if by_hash.groupBy("h").count().where("count > 1").isEmpty():
        named = refs.join(by_hash, "h")
    else:
        whole = cut.select("doc_id", F.unhex(F.sha2("b", 256)).alias("sha"), F.posexplode("blocks").alias("idx", "block"))
        named = whole.join(names, "block")
    row = ["doc_id", "sha"]
    seq = F.expr("transform(sort_array(collect_set(struct(idx, name))), x -> x.name)").alias("names")
    state = save(named.groupBy(*row).agg(seq, F.sum((F.col("idx") == 0).cast("long")).alias("rows")), "name-seqs")
    discard(names, refs)

    done, level = [], 0
    while True:
        done.append(state.where("size(names) = 1").select(*row, "rows", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        active = state.where("size(names) > 1")
        if active.isEmpty():
            break
        pairs = active.select(
            *row,
            "rows",
            F.posexplode(
                F.expr("transform(sequence(0, cast(ceil(size(names) / 2) - 1 as int)), i -> struct(names[2 * i] as l, coalesce(get(names, 2 * i + 1), -1L) as r))")
            ).alias("idx", "pair"),
        ).select(*row, "rows", "idx", "pair.l", "pair.r")
        pair_names = _names(pairs, ["l", "r"], "pair-names")
        state = save(pairs.join(pair_names, ["l", "r"]).groupBy(*row).agg(seq, F.max("rows").alias("rows")), "name-seqs")
        discard(pair_names)
        level += 1

    rows = done[0]
    for x in done[1:]:
        rows = rows.unionAll(x)
    rows = save(rows, "identities")
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    each = rows.join(save(groups, "groups"), ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

"""Corpus-wide removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, save, text_or_empty


def _keys(text: Column, min_chars: int) -> Column:
    """A 128-bit key for each line, by position; null for lines too short to count."""
    trimmed = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    key = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))
    return F.transform(trimmed, lambda x: F.when(F.char_length(x) >= min_chars, key(x)))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents, in all of them.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; keys of under
    ``min_chars`` code points are never dropped. Returns all columns of ``docs``, with the remaining lines, joined by
    \\n in their old order, as text, and the columns n_lines (before) and n_dropped, which replace columns so named.

    A null or empty text has one empty line. Each row is a document of its own, repeated rows and null ids included.
    Losing all lines gives an empty text. An empty table gives an empty result.

    Lines are exploded, hashed and counted once per document; that is summed on the map side, so a line found
    everywhere costs a row for each task. The places of lines over the threshold go back to their documents, which are
    found by id and two hashes of the text, and what stands at the other places is put together again.
    """
    text = text_or_empty(text_col)
    per_doc = F.array_distinct(F.filter(_keys(text, min_chars), lambda x: x.isNotNull()))
    lines = docs.select(F.explode(per_doc).alias("k")).select("k.h1", "k.h2")
    common = save(lines.groupBy("h1", "h2").count().where(F.col("count") >= min_docs).select("h1", "h2"), "common-lines")
    # Whether a line goes depends on its key alone, so rows of the same id and text can share the places.
    name = lambda text: (F.xxhash64(text).alias("line_h1"), F.xxhash64(F.lit(1), text).alias("line_h2"))
    places = docs.select(F.col(id_col).alias("line_doc"), *name(text), F.posexplode(_keys(text, min_chars)).alias("at", "k"))
    places = places.select("line_doc", "line_h1", "line_h2", "at", "k.h1", "k.h2").join(common, ["h1", "h2"])
    drops = places.groupBy("line_doc", "line_h1", "line_h2").agg(F.collect_set("at").alias("line_drops"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("row_doc"), *(c.alias(f"row_h{i + 1}") for i, c in enumerate(name(text))))
    same = F.col("row_doc").eqNullSafe(F.col("line_doc")) & (F.col("row_h1") == F.col("line_h1")) & (F.col("row_h2") == F.col("line_h2"))
    both = rows.join(drops, same, "left")
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    both = both.withColumn("every", F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("every") - 1), F.col("line_drops"))  # by a hash set, in order
    rest = F.transform(left, lambda i: F.get(F.col("every"), i))
    both = both.withColumn("rest", F.when(F.col("line_drops").isNull(), F.col("every")).otherwise(rest))
    out = [F.array_join("rest", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept]
    n = F.size("every").cast("long")
    return both.select(*out, n.alias("n_lines"), (n - F.size("rest")).alias("n_dropped"))

"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix_tree_lm
from .common import LOWER, UPPER, read, text_or_empty
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import plan_mix
from .ngram_join import ngram_components
from .quality import fit, in_fold, quality_scores
from .sharding import rendezvous, shard
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts

SHARDS = 40


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty().cast("binary")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    out = shard(docs, weights=[1.0] * SHARDS, ties=("text_crc32", "size"))
    return out.withColumn("grown_shard", rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = plan_mix(docs, weights=(3, 1, 2), share=1.5, most=2.0, keep=["doc_id"])
    goals = plan.sources.select("source_no", "source_size", "target")
    return plan.taken().join(goals, "source_no").select("row.doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), rule="first")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, read(spark, sf_dir, "labels"), label_col="quality", modulus=5, max_rows=4000)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return quality_scores(docs, net).select("doc_id", in_fold(F.col("doc_id"), 5).alias("held_out"), "score", predicted)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), n=5, percent=80)


def op8_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = suffix_tree_lm.in_fold(F.col("doc_id"), 7, 2)
    scores = suffix_tree_lm.suffix_tree_scores(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)
    return found.where("contaminated").select("doc_id", "item_id", "coverage", "n_items", "contaminated")  # the documents that hold test items


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_rendezvous_sharding,
        op3_source_mixing,
        op4_line_dedup,
        op5_token_counts,
        op6_quality_classifier,
        op7_ngram_jaccard_join,
        op8_suffix_tree_scoring,
        op9_exact_dedup,
        op10_decontamination,
    )
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _shard_sql(n: int) -> str:
    drawn = "-ln((('0x' || md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s)[1:13])::BIGINT + 1) / 4503599627370496.0)"
    return f"(SELECT arg_min(s, {drawn}) FROM (SELECT unnest(range({n})) AS s))"


ORACLES: dict[str, str] = {
    "op2_rendezvous_sharding": f"""
        WITH poly AS (
          SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
            lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t),
        d AS (
          SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
            xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
              lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
          FROM documents, poly),
        s AS (SELECT *, {_shard_sql(SHARDS)} AS shard, {_shard_sql(SHARDS + 1)} AS grown FROM d)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
          row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id, text_crc32, size) - 1 AS slot,
          grown::INTEGER AS grown_shard
        FROM s""",
    "op4_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
        bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN bad USING (key) GROUP BY r""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
          row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}

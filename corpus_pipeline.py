"""A training-data pipeline: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read, save
from millrace.llm.decontaminate import decontaminate
from millrace.llm.mixing import mixed_documents
from millrace.llm.ngram_join import ngram_components
from millrace.llm.quality import fit, quality_scores
from millrace.llm.sharding import shard


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more. Empty documents have a score like any other."""
    net = fit(docs, read(spark, sf_dir, "labels"))
    return quality_scores(docs, net).where("score >= 0.3").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document with the smallest id; documents without an id go by
    a hash of their text and come after the others. Rows alike in id and text count as one, of which any stays; rows that
    share an id but not a text share its fate. Documents without words are no one's duplicates."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62))
    heads = ngram_components(docs.select(own.alias("own"), "text"), id_col="own", n=5, percent=80)
    heads = heads.where("doc_id = component_id").select(F.col("doc_id").alias("head")).distinct()
    text = F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own"), *text)
    return rows.join(heads, F.col("own") == F.col("head"), "left_semi").dropDuplicates(["own", "t1", "t2"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item of which tiles cover half or more."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by the weights 3, 1, 2, as documents; one taken twice gives two rows."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard, of 40, and the slot in it."""
    return shard(docs, weights=[1.0] * 40, ties=("text",))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The classifier is trained by gradient descent, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

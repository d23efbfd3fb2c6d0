"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch_root

# The ASCII letters, and the characters [\x20\x09-\x0D].
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its plan is then a plain scan, and a lost executor costs a reread only."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """The table itself if it is read from files or memory row by row, so that a lost task reads the same rows in the same
    order again; else a written copy."""
    plan = df._jdf.queryExecution().optimizedPlan()
    alone = {"LogicalRelation", "LocalRelation", "Project", "Filter", "Union", "Range"}

    def fixed(node) -> bool:
        below = node.children()
        return node.getClass().getSimpleName() in alone and node.deterministic() and all(fixed(below.apply(i)) for i in range(below.size()))

    return df if fixed(plan) else save(df, "settled")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the faster of the two and the same on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The bytes of all texts, by which buckets are cut; a pass that reads one column and shuffles a row for each task."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def order_key(key: Column) -> Column:
    """A stable pseudorandom place for a record key; its first three hex digits serve as one of 4,096 buckets."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("null")))


BUCKET_DIGITS = 3

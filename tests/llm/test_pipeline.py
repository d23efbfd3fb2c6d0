"""Each stage on tables without rows, with nulls, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import SCHEMA  # noqa: E402

PASSAGE = "one fine day the quick brown fox did jump over that lazy old dog and nobody saw it happen"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with benchmark and labels; labels also of ids that are null or met twice."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, int(k % 3 > 0), 0) for k in range(60)] + [(None, 1, 0), (5, 1, 0), (900, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(k):
    return " ".join(f"{'good' if k % 3 else 'bad!!'}{(k * 7 + i) % 50}" for i in range(20 + k % 9))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(k, plain(k), "en", f"s{k % 3}" if k % 4 else None, 0) for k in range(60)]
    rows += [(None, None, None, None, None), (None, plain(1), "en", "s1", 0), (None, plain(1) + " more", "en", "s1", 0)]
    rows += [(70, "", "en", "s0", 0), (71, "same text " * 9, "en", "s0", 0), (71, "same text " * 9, "en", "s0", 0), (72, "x" * 40_000, "en", "s0", 0), (73, f"before {PASSAGE} after", "en", "s0", 0), (None, f"{PASSAGE}!", "en", "s0", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("score", "label", "component_id", "head", "contaminated", "coverage", "size", "begin", "block", "row", "pass", "parts", "slot", "bucket", "place"))))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty(spark, tables, odd_docs, name, stage):
    assert stage(spark, odd_docs.limit(0), tables).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd(spark, tables, odd_docs, name, stage):
    out = stage(spark, odd_docs, tables)
    kept = [c for c in odd_docs.columns if c != "slot"]
    assert [c for c in out.columns if c not in ("shard", "slot")] == kept
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    before, after = sorted(map(key, odd_docs.collect())), sorted(map(key, out.collect()))
    assert {r["label"] for r in out.collect()} == {1}  # columns of the table come through, whatever their names
    if name == "near_duplicates":
        # a repeated row counts once; of those without an id, a copy of another document goes
        assert ("None", plain(1)) not in after and ("None", f"{PASSAGE}!") in after
        assert after.count(key({"doc_id": 71, "text": "same text " * 9})) == 1
        assert ("70", "") in after and {k for k, _ in after} <= {k for k, _ in before}
    elif name == "decontamination":
        assert set(before) - set(after) == {("73", f"before {PASSAGE} after"), ("None", f"{PASSAGE}!")} and len(after) == len(before) - 2
    elif name == "sharding":
        assert after == before
    elif name == "mixing":
        assert {k for k, t in before if t.strip()} >= {k for k, _ in after} and all(t for _, t in after)
    else:
        assert set(after) <= set(before)


def test_near_duplicates_by_brute_force(spark, tables, odd_docs):
    """One document of each group stays, that with the smallest id."""
    from . import brute

    docs = odd_docs.where("doc_id is not null").dropDuplicates()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = brute.groups(sorted(texts), {k: brute.shingles(t) for k, t in texts.items()})
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, tables).collect()) == sorted(set(groups.values()))

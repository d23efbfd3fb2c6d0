import os

import duckdb
import pytest

from millrace.llm.queries import ORACLES, QUERIES

from ..conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    out = QUERIES[name](spark, DATA)
    found = out.select("doc_id").distinct().count()
    assert 0 < found < n if name.startswith("op10_") else found == n


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert 0 < out.count()

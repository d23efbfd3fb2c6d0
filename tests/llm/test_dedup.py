import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import suffix_dedup
from millrace.llm.components import by_rounds, connected_components, smallest_reached
from millrace.llm.common import save
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.line_dedup import line_dedup
from millrace.llm.ngram_join import ngram_components, tree_links
from millrace.llm.suffix_array import suffix_array

from . import brute


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("text", [[1] * 300, [1, 2] * 150, [2, 1] * 150, [1, 1, 2] * 100, list(range(200, 0, -1)), list(range(1, 200))])
def test_suffix_array_of_runs(text):
    text = [*text, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def as_sha(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}


@pytest.mark.parametrize("length", [80, 200])
def test_suffix_dedup(docs, corpus, length):
    want = brute.windows([t for _, t in corpus], length)
    got = as_sha(suffix_dedup.suffix_dedup(docs, length=length).collect())
    assert got == {k: w for (k, _), w in zip(corpus, want, strict=True)}


def test_suffix_dedup_hot_cores_and_pieces(docs, corpus, monkeypatch):
    """Windows counted by digest, and documents in pieces, give the same."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 3)
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", 5)
    want = brute.windows([t for _, t in corpus], 100)
    got = as_sha(suffix_dedup.suffix_dedup(docs, length=100).collect())
    assert got == {k: w for (k, _), w in zip(corpus, want, strict=True)}


def test_runs_in_pieces(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.randrange(97, 100) for _ in range(5000))
    data = np.frombuffer(raw, np.uint8)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    [(_, _, (_, lo, hi, anchor, _, _))] = suffix_dedup.runs(data, np.array([0, 5000]), 100)
    assert [x for a, b in zip(lo, hi, strict=True) for x in range(a, b + 1)] == list(range(4901))
    assert (anchor >= hi).all() and (anchor - lo < suffix_dedup.REACH).all()


def test_suffix_dedup_odd(odd, empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(odd, length=80).collect()) == sorted(
        [("None", 11, 0), ("None", 0, 0), ("1", 9, 0), ("1", 9, 0), ("1", 5, 0), ("2", 9, 0)]
    )


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(docs, corpus, block):
    low = {k: brute.lower(t or "") for k, t in corpus}
    by = {}
    for k, t in low.items():
        by.setdefault(t, []).append(k)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(docs, block_bytes=block).collect()}
    assert got == {k: (max(by[t]), len(by[t]), k == max(by[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in low.items()}


def test_exact_dedup_odd(odd, empty):
    assert exact_dedup(empty).count() == 0
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup(odd).collect())
    assert got == sorted([("None", "None", 1, True), ("None", "None", 1, True), ("1", "2", 3, False), ("1", "2", 3, False), ("1", "1", 1, True), ("2", "2", 3, True)])


def test_exact_dedup_keeps_one_of_repeats(spark):
    rows = spark.createDataFrame([(7, "a")] * 3 + [(None, "b")] * 2, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["kept"]) for r in exact_dedup(rows).collect()) == [("7", False), ("7", False), ("7", True), ("None", False), ("None", True)]


def test_line_dedup(docs, corpus):
    lines = {k: (t or "").split("\n") for k, t in corpus}
    key = lambda x: brute.lower(x).strip(" \t\n\x0b\x0c\r")
    count = {}
    for v in lines.values():
        for x in {key(x) for x in v}:
            count[x] = count.get(x, 0) + 1
    want = {}
    for k, v in lines.items():
        stay = [x for x in v if not (key(x) and count[key(x)] >= 10)]
        want[k] = ("\n".join(stay), len(v), len(v) - len(stay))
    out = line_dedup(docs, min_docs=10)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == want
    assert sum(w[2] for w in want.values()) == 28


def test_line_dedup_odd(odd, empty):
    assert line_dedup(empty).count() == 0
    out = line_dedup(odd, min_docs=3).collect()
    assert sorted((r["text"], r["n_dropped"]) for r in out) == sorted([("a b c d e f", 0), ("", 0), ("", 1), ("", 1), ("other", 0), ("", 1)])


def test_ngram_components(docs, corpus):
    sets = {k: brute.shingles(t) for k, t in corpus}
    parts = brute.groups(list(sets), sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs).collect()}
    assert got == {k: (len(sets[k]), parts[k]) for k in sets}


def test_ngram_components_in_blocks(docs, corpus, monkeypatch):
    from millrace.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TREE_SETS", 3)
    sets = {k: brute.shingles(t, 3) for k, t in corpus}
    parts = brute.groups(list(sets), sets, 60)
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(docs, n=3, percent=60).collect()}
    assert got == parts


def test_ngram_components_odd(odd, empty):
    assert ngram_components(empty).count() == 0
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_components(odd).collect())
    assert got == sorted([("None", 2, "None"), ("None", 0, "None"), ("1", 1, "1"), ("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=2, max_size=14), st.sampled_from([50, 80]))
def test_tree_links(sets, percent):
    ids = list(range(len(sets)))
    found = tree_links([(i, len(s), sorted(s)) for i, s in zip(ids, sets, strict=True)], percent)
    want = brute.groups(ids, dict(zip(ids, sets, strict=True)), percent)
    up = dict(zip(ids, ids, strict=True))
    for a, b in found:
        both = len(sets[a] & sets[b])
        assert 100 * both >= percent * len(sets[a] | sets[b])
        x, y = up[a], up[b]
        up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    assert up == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    sets = {k: {k} for e in edges for k in e}
    want = brute.groups(sorted(sets), {k: set() for k in sets})
    for a, b in edges:
        x, y = want[a], want[b]
        want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    want = {k: v for k, v in want.items() if k != 200}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r[0]: r[1] for r in connected_components(df).collect()} == want
    from pyspark.sql import functions as F

    ordered = save(df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "test")
    assert {r[0]: r[1] for r in by_rounds(ordered).collect()} == want
    u, v = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    nodes, roots = smallest_reached(u, v)
    assert {int(k): int(r) for k, r in zip(nodes, roots, strict=True) if k != 200} == want

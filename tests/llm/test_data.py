import collections
import math
import os
import re
import zlib

import numpy as np
import pytest

from millrace.llm import mixing, quality, suffix_tree_lm
from millrace.llm.decontaminate import decontaminate, tiles
from millrace.llm.queries import QUERIES
from millrace.llm.sharding import rendezvous, shard
from millrace.llm.token_counts import attribute, token_counts, token_spans

from ..conftest import DATA
from . import brute


def test_shard(spark, docs, corpus):
    out = shard(docs, weights=[1.0] * 5)
    assert set(out.columns) == set(docs.columns) | {"slot"}
    rows = out.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    ids = spark.range(4000).toDF("id")
    moved = ids.select("id", rendezvous(ids.id, [1.0] * 9).alias("a"), rendezvous(ids.id, [1.0] * 10).alias("b"), rendezvous(ids.id, [3.0, 1.0]).alias("c")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 9 for r in moved)
    assert 300 < sum(r["a"] != r["b"] for r in moved) < 500
    assert 0.72 < sum(r["c"] == 0 for r in moved) / 4000 < 0.78
    with pytest.raises(ValueError):
        rendezvous(ids.id, [1.0, 0.0])


def test_shard_odd(odd, empty):
    assert shard(empty).count() == 0
    rows = shard(odd, weights=[1.0] * 3).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1 and len(rows) == 6


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 0, 1000], [3, 1, 2], 1.5, 2.0) == [20.0, 0.0, 1495.0]
    assert mixing.targets([], [], 1.5, 2.0) == []
    assert sum(mixing.targets([5, 7], [1, 1], 3.0, 2.0)) == 24  # all at their limits


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 7)) == list(range(n))
    assert not (mixing.permute(np.arange(1000), 1000, 1) == mixing.permute(np.arange(1000), 1000, 2)).all()
    out = mixing.draw([100, 0, 7, 3000], 12, 5)
    assert out.sum(0).tolist() == [100, 0, 7, 3000] and max(out.sum(1)) - min(out.sum(1)) <= 12
    assert (out == mixing.draw([100, 0, 7, 3000], 12, 5)).all()


def test_mix(docs, corpus):
    plan = mixing.plan_mix(docs, block_tokens=16, out_shards=4)
    size = {k: len(brute.WORD.findall(t or "")) for k, t in corpus}
    rows = plan.taken().collect()
    taken = {r["row"]["doc_id"]: r["taken"] for r in rows}
    assert {r["row"]["doc_id"]: r["size"] for r in rows} == size
    assert all(0 <= taken[k] <= 2 * size[k] for k in size)
    per = collections.Counter()
    for r in rows:
        per[r["source_no"]] += r["taken"]
    sources = plan.sources.collect()
    assert [r["source"] for r in sources] == ["src0", "src1", "src2", "src3", None]
    goal = mixing.targets([r["source_size"] for r in sources], [3, 1, 2, 3, 1], 1.5, 2.0)
    for r, g in zip(sources, goal, strict=True):
        assert r["target"] == g and abs(per[r["source_no"]] - g) <= 32
    assert {r["row"]["doc_id"]: r["taken"] for r in mixing.plan_mix(docs.repartition(5), block_tokens=16, out_shards=4).taken().collect()} == taken


def test_mixed_documents(docs, corpus):
    out = mixing.mixed_documents(docs, block_tokens=16)
    assert out.columns == docs.columns
    plan = {r["row"]["doc_id"]: r["taken"] for r in mixing.plan_mix(docs, block_tokens=16).taken().collect()}
    words = collections.Counter()
    texts = dict(corpus)
    for r in out.collect():
        own = brute.WORD.findall(r["text"])
        words[r["doc_id"]] += len(own)
        assert r["n_chars"] == len(r["text"])
        assert not collections.Counter(own) - collections.Counter(brute.WORD.findall(texts[r["doc_id"]]))
    assert words == collections.Counter({k: v for k, v in plan.items() if v})


def test_mix_odd(odd, empty):
    assert mixing.plan_mix(empty).taken().count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.plan_mix(odd, block_tokens=2).taken().count() == 6
    few, many = mixing.plan_mix(odd, block_tokens=2), mixing.plan_mix(odd, block_tokens=2, max_sources=2)
    assert sorted(many.sources.collect(), key=str) == sorted(few.sources.collect(), key=str) and many.taken().count() == 6


def test_mix_many_sources(spark):
    # one source with a third of all rows, one without words, a null one, and names whose code point order isn't UTF-16's
    rows = [(k, "w " * (1 + k * 7 % 90), "hot" if k % 3 == 0 else f"s{k % 59}" if k % 58 else ("\U0001f600", "\uffee", None)[k // 174 % 3]) for k in range(1500)]
    docs = spark.createDataFrame([*rows, (1500, " ", "none")], "doc_id long, text string, source string").repartition(7)
    one = mixing.plan_mix(docs, block_tokens=16, out_shards=4)
    plan = mixing.plan_mix(docs, block_tokens=16, out_shards=4, max_sources=10)
    by_no = lambda p: sorted(p.sources.collect(), key=lambda r: r["source_no"])
    assert len(by_no(plan)) > 50
    for a, b in zip(by_no(one), by_no(plan), strict=True):
        assert a[:5] == b[:5] and a["slots"] == b["slots"] and b["target"] == pytest.approx(a["target"])
    taken = {r["row"]["doc_id"]: (r["source_no"], r["size"], r["taken"]) for r in plan.taken().collect()}
    per = collections.Counter()
    for no, size, n in taken.values():
        assert 0 <= n <= 2 * size
        per[no] += n
    assert all(abs(per[r["source_no"]] - r["target"]) <= 32 for r in by_no(plan))
    # every block is taken floor or ceil of slots / blocks times, as with few sources
    times = {(r["source_no"], r["block"]): r["count"] for r in plan.slots.groupBy("source_no", "block").count().collect()}
    for r in by_no(plan):
        own = [times.get((r["source_no"], b), 0) for b in range(r["blocks"])]
        assert sum(own) == r["slots"] and max(own, default=0) - min(own, default=0) <= 1
    shards = [r["count"] for r in plan.slots.groupBy("out_shard").count().collect()]
    assert len(shards) == 4 and max(shards) - min(shards) <= 6
    again = mixing.plan_mix(docs.repartition(3), block_tokens=16, out_shards=4, max_sources=10)
    assert {r["row"]["doc_id"]: (r["source_no"], r["size"], r["taken"]) for r in again.taken().collect()} == taken


def test_token_counts(docs, corpus):
    rows = collections.defaultdict(list)
    for r in token_counts(docs).collect():
        rows[r["doc_id"]].append(tuple(r)[1:])
    for k, t in corpus:
        text = t or ""
        ids, first, end = token_spans(text)
        starts = [0] + [m.end() for m in re.finditer("\n", text)]
        own = sorted(rows[k])
        assert [x[1] for x in own] == starts and [x[2] for x in own] == [*starts[1:], len(text)]
        assert sum(x[3] for x in own) == len(ids)
        for n, (_, a, b, count, crossing) in enumerate(own):
            b = b if n + 1 < len(own) else b + 1
            assert count == sum(a <= f < b for f in first.tolist())
            assert crossing == sum(a <= f < b and e > b for f, e in zip(first.tolist(), end.tolist(), strict=True))


def test_token_spans_join_up():
    text = "Héllo wörld,\n\n日本 🙂 don't  stop\n"
    _, first, end = token_spans(text)
    covered = set()
    for a, b in zip(first, end, strict=True):
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))
    starts = np.array([0, 3, 5])
    f, e = np.array([0, 2, 2, 4]), np.array([2, 4, 8, 5])
    assert attribute(f, e, starts, "first")[0].tolist() == [0, 0, 0, 1]
    assert attribute(f, e, starts, "last")[0].tolist() == [0, 1, 2, 1]
    assert attribute(f, e, starts, "most")[0].tolist() == [0, 0, 2, 1]
    assert attribute(f, e, starts)[1].tolist() == [False, True, True, False]
    with pytest.raises(ValueError):
        attribute(f, e, starts, "half")


def test_token_counts_odd(odd, empty):
    assert token_counts(empty).count() == 0
    assert token_counts(odd).count() == 6


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(400):
        bad = rng.random() < 0.3
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) + ("!!" if bad else "") for _ in range(rng.integers(3, 200))]
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, int(not bad), 0))
    rows.append((400, None, "en", "s", 0))
    from .conftest import SCHEMA

    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(labelled, empty):
    docs, labels = labelled
    net = quality.fit(docs, labels, max_rows=200)
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, net).collect()}
    truth = {r[0]: r[1] for r in labels.collect()}
    held = [k for k in truth if brute.fold(k, 5) == 0]
    assert sum((scores[k] >= 0.5) == truth[k] for k in held) / len(held) > 0.95
    assert 0 <= scores[400] <= 1
    again = quality.fit(docs.repartition(7), labels, max_rows=200)
    assert (again.table == net.table).all()
    assert quality.quality_scores(empty, net).count() == 0
    only = quality.fit(docs, labels.where("quality = 1"))
    assert quality.quality_scores(docs, only).count() == 401


def test_forward_pass():
    """The scores of a plain forward pass, byte by byte."""
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(4, 257, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), rng.normal(size=6).astype(np.float32), np.array(0.3, np.float32))
    net.table[:, quality.PAD] = 0
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 3, 255, 256, 257, 700, 2000)]
    got = quality.score(net, np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for t, p in zip(texts, got, strict=True):
        cells = -(-(len(t) + 3) // 256)
        code = [*t.tolist(), *[256] * (cells * 256 + 3 - len(t))]
        best = [[max(sum(net.table[j, code[i + j], f] for j in range(4)) for i in range(c * 256, c * 256 + 256)) for f in range(3)] for c in range(cells)]
        chunks = [[max(a, b) for a, b in zip(best[c], best[min(c + 1, cells - 1)], strict=True)] for c in range(max(cells - 1, 1))]
        act = [[max(x + b, 0) for x, b in zip(c, net.bias, strict=True)] for c in chunks]
        x = [max(c[f] for c in act) for f in range(3)] + [sum(c[f] for c in act) / len(act) for f in range(3)]
        assert p == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, net.weights, strict=True)) + 0.3))), rel=1e-3)


def test_quality_odd(spark, odd, empty, labelled):
    """Null ids, repeated rows, clashing columns, tables without rows."""
    net = quality.fit(odd, spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    clash = odd.selectExpr("*", "1 AS score", "2 AS label", "3 AS b", "4 AS quality")
    rows = quality.quality_scores(clash, net).collect()
    assert len(rows) == 6 and {(r["label"], r["b"], r["quality"]) for r in rows} == {(2, 3, 4)} and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "same same"}) == 1
    assert quality.quality_scores(odd, quality.fit(empty, labelled[1])).count() == 6
    assert quality.quality_scores(odd, quality.fit(odd, labelled[1].limit(0))).count() == 6


def test_quality_on_labels(spark):
    """Held-out accuracy at 0.3 on the labels of the test tables."""
    data = DATA.replace("sf0.001", "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    out = QUERIES["op6_quality_classifier"](spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("quality is not null").collect()
    assert len(out) > 50
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.9
    assert sum(r["predicted"] for r in out if r["quality"]) >= 0.97 * sum(r["quality"] for r in out)


def test_chunks_cover_the_document():
    """A pattern counts wherever it stands, also across cells and at the end."""
    rng = np.random.default_rng(1)
    net = quality.Network(np.zeros((quality.WIDTH, 257, 1), np.float32), np.zeros(1, np.float32), np.array([1, 0], np.float32), np.array(0, np.float32))
    for j, c in enumerate(b"#!#!"):
        net.table[j, c, 0] = 1
    for at in (0, 254, 255, 256, 700, 1020):
        raw = rng.integers(97, 123, 1024, dtype=np.uint8)
        raw[at : at + 4] = np.frombuffer(b"#!#!", np.uint8)
        codes, starts = quality.cells(raw, np.array([0, 1024]))
        assert quality.features(net, codes, starts)[0, 0] == 4


def lm(df, learns=None, **options):
    rows = suffix_tree_lm.suffix_tree_scores(df, ~suffix_tree_lm.in_fold(df.doc_id) if learns is None else learns, **options).collect()
    return {r["doc_id"]: r for r in rows}


def test_lm(docs, corpus):
    """The base scores and counts, whatever is broadcast."""
    want = brute.unigram(corpus, lambda k: brute.fold(k, 7) == 2)
    for options in ({}, {"broadcast_words": 0}, {"broadcast_words": 40, "block_places": 50, "bucket_places": 100}):
        rows = lm(docs, **options)
        assert rows.keys() == want.keys()
        for k, (n, known, train, base) in want.items():
            assert (rows[k]["n_tokens"], rows[k]["n_known"], rows[k]["train_tokens"]) == (n, known, train)
            assert rows[k]["base_score"] == pytest.approx(base, rel=1e-9)


def test_lm_tree(spark):
    """A word that only ever follows one word is scored by that context."""
    text = " ".join(["up", "down", "left", "right"] * 200)
    df = spark.createDataFrame([*((k, text) for k in range(5)), (9, "down up right left " * 50)], "doc_id long, text string")
    rows = lm(df, df.doc_id < 9)
    assert rows[0]["score"] > rows[0]["base_score"] + 300
    assert rows[9]["score"] < rows[9]["base_score"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_tree_brute(docs, corpus, order):
    """The scores of a plain suffix tree; dealing places of frequent symbols to several buckets changes nothing."""
    train = [t for k, t in corpus if brute.fold(k, 7) != 2]
    met = collections.Counter(w for t in train for w in brute.words(t)).values()
    for options in ({}, {"block_places": 300, "bucket_places": 400}, {"broadcast_words": 100, "bucket_places": 1000}, {"min_context": 5, "gain": 3.0, "discount": 0.5}):
        often_from = next(10 << j for j in range(40) if sum(n >= 10 << j for n in met) <= options.get("broadcast_words", 1e6))
        more = {k: v for k, v in options.items() if k in ("min_context", "gain", "discount")}
        want, nodes = brute.suffix_tree([t for _, t in corpus], train, 10, order=order, often_from=often_from, **more)
        assert nodes > 20
        rows = lm(docs, order=order, **options)
        assert {k: r["score"] for k, r in rows.items()} == pytest.approx(dict(zip((k for k, _ in corpus), want, strict=True)), rel=1e-5, abs=1e-4)


def test_lm_probabilities_add_up():
    """Over all symbols, the probabilities in any context add up to one."""
    rng = np.random.default_rng(3)
    seq = rng.integers(2, 7, 4000).astype(np.uint64)
    for i in range(3, 4000, 4):
        seq[i] = (seq[i - 1] + seq[i - 2]) % 5 + 2
    before = suffix_tree_lm.contexts(seq, np.arange(4000), 2)
    asked = [(a, b, x) for a in range(2, 7) for b in range(2, 7) for x in range(2, 7)]
    cols = np.array(asked, np.uint64).T
    root = np.full(4000 + len(asked), 0.2)
    weight = np.concatenate((np.ones(4000), np.zeros(len(asked))))
    won, nodes = suffix_tree_lm.grow([np.concatenate((before[k], cols[k])) for k in (0, 1)], np.concatenate((seq, cols[2])), [weight] * 2, root, 2, 10.0, 0.75)
    assert nodes > 5
    sums = (10 ** won[4000:] * 0.2).reshape(25, 5).sum(1)
    assert np.allclose(sums, 1) and (10 ** won[4000:]).std() > 0.1


def test_lm_grows_with_corpus(spark):
    """A pair of words met 12 times is learnt however many tokens stand around it, and so is a text that occurs twice."""
    rows = [(i, " ".join(f"first{j}x second{j}x" for j in range(i % 100, 3000, 100))) for i in range(1200)]
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 200, 40)) for _ in range(400)]
    rows += [(2000 + i, t) for i, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = lm(df, suffix_tree_lm.F.lit(True))
    won = lambda k: (rows[k]["score"] - rows[k]["base_score"]) / rows[k]["n_tokens"]
    assert won(0) > 1 and won(2000) == won(2400) > max(won(2000 + i) for i in range(1, 400)) + 0.5


def test_lm_odd(odd, empty):
    learns = suffix_tree_lm.F.lit(False)
    assert suffix_tree_lm.suffix_tree_scores(empty, learns).count() == 0
    rows = suffix_tree_lm.suffix_tree_scores(odd, learns).collect()
    assert len(rows) == 6 and all(r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
    rows = suffix_tree_lm.suffix_tree_scores(odd, odd.doc_id == 1).collect()  # null: not learnt from
    assert sorted(r["n_known"] for r in rows) == [1, 1, 2, 3, 3, 3] and {r["train_tokens"] for r in rows} == {8}
    with pytest.raises(ValueError):
        suffix_tree_lm.suffix_tree_scores(odd, learns, order=9)


def plain_tiles(p, t, least):
    """Greedy tiling without hashing: how many tokens of p it covers."""
    pf, tf, covered = [True] * len(p), [True] * len(t), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and pf[i + k] and tf[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        for x in range(k):
            pf[i + x] = tf[j + x] = False
        covered += k


def test_tiles():
    rng = np.random.default_rng(9)
    for n in range(300):
        p = rng.integers(0, 2 + n % 9, rng.integers(3, 70)).tolist()
        t = rng.integers(0, 2 + n % 9, rng.integers(3, 90)).tolist()
        if rng.random() < 0.5:
            cut = len(p) // 2
            t = t[:5] + p[cut:] + t[5:8] + p[:cut] + t[8:]
        found = tiles(p, t, 3)
        assert all(p[i : i + k] == t[j : j + k] and k >= 3 for i, j, k in found)
        for side in (0, 1):
            places = [x for f in found for x in range(f[side], f[side] + f[2])]
            assert len(places) == len(set(places))
        assert sum(f[2] for f in found) == plain_tiles(p, t, 3)


def test_decontaminate(spark, docs, empty):
    passage = "One fine day the quick brown fox did jump over that lazy old dog, and nobody saw it happen at all"
    w = passage.split()
    bench = spark.createDataFrame([(1, passage), (2, "tiny thing"), (3, None), (4, "..."), (5, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string")
    texts = [
        (0, "Before. " + passage.upper() + " After."),
        (1, " ".join(w[10:]) + " -- and then -- " + " ".join(w[:10])),
        (2, " ".join(w[:6]) + " something else"),
        (3, None),
        (4, ""),
        (5, "what a tiny thing!"),
        (6, "x " * 3000 + passage),
        (7, " ".join(f"q{i}" for i in range(14))),
    ]
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, coverage int")
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontaminate(df, bench).collect()}
    assert got == {0: (True, 1), 1: (True, 1), 2: (False, 1), 3: (False, None), 4: (False, None), 5: (True, 2), 6: (True, 1), 7: (False, 5)}
    blocks = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontaminate(df, bench, block_chars=50).collect()}
    assert blocks == got
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert set(decontaminate(docs, bench).columns) == set(docs.columns) | {"contaminated", "coverage", "item_id", "n_items"}


def plain_tokens(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", brute.lower(text or ""))


def test_decontaminate_brute(spark):
    """Every document against every item, by the plain tiling."""
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60, n))
    common = prose(9)  # in half of all items and documents
    items = [(k % 40 if k else None, (prose(rng.integers(1, 25)) + " " + common) if k % 2 else prose(rng.integers(2, 40))) for k in range(60)]
    texts = []
    for k in range(120):
        w = items[rng.integers(60)][1].split()
        cut = rng.integers(0, len(w) + 1)
        own = [prose(rng.integers(0, 30)), " ".join(w[cut:]), prose(4), " ".join(w[:cut]).upper(), common if k % 2 else ""]
        texts.append((k if k % 10 else None, "; ".join(own)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, t in texts:
        best, which, many = 0.0, None, 0
        for i, x in items:
            p = plain_tokens(x)
            share = plain_tiles(p, plain_tokens(t), min(5, len(p))) / len(p)
            many += share >= 0.5
            if share > best or share == best > 0 and i is not None and (which is None or i < which):
                best, which = share, i
        want.append((k, t, best >= 0.5, best, which, many))
    key = lambda r: (r[1], r[0] is None, r[0] or 0)
    for options in ({}, {"block_chars": 700}):
        assert sorted(map(tuple, decontaminate(docs, bench, **options).collect()), key=key) == sorted(want, key=key)


def test_decontaminate_many_items(spark):
    """Fifty thousand items that share a seed; the index takes time by their tokens only."""
    items = [(k, f"these five words stand everywhere a{k} b{k} c{k} d{k} e{k} f{k} g{k}") for k in range(50_000)]
    docs = spark.createDataFrame([(k, items[k * 7][1] + " and more") for k in range(20)], "doc_id long, text string")
    rows = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["item_id"], r["coverage"], r["n_items"]) for r in rows} == {k: (k * 7, 1.0, 1) for k in range(20)}


def test_decontaminate_odd(spark, odd, empty):
    """Null ids, repeated rows and items, clashing columns."""
    bench = spark.createDataFrame([(None, "same same"), (7, "SAME, same!"), (7, "same same"), (None, None), (3, "")], "item_id long, text string")
    clash = odd.selectExpr("*", "1 AS item_id", "2 AS coverage", "3 AS n_items", "4 AS row")
    rows = decontaminate(clash, bench).collect()
    assert len(rows) == 6 and {r["row"] for r in rows} == {4}
    assert all((r["contaminated"], r["item_id"], r["n_items"]) == ((True, 7, 3) if "ame" in (r["text"] or "") else (False, None, 0)) for r in rows)
    assert decontaminate(odd, empty.selectExpr("doc_id AS item_id", "text")).where("contaminated").count() == 0


def test_contract_helpers():
    assert brute.fold("12", 5) == zlib.crc32(b"12") % 5
    assert math.isclose(sum(mixing.targets([3, 4], [3, 1], 1.5, 2)), 10.5)

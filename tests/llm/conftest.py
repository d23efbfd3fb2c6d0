import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(rng):
    words = ["alpha", "Beta", "gamma", "delta", "é", "naïve", "x", "y.", "zeta,", "日本", "the", "of", "and", "or", "Not"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = [prose(rng.randrange(1, 120)) for _ in range(30)]
    passage = prose(90)
    out = [None, "", " ", "\n", "a", "one two three", "x" * 5000, "ab" * 3000, "word " * 2000, "\x00\t \x0b", prose(4000)]
    out += base + base[:6] + base[:3]
    out += [b.upper() for b in base[3:6]]
    out += [b + " tail" + str(i) for i, b in enumerate(base[5:15])]
    out += [prose(30) + "\n" + passage + "\n" + prose(20) for _ in range(8)]
    out += ["Common line.\n" + prose(10) + "\n  COMMON LINE. \n" for _ in range(14)]
    near = prose(200).split()
    for i in range(12):
        n = list(near)
        for _ in range(i % 5):
            n[rng.randrange(len(n))] = f"edit{rng.randrange(999)}"
        out.append(" ".join(n))
    return out


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text: nulls, empty and long texts, exact and near copies, shared passages and lines, all ids once."""
    rng = random.Random(5)
    texts = _texts(rng)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    rows = [(k, t, "en", f"src{k % 4}" if k % 11 else None, len(t or "")) for k, t in corpus]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(1).alias(c) for c in ("row", "size", "block", "name", "idx", "rid", "score", "shard", "begin", "did")))


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and ids shared by different texts."""
    rows = [(None, "a b c d e f", "en", None, 0), (None, None, "en", None, 0), (1, "same same", "en", "s", 0), (1, "same same", "en", "s", 0), (1, "other", "en", "s", 0), (2, "SAME same", "en", "t", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

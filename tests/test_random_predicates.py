"""Random conditions: the rows that the standard library's engine finds, and that the raw builder finds."""

import random
import sqlite3

import pytest

ROWS = [(i, None if i % 7 == 0 else (i * 37) % 11, None if i % 5 == 0 else ["Ab", "aB", "b", "", "a_b", "zz%", "é"][i % 7]) for i in range(40)]


def condition(rng, depth=2):
    if depth and rng.random() < 0.6:
        return f"({condition(rng, depth - 1)} {rng.choice(['AND', 'OR'])} {condition(rng, depth - 1)})"
    n, s = rng.randrange(11), rng.choice(["'a%'", "'_b'", "'%'", "'AB'", "''", "'%z%'"])
    return rng.choice(
        [
            f"n {rng.choice(['=', '<>', '<', '<=', '>', '>=', '!='])} {n}",
            f"n BETWEEN {min(n, 4)} AND {n}",
            f"n IN ({n}, 3, 5)",
            f"n + id {rng.choice(['<', '>'])} {n + 12} - 2",
            "n IS NULL",
            "t IS NOT NULL",
            f"n IS {n}",
            f"n IS NOT {n}",
            f"t LIKE {s}",
            f"t NOT LIKE {s}",
            "t GLOB '[aA]*'",
            "t NOT GLOB '*b'",
            f"length(t) < {n % 4}",
            "lower(t) = 'ab'",
            "instr(t, 'b') > 1",
            f"abs(n - 5) = {n % 6}",
            f"coalesce(n, {n}) = {n}",
            f"id IN (SELECT n FROM x WHERE n > {n})",
            f"EXISTS (SELECT 1 FROM x AS y WHERE y.n = x.id AND y.id > {n})",
        ]
    )


@pytest.fixture(scope="module")
def both(spark):
    from millrace import Database

    db, file = Database(spark), sqlite3.connect(":memory:")
    file.execute("CREATE TABLE x (id INTEGER, n INTEGER, t TEXT)")
    file.executemany("INSERT INTO x VALUES (?, ?, ?)", ROWS)
    db.exec("CREATE TABLE x (id INTEGER, n INTEGER, t TEXT)")
    for i in range(0, 40, 20):
        part = ROWS[i : i + 20]
        db.exec("INSERT INTO x VALUES " + ", ".join(["(?, ?, ?)"] * len(part)), [v for r in part for v in r])
    yield db, file
    db.close()
    file.close()


@pytest.mark.parametrize("seed", range(40))
def test_condition(both, seed):
    db, file = both
    text = condition(random.Random(seed))
    if "length(t)" in text:  # bytes here, characters there
        text = text.replace("length(t)", "length(replace(t, 'é', 'ee'))")
    want = sorted(r[0] for r in file.execute(f"SELECT id FROM x WHERE {text}"))
    assert sorted(r[0] for r in db.exec(f"SELECT id FROM x WHERE {text}").rows()) == want, text

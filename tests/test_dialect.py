"""What the dialect's queries mean."""

import sqlite3

import pytest

from millrace import errors
from millrace.functions.patterns import glob_regex
from millrace.sql.select import Params, literal
from millrace.sql.tokens import statements, tokenize


@pytest.fixture
def items(db):
    db.exec("CREATE TABLE items (id INTEGER, label TEXT); INSERT INTO items VALUES (1, 'alpha'), (2, 'beta'), (3, NULL), (4, 'alpha')")
    return db


def ids(db, where, params=None):
    return sorted(r[0] for r in db.exec(f"SELECT id FROM items WHERE {where}", params).rows())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("id BETWEEN 1 AND 2 OR label IS NULL", [1, 2, 3]),
        ("label LIKE 'A%'", [1, 4]),
        ("label NOT LIKE 'a%'", [2]),
        ("label IS NULL", [3]),
        ("label IS 'alpha'", [1, 4]),
        ("label IS NOT 'alpha'", [2, 3]),
        ("label IS NOT NULL", [1, 2, 4]),
        ("label IS NOT DISTINCT FROM NULL", [3]),
        ("label IS DISTINCT FROM 'beta'", [1, 3, 4]),
        ("id IN (1, 3, 4)", [1, 3, 4]),
        ("id NOT IN (1, 3, 4)", [2]),
        ("label NOT IN ('alpha', NULL)", [2, 3]),
        ("label GLOB 'a*'", [1, 4]),
        ("label GLOB 'A*'", []),
        ("label NOT GLOB '[ab]l*'", [2]),
        ("id + 1 = 3", [2]),
        ("id - 1 IS 3", [4]),
        ("id != 1 AND (id = 2 OR id = 4)", [2, 4]),
        ("instr(label, 'ph') > 0", [1, 4]),
        ("lower(label) = 'beta' OR length(label) > 4", [1, 2, 4]),
        ("id IN (SELECT id FROM items WHERE label = 'beta')", [2]),
        ("EXISTS (SELECT 1 FROM items WHERE id = 9)", []),
        ("(id > 1) = TRUE AND id < 3", None),
    ],
)
def test_predicates(items, where, want):
    if want is None:
        with pytest.raises(errors.DatabaseError):
            ids(items, where)
    else:
        assert ids(items, where) == want


def test_not_in_subquery_passes_nulls(items):
    items.exec("CREATE TABLE blocked (label TEXT); INSERT INTO blocked VALUES ('beta'), (NULL)")
    assert ids(items, "label NOT IN (SELECT label FROM blocked)") == [1, 3, 4]


def test_parameters(items):
    assert ids(items, "id = ? OR label = ?", [2, "alpha"]) == [1, 2, 4]
    assert ids(items, "id = ?2 OR id = ?1", [1, 3]) == [1, 3]
    assert ids(items, "id = :a OR id = @b OR id = :a", {"a": 1, "b": 2}) == [1, 2]
    assert ids(items, "label LIKE ?", ["B%"]) == [2]
    assert items.exec("SELECT id FROM items ORDER BY id LIMIT ?", [2]).rows() == [(1,), (2,)]
    with pytest.raises(errors.InvalidParameter):
        ids(items, "id = ?")
    p = items.prepare("SELECT id FROM items WHERE label IS ?")
    assert [r[0] for r in p.bind(1, None).step().rows()] == [3]
    with pytest.raises(errors.InvalidParameter):
        p.bind(0, 1)


@pytest.mark.parametrize("text", ["it's", "a\\b", "x\ny\tz", 'q"q', "100%", "", "é日"])
def test_strings_come_back(db, text):
    assert db.exec("SELECT ? AS x", [text]).rows() == [(text,)]
    assert db.exec("SELECT '" + text.replace("'", "''") + "' AS x").rows() == [(text,)]


def test_scalars(db):
    row = db.exec(
        "SELECT abs(-12) a, round(1.6) b, round(1.236, 2) c, round(123, -1) d, cast('42' AS INTEGER) e, cast('x' AS REAL) f, cast(4.9 AS INTEGER) g, "
        "typeof(NULL) h, typeof('a') i, typeof(1.5) j, upper('aé') k, trim('\t a ') l, replace('ab', 'b', 'c') m, substr('Alice', 1, 5) n, substr('abc', -4) o, "
        "instr('fallback', 'back') p, nullif(1, 1) q, coalesce(NULL, NULL, 'f') r, ifnull(NULL, 7) s, length('é') t, cast(5 AS TEXT) u"
    ).rows()[0]
    assert row == (12, 2.0, 1.24, 120.0, 42, 0.0, 4, "null", "text", "real", "Aé", "a", "ac", "Alice", "abc", 5, None, "f", 7, 2, "5")


def test_json(db):
    doc = '{"name":"Alice","age":42,"missing":null}'
    assert db.exec("SELECT json_extract(?1, '$.name'), json_extract(?1, '$.age'), json_extract(?1, '$.missing')", [doc]).rows() == [("Alice", "42", None)]
    for j, key, value, want in [
        ('{"city":"London"}', "city", "Paris", '{"city":"Paris"}'),
        ('{"city":"London"}', "country", "UK", '{"city":"London","country":"UK"}'),
        ("{}", "a", "b", '{"a":"b"}'),
        ('{"a": 1, "b": 2}', "a", 'q"$1\\', '{"a": "q\\"$1\\\\", "b": 2}'),
    ]:
        assert db.exec(f"SELECT json_set(?, '$.{key}', ?)", [j, value]).rows() == [(want,)]


PATTERNS = ["*", "a*", "?b?", "[abc]*", "[a-c]1", "[^a]*", "[!a]*", "a[", "a]b", "[]a]", "*.txt", "a.b", "a\\b", "[a-]", "x(y)", "a*b*c", "", "[[]x"]
TEXTS = ["", "a", "ab", "abc", "a1", "d1", "a[", "a]b", "]", "x.txt", "axb", "a.b", "a\\b", "-", "x(y)", "a\nb\nc", "[x", "B"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_glob_as_sqlite(spark, pattern):
    file = sqlite3.connect(":memory:")
    # a second "!" form isn't sqlite's; there it is spelt "^"
    want = [bool(file.execute("SELECT ? GLOB ?", (t, pattern.replace("[!", "[^"))).fetchone()[0]) for t in TEXTS]
    if "[" in pattern and "]" not in pattern.split("[", 1)[1]:
        want = [t == pattern for t in TEXTS]  # ours: a bracket without an end stands for itself
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", df.t.rlike(glob_regex(pattern))).collect())]
    assert got == want


def test_joins(db):
    db.exec("CREATE TABLE u (id INTEGER, name TEXT); CREATE TABLE o (oid INTEGER, user_id INTEGER); INSERT INTO u VALUES (1, 'A'), (2, 'B'); INSERT INTO o VALUES (10, 1), (11, 99)")
    for kind, n in (("JOIN", 1), ("LEFT JOIN", 2), ("RIGHT JOIN", 2), ("FULL OUTER JOIN", 3)):
        assert db.exec(f"SELECT u.id, o.oid FROM u {kind} o ON u.id = o.user_id").row_count() == n
    assert db.exec("SELECT * FROM u CROSS JOIN o").row_count() == 4
    assert db.exec("SELECT x.name FROM u AS x JOIN o y ON x.id = y.user_id WHERE y.oid > 5 ORDER BY x.name").rows() == [("A",)]


def test_groups(db):
    db.exec("CREATE TABLE s (c TEXT, n INTEGER); INSERT INTO s VALUES ('a', 10), ('a', 20), ('b', 7), (NULL, 1)")
    assert sorted(db.exec("SELECT c, count(*), sum(n), average(n) FROM s GROUP BY c").rows(), key=str) == sorted([("a", 2, 30, 15.0), ("b", 1, 7, 7.0), (None, 1, 1, 1.0)], key=str)
    assert db.exec("SELECT c, sum(n) FROM s GROUP BY c HAVING count(*) > 1").rows() == [("a", 30)]
    assert db.exec("SELECT count(*), sum(n) FROM s WHERE n > 99").rows() == [(0, None)]


def test_ctes(db):
    assert db.exec("WITH a(x) AS (SELECT 1), b AS (SELECT x + 1 AS y FROM a) SELECT x, y FROM a, b").rows() == [(1, 2)]
    assert db.exec("WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 5) SELECT sum(x) FROM n").rows() == [(15,)]
    assert db.exec("WITH RECURSIVE n(x) AS (SELECT 0 UNION SELECT (x + 2) % 6 FROM n) SELECT count(*) FROM n").rows() == [(3,)]
    with pytest.raises(errors.ColumnCountMismatch):
        db.exec("WITH a(x, y) AS (SELECT 1) SELECT x FROM a")


def test_recursion_is_limited(spark):
    from pyspark.sql import functions as F

    from millrace.operators.recursion import fixpoint

    start = spark.range(1).toDF("x")
    with pytest.raises(errors.RecursiveCteLimit):
        fixpoint(start, lambda df: df.select((F.col("x") + 1).alias("x")), lambda df: spark.createDataFrame(df.collect(), df.schema), rounds=3)


def test_views_series_explain(items):
    items.exec("CREATE VIEW named AS SELECT id, label FROM items WHERE label IS NOT NULL; CREATE VIEW few AS SELECT id FROM named WHERE id < 3")
    assert sorted(items.exec("SELECT id FROM few").rows()) == [(1,), (2,)]
    items.exec("INSERT INTO items VALUES (0, 'new')")
    assert items.exec("SELECT count(*) FROM few").rows() == [(3,)]
    with pytest.raises(errors.ViewExists):
        items.exec("CREATE VIEW few AS SELECT 1")
    items.exec("CREATE VIRTUAL TABLE s USING generate_series(5, 1, -2)")
    assert sorted(items.exec("SELECT value FROM s").rows()) == [(1,), (3,), (5,)]
    with pytest.raises(errors.VirtualTableTooLarge):
        items.exec("CREATE VIRTUAL TABLE t USING generate_series(1, 9000000)")
    with pytest.raises(errors.InvalidSql):
        items.exec("CREATE VIRTUAL TABLE t USING generate_series(1, 9, 0)")
    with pytest.raises(errors.Unsupported):
        items.exec("DELETE FROM s")
    items.exec("CREATE INDEX by_label ON items (label)")
    assert items.exec("EXPLAIN QUERY PLAN SELECT * FROM items WHERE label = 'x'").rows() == [("SEARCH items USING INDEX by_label (label=?)",)]
    assert "Physical Plan" in items.exec("EXPLAIN SELECT * FROM items").rows()[0][0]


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("", errors.InvalidSql),
        ("SELEC 1", errors.InvalidSql),
        ("SELECT * FROM nowhere", errors.UnknownTable),
        ("SELECT nothing FROM items", errors.UnknownColumn),
        ("SELECT 'open", errors.InvalidSql),
        ("SELECT FROM items WHERE", errors.InvalidSql),
        ("SELECT 99999999999999999999", errors.InvalidSql),
        ("PRAGMA page_size", errors.Unsupported),
        ("INSERT INTO items VALUES (1)", errors.ColumnCountMismatch),
        ("DROP INDEX none", errors.UnknownIndex),
        ("CREATE TABLE items (a INTEGER)", errors.TableExists),
    ],
)
def test_errors(items, sql, error):
    with pytest.raises(error):
        items.exec(sql)


def test_tokens():
    found = tokenize("SELECT 'a;b' /* ; */ AS \"x y\" -- ;\n; CREATE TRIGGER t AFTER INSERT ON a BEGIN SELECT 1; SELECT 2; END; SELECT ?1")
    assert [s[0].text for s in statements(found)] == ["SELECT", "CREATE", "SELECT"]
    assert [t.text for t in found[:4]] == ["SELECT", "a;b", "AS", "x y"]
    assert literal(True) == "1L" and literal(-(2**63)).startswith("(")
    with pytest.raises(errors.InvalidParameter):
        Params([1]).value("?0")


def test_recursion_stores_large_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.operators import recursion
    from millrace.sources.store import scratch

    monkeypatch.setattr(recursion, "LOCAL_ROWS", 4)
    start = spark.range(3).toDF("x")
    found = recursion.fixpoint(start, lambda df: df.select((F.col("x") + 3).alias("x")).where("x < 20"), scratch)
    assert sorted(r[0] for r in found.collect()) == list(range(20))

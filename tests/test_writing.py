"""Writing: conflicts, keys, foreign keys, triggers, transactions, schema changes, storage, migrations."""

import sqlite3
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from millrace import Database, Migration, Migrator, errors
from millrace.operators import checks
from millrace.sources.store import scratch


def rows(db, sql):
    return sorted(db.exec(sql).rows(), key=str)


@pytest.fixture
def keyed(db):
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, label TEXT, n INTEGER DEFAULT 5); INSERT INTO t VALUES (1, 'original', 10)")
    return db


def test_insert_forms(keyed):
    assert keyed.exec("INSERT INTO t (id) VALUES (2), (3)").changes == 2
    assert keyed.exec("INSERT INTO t SELECT id + 10, label, n FROM t WHERE id > 1").changes == 2
    assert rows(keyed, "SELECT * FROM t WHERE id > 1") == [(12, None, 5), (13, None, 5), (2, None, 5), (3, None, 5)]
    keyed.exec("CREATE TABLE d (a TEXT, b INTEGER); INSERT INTO d DEFAULT VALUES")
    assert rows(keyed, "SELECT a, b FROM d") == [(None, None)]


def test_conflicts(keyed):
    with pytest.raises(errors.ConstraintViolation):
        keyed.exec("INSERT INTO t VALUES (1, 'x', 1)")
    with pytest.raises(errors.ConstraintViolation):
        keyed.exec("INSERT INTO t VALUES (7, 'x', 1), (7, 'y', 1)")
    with pytest.raises(errors.ConstraintViolation):
        keyed.exec("INSERT INTO t VALUES (NULL, 'x', 1)")
    assert keyed.exec("INSERT OR IGNORE INTO t VALUES (1, 'x', 1), (2, 'accepted', 1)").changes == 1
    assert keyed.exec("INSERT INTO t VALUES (1, 'updated', 99) ON CONFLICT (id) DO UPDATE SET label = excluded.label, n = excluded.n + 1").changes == 1
    assert keyed.exec("INSERT INTO t VALUES (1, 'never', 0) ON CONFLICT (id) DO UPDATE SET label = excluded.label WHERE n = 1").changes == 0
    assert rows(keyed, "SELECT * FROM t") == [(1, "updated", 100), (2, "accepted", 1)]
    assert keyed.exec("INSERT OR REPLACE INTO t VALUES (2, 'replaced', 2)").changes == 1
    assert keyed.exec("INSERT INTO t VALUES (5, 'a', 1), (5, 'b', 1), (5, 'c', 1) ON CONFLICT (id) DO UPDATE SET label = label || excluded.label").changes == 3
    assert rows(keyed, "SELECT id, label FROM t WHERE id > 1") == [(2, "replaced"), (5, "abc")]


def test_update_and_delete(keyed):
    keyed.exec("INSERT INTO t VALUES (2, 'two', 20); CREATE TABLE s (k INTEGER, v INTEGER); INSERT INTO s VALUES (1, 99), (1, 98)")
    assert keyed.exec("UPDATE t SET n = n + 5, label = 'new' WHERE id = 1").changes == 1
    assert keyed.exec("UPDATE t SET n = s.v FROM s WHERE t.id = s.k").changes == 1
    assert rows(keyed, "SELECT id, label, n FROM t") == [(1, "new", 99), (2, "two", 20)]
    keyed.exec("CREATE TABLE w (a INTEGER, b INTEGER); INSERT INTO w VALUES (1, 2); UPDATE w SET a = b, b = a")
    assert rows(keyed, "SELECT a, b FROM w") == [(2, 1)]
    with pytest.raises(errors.ConstraintViolation):
        keyed.exec("UPDATE t SET id = 2 WHERE id = 1")
    assert keyed.exec("DELETE FROM t WHERE id IN (SELECT k FROM s)").changes == 1
    assert keyed.exec("DELETE FROM t").changes == 1
    assert rows(keyed, "SELECT * FROM t") == []


def test_unique_and_types(db):
    db.exec("CREATE TABLE p (id INTEGER PRIMARY KEY, email VARCHAR(80) UNIQUE, x REAL, UNIQUE (id, email)); INSERT INTO p VALUES (1, NULL, 1), (2, NULL, 2.5)")
    db.exec("INSERT INTO p VALUES (3, 'a', '4')")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("INSERT INTO p VALUES (4, 'a', 1)")
    with pytest.raises(Exception, match="TypeMismatch|CAST"):
        db.exec("INSERT INTO p VALUES (1.5, 'b', 1)").rows()
    assert rows(db, "SELECT x FROM p") == [(1.0,), (2.5,), (4.0,)]
    db.exec("CREATE TABLE q (a INTEGER, b INTEGER); INSERT INTO q VALUES (1, 1), (1, 2)")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("CREATE UNIQUE INDEX qa ON q (a)")
    db.exec("CREATE UNIQUE INDEX qab ON q (a, b)")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("INSERT INTO q VALUES (1, 2)")
    db.exec("DROP INDEX qab; INSERT INTO q VALUES (1, 2)")


@pytest.mark.parametrize(
    ("action", "want"),
    [("ON DELETE CASCADE ON UPDATE CASCADE", [(10, 20)]), ("ON DELETE SET NULL ON UPDATE SET NULL", [(10, None), (11, None)]), ("", None)],
)
def test_foreign_keys(db, action, want):
    db.exec(f"CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) {action}); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (10, 1), (11, 2)")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("INSERT INTO c VALUES (12, 9)")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("UPDATE c SET p = 9")
    if want is None:
        for sql in ("DELETE FROM p WHERE id = 1", "UPDATE p SET id = 7 WHERE id = 1"):
            with pytest.raises(errors.ConstraintViolation):
                db.exec(sql)
        db.exec("PRAGMA foreign_keys = OFF; INSERT INTO c VALUES (12, 9); DELETE FROM p")
        assert db.exec("SELECT count(*) FROM c").rows() == [(3,)]
    else:
        db.exec("UPDATE p SET id = 20 WHERE id = 1; DELETE FROM p WHERE id = 2")
        assert rows(db, "SELECT id, p FROM c") == want


def test_self_reference_cascades(db):
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, up INTEGER REFERENCES t(id) ON DELETE CASCADE); INSERT INTO t VALUES (1, NULL), (2, 1), (3, 2), (4, NULL)")
    db.exec("DELETE FROM t WHERE id = 1")
    assert rows(db, "SELECT id FROM t") == [(4,)]


def test_triggers(db):
    db.exec(
        "CREATE TABLE t (id INTEGER, label TEXT); CREATE TABLE audit (kind TEXT, a TEXT, b TEXT);"
        "CREATE TRIGGER i AFTER INSERT ON t BEGIN INSERT INTO audit VALUES ('i', NEW.label, NULL); END;"
        "CREATE TRIGGER u AFTER UPDATE OF label ON t WHEN NEW.id < 3 BEGIN INSERT INTO audit VALUES ('u', OLD.label, NEW.label); DELETE FROM audit WHERE a = NEW.label; END;"
        "CREATE TRIGGER d AFTER DELETE ON t FOR EACH ROW BEGIN INSERT INTO audit VALUES ('d', OLD.label, 'x'); END;"
        "INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); UPDATE t SET label = label || '!'; DELETE FROM t WHERE id = 3"
    )
    assert rows(db, "SELECT * FROM audit") == sorted([("i", "a", None), ("i", "b", None), ("i", "c", None), ("u", "a", "a!"), ("u", "b", "b!"), ("d", "c!", "x")], key=str)
    with pytest.raises(errors.InvalidSql):
        db.exec("CREATE TRIGGER bad AFTER INSERT ON t BEGIN INSERT INTO audit VALUES ('x', OLD.label, NULL); END; INSERT INTO t VALUES (9, 'z')")
    assert db.exec("SELECT count(*) FROM t WHERE id = 9").rows() == [(0,)]
    db.exec("DROP TRIGGER bad; DROP TRIGGER i; CREATE TRIGGER loop AFTER INSERT ON t BEGIN INSERT INTO t VALUES (NEW.id + 1, 'l'); END")
    with pytest.raises(errors.TriggerLimit):
        import millrace.database as m

        old, m.TRIGGER_DEPTH = m.TRIGGER_DEPTH, 3
        try:
            db.exec("INSERT INTO t VALUES (50, 'l')")
        finally:
            m.TRIGGER_DEPTH = old


def test_transactions(keyed):
    keyed.exec("BEGIN; DELETE FROM t; ROLLBACK")
    assert keyed.exec("SELECT count(*) FROM t").rows() == [(1,)]
    keyed.exec("START TRANSACTION; INSERT INTO t (id) VALUES (2); SAVEPOINT a; INSERT INTO t (id) VALUES (3); SAVEPOINT b; DELETE FROM t; ROLLBACK TO SAVEPOINT a; RELEASE a; END")
    assert rows(keyed, "SELECT id FROM t") == [(1,), (2,)]
    with pytest.raises(errors.NotInTransaction):
        keyed.exec("COMMIT")
    keyed.exec("BEGIN EXCLUSIVE")
    with pytest.raises(errors.TransactionActive):
        keyed.exec("BEGIN")
    with pytest.raises(errors.UnknownSavepoint):
        keyed.exec("RELEASE nothing")
    keyed.rollback()
    with pytest.raises(ZeroDivisionError), keyed.transaction():
        keyed.exec("DELETE FROM t")
        raise ZeroDivisionError
    assert keyed.exec("SELECT count(*) FROM t").rows() == [(2,)]


def test_alter(keyed):
    keyed.exec("ALTER TABLE t ADD COLUMN extra TEXT; ALTER TABLE t ADD more INTEGER DEFAULT 3; ALTER TABLE t RENAME COLUMN label TO title; ALTER TABLE t DROP COLUMN n; ALTER TABLE t RENAME TO u")
    assert keyed.exec("SELECT * FROM u").df.columns == ["id", "title", "extra", "more"]
    assert rows(keyed, "SELECT * FROM u") == [(1, "original", None, 3)]
    with pytest.raises(errors.UnknownTable):
        keyed.exec("SELECT * FROM t")
    with pytest.raises(errors.ConstraintViolation):
        keyed.exec("ALTER TABLE u DROP COLUMN id")
    with pytest.raises(errors.ColumnExists):
        keyed.exec("ALTER TABLE u ADD title TEXT")
    assert [r[1] for r in keyed.exec("PRAGMA table_info(u)").rows()] == ["id", "title", "extra", "more"]
    keyed.exec("DROP TABLE u; DROP TABLE IF EXISTS u")


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with Database(spark, path) as db:
        db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, label TEXT DEFAULT 'untitled'); INSERT INTO t (id) VALUES (1); CREATE VIEW v AS SELECT id FROM t; CREATE UNIQUE INDEX tl ON t (label)")
        db.exec("CREATE VIRTUAL TABLE s USING generate_series(1, 3); PRAGMA user_version = 7")
        db.exec("BEGIN; DELETE FROM t")
    with Database(spark, path) as db:
        assert rows(db, "SELECT * FROM t") == [(1, "untitled")]
        assert db.exec("SELECT count(*) FROM s").rows() == [(3,)]
        assert db.exec("SELECT id FROM v").rows() == [(1,)]
        assert db.exec("PRAGMA user_version").rows() == [(7,)]
        with pytest.raises(errors.ConstraintViolation):
            db.exec("INSERT INTO t VALUES (2, 'untitled')")
        db.exec("INSERT INTO t VALUES (2, 'x')")
        assert len(db.state.table("t").parts) == 2  # an insert adds a part and rewrites nothing
        first = db.state.table("t").parts[0]
        db.exec("UPDATE t SET label = 'y' WHERE id = 2")
        assert any(p.startswith(first) for p in db.state.table("t").parts)  # what holds none of the rows stays
        assert db.store.vacuum(db.state) == 1
    with Database(spark, path) as db:
        assert rows(db, "SELECT * FROM t") == [(1, "untitled"), (2, "y")]


def test_writes_keep_other_files(spark, tmp_path):
    """An update or delete rewrites the files that hold its rows; keys are still checked against all."""
    path = f"file://{tmp_path}/db"
    with Database(spark, path) as db:
        db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, k INTEGER)")
        for k in range(5):
            db.exec("INSERT INTO t VALUES (?, ?), (?, ?)", [2 * k, k, 2 * k + 1, k])
        before = set(db.state.table("t").parts)
        files = {p.name for p in (tmp_path / "db/t").rglob("*.parquet")}
        assert db.exec("UPDATE t SET k = 70 WHERE id = 7").changes == 1
        now = {p.rsplit("/", 1)[1] for p in db.state.table("t").parts if p.endswith(".parquet")}
        held = [f for f in files if f in now]
        assert len(before) == 5 and len(held) >= 4
        with pytest.raises(errors.ConstraintViolation):
            db.exec("UPDATE t SET id = 0 WHERE id = 9")
        assert db.exec("BEGIN; DELETE FROM t WHERE id = 2; UPDATE t SET k = -1 WHERE id = 3; INSERT INTO t VALUES (50, 5); UPDATE t SET k = 6 WHERE id = 50; COMMIT").changes == 0
        assert len([p for p in db.state.table("t").parts if p.rsplit("/", 1)[1] in files]) >= 3
        db.store.vacuum(db.state)
    with Database(spark, path) as db:
        assert rows(db, "SELECT id, k FROM t WHERE id IN (2, 3, 7, 9, 50) ORDER BY id") == [(3, -1), (50, 6), (7, 70), (9, 4)]
        assert db.exec("SELECT count(*) FROM t").rows() == [(10,)]
        assert db.exec("DELETE FROM t").changes == 10


def test_inserts_dont_shuffle_the_table(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "sha2(cast(id AS string), 512) AS x").write.parquet(f"{tmp_path}/big")
    big, few = spark.read.parquet(f"{tmp_path}/big"), scratch(spark.sql("SELECT * FROM VALUES (7L), (NULL), (1000000000L) AS t(id)"))
    for how, want in (("left_semi", [7]), ("left_anti", [None, 10**9])):
        found = checks.matching(few, ("id",), big, ("id",), how)
        assert sorted((r["id"] for r in found.collect()), key=str) == sorted(want, key=str)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan  # the large side's keys are cut down before they move


def test_upsert_of_repeated_keys(db, spark):
    """Rows that share a key cost no further jobs where only the incoming rows matter; else they are taken in turn."""
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER, b TEXT NOT NULL); INSERT INTO t VALUES (1, 0, 'old'), (2, 0, 'old')")
    db.exec("CREATE VIRTUAL TABLE s USING generate_series(1, 1000)")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("upsert", "")
    out = db.exec("INSERT INTO t SELECT value % 2 + 2, value, 'n' || value FROM s ON CONFLICT (id) DO UPDATE SET a = excluded.a, b = excluded.b WHERE excluded.a <> 999")
    assert len(tracker.getJobIdsForGroup("upsert")) < 60
    spark.sparkContext.setJobGroup("", "")
    # 2: there, 500 even values; 3: new with 1, then 499 odd ones, of which 999 is passed over
    assert out.changes == 500 + 1 + 498
    assert rows(db, "SELECT id, a, b FROM t") == [(1, 0, "old"), (2, 1000, "n1000"), (3, 997, "n997")]
    with pytest.raises(errors.ConstraintViolation):
        db.exec("INSERT INTO t VALUES (1, 1, NULL), (1, 2, 'x') ON CONFLICT (id) DO UPDATE SET b = excluded.b")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("INSERT INTO t VALUES (9, 1, NULL), (9, 2, 'x') ON CONFLICT (id) DO UPDATE SET b = excluded.b")
    db.exec("INSERT INTO t VALUES (9, 1, 'first'), (9, 2, 'second') ON CONFLICT (id) DO UPDATE SET a = excluded.a")
    assert rows(db, "SELECT * FROM t WHERE id = 9") == [(9, 2, "first")]


def test_check_constraints(db):
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY CHECK (id > 0), n INTEGER, label TEXT, CHECK (n < 10 OR label = 'big'))")
    db.exec("INSERT INTO t VALUES (1, 5, 'x'), (2, 50, 'big'), (3, NULL, NULL)")
    for bad in ("INSERT INTO t VALUES (0, 1, 'x')", "INSERT INTO t VALUES (4, 10, 'x')", "UPDATE t SET n = 11 WHERE id = 1", "INSERT INTO t VALUES (1, 0, '') ON CONFLICT (id) DO UPDATE SET n = 99"):
        with pytest.raises(errors.ConstraintViolation):
            db.exec(bad)
    db.exec("ALTER TABLE t RENAME COLUMN n TO m; UPDATE t SET m = 9 WHERE id = 1")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("UPDATE t SET m = 10 WHERE id = 1")
    with pytest.raises(errors.ConstraintViolation):
        db.exec("ALTER TABLE t DROP COLUMN m")
    with pytest.raises(errors.UnknownColumn):
        db.exec("CREATE TABLE u (id INTEGER, CHECK (nothing > 1))")


def test_datetime(db):
    assert db.exec("SELECT datetime('2024-02-03 04:05:06'), datetime('2024-02-03'), datetime('no'), length(datetime('now'))").rows() == [("2024-02-03 04:05:06", "2024-02-03 00:00:00", None, 19)]


def test_index_orders_files(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db:
        db.exec("BEGIN; CREATE TABLE t (id INTEGER, k INTEGER); CREATE INDEX by_k ON t (k); CREATE VIRTUAL TABLE s USING generate_series(1, 400); INSERT INTO t SELECT value, value * 37 % 400 FROM s; COMMIT")
        files = [f for p in db.state.table("t").parts for f in Path(p.removeprefix("file://")).glob("*.parquet")]
        assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 400
        for f in files:
            k = pq.read_table(f)["k"].to_pylist()
            assert k == sorted(k)


def test_migrations(db):
    m = Migrator([Migration(2, "INSERT INTO t VALUES (2)", "DELETE FROM t WHERE id = 2")])
    m.add(Migration(1, "CREATE TABLE t (id INTEGER)", "DROP TABLE t"))
    assert m.apply(db) == 2 and m.apply(db) == 2
    assert rows(db, "SELECT id FROM t") == [(2,)]
    assert m.rollback(db) == 2 and m.rollback(db) == 1 and m.rollback(db) == 0
    with pytest.raises(errors.UnknownTable):
        db.exec("SELECT * FROM t")


def test_db_files(db, tmp_path):
    from millrace.sources.db_file import export_file, import_file

    path = str(tmp_path / "a.db")
    file = sqlite3.connect(path)
    file.executescript(
        "CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT NOT NULL, x REAL, b BLOB); INSERT INTO p VALUES (1, 'é', 1.5, x'00ff'), (5, 'b', NULL, NULL);"
        "CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p(id) ON DELETE CASCADE); INSERT INTO c VALUES (1, 5); CREATE VIEW v AS SELECT name FROM p; CREATE INDEX i ON p (name)"
    )
    file.execute("PRAGMA user_version = 12")
    file.close()
    assert import_file(db, path) == ["p", "c"]
    assert db.exec("PRAGMA user_version").rows() == [(12,)]
    assert rows(db, "SELECT id, name, x FROM p") == [(1, "é", 1.5), (5, "b", None)]
    assert [bytes(r[0]) for r in db.exec("SELECT b FROM p WHERE id = 1").rows()] == [b"\x00\xff"]
    db.exec("DELETE FROM p WHERE id = 5")
    assert rows(db, "SELECT * FROM c") == []
    (tmp_path / "no.db").write_text("nothing of the kind, " * 99)
    with pytest.raises(errors.InvalidHeader):
        import_file(db, str(tmp_path / "no.db"))
    out = str(tmp_path / "b.db")
    export_file(db, out)
    file = sqlite3.connect(out)
    assert file.execute("SELECT * FROM p").fetchall() == [(1, "é", 1.5, b"\x00\xff")]
    assert file.execute("SELECT name FROM v").fetchall() == [("é",)]
    file.close()


def test_db_files_keep_defaults_and_triggers(db, spark, tmp_path):
    from millrace import Database
    from millrace.sources.db_file import export_file, import_file

    db.exec("CREATE TABLE d (id INTEGER PRIMARY KEY, n INTEGER DEFAULT -3, x REAL DEFAULT 1.5, s TEXT NOT NULL DEFAULT 'it''s; é', z TEXT DEFAULT NULL, b BLOB DEFAULT 'ab')")
    db.exec("CREATE TABLE log (id INTEGER, was INTEGER, now INTEGER)")
    db.exec("CREATE TRIGGER ins AFTER INSERT ON d BEGIN INSERT INTO log VALUES (NEW.id, NULL, NEW.n); END")
    db.exec("CREATE TRIGGER upd AFTER UPDATE OF n ON d FOR EACH ROW WHEN NEW.n > 5 BEGIN INSERT INTO log VALUES (NEW.id, OLD.n, NEW.n); DELETE FROM log WHERE id = 99; END")
    db.exec("INSERT INTO d (id) VALUES (1)")
    out = str(tmp_path / "d.db")
    export_file(db, out)

    file = sqlite3.connect(out)
    file.execute("INSERT INTO d (id) VALUES (2)")
    file.execute("UPDATE d SET n = 9 WHERE id = 2")
    assert file.execute("SELECT n, x, s, z, b FROM d WHERE id = 2").fetchall() == [(9, 1.5, "it's; é", None, b"ab")]
    assert file.execute("SELECT * FROM log").fetchall() == [(1, None, -3), (2, None, -3), (2, -3, 9)]
    file.close()

    export_file(db, str(tmp_path / "e.db"))
    with Database(spark) as other:
        import_file(other, str(tmp_path / "e.db"))
        other.exec("INSERT INTO d (id) VALUES (3)")
        other.exec("UPDATE d SET n = n + 10 WHERE id = 3")
        other.exec("UPDATE d SET n = 0 WHERE id = 3")
        assert other.exec("SELECT n, x, s, z FROM d WHERE id = 3").rows() == [(0, 1.5, "it's; é", None)]
        assert other.exec("SELECT * FROM log ORDER BY id, now").rows() == [(1, None, -3), (3, None, -3), (3, -3, 7)]


def test_trigger_bodies_over_many_rows(db):
    """Over 10,000 rows; what depends on the order still goes row by row."""
    db.exec(
        "CREATE TABLE t (id INTEGER, g INTEGER); CREATE TABLE copy (id INTEGER, g INTEGER); CREATE TABLE names (g INTEGER, name TEXT); CREATE TABLE log (id INTEGER, name TEXT, n INTEGER);"
        "CREATE TABLE totals (g INTEGER, n INTEGER); INSERT INTO totals VALUES (0, 0), (1, 0); INSERT INTO names VALUES (0, 'zero'), (1, 'one');"
        "CREATE VIRTUAL TABLE s USING generate_series(1, 10050); INSERT INTO t SELECT value, value % 2 FROM s; INSERT INTO copy SELECT id, g FROM t;"
        "CREATE TRIGGER u AFTER UPDATE ON t BEGIN UPDATE copy SET g = copy.g + NEW.g WHERE copy.id = OLD.id;"
        "  INSERT INTO log SELECT NEW.id, name, OLD.g FROM names WHERE names.g = NEW.g; INSERT INTO log SELECT 0, 'count', count(*) FROM names WHERE names.g < OLD.g; END;"
        "CREATE TRIGGER d AFTER DELETE ON t BEGIN DELETE FROM copy WHERE copy.id = OLD.id; END;"
        "UPDATE t SET g = 1"
    )
    assert db.exec("SELECT sum(g), count(*) FROM copy").rows() == [(5025 + 10050, 10050)]
    assert rows(db, "SELECT name, count(*), sum(n), count(DISTINCT id) FROM log GROUP BY name") == sorted([("one", 10050, 5025, 10050), ("count", 10050, 5025, 1)], key=str)
    db.exec("DELETE FROM t WHERE id > 5")
    assert rows(db, "SELECT id FROM copy") == [(1,), (2,), (3,), (4,), (5,)]
    db.exec("CREATE TRIGGER sum AFTER INSERT ON t BEGIN UPDATE totals SET n = totals.n + NEW.id WHERE totals.g = NEW.g; END; INSERT INTO t VALUES (10, 1), (20, 1), (5, 0)")
    assert rows(db, "SELECT * FROM totals") == [(0, 5), (1, 30)]

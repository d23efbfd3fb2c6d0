"""Interchange with .db files, through the standard library's reader of them.

Reading is a Spark data source with a partition for each range of rowids; the file must be at a path that executors see.
Writing makes one file, so it is the driver's work, row by row from the executors.
"""

from __future__ import annotations

import math
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import RID, Column, Trigger
from ..errors import InvalidHeader, InvalidRecord
from ..operators import dml
from ..types import affinity, declared_type, spark_type

FORMAT = "millrace_db_file"
ROWS_PER_PART = 200_000
_PYTHON = {T.LongType(): int, T.DoubleType(): float, T.StringType(): str, T.BinaryType(): bytes}


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _fitted(value: object, kind: type | None) -> object:
    """A value as its column's type; a column of a file may hold values of several classes."""
    if value is None or kind is None or isinstance(value, kind):
        return value
    try:
        return value.encode() if kind is bytes and isinstance(value, str) else value.decode() if kind is str and isinstance(value, bytes) else kind(value)
    except (TypeError, ValueError) as e:
        raise InvalidRecord(f"{value!r} is no {kind.__name__}") from e


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]

    def partitions(self) -> list[_Range]:
        db = _connect(self.path)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
        finally:
            db.close()
        if low is None:
            return [_Range(0, 0)]
        return [_Range(a, min(a + ROWS_PER_PART, high + 1)) for a in range(low, high + 1, ROWS_PER_PART)]

    def read(self, part: _Range) -> Iterator[tuple]:
        kinds = [_PYTHON.get(f.dataType) for f in self.schema]
        names = ", ".join(_quote(f.name) for f in self.schema)
        db = _connect(self.path)
        try:
            for row in db.execute(f"SELECT {names} FROM {_quote(self.table)} WHERE rowid >= ? AND rowid < ?", (part.low, part.high)):
                yield tuple(_fitted(v, k) for v, k in zip(row, kinds, strict=True))
        finally:
            db.close()


class DbFile(DataSource):
    """Options: path and table."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        db = _connect(self.options["path"])
        try:
            info = db.execute(f"PRAGMA table_info({_quote(self.options['table'])})").fetchall()
        finally:
            db.close()
        # NUMERIC columns hold what their values are, so they come as real numbers
        return T.StructType([T.StructField(r[1], spark_type(r[2] or "BLOB") if affinity(r[2] or "BLOB") != "numeric" else T.DoubleType()) for r in info])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(DbFile)
    return spark.read.format(FORMAT).option("path", path).option("table", table).load()


def import_file(db: object, path: str) -> list[str]:
    """Make the file's tables, with keys, foreign keys, views and indexes, in a database; their names."""
    file = _connect(path)
    try:
        version, app = (file.execute(f"PRAGMA {x}").fetchone()[0] for x in ("user_version", "application_id"))
        found = file.execute("SELECT type, name, tbl_name, sql FROM sqlite_master WHERE sql IS NOT NULL AND name NOT LIKE 'sqlite_%' ORDER BY rowid").fetchall()
    except sqlite3.DatabaseError as e:
        raise InvalidHeader(f"{path}: {e}") from e
    finally:
        file.close()
    names = [name for kind, name, _, _ in found if kind == "table"]
    fk = db.state.foreign_keys
    db.exec("PRAGMA foreign_keys = OFF")
    for kind, name, _, sql in found:
        if kind == "table":
            db.exec(sql)
            rows = read_table(db.spark, path, name)
            incoming = db._incoming(db.state.table(name), rows.columns, rows)
            db._change(lambda n=name, r=incoming: db._write(lambda s: dml.insert(s, n, r)))
    for kind, _, _, sql in found:
        if kind in ("index", "view", "trigger"):
            db.exec(sql)
    db.exec(f"PRAGMA foreign_keys = {'ON' if fk else 'OFF'}; PRAGMA user_version = {version}; PRAGMA application_id = {app}")
    return names


def _default(spark: SparkSession, column: Column) -> str:
    """A column's default as the file's SQL."""
    if column.default.strip().removesuffix("()").upper() in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME"):
        return column.default.strip().removesuffix("()").upper()
    value = spark.range(1).select(F.expr(column.default).cast(column.type)).first()[0]
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (str, bytes, bytearray)):
        kind, raw = ("TEXT", value.encode()) if isinstance(value, str) else ("BLOB", bytes(value))
        try:
            text = "'" + raw.decode().replace("'", "''") + "'"
        except UnicodeDecodeError:
            text = None
        if text is None or "\0" in text:
            return f"(CAST(unhex('{raw.hex()}') AS {kind}))"
        return text if kind == "TEXT" else f"(CAST({text} AS BLOB))"
    return f"{'-' * (value < 0)}9e999" if isinstance(value, float) and math.isinf(value) else repr(value)


def trigger_sql(t: Trigger) -> str:
    """The CREATE TRIGGER that makes a trigger of the catalog."""
    of = f" OF {', '.join(map(_quote, t.of))}" if t.of else ""
    when = f" WHEN {t.when.strip()}" if t.when else ""
    body = t.body.strip()
    return f"CREATE TRIGGER {_quote(t.name)} {t.timing} {t.event}{of} ON {_quote(t.table)} FOR EACH ROW{when} BEGIN {body}{'' if body.endswith(';') else ';'} END"


def table_sql(state: object, name: str) -> str:
    """The CREATE TABLE that makes a table of the catalog."""
    table = state.table(name)
    parts = []
    for c in table.columns:
        text = f"{_quote(c.name)} {c.declared or declared_type(c.type)}" + (" NOT NULL" if c.not_null else "")
        if c.default is not None:
            text += f" DEFAULT {_default(table.df.sparkSession, c)}"
        parts.append(text)
    for k in table.keys:
        if k.index is None:
            parts.append(f"{'PRIMARY KEY' if k.primary else 'UNIQUE'} ({', '.join(map(_quote, k.columns))})")
    for f in table.foreign:
        parts.append(
            f"FOREIGN KEY ({', '.join(map(_quote, f.columns))}) REFERENCES {_quote(f.parent)} ({', '.join(map(_quote, f.parent_columns))}) ON DELETE {f.on_delete} ON UPDATE {f.on_update}"
        )
    parts += [f"CHECK ({c})" for c in table.checks]
    return f"CREATE TABLE {_quote(table.name)} ({', '.join(parts)})"


def export_file(db: object, path: str) -> None:
    """Write tables, indexes, views and triggers to a new .db file."""
    out = sqlite3.connect(path)
    try:
        out.execute(f"PRAGMA user_version = {db.state.user_version}")
        out.execute(f"PRAGMA application_id = {db.state.application_id}")
        for table in db.state.tables.values():
            out.execute(table_sql(db.state, table.name))
            marks = ", ".join("?" * len(table.columns))
            rows = (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in table.df.orderBy(RID).drop(RID).toLocalIterator())
            out.executemany(f"INSERT INTO {_quote(table.name)} VALUES ({marks})", rows)
        for i in db.state.indexes.values():
            out.execute(f"CREATE {'UNIQUE ' * i.unique}INDEX {_quote(i.name)} ON {_quote(i.table)} ({', '.join(map(_quote, i.columns))})")
        for v in db.state.views.values():
            out.execute(f"CREATE VIEW {_quote(v.name)} AS {v.sql}")
        for t in db.state.triggers.values():
            out.execute(trigger_sql(t))
        out.commit()
    finally:
        out.close()

"""What a database holds at one moment. All of it is immutable; a transaction keeps a reference and puts it back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import errors

RID = "_rid"  # hidden: the order in which rows came


@dataclass(frozen=True)
class Column:
    name: str
    declared: str
    type: T.DataType
    not_null: bool = False
    default: str | None = None  # Spark SQL of a constant


@dataclass(frozen=True)
class Key:
    """A primary or unique key. Rows with a null in a unique key never clash."""

    columns: tuple[str, ...]
    primary: bool = False
    index: str | None = None  # the unique index that it comes from


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class Table:
    """df: RID and the columns. parts: where df is stored, but for the frames in ``added``; None: it is to be rewritten."""

    name: str
    columns: tuple[Column, ...]
    keys: tuple[Key, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()  # Spark SQL of what no row may make false
    df: DataFrame = None
    next_rid: int = 1
    parts: tuple[str, ...] | None = ()
    added: tuple[DataFrame, ...] = ()
    steps: int = 0  # plans laid upon one another since df was last stored
    series: tuple[int, int, int] | None = None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise errors.UnknownColumn(f"{self.name}.{name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(RID, T.LongType())] + [T.StructField(c.name, c.type) for c in self.columns])


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class View:
    name: str
    sql: str


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    timing: str
    event: str
    body: str
    when: str | None = None
    of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Snapshot:
    tables: Mapping[str, Table] = field(default_factory=dict)
    indexes: Mapping[str, Index] = field(default_factory=dict)
    views: Mapping[str, View] = field(default_factory=dict)
    triggers: Mapping[str, Trigger] = field(default_factory=dict)
    foreign_keys: bool = True
    user_version: int = 0
    application_id: int = 0
    journal_mode: str = "delete"

    def table(self, name: str) -> Table:
        found = self.tables.get(name.lower())
        if found is None:
            raise errors.UnknownTable(name)
        return found

    def put(self, kind: str, name: str, value: object) -> Snapshot:
        """With an entry set, or removed if value is None. kind: tables, indexes, views or triggers."""
        entries = {k: v for k, v in getattr(self, kind).items() if k != name.lower()}
        if value is not None:
            entries[name.lower()] = value
        return replace(self, **{kind: entries})

    def put_table(self, table: Table) -> Snapshot:
        # a table keeps its place, so that a changed one doesn't move to the end
        return replace(self, tables={**self.tables, table.name.lower(): table})

    def taken(self, name: str) -> type[errors.DatabaseError] | None:
        """The error for creating something of this name, if the name is taken."""
        low = name.lower()
        for entries, error in ((self.tables, errors.TableExists), (self.views, errors.ViewExists), (self.indexes, errors.IndexExists)):
            if low in entries:
                return error
        return None

    def children(self, parent: str) -> list[tuple[Table, ForeignKey]]:
        return [(t, f) for t in self.tables.values() for f in t.foreign if f.parent.lower() == parent.lower()]

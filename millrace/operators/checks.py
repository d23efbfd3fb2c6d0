"""Constraint checks: the rows that break a rule, found in one job for a whole statement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import RID, ForeignKey, Key, Snapshot, Table
from ..errors import ConstraintViolation
from ..sources.store import LOCAL_BYTES


def filled(columns: tuple[str, ...], prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{prefix}`{c}`").isNotNull() for c in columns))


def not_null_columns(table: Table) -> list[str]:
    own = {c.name for c in table.columns if c.not_null}
    return [c.name for c in table.columns if c.name in own or any(k.primary and c.name in k.columns for k in table.keys)]


def key_rows(df: DataFrame, columns: tuple[str, ...], names: list[str]) -> DataFrame:
    return df.where(filled(columns)).select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))


def matching(df: DataFrame, columns: tuple[str, ...], other: DataFrame, other_columns: tuple[str, ...], how: str) -> DataFrame:
    """df semi- or anti-joined to other by equal, non-null columns. Where df is small, other is first cut down to its keys
    by a broadcast, so that a large table's keys aren't shuffled for a few new rows."""
    names = [f"_k{i}" for i in range(len(columns))]
    keys = key_rows(other, other_columns, names)
    if small(df) and not small(other):
        keys = keys.join(F.broadcast(key_rows(df, columns, names).distinct()), names, "left_semi")
    on = reduce(lambda a, b: a & b, (df[c] == keys[n] for c, n in zip(columns, names, strict=True)))
    return df.join(keys, on, how)


def small(df: DataFrame) -> bool:
    """Whether Catalyst knows the frame to hold few bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= LOCAL_BYTES


def conditions(table: Table, rows: DataFrame) -> list[tuple[str, DataFrame]]:
    """The rows against which a CHECK is; one that is null holds."""
    return [(f"{table.name}: CHECK ({c})", rows.where(~F.coalesce(F.expr(c).cast("boolean"), F.lit(True)))) for c in table.checks]


def repeated(df: DataFrame, key: Key) -> DataFrame:
    return df.where(filled(key.columns)).groupBy(*(F.col(f"`{c}`") for c in key.columns)).count().where("count > 1")


def probes(state: Snapshot, table: Table, delta: DataFrame, rest: DataFrame | None, all_keys: bool = True) -> list[tuple[str, DataFrame]]:
    """What must be empty for ``delta`` to stand in the table beside the rows ``rest``."""
    out = [(f"{table.name}.{c} is null", delta.where(F.col(f"`{c}`").isNull())) for c in not_null_columns(table)]
    out += conditions(table, delta)
    for key in table.keys if all_keys else ():
        said = f"{table.name}({', '.join(key.columns)}) is not unique"
        out.append((said, repeated(delta, key)))
        if rest is not None:
            out.append((said, matching(delta, key.columns, rest, key.columns, "left_semi")))
    if state.foreign_keys:
        for f in table.foreign:
            out.append((f"{table.name}({', '.join(f.columns)}) has no parent in {f.parent}", orphans(state, delta, f)))
    return out


def orphans(state: Snapshot, rows: DataFrame, f: ForeignKey) -> DataFrame:
    parent = state.table(f.parent)
    return matching(rows.where(filled(f.columns)), f.columns, parent.df, f.parent_columns, "left_anti")


def first_broken(found: list[tuple[str, DataFrame]]) -> str | None:
    """The first rule that has a row against it; one job probes all, each until its first row."""
    if not found:
        return None
    parts = [df.limit(1).select(F.lit(i).alias("i")) for i, (_, df) in enumerate(found)]
    rows = reduce(DataFrame.unionAll, parts).collect()
    return found[min(r["i"] for r in rows)][0] if rows else None


def demand(found: list[tuple[str, DataFrame]]) -> None:
    if said := first_broken(found):
        raise ConstraintViolation(said)


__all__ = ["RID", "conditions", "demand", "filled", "first_broken", "key_rows", "matching", "not_null_columns", "orphans", "probes", "repeated", "small"]

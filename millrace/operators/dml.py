"""INSERT, UPDATE and DELETE as plans over the current version of a table. Each returns the new snapshot, the rows that
changed, and how many; nothing is changed in place, so a statement that fails leaves all as it was."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import RID, ForeignKey, Key, Snapshot, Table
from ..errors import ConstraintViolation, Unsupported
from ..sources.store import files_of, scratch
from . import checks

ORD = "_ord"  # the order of incoming rows
#: Plans laid upon one another before a table is stored.
STEPS = 6
DEPTH = 64


@dataclass
class Change:
    """What happened to one table: frames with the old and new values of the rows, or None."""

    table: str
    event: str
    old: DataFrame | None
    new: DataFrame | None


def settle(table: Table, df: DataFrame, added: DataFrame | None = None) -> Table:
    """The table with other rows: ``added`` ones beside the old, or all anew. Long plans are cut by storing."""
    steps = table.steps + 1
    if steps >= STEPS:
        df, steps = scratch(df), 0
    if added is not None and table.parts is not None:
        return replace(table, df=df, added=(*table.added, added), steps=steps)
    return replace(table, df=df, parts=None, added=(), steps=steps)


@dataclass
class Apart:
    """A stored table by the files that hold some rows, with what isn't stored yet, and the other files."""

    touched: DataFrame
    others: DataFrame
    files: tuple[str, ...]

    def with_rows(self, table: Table, rows: DataFrame) -> Table:
        """The table with ``rows`` in place of what is touched; the other files stay as they are."""
        steps = table.steps + 1
        if steps >= STEPS:
            rows, steps = scratch(rows), 0
        return replace(table, df=self.others.unionByName(rows), parts=self.files, added=(rows,), steps=steps)


def _apart(table: Table, rids: DataFrame) -> Apart | None:
    """Where the rows are; None if the table isn't stored or all its files hold some. Of the files only RIDs are read."""
    if not table.parts or table.series:
        return None
    spark = table.df.sparkSession
    read = lambda paths: spark.read.schema(table.schema).parquet(*paths)
    stored = read(table.parts)
    at = stored.select(RID, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    hit = {r["file"] for r in at.join(rids, RID, "left_semi").select("file").distinct().collect()}
    files = files_of(table.parts, stored.inputFiles())
    others = tuple(p for name, p in files.items() if name not in hit)
    if not others:
        return None
    touched = [p for name, p in files.items() if name in hit]
    frames = ([read(touched)] if touched else []) + list(table.added)
    return Apart(reduce(DataFrame.unionByName, frames), read(others), others) if frames else None


def numbered(table: Table, rows: DataFrame) -> tuple[Table, DataFrame, int]:
    """Rows with ORD get their RIDs in that order; also how many they are."""
    names = [F.col(f"`{n}`") for n in table.names]
    rows = rows.select((F.col(ORD) + table.next_rid).alias(RID), *names)
    top, n = rows.agg(F.max(RID), F.count("*")).first()
    return replace(table, next_rid=(top if top is not None else table.next_rid - 1) + 1), rows, n


def _first_of_each(rows: DataFrame, key: Key, last: bool = False) -> DataFrame:
    """Of rows that clash in the key, the first (or last); rows that can't clash all stay."""
    order = F.col(ORD).desc() if last else F.col(ORD)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in key.columns)).orderBy(order)))
    return ranked.where((F.col("_n") == 1) | ~checks.filled(key.columns)).drop("_n")


def insert(state: Snapshot, name: str, rows: DataFrame, mode: str = "abort") -> tuple[Snapshot, list[Change], int]:
    """rows: the table's columns and ORD. mode: abort; ignore (rows that would break a rule are left out); replace (rows
    of the table, and earlier ones among the new, give way to those that clash with them)."""
    table, changes = state.table(name), []
    if table.series:
        raise Unsupported(f"{name} can't be written")
    if mode == "ignore":
        for c in checks.not_null_columns(table):
            rows = rows.where(F.col(f"`{c}`").isNotNull())
        for f in table.foreign if state.foreign_keys else ():
            with_parent = checks.matching(rows.where(checks.filled(f.columns)), f.columns, state.table(f.parent).df, f.parent_columns, "left_semi")
            rows = rows.where(~checks.filled(f.columns)).unionByName(with_parent)
        for key in table.keys:
            rows = checks.matching(rows, key.columns, table.df, key.columns, "left_anti")
        for key in table.keys:
            rows = _first_of_each(rows, key)
    elif mode == "replace":
        for key in table.keys:
            rows = _first_of_each(rows, key, last=True)
        rows = scratch(rows) if table.keys else rows
        for key in table.keys:
            victims = checks.matching(table.df, key.columns, rows, key.columns, "left_semi").select(RID)
            if not victims.isEmpty():
                state, more, _ = delete(state, name, victims)
                changes += more
                table = state.table(name)
    if mode != "abort":
        rows = scratch(rows)
    table, new, n = numbered(table, rows)
    if n:
        checks.demand(checks.probes(state.put_table(replace(table, df=table.df.unionByName(new))), table, new, table.df if mode == "abort" else None, mode == "abort"))
        state = state.put_table(settle(table, table.df.unionByName(new), new))
        changes.append(Change(table.name, "INSERT", None, new))
    return state, changes, n


def upsert(
    state: Snapshot, name: str, rows: DataFrame, target: tuple[str, ...], build: Callable[[DataFrame], tuple[dict[str, Column], Column | None]] | None
) -> tuple[Snapshot, list[Change], int]:
    """INSERT ... ON CONFLICT. target: the columns of the key meant (none: any). build: from the joined frame, whose old
    columns are named o_ and incoming ones n_, what to set and under which condition; None: do nothing. Of incoming rows that
    share a key, later ones see what earlier ones left. Where what is set depends on the incoming rows alone
    (build.of_new), one aggregation finds what the last of them leaves; else they are taken one rank after another."""
    table = state.table(name)
    keys = [k for k in table.keys if not target or {c.lower() for c in k.columns} == {c.lower() for c in target}]
    if target and not keys:
        raise ConstraintViolation(f"no key of {name} has just the columns {', '.join(target)}")
    if build is None:
        return insert(state, name, rows, "ignore") if not target else _do_nothing(state, table, rows, keys[0])
    if not keys:
        return insert(state, name, rows)
    key = keys[0]
    if getattr(build, "of_new", False):
        done = _upsert_at_once(state, table, rows, key, build)
        if done is not None:
            return done
    ranked = rows.withColumn("_n", F.when(checks.filled(key.columns), F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in key.columns)).orderBy(ORD))).otherwise(1))
    ranked = scratch(ranked)
    changes, total = [], 0
    for rank in range(1, (ranked.agg(F.max("_n")).first()[0] or 0) + 1):
        table, part = state.table(name), ranked.where(F.col("_n") == rank).drop("_n")
        new = part.select(*(F.col(f"`{c}`").alias(f"n_{c}") for c in table.names))
        old = table.df.select(F.col(RID).alias("o_rid"), *(F.col(f"`{c}`").alias(f"o_{c}") for c in table.names))
        on = None
        for c in key.columns:
            one = old[f"o_{c}"] == new[f"n_{c}"]
            on = one if on is None else on & one
        joined = old.join(new, on)
        sets, where = build(joined)
        hits = joined if where is None else joined.where(where)
        updates = scratch(hits.select(F.col("o_rid").alias(RID), *(c.alias(f"u_{k}") for k, c in sets.items())))
        fresh = checks.matching(part, key.columns, table.df, key.columns, "left_anti")
        state, more, n = update(state, name, updates, list(sets))
        state, more_new, m = insert(state, name, scratch(fresh))
        changes += more + more_new
        total += n + m
    return state, changes, total


def _upsert_at_once(state: Snapshot, table: Table, rows: DataFrame, key: Key, build: Callable) -> tuple[Snapshot, list[Change], int] | None:
    """An upsert whose values and condition depend on the incoming rows alone, in as many jobs however often keys repeat;
    None if something else looks at each of the steps."""
    renamed = rows.select(ORD, *(F.col(f"`{c}`").alias(f"n_{c}") for c in table.names))
    sets, where = build(renamed)
    touched = {c.lower() for c in sets}
    in_keys = [c for k in table.keys for c in k.columns]
    in_foreign = [c for f in table.foreign for c in f.columns] + [c for _, f in state.children(table.name) for c in f.parent_columns]
    fires = any(t.table.lower() == table.name.lower() and t.event in ("INSERT", "UPDATE") for t in state.triggers.values())
    if fires or touched & {c.lower() for c in (*in_keys, *in_foreign)}:
        return None
    names = [F.col(f"`{c}`") for c in table.names]
    own, ks = [F.col(f"n_{c}").alias(c) for c in table.names], [f"_k{i}" for i in range(len(key.columns))]
    made = renamed.select(ORD, F.struct(*own).alias("row"), F.struct(*(c.alias(k) for k, c in sets.items())).alias("set"), F.coalesce(where, F.lit(False)).alias("ok") if where is not None else F.lit(True).alias("ok"))
    keyed = made.select("*", *(F.col(f"row.`{c}`").alias(k) for c, k in zip(key.columns, ks, strict=True)))
    full = keyed.where(checks.filled(tuple(ks)))
    must = [c for c in checks.not_null_columns(table) if c.lower() in touched]
    bad = lambda c: F.col("ok") & F.col(f"set.`{c}`").isNull()
    groups = full.groupBy(*ks).agg(
        F.min(ORD).alias(ORD),
        F.min_by("row", ORD).alias("row"),
        F.max_by("set", F.when(F.col("ok"), F.col(ORD))).alias("set"),
        F.sum(F.col("ok").cast("long")).alias("hits"),
        F.min_by(F.col("ok").cast("long"), ORD).alias("first"),
        *(F.sum(bad(c).cast("long")).alias(f"b_{i}") for i, c in enumerate(must)),
        *(F.min_by(bad(c).cast("long"), ORD).alias(f"f_{i}") for i, c in enumerate(must)),
    )
    groups = scratch(groups)
    there = checks.key_rows(table.df.withColumn("_there", F.col(RID)), (*key.columns, "_there"), [*ks, "_there"])
    met = scratch(groups.join(there, ks, "left")).withColumn("later", F.col("hits") - F.when(F.col("_there").isNull(), F.col("first")).otherwise(0))
    checks.demand(
        [(f"{table.name}.{c} is null", met.where(F.col(f"b_{i}") > F.when(F.col("_there").isNull(), F.col(f"f_{i}")).otherwise(0))) for i, c in enumerate(must)]
        + [(f"{table.name}.{c} is null", met.where(F.col("_there").isNull() & F.col(f"row.`{c}`").isNull())) for c in must]
    )
    updates = met.where(F.col("_there").isNotNull() & (F.col("later") > 0))
    total = updates.agg(F.coalesce(F.sum("later"), F.lit(0))).first()[0]
    state, changes, _ = update(state, table.name, scratch(updates.select(F.col("_there").alias(RID), *(F.col(f"set.`{c}`").alias(f"u_{c}") for c in sets))), list(sets))
    value = lambda c: F.when(F.col("later") > 0, F.col(f"set.`{c}`")).otherwise(F.col(f"row.`{c}`")) if c in sets else F.col(f"row.`{c}`")
    fresh = met.where(F.col("_there").isNull())
    total += fresh.agg(F.coalesce(F.sum("later"), F.lit(0))).first()[0]
    fresh = fresh.select(ORD, *(value(c).alias(c) for c in table.names))
    alone = keyed.where(~checks.filled(tuple(ks))).select(ORD, "row.*").select(ORD, *names)
    state, more, n = insert(state, table.name, scratch(fresh.unionByName(alone)))
    return state, changes + more, total + n


def _do_nothing(state: Snapshot, table: Table, rows: DataFrame, key: Key) -> tuple[Snapshot, list[Change], int]:
    rows = checks.matching(rows, key.columns, table.df, key.columns, "left_anti")
    return insert(state, table.name, scratch(_first_of_each(rows, key)))


def update(state: Snapshot, name: str, updates: DataFrame, columns: list[str], depth: int = 0) -> tuple[Snapshot, list[Change], int]:
    """updates: RID, once each, and u_<column> for each column to set, from the old values of the row."""
    table = state.table(name)
    n = updates.count()
    if not n:
        return state, [], 0
    columns = [table.column(c).name for c in columns]
    apart = _apart(table, updates.select(RID))
    base, others = (table.df, None) if apart is None else (apart.touched, apart.others)
    marked = updates.withColumnRenamed(RID, "_hit")
    both = base.join(marked, base[RID] == F.col("_hit"), "left")
    value = lambda c: F.when(F.col("_hit").isNotNull(), F.col(f"`u_{c}`")).otherwise(F.col(f"`{c}`")) if c in columns else F.col(f"`{c}`")
    after = both.select(RID, *(value(c).alias(c) for c in table.names))
    hit = both.where(F.col("_hit").isNotNull())
    old = hit.select(RID, *(F.col(f"`{c}`") for c in table.names))
    new = hit.select(RID, *(value(c).alias(c) for c in table.names))
    touched = {c.lower() for c in columns}
    # only what the changed columns can break is looked at
    found = [(f"{table.name}.{c} is null", new.where(F.col(f"`{c}`").isNull())) for c in checks.not_null_columns(table) if c.lower() in touched]
    for key in table.keys:
        if touched & {c.lower() for c in key.columns}:
            said = f"{table.name}({', '.join(key.columns)}) is not unique"
            rest = both.where(F.col("_hit").isNull()).select(*base.columns)
            rest = rest if others is None else rest.unionByName(others)
            found += [(said, checks.repeated(new, key)), (said, checks.matching(new, key.columns, rest, key.columns, "left_semi"))]
    found += checks.conditions(table, new)
    checks.demand(found)
    state = state.put_table(settle(table, after) if apart is None else apart.with_rows(table, after))
    changes = [Change(table.name, "UPDATE", old, new)]
    if state.foreign_keys:
        for child, f in state.children(name):
            if touched & {c.lower() for c in f.parent_columns}:
                state = _parent_moved(state, child.name, f, old, new, depth)
        found = [(f"{table.name}({', '.join(f.columns)}) has no parent in {f.parent}", checks.orphans(state, new, f)) for f in table.foreign if touched & {c.lower() for c in f.columns}]
        checks.demand(found)
    return state, changes, n


def _parent_moved(state: Snapshot, child: str, f: ForeignKey, old: DataFrame, new: DataFrame, depth: int) -> Snapshot:
    if depth > DEPTH:
        raise ConstraintViolation("foreign keys lead in a circle")
    a = old.select(F.col(RID).alias("_r"), *(F.col(f"`{c}`").alias(f"_a{i}") for i, c in enumerate(f.parent_columns)))
    b = new.select(F.col(RID).alias("_s"), *(F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(f.parent_columns)))
    same = None
    for i in range(len(f.columns)):
        one = F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
        same = one if same is None else same & one
    moved = a.join(b, F.col("_r") == F.col("_s")).where(~same)
    kids = state.table(child).df
    on = None
    for i, c in enumerate(f.columns):
        one = kids[c] == moved[f"_a{i}"]
        on = one if on is None else on & one
    hits = kids.join(moved, on)
    if hits.isEmpty():
        return state
    if f.on_update in ("RESTRICT", "NO ACTION"):
        raise ConstraintViolation(f"{child}({', '.join(f.columns)}) still refers to {f.parent}")
    values = {c: F.col(f"_b{i}") if f.on_update == "CASCADE" else _unset(state.table(child), c, f.on_update) for i, c in enumerate(f.columns)}
    updates = scratch(hits.select(RID, *(v.alias(f"u_{c}") for c, v in values.items())))
    state, _, _ = update(state, child, updates, list(values), depth + 1)
    return state  # what follows from a foreign key fires no triggers


def _unset(table: Table, column: str, action: str) -> Column:
    c = table.column(column)
    return F.expr(c.default).cast(c.type) if action == "SET DEFAULT" and c.default else F.lit(None).cast(c.type)


def delete(state: Snapshot, name: str, victims: DataFrame, depth: int = 0) -> tuple[Snapshot, list[Change], int]:
    """victims: the RIDs of the rows that go, with what foreign keys make of their children."""
    if depth > DEPTH:
        raise ConstraintViolation("foreign keys lead in a circle")
    table = state.table(name)
    gone = table.df.join(victims.select(F.col(RID).alias("_gone")).distinct(), F.col(RID) == F.col("_gone"), "left_semi")
    children = state.children(name) if state.foreign_keys else []
    if children:
        gone = scratch(gone)
    n = gone.count()
    if not n:
        return state, [], 0
    apart = _apart(table, gone.select(RID))
    base = table.df if apart is None else apart.touched
    rest = base.join(gone.select(F.col(RID).alias("_gone")), F.col(RID) == F.col("_gone"), "left_anti")
    state = state.put_table(settle(table, rest) if apart is None else apart.with_rows(table, rest))
    for child, f in children:
        kids = state.table(child.name)
        hits = checks.matching(kids.df, f.columns, gone, f.parent_columns, "left_semi")
        if f.on_delete in ("RESTRICT", "NO ACTION"):
            checks.demand([(f"{child.name}({', '.join(f.columns)}) still refers to {name}", hits)])
        elif f.on_delete == "CASCADE":
            state, _, _ = delete(state, child.name, scratch(hits.select(RID)), depth + 1)
        else:
            values = {c: _unset(kids, c, f.on_delete) for c in f.columns}
            state, _, _ = update(state, child.name, scratch(hits.select(RID, *(v.alias(f"u_{c}") for c, v in values.items()))), list(values), depth + 1)
    return state, [Change(table.name, "DELETE", gone, None)], n

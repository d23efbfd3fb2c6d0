"""A database: statements, prepared statements, transactions, and the catalog calls of the typed API."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .catalog import RID, Column, ForeignKey, Index, Key, Snapshot, Table, Trigger, View
from .operators import checks, dml
from .operators.recursion import fixpoint
from .plans.explain import detail
from .sources.store import Store, scratch, series
from .sql.reader import Reader
from .sql.select import Params, Rewriter, is_query, literal, split
from .sql.tokens import Token, statements, tokenize
from .types import coerce, declared_type, host_field, host_type, row_fields, spark_type

TRIGGER_DEPTH = 32
TRIGGER_ROWS = 10_000


@dataclass
class Result:
    """df: the rows of a query, None of other statements; changes: the rows that a statement wrote."""

    df: DataFrame | None = None
    changes: int = 0

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []

    def row_count(self) -> int:
        return self.df.count() if self.df is not None else 0


class Prepared:
    """A statement with parameters; bind() counts from 1, and what isn't bound below the highest is null."""

    def __init__(self, database: Database, sql: str):
        self._database, self.sql, self._values = database, sql, {}

    def bind(self, place: int | str, value: object) -> Prepared:
        if isinstance(place, int) and place < 1:
            raise errors.InvalidParameter("parameters count from 1")
        self._values[place] = value
        return self

    def step(self) -> Result:
        top = max((k for k in self._values if isinstance(k, int)), default=0)
        return self._database.exec(self.sql, {k: None for k in range(1, top + 1)} | self._values)

    def reset(self) -> None:
        self._values.clear()

    def finalize(self) -> None:
        self.reset()


class Database:
    """One writer's view. Without a path, tables live as long as the object does; with one, each statement outside a
    transaction, and each commit, is stored there."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.store = Store(spark, path) if path else None
        self.state = (self.store.load() if self.store else None) or Snapshot()
        self._backup: Snapshot | None = None
        self._savepoints: list[tuple[str, Snapshot]] = []
        self._id, self._views, self._depth = uuid.uuid4().hex[:8], {}, 0

    # Life

    def close(self) -> None:
        if self._backup is not None:
            self.rollback()
        for _, view in self._views.values():
            self.spark.catalog.dropTempView(view)
        self._views.clear()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Statements

    def exec(self, sql: str, params: Sequence | dict | None = None) -> Result:
        """Run one statement or a script; the result is the last statement's. Each statement counts wholly or not at all."""
        found = statements(tokenize(sql))
        if not found:
            raise errors.InvalidSql("no statement")
        values, out = Params(params), Result()
        for tokens in found:
            out = self._run(sql, tokens, values)
        return out

    def query(self, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        out = self.exec(sql, params)
        if out.df is None:
            raise errors.InvalidSql("not a query")
        return out.df

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def _run(self, sql: str, tokens: list[Token], params: Params, columns: Callable | None = None) -> Result:
        before = self.state
        try:
            out = self._statement(sql, tokens, params, columns)
        except errors.DatabaseError:
            self.state = before
            raise
        except ParseException as e:
            self.state = before
            raise errors.InvalidSql(str(e).split("\n")[0]) from e
        except AnalysisException as e:
            self.state = before
            kind = {"UNRESOLVED_COLUMN": errors.UnknownColumn, "TABLE_OR_VIEW_NOT_FOUND": errors.UnknownTable}.get((e.getCondition() or "").split(".")[0], errors.InvalidSql)
            raise kind(str(e).split("\n")[0]) from e
        if self.state is not before and self._backup is None and not self._depth:
            self._persist()
        return out

    def _persist(self) -> None:
        if self.store:
            self.state = self.store.save(self.state)

    def _statement(self, sql: str, tokens: list[Token], params: Params, columns: Callable | None) -> Result:
        r = Reader(tokens)
        word = tokens[0].text.upper() if tokens[0].kind == "word" else ""
        if is_query(tokens):
            if word == "WITH":
                return self._with(tokens, params, columns)
            return Result(self._select(tokens, params, columns))
        handler = getattr(self, f"_do_{word.lower()}", None)
        if handler is None:
            raise errors.InvalidSql(f"unknown statement {tokens[0].text!r}")
        r.i = 1
        return handler(r, params, sql, columns) or Result()

    # Queries

    def table_df(self, name: str) -> DataFrame:
        table = self.state.table(name)
        return table.df.select(*(F.col(f"`{c}`") for c in table.names))

    def _view_name(self, name: str, hidden: bool = False) -> str | None:
        """The SQL of a table or view of the snapshot."""
        low = name.lower()
        if low in self.state.views:
            text = self.state.views[low].sql
            found = tokenize(text)
            inner = Result(self._select(found, Params())) if not found[0].is_("WITH") else self._with(found, Params(), None)
            return self._temp(f"view {low}", inner.df)
        if low in self.state.tables:
            df = self.state.tables[low].df if hidden else self.table_df(low)
            return self._temp(f"table {low} {hidden}", df, self.state.tables[low])
        return None

    def _temp(self, key: str, df: DataFrame, version: object = None) -> str:
        known = self._views.get(key)
        if known is None or known[0] is not version or version is None:
            known = (version, f"mr_{self._id}_{len(self._views) if known is None else known[1].rsplit('_', 1)[1]}")
            df.createOrReplaceTempView(known[1])
            self._views[key] = known
        return known[1]

    def _rewriter(self, params: Params, columns: Callable | None = None, hidden: str | None = None) -> Rewriter:
        return Rewriter(lambda n: self._view_name(n, n.lower() == hidden), params, columns)

    def _select(self, tokens: list[Token], params: Params, columns: Callable | None = None, own: dict[str, str] | None = None) -> DataFrame:
        rewriter = self._rewriter(params, columns)
        if own:
            names, base = own, rewriter.table
            rewriter.table = lambda n: names.get(n.lower()) or base(n)
        return self.spark.sql(rewriter.sql(tokens))

    def _with(self, tokens: list[Token], params: Params, columns: Callable | None) -> Result:
        r = Reader(tokens)
        r.demand("WITH")
        recursive, own = r.accept("RECURSIVE"), {}
        while True:
            name = r.name()
            heads = r.names() if r.now is not None and r.now.op("(") else None
            r.demand("AS")
            body = r.inside()
            df = self._recursive(name, heads, body, params, columns, own) if recursive and any(t.named and t.text.lower() == name.lower() for t in body) else self._select(body, params, columns, own)
            if heads:
                if len(heads) != len(df.columns):
                    raise errors.ColumnCountMismatch(f"{name} has {len(df.columns)} columns")
                df = df.toDF(*heads)
            own = own | {name.lower(): self._temp(f"cte {name.lower()} {uuid.uuid4().hex}", df)}
            if not r.accept_op(","):
                break
        rest = r.rest()
        if rest and rest[0].is_("INSERT", "UPDATE", "DELETE"):
            extra = own
            old, self._view_name = self._view_name, lambda n, hidden=False: extra.get(n.lower()) or Database._view_name(self, n, hidden)
            try:
                return self._statement("", rest, params, columns)
            finally:
                self._view_name = old
        return Result(self._select(rest, params, columns, own))

    def _recursive(self, name: str, heads: tuple[str, ...] | None, body: list[Token], params: Params, columns: Callable | None, own: dict[str, str]) -> DataFrame:
        depth, cut = 0, None
        for k, t in enumerate(body):
            depth += t.op("(") - t.op(")")
            if not depth and t.is_("UNION"):
                cut = k
                break
        if cut is None:
            raise errors.InvalidSql(f"{name} needs UNION")
        first, term = body[:cut], body[cut + 1 + body[cut + 1].is_("ALL") :]
        anchor = self._select(first, params, columns, own)
        anchor = anchor.toDF(*heads) if heads else anchor
        types = [f.dataType for f in anchor.schema]

        def step(front: DataFrame) -> DataFrame:
            view = self._temp(f"front {name} {uuid.uuid4().hex}", front)
            made = self._select(term, params, columns, own | {name.lower(): view})
            if len(made.columns) != len(types):
                raise errors.ColumnCountMismatch(f"{name} has {len(types)} columns")
            made = made.toDF(*(f"c{i}" for i in range(len(types))))
            return made.select(*(F.col(f"c{i}").cast(t).alias(f"c{i}") for i, t in enumerate(types)))

        return fixpoint(anchor, step, scratch)

    def _do_explain(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        plan = r.accept("QUERY", "PLAN")
        tokens = r.rest()
        if not is_query(tokens):
            raise errors.Unsupported("EXPLAIN takes a query")
        if plan:
            return Result(self.spark.createDataFrame([(x,) for x in detail(self.state, tokens)], "detail string"))
        df = self._with(tokens, params, columns).df if tokens[0].is_("WITH") else self._select(tokens, params, columns)
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return Result(self.spark.createDataFrame([(df._jdf.queryExecution().explainString(mode),)], "detail string"))

    # Writing

    def _incoming(self, table: Table, names: Sequence[str], df: DataFrame) -> DataFrame:
        """The rows of df, by place, as the table's columns with ORD."""
        if len(names) != len(df.columns):
            raise errors.ColumnCountMismatch(f"{table.name}: {len(names)} columns, {len(df.columns)} values")
        df = df.toDF(*(f"v{i}" for i in range(len(names))))
        place = {table.column(n).name: i for i, n in enumerate(names)}
        out = []
        for c in table.columns:
            if c.name in place:
                i = place[c.name]
                value = coerce(F.col(f"v{i}"), df.schema[i].dataType, c.type, f"{table.name}.{c.name}")
            else:
                value = F.expr(c.default).cast(c.type) if c.default else F.lit(None).cast(c.type)
            out.append(value.alias(c.name))
        return df.select(F.monotonically_increasing_id().alias(dml.ORD), *out)

    def _do_insert(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        mode = "abort"
        if r.accept("OR"):
            mode = {"IGNORE": "ignore", "REPLACE": "replace", "ABORT": "abort", "FAIL": "abort", "ROLLBACK": "abort"}[r.one_of("IGNORE", "REPLACE", "ABORT", "FAIL", "ROLLBACK") or r.name()]
        return self._insert(r, params, mode, columns)

    def _do_replace(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        return self._insert(r, params, "replace", columns)

    def _insert(self, r: Reader, params: Params, mode: str, columns: Callable | None) -> Result:
        r.demand("INTO")
        table = self.state.table(r.name())
        names = r.names() if r.now is not None and r.now.op("(") and not (len(r.tokens) > r.i + 1 and r.tokens[r.i + 1].is_("SELECT", "WITH")) else table.names
        if r.accept("DEFAULT", "VALUES"):
            df, names = self.spark.range(1).drop("id"), []
        elif r.accept("VALUES"):
            tuples = [r.inside()]
            while r.accept_op(","):
                tuples.append(r.inside())
            if any(len(split(t)) != len(names) for t in tuples):
                raise errors.ColumnCountMismatch(f"{table.name}: {len(names)} columns")
            rewrite = self._rewriter(params, columns).sql
            df = self.spark.sql("VALUES " + ", ".join("(" + ", ".join(rewrite(x) for x in split(t)) + ")" for t in tuples))
        else:
            body = r.until("ON") if not any(t.is_("JOIN") for t in r.tokens[r.i :]) else self._to_conflict(r)
            df = self._with(body, params, columns).df if body and body[0].is_("WITH") else self._select(body, params, columns)
            df = scratch(df)
        rows = self._incoming(table, names, df)
        target, build, upsert = (), None, False
        if r.accept("ON", "CONFLICT"):
            upsert = True
            target = r.names() if r.now is not None and r.now.op("(") else ()
            r.demand("DO")
            if not r.accept("NOTHING"):
                r.demand("UPDATE", "SET")
                build = self._upsert_builder(table, r.rest(), params)
        r.end()
        if upsert:
            return self._write(lambda s: dml.upsert(s, table.name, rows, target, build))
        return self._write(lambda s: dml.insert(s, table.name, rows, mode))

    @staticmethod
    def _to_conflict(r: Reader) -> list[Token]:
        for k in range(r.i, len(r.tokens) - 1):
            if r.tokens[k].is_("ON") and r.tokens[k + 1].is_("CONFLICT"):
                body, r.i = r.tokens[r.i : k], k
                return body
        return r.rest()

    def _assignments(self, table: Table, tokens: list[Token]) -> dict[str, list[Token]]:
        out = {}
        for part in split(tokens):
            p = Reader(part)
            name = p.name()
            if p.accept_op("."):
                name = p.name()
            p.demand_op("=")
            out[table.column(name).name] = p.rest()
        if not out:
            raise errors.InvalidSql("SET without a column")
        return out

    def _upsert_builder(self, table: Table, tokens: list[Token], params: Params) -> Callable:
        r = Reader(tokens)
        sets = self._assignments(table, r.until("WHERE"))
        where = r.rest() if r.accept("WHERE") else None
        low = {c.lower() for c in table.names}

        def column(owner: str, name: str) -> str | None:
            if name.lower() in low and owner.lower() in ("excluded", table.name.lower()):
                return f"`{'n_' if owner.lower() == 'excluded' else 'o_'}{table.column(name).name}`"
            return None

        def plain(part: list[Token]) -> list[Token]:
            # a bare column means the row that is there
            out = []
            for k, t in enumerate(part):
                alone = not (k and part[k - 1].op(".")) and not (k + 1 < len(part) and (part[k + 1].op(".") or part[k + 1].op("(")))
                out += [Token("name", table.name, t.at), Token("op", ".", t.at), t] if t.named and t.text.lower() in low and alone else [t]
            return out

        rewrite = self._rewriter(params, column).sql
        exprs = {c: rewrite(plain(t)) for c, t in sets.items()}
        condition = rewrite(plain(where)) if where else None

        def build(joined: DataFrame):
            made = joined.select(*(F.expr(e) for e in exprs.values())).schema
            return {c: coerce(F.expr(e), f.dataType, table.column(c).type, f"{table.name}.{c}") for (c, e), f in zip(exprs.items(), made, strict=True)}, F.expr(condition) if condition else None

        build.of_new = not any("`o_" in e for e in (*exprs.values(), condition or ""))
        return build

    def _do_update(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        r.accept("OR", "IGNORE")
        table = self.state.table(r.name())
        if table.series:
            raise errors.Unsupported(f"{table.name} can't be written")
        r.demand("SET")
        sets = self._assignments(table, r.until("FROM", "WHERE"))
        source = r.until("WHERE") if r.accept("FROM") else None
        where = r.rest() if r.accept("WHERE") else []
        r.end()
        rewriter = self._rewriter(params, columns, hidden=table.name.lower())
        exprs = {c: rewriter.sql(t) for c, t in sets.items()}
        me = Token("word", table.name, 0)
        text = "SELECT `" + table.name + "`.`" + RID + "`, " + ", ".join(f"{e} AS `u_{c}`" for c, e in exprs.items()) + " "
        tail = [Token("word", "FROM", 0), me]
        if source is not None:
            tail += [Token("op", ",", 0), *source]
        if where:
            tail += [Token("word", "WHERE", 0), *where]
        found = self.spark.sql(text + rewriter.sql(tail))
        if source is not None:
            # of several rows that match, the first in the source's order
            first = self._first_match(table, found, source, text, rewriter, where)
            found = first
        kinds = {f.name: f.dataType for f in found.schema}
        made = found.select(RID, *(coerce(F.col(f"`u_{c}`"), kinds[f"u_{c}"], table.column(c).type, f"{table.name}.{c}").alias(f"u_{c}") for c in exprs))
        updates = scratch(made)
        return self._write(lambda s: dml.update(s, table.name, updates, list(exprs)))

    def _first_match(self, table: Table, found: DataFrame, source: list[Token], text: str, rewriter: Rewriter, where: list[Token]) -> DataFrame:
        names = [c for c in found.columns if c != RID]
        other = self.state.tables.get(source[0].text.lower()) if source and source[0].named else None
        if other is None:
            return found.groupBy(RID).agg(*(F.first(f"`{c}`").alias(c) for c in names))
        alias = source[-1].text if len(source) > 1 and source[-1].named else source[0].text
        hidden = Rewriter(lambda n: self._view_name(n, n.lower() in (table.name.lower(), other.name.lower())), rewriter.params, rewriter.columns)
        rewriter.params.next = 1
        tail = [Token("word", "FROM", 0), Token("word", table.name, 0), Token("op", ",", 0), *source] + ([Token("word", "WHERE", 0), *where] if where else [])
        df = self.spark.sql(text[:-1] + f", `{alias}`.`{RID}` AS _src " + hidden.sql(tail))
        best = df.groupBy(RID).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), "_src").alias("v"))
        return best.select(RID, *(F.col(f"v.`{c}`").alias(c) for c in names))

    def _do_delete(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        r.demand("FROM")
        table = self.state.table(r.name())
        if table.series:
            raise errors.Unsupported(f"{table.name} can't be written")
        where = r.rest() if r.accept("WHERE") else []
        r.end()
        rewriter = self._rewriter(params, columns, hidden=table.name.lower())
        tail = [Token("word", "FROM", 0), Token("word", table.name, 0)] + ([Token("word", "WHERE", 0), *where] if where else [])
        victims = self.spark.sql(f"SELECT `{table.name}`.`{RID}` " + rewriter.sql(tail))
        victims = scratch(victims) if self.state.children(table.name) else victims
        return self._write(lambda s: dml.delete(s, table.name, victims))

    def _write(self, step: Callable[[Snapshot], tuple[Snapshot, list[dml.Change], int]]) -> Result:
        self.state, changes, n = step(self.state)
        for change in changes:
            self._fire(change)
        return Result(changes=n)

    # Triggers

    def _fire(self, change: dml.Change) -> None:
        own = [t for t in self.state.triggers.values() if t.table.lower() == change.table.lower() and t.event == change.event]
        if not own:
            return
        if self._depth >= TRIGGER_DEPTH:
            raise errors.TriggerLimit(f"triggers nest over {TRIGGER_DEPTH} deep")
        frames = []
        for prefix, df in (("old", change.old), ("new", change.new)):
            if df is not None:
                frames.append(df.select(F.col(RID).alias(f"{prefix}{RID}"), *(F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns if c != RID)))
        delta = frames[0] if len(frames) == 1 else frames[0].join(frames[1], F.col(f"old{RID}") == F.col(f"new{RID}"))
        delta = scratch(delta)
        names = {c.lower(): c for c in delta.columns}
        self._depth += 1
        try:
            for trigger in own:
                self._body(trigger, delta, names)
        finally:
            self._depth -= 1

    def _body(self, trigger: Trigger, delta: DataFrame, names: dict[str, str]) -> None:
        def column(owner: str, name: str) -> str | None:
            if owner.lower() not in ("new", "old"):
                return None
            found = names.get(f"{owner.lower()}_{name.lower()}")
            if found is None:
                raise errors.InvalidSql(f"{owner}.{name} means nothing in a trigger on {trigger.event}")
            return f"`{found}`"

        if trigger.of:
            same = None
            for c in trigger.of:
                one = F.col(f"`{names['old_' + c.lower()]}`").eqNullSafe(F.col(f"`{names['new_' + c.lower()]}`"))
                same = one if same is None else same & one
            delta = delta.where(~same)
        if trigger.when:
            delta = delta.where(F.expr(self._rewriter(Params(), column).sql(tokenize(trigger.when))))
        for tokens in statements(tokenize(trigger.body)):
            uses = any(t.is_("NEW", "OLD") and k + 1 < len(tokens) and tokens[k + 1].op(".") for k, t in enumerate(tokens))
            values = [k for k, t in enumerate(tokens) if t.is_("VALUES")]
            if tokens[0].is_("INSERT", "REPLACE") and len(values) == 1 and not any(t.is_("SELECT") for t in tokens):
                # one insert of all rows' values
                k = values[0]
                r = Reader(tokens)
                r.i = k + 1
                rows = [r.inside()]
                if r.now is None:
                    made = self._rewriter(Params(), column)
                    parts = ", ".join(f"{made.sql(x)} AS v{i}" for i, x in enumerate(split(rows[0])))
                    view = self._temp(f"delta {uuid.uuid4().hex}", delta.orderBy(*(c for c in delta.columns if c.endswith(RID))))
                    head, df = tokens[:k], self.spark.sql(f"SELECT {parts} FROM {view}")
                    hold = self._temp(f"delta {uuid.uuid4().hex}", df)
                    old, self._view_name = self._view_name, lambda n, hidden=False, base=self._view_name, hold=hold: hold if n == "mr_delta" else base(n, hidden)
                    try:
                        self._run("", [*head, Token("word", "SELECT", 0), Token("op", "*", 0), Token("word", "FROM", 0), Token("word", "mr_delta", 0)], Params())
                    finally:
                        self._view_name = old
                    continue
            if uses and self._at_once(tokens, delta, column):
                continue
            # otherwise once for each row, whose values stand in as literals
            rows = delta.orderBy(*(c for c in delta.columns if c.endswith(RID))).limit(TRIGGER_ROWS + 1).collect() if uses else [None]
            if len(rows) > TRIGGER_ROWS:
                raise errors.TriggerLimit(f"{trigger.name} would run over {TRIGGER_ROWS} times")
            if not uses and delta.isEmpty():
                continue
            for row in rows:

                def value(owner: str, name: str, row=row) -> str | None:
                    known = column(owner, name)
                    return None if known is None else literal(row[known.strip("`")])

                self._run("", tokens, Params(), value)

    def _at_once(self, tokens: list[Token], delta: DataFrame, column: Callable) -> bool:
        """Run an UPDATE, DELETE or INSERT ... SELECT of a trigger for all rows by a join, where that is the same as once for
        each in turn; False: nothing was done, as the order may matter."""
        r = Reader(tokens)
        verb = "UPDATE" if r.accept("UPDATE") else "DELETE" if r.accept("DELETE", "FROM") else "INSERT" if r.accept("INSERT", "INTO") else None
        if verb is None or r.now is None or r.now.is_("OR"):
            return False
        table = self.state.tables.get(r.name().lower())
        if table is None or table.series or any(t.table.lower() == table.name.lower() and t.event == verb for t in self.state.triggers.values()):
            return False

        def outer(owner: str, name: str) -> str | None:
            known = column(owner, name)
            return None if known is None else f"mr_delta.{known}"

        order = [c for c in delta.columns if c.endswith(RID)]
        if verb == "INSERT":
            k = next((k for k, t in enumerate(tokens) if t.is_("SELECT")), None)
            # what it reads mustn't be what it writes, which a view or a foreign key to itself may hide
            read = {t.text.lower() for t in tokens[k or 0 :] if t.named}
            itself = any(f.parent.lower() == table.name.lower() for f in table.foreign)
            if k is None or itself or table.name.lower() in read or read & set(self.state.views) or any(t.is_("CONFLICT", "WITH") for t in tokens):
                return False
            view = self._temp(f"delta {uuid.uuid4().hex}", delta)
            # stored first: Spark takes no plan that numbers rows into a lateral subquery
            stored = {n: self._temp(f"delta {uuid.uuid4().hex}", scratch(self.state.tables[n].df.drop(RID))) for n in read & set(self.state.tables)}
            old, self._view_name = self._view_name, lambda n, hidden=False, base=self._view_name: stored.get(n.lower()) or base(n, hidden)
            try:
                made = self._rewriter(Params(), outer).sql(tokens[k:])
            finally:
                self._view_name = old
            try:
                df = self.spark.sql(f"SELECT mr_rows.* FROM {view} AS mr_delta, LATERAL ({made}) AS mr_rows ORDER BY {', '.join(f'mr_delta.`{c}`' for c in order)}")
                hold = self._temp(f"delta {uuid.uuid4().hex}", scratch(df))
            except AnalysisException:
                return False
            old, self._view_name = self._view_name, lambda n, hidden=False, base=self._view_name: hold if n == "mr_delta" else base(n, hidden)
            try:
                self._run("", [*tokens[:k], Token("word", "SELECT", 0), Token("op", "*", 0), Token("word", "FROM", 0), Token("word", "mr_delta", 0)], Params())
            finally:
                self._view_name = old
            return True

        if any(t.is_("SELECT") for t in tokens) or self.state.children(table.name):
            return False
        sets = {}
        if verb == "UPDATE":
            if not r.accept("SET"):
                return False
            sets = self._assignments(table, r.until("FROM", "WHERE"))
        where = r.rest() if r.accept("WHERE") else []
        if r.now is not None:
            return False
        changed = {c.lower() for c in sets}
        if changed & {c.lower() for k in table.keys for c in k.columns}:
            return False
        own = lambda k: not (k > 1 and where[k - 1].op(".") and where[k - 2].is_("NEW", "OLD"))
        if any(t.named and t.text.lower() in changed and own(k) for k, t in enumerate(where)):
            return False
        rewriter = self._rewriter(Params(), outer, hidden=table.name.lower())
        values = "".join(f", {rewriter.sql(t)} AS `u_{c}`" for c, t in sets.items())
        view = self._temp(f"delta {uuid.uuid4().hex}", delta)
        text = f"SELECT `{table.name}`.`{RID}`{values} " + rewriter.sql([Token("word", "FROM", 0), Token("word", table.name, 0)])
        try:
            found = self.spark.sql(f"{text} CROSS JOIN {view} AS mr_delta" + (" WHERE " + rewriter.sql(where) if where else ""))
        except AnalysisException:
            # such as a bare column of the table that is named like one of the changed rows'
            return False
        if verb == "DELETE":
            victims = scratch(found.distinct())
            self._write(lambda s: dml.delete(s, table.name, victims))
            return True
        found = scratch(found)
        if not found.groupBy(RID).count().where("count > 1").isEmpty():
            return False
        kinds = {f.name: f.dataType for f in found.schema}
        updates = scratch(found.select(RID, *(coerce(F.col(f"`u_{c}`"), kinds[f"u_{c}"], table.column(c).type, f"{table.name}.{c}").alias(f"u_{c}") for c in sets)))
        self._write(lambda s: dml.update(s, table.name, updates, list(sets)))
        return True

    # Schema

    def _do_create(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        if r.accept("VIRTUAL", "TABLE"):
            return self._create_series(r)
        unique = r.accept("UNIQUE")
        kind = r.one_of("TABLE", "INDEX", "VIEW", "TRIGGER")
        if kind is None or (unique and kind != "INDEX"):
            raise errors.InvalidSql("CREATE TABLE, INDEX, VIEW or TRIGGER expected")
        optional = r.if_not_exists()
        name = r.name()
        if kind == "TABLE":
            if optional and name.lower() in self.state.tables:
                return Result()
            self._create_table(name, r, params)
        elif kind == "INDEX":
            if optional and name.lower() in self.state.indexes:
                return Result()
            r.demand("ON")
            table, cols = r.name(), r.names()
            r.end()
            self._add_index(name, table, cols, unique)
        elif kind == "VIEW":
            if optional and name.lower() in self.state.views:
                return Result()
            r.demand("AS")
            self._add_view(name, sql[r.now.at : self._end(r)])
        else:
            if optional and name.lower() in self.state.triggers:
                return Result()
            self._create_trigger(name, r, sql)
        return Result()

    @staticmethod
    def _end(r: Reader) -> int:
        t = r.tokens[-1]
        return t.at + len(t.text) + (2 + t.text.count("'") if t.kind in ("string", "name") else 0)

    def _free(self, name: str) -> None:
        if error := self.state.taken(name):
            raise error(name)

    def _create_series(self, r: Reader) -> Result:
        optional = r.if_not_exists()
        name = r.name()
        if optional and name.lower() in self.state.tables:
            return Result()
        r.demand("USING")
        module = r.name()
        if module.lower() != "generate_series":
            raise errors.Unsupported(f"no module {module}")
        args = []
        for part in split(r.inside()):
            p = Reader(part)
            args.append(p.signed())
            p.end()
        if len(args) not in (2, 3):
            raise errors.InvalidSql("generate_series() takes a start, a stop and perhaps a step")
        start, stop, step = (*args, 1 if args[1] >= args[0] else -1)[:3]
        self._free(name)
        df = series(self.spark, start, stop, step)
        self.state = self.state.put_table(Table(name, (Column("value", "INTEGER", spark_type("INTEGER")),), df=df, series=(start, stop, step)))
        return Result()

    def _create_table(self, name: str, r: Reader, params: Params) -> None:
        self._free(name)
        if r.accept("AS"):
            df = scratch(self._select(r.rest(), params))
            cols = tuple(Column(f.name, declared_type(f.dataType), f.dataType) for f in df.schema)
            self.state = self.state.put_table(self._empty(name, cols, (), ()))
            self._write(lambda s: dml.insert(s, name, df.select(F.monotonically_increasing_id().alias(dml.ORD), "*")))
            return
        cols, keys, foreign, rules = [], [], [], []
        for part in split(r.inside()):
            p = Reader(part)
            if p.accept("CONSTRAINT"):
                p.name()
            if p.accept("PRIMARY", "KEY"):
                keys.append(Key(p.names(), True))
            elif p.now is not None and p.now.is_("UNIQUE"):
                p.accept("UNIQUE")
                keys.append(Key(p.names()))
            elif p.accept("FOREIGN", "KEY"):
                foreign.append(self._references(p.names(), p))
            elif p.accept("CHECK"):
                rules.append(self._rewriter(params).sql(p.inside()))
            else:
                cols.append(self._column(p, keys, foreign, params, rules))
            p.end()
        self._define(name, tuple(cols), tuple(keys), tuple(foreign), tuple(rules))

    def _column(self, p: Reader, keys: list[Key], foreign: list[ForeignKey], params: Params, rules: list[str]) -> Column:
        name, declared = p.name(), p.type()
        not_null, default = False, None
        while p.now is not None:
            if p.accept("PRIMARY", "KEY"):
                p.one_of("ASC", "DESC")
                keys.append(Key((name,), True))
            elif p.accept("NOT", "NULL"):
                not_null = True
            elif p.accept("NULL"):
                pass
            elif p.accept("UNIQUE"):
                keys.append(Key((name,)))
            elif p.accept("DEFAULT"):
                parts = p.inside() if p.now is not None and p.now.op("(") else [p.tokens[p.i + k] for k in range(2 if p.now is not None and p.now.op("-", "+") else 1) if p.i + k < len(p.tokens)]
                if not (p.i and p.tokens[p.i - 1].op(")")):
                    p.i += len(parts)
                default = self._rewriter(params).sql(parts)
            elif p.accept("CHECK"):
                rules.append(self._rewriter(params).sql(p.inside()))
            elif p.now.is_("REFERENCES"):
                foreign.append(self._references((name,), p))
            else:
                raise errors.InvalidSql(f"{p.now.text!r} in the definition of {name}")
        return Column(name, declared, spark_type(declared), not_null, default)

    @staticmethod
    def _references(columns: tuple[str, ...], p: Reader) -> ForeignKey:
        p.demand("REFERENCES")
        parent, own = p.name(), p.names()
        actions = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while p.accept("ON"):
            event = p.one_of("DELETE", "UPDATE")
            if event is None:
                raise errors.InvalidSql("ON DELETE or ON UPDATE expected")
            for action in (("CASCADE",), ("RESTRICT",), ("SET", "NULL"), ("SET", "DEFAULT"), ("NO", "ACTION")):
                if p.accept(*action):
                    actions[event] = " ".join(action)
                    break
            else:
                raise errors.InvalidSql("an action expected")
        return ForeignKey(columns, parent, own, actions["DELETE"], actions["UPDATE"])

    def _empty(self, name: str, cols: tuple[Column, ...], keys: tuple[Key, ...], foreign: tuple[ForeignKey, ...]) -> Table:
        table = Table(name, cols, keys, foreign)
        return replace(table, df=self.spark.createDataFrame([], table.schema))

    def _define(self, name: str, cols: tuple[Column, ...], keys: tuple[Key, ...], foreign: tuple[ForeignKey, ...], rules: tuple[str, ...] = ()) -> None:
        low = [c.name.lower() for c in cols]
        if not cols or len(set(low)) < len(low):
            raise errors.ColumnExists(f"{name} needs columns of different names")
        table = self._empty(name, cols, keys, foreign)
        fixed = lambda names: tuple(table.column(n).name for n in names)
        if sum(k.primary for k in keys) > 1:
            raise errors.InvalidSql(f"{name} has two primary keys")
        keys = tuple(replace(k, columns=fixed(k.columns)) for k in keys)
        for f in foreign:
            if len(f.columns) != len(f.parent_columns):
                raise errors.ColumnCountMismatch(f"the foreign key of {name}")
        foreign = tuple(replace(f, columns=fixed(f.columns)) for f in foreign)
        table.df.select(*(F.expr(c).cast("boolean") for c in rules))  # so that a rule that means nothing fails here
        self.state = self.state.put_table(replace(table, keys=keys, foreign=foreign, checks=rules))

    def _create_trigger(self, name: str, r: Reader, sql: str) -> None:
        if name.lower() in self.state.triggers:
            raise errors.TriggerExists(name)
        timing = r.one_of("AFTER", "BEFORE") or "AFTER"
        event = r.one_of("INSERT", "UPDATE", "DELETE")
        if event is None:
            raise errors.InvalidSql("INSERT, UPDATE or DELETE expected")
        of = ()
        if r.accept("OF"):
            of = [r.name()]
            while r.accept_op(","):
                of.append(r.name())
        r.demand("ON")
        table = self.state.table(r.name())
        r.accept("FOR", "EACH", "ROW")
        when = None
        if r.accept("WHEN"):
            at = r.now.at
            r.until("BEGIN")
            when = sql[at : r.now.at if r.now is not None else len(sql)]
        r.demand("BEGIN")
        start = r.now.at if r.now is not None else 0
        last = r.tokens[-1]
        if not last.is_("END"):
            raise errors.InvalidSql("a trigger ends with END")
        body = sql[start : last.at]
        if not statements(tokenize(body)):
            raise errors.InvalidSql("a trigger needs a statement")
        self.state = self.state.put("triggers", name, Trigger(name, table.name, timing, event, body, when, tuple(table.column(c).name for c in of)))

    def _do_drop(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        kind = r.one_of("TABLE", "INDEX", "VIEW", "TRIGGER")
        if kind is None:
            raise errors.InvalidSql("DROP TABLE, INDEX, VIEW or TRIGGER expected")
        optional = r.if_exists()
        name = r.name()
        r.end()
        known = getattr(self.state, {"TABLE": "tables", "INDEX": "indexes", "VIEW": "views", "TRIGGER": "triggers"}[kind])
        if name.lower() not in known and optional:
            return Result()
        {"TABLE": self._drop_table, "INDEX": self._drop_index, "VIEW": self._drop_view, "TRIGGER": self._drop_trigger}[kind](name)
        return Result()

    def _drop_table(self, name: str) -> None:
        table = self.state.table(name)
        state = self.state.put("tables", name, None)
        for i in [i for i in state.indexes.values() if i.table.lower() == table.name.lower()]:
            state = state.put("indexes", i.name, None)
        for t in [t for t in state.triggers.values() if t.table.lower() == table.name.lower()]:
            state = state.put("triggers", t.name, None)
        self.state = state

    def _drop_index(self, name: str) -> None:
        index = self.state.indexes.get(name.lower())
        if index is None:
            raise errors.UnknownIndex(name)
        table = self.state.table(index.table)
        keys = tuple(k for k in table.keys if (k.index or "").lower() != name.lower())
        self.state = self.state.put("indexes", name, None).put_table(replace(table, keys=keys))

    def _drop_view(self, name: str) -> None:
        if name.lower() not in self.state.views:
            raise errors.UnknownView(name)
        self.state = self.state.put("views", name, None)

    def _drop_trigger(self, name: str) -> None:
        if name.lower() not in self.state.triggers:
            raise errors.UnknownTrigger(name)
        self.state = self.state.put("triggers", name, None)

    def _add_index(self, name: str, table_name: str, cols: Sequence[str], unique: bool) -> None:
        self._free(name)
        table = self.state.table(table_name)
        own = tuple(table.column(c).name for c in cols)
        if unique:
            key = Key(own, False, name)
            checks.demand([(f"{table.name}({', '.join(own)}) is not unique", checks.repeated(table.df, key))])
            self.state = self.state.put_table(replace(table, keys=(*table.keys, key)))
        self.state = self.state.put("indexes", name, Index(name, table.name, own, unique))

    def _add_view(self, name: str, text: str) -> None:
        self._free(name)
        tokens = tokenize(text)
        if not is_query(tokens):
            raise errors.InvalidSql("a view is a query")
        self._with(tokens, Params(), None) if tokens[0].is_("WITH") else self._select(tokens, Params())
        self.state = self.state.put("views", name, View(name, text))

    def _do_alter(self, r: Reader, params: Params, sql: str, columns: Callable | None) -> Result:
        r.demand("TABLE")
        name = r.name()
        if r.accept("ADD"):
            r.accept("COLUMN")
            keys, foreign, rules = [], [], []
            column = self._column(r, keys, foreign, params, rules)
            self._alter_add(name, column, keys, foreign, rules)
        elif r.accept("RENAME", "TO"):
            self._alter_rename(name, r.name())
        elif r.accept("RENAME"):
            r.accept("COLUMN")
            old = r.name()
            r.demand("TO")
            self._alter_column(name, old, r.name())
        elif r.accept("DROP"):
            r.accept("COLUMN")
            self._alter_drop(name, r.name())
        else:
            raise errors.InvalidSql("ADD, RENAME or DROP expected")
        r.end()
        return Result()

    def _alter_add(self, name: str, column: Column, keys: Sequence[Key] = (), foreign: Sequence[ForeignKey] = (), rules: Sequence[str] = ()) -> None:
        table = self.state.table(name)
        if column.name.lower() in (n.lower() for n in table.names):
            raise errors.ColumnExists(f"{name}.{column.name}")
        value = F.expr(column.default).cast(column.type) if column.default else F.lit(None).cast(column.type)
        df = table.df.withColumn(column.name, value)
        new = replace(dml.settle(table, df), columns=(*table.columns, column), keys=(*table.keys, *keys), foreign=(*table.foreign, *foreign), checks=(*table.checks, *rules))
        state = self.state.put_table(new)
        checks.demand(checks.probes(state, new, df, None))
        self.state = state

    def _alter_rename(self, name: str, new: str) -> None:
        table = self.state.table(name)
        self._free(new)
        tables = {}
        for k, t in self.state.tables.items():
            own = replace(table, name=new) if k == name.lower() else t
            moved = tuple(replace(f, parent=new) if f.parent.lower() == name.lower() else f for f in own.foreign)
            tables[own.name.lower()] = replace(own, foreign=moved)
        same = lambda x: x.table.lower() == name.lower()
        indexes = {k: replace(i, table=new) if same(i) else i for k, i in self.state.indexes.items()}
        triggers = {k: replace(t, table=new) if same(t) else t for k, t in self.state.triggers.items()}
        self.state = replace(self.state, tables=tables, indexes=indexes, triggers=triggers)

    def _alter_column(self, name: str, old: str, new: str) -> None:
        table = self.state.table(name)
        old = table.column(old).name
        if new.lower() in (n.lower() for n in table.names) and new.lower() != old.lower():
            raise errors.ColumnExists(f"{name}.{new}")
        swap = lambda names: tuple(new if n.lower() == old.lower() else n for n in names)
        changed = replace(
            dml.settle(table, table.df.withColumnRenamed(old, new)),
            columns=tuple(replace(c, name=new) if c.name == old else c for c in table.columns),
            keys=tuple(replace(k, columns=swap(k.columns)) for k in table.keys),
            foreign=tuple(replace(f, columns=swap(f.columns)) for f in table.foreign),
            checks=tuple(re.sub(f"`{re.escape(old)}`", lambda _: f"`{new}`", c, flags=re.IGNORECASE) for c in table.checks),
        )
        state = self.state.put_table(changed)
        for child, _ in self.state.children(name):
            child = state.table(child.name)
            moved = tuple(replace(f, parent_columns=swap(f.parent_columns)) if f.parent.lower() == name.lower() else f for f in child.foreign)
            state = state.put_table(replace(child, foreign=moved))
        indexes = {k: replace(i, columns=swap(i.columns)) if i.table.lower() == name.lower() else i for k, i in state.indexes.items()}
        self.state = replace(state, indexes=indexes)

    def _alter_drop(self, name: str, column: str) -> None:
        table = self.state.table(name)
        column = table.column(column).name
        if len(table.columns) == 1:
            raise errors.ConstraintViolation(f"{column} is the last column of {name}")
        if any(f"`{column.lower()}`" in c.lower() for c in table.checks):
            raise errors.ConstraintViolation(f"a CHECK uses {name}.{column}")
        uses = [k.columns for k in table.keys] + [f.columns for f in table.foreign] + [f.parent_columns for _, f in self.state.children(name)] + [i.columns for i in self.state.indexes.values() if i.table.lower() == name.lower()]
        if any(column.lower() in (c.lower() for c in u) for u in uses):
            raise errors.ConstraintViolation(f"a key or index uses {name}.{column}")
        self.state = self.state.put_table(replace(dml.settle(table, table.df.drop(column)), columns=tuple(c for c in table.columns if c.name != column)))

    # Transactions

    def begin(self) -> None:
        if self._backup is not None:
            raise errors.TransactionActive("a transaction is open")
        self._backup = self.state

    begin_immediate = begin_exclusive = begin

    def commit(self) -> None:
        if self._backup is None:
            raise errors.NotInTransaction("no transaction is open")
        self._backup, self._savepoints = None, []
        self._persist()

    def rollback(self) -> None:
        if self._backup is None:
            raise errors.NotInTransaction("no transaction is open")
        self.state, self._backup, self._savepoints = self._backup, None, []

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    def savepoint(self, name: str) -> None:
        if self._backup is None:
            self.begin()
        self._savepoints.append((name.lower(), self.state))

    def _saved(self, name: str) -> int:
        for k in range(len(self._savepoints) - 1, -1, -1):
            if self._savepoints[k][0] == name.lower():
                return k
        raise errors.UnknownSavepoint(name)

    def release(self, name: str) -> None:
        del self._savepoints[self._saved(name) :]

    def rollback_to(self, name: str) -> None:
        k = self._saved(name)
        self.state = self._savepoints[k][1]
        del self._savepoints[k + 1 :]

    def _do_begin(self, r: Reader, *_: object) -> None:
        r.one_of("DEFERRED", "IMMEDIATE", "EXCLUSIVE")
        r.accept("TRANSACTION")
        r.end()
        self.begin()

    def _do_start(self, r: Reader, *_: object) -> None:
        r.demand("TRANSACTION")
        r.end()
        self.begin()

    def _do_commit(self, r: Reader, *_: object) -> None:
        r.accept("TRANSACTION")
        r.end()
        self.commit()

    _do_end = _do_commit

    def _do_rollback(self, r: Reader, *_: object) -> None:
        r.accept("TRANSACTION")
        if r.accept("TO"):
            r.accept("SAVEPOINT")
            self.rollback_to(r.name())
        else:
            r.end()
            self.rollback()

    def _do_savepoint(self, r: Reader, *_: object) -> None:
        self.savepoint(r.name())
        r.end()

    def _do_release(self, r: Reader, *_: object) -> None:
        r.accept("SAVEPOINT")
        self.release(r.name())
        r.end()

    # Settings

    def _do_pragma(self, r: Reader, *_: object) -> Result:
        name = r.name().lower()
        value = None
        if r.accept_op("=") or (r.now is not None and r.now.op("(")):
            value = (r.inside() if r.now is not None and r.now.op("(") else r.rest())[-1].text.lower()
        r.end()
        if name == "foreign_keys":
            if value is not None:
                if value not in ("on", "off", "1", "0", "true", "false"):
                    raise errors.InvalidSql(f"foreign_keys can't be {value}")
                self.state = replace(self.state, foreign_keys=value in ("on", "1", "true"))
            return self._setting(name, int(self.state.foreign_keys))
        if name in ("user_version", "application_id"):
            if value is not None:
                if not value.isdigit() or int(value) >= 2**32:
                    raise errors.InvalidSql(f"{name} can't be {value}")
                self.state = replace(self.state, **{name: int(value)})
            return self._setting(name, getattr(self.state, name))
        if name == "journal_mode":
            if value is not None:
                if value not in ("wal", "delete", "rollback"):
                    raise errors.InvalidSql(f"journal_mode can't be {value}")
                self.state = replace(self.state, journal_mode="wal" if value == "wal" else "delete")
            return self._setting(name, self.state.journal_mode)
        if name == "table_info" and value:
            table = self.state.table(value)
            primary = [c for k in table.keys if k.primary for c in k.columns]
            rows = [(i, c.name, c.declared, int(c.name in checks.not_null_columns(table)), c.default, primary.index(c.name) + 1 if c.name in primary else 0) for i, c in enumerate(table.columns)]
            return Result(self.spark.createDataFrame(rows, "cid long, name string, type string, notnull long, dflt_value string, pk long"))
        raise errors.Unsupported(f"PRAGMA {name}")

    def _setting(self, name: str, value: object) -> Result:
        kind = "string" if isinstance(value, str) else "long"
        return Result(self.spark.createDataFrame([(value,)], f"{name} {kind}"))

    # The typed API

    def load(self, name: str, df: DataFrame) -> None:
        """Make a table of a DataFrame, keyless, without copying it."""
        self._free(name)
        cols = tuple(Column(f.name, declared_type(f.dataType), f.dataType) for f in df.schema)
        table = Table(name, cols, df=df.select(F.monotonically_increasing_id().alias(RID), "*"), next_rid=1 << 62, parts=None)
        self.state = self.state.put_table(table)

    def from_(self, source: object) -> object:
        """A query over a typed table, or over a table by its name."""
        from .dsl import Query, RawQuery, TypedTable

        return Query(self, source) if isinstance(source, TypedTable) else RawQuery(self, source)

    def col(self, name: str) -> object:
        from .dsl import RawColumn

        return RawColumn(name)

    def table_exists(self, table: object) -> bool:
        return getattr(table, "name", table).lower() in self.state.tables

    def create_table(
        self,
        table: object,
        *,
        primary_key: object = None,
        unique: Sequence = (),
        composite_primary_key: Sequence = (),
        composite_unique: Sequence[Sequence] = (),
        foreign_keys: Sequence[tuple] = (),
        if_not_exists: bool = False,
    ) -> None:
        """The table of a dataclass. foreign_keys: (columns, parent, parent columns[, on delete[, on update]]); columns
        are names or the table's own columns, one or several."""
        if if_not_exists and self.table_exists(table):
            return
        names = lambda x: tuple(getattr(c, "name", c) for c in (x if isinstance(x, (list, tuple)) else (x,)))
        cols = tuple(Column(n, declared_type(host_type(h)), host_type(h), not host_field(h)[1] and primary_key is not None and names(primary_key) == (n,)) for n, h in row_fields(table.row).items())
        keys = [Key(names(primary_key), True)] if primary_key is not None else []
        keys += [Key(names(composite_primary_key), True)] if composite_primary_key else []
        keys += [Key(names(c)) for c in unique] + [Key(names(c)) for c in composite_unique]
        foreign = [ForeignKey(names(f[0]), getattr(f[1], "name", f[1]), names(f[2]), *(a.upper() for a in f[3:])) for f in foreign_keys]
        self._change(lambda: (self._free(table.name), self._define(table.name, cols, tuple(keys), tuple(foreign))))

    def _change(self, step: Callable[[], object]) -> None:
        before = self.state
        try:
            step()
        except Exception:
            self.state = before
            raise
        if self._backup is None:
            self._persist()

    def drop_table(self, table: object) -> None:
        self._change(lambda: self._drop_table(getattr(table, "name", table)))

    def create_index(self, table: object, name: str, columns: Sequence, unique: bool = False) -> None:
        self._change(lambda: self._add_index(name, getattr(table, "name", table), [getattr(c, "name", c) for c in columns], unique))

    def drop_index(self, name: str) -> None:
        self._change(lambda: self._drop_index(name))

    def create_view(self, name: str, sql: str) -> None:
        self._change(lambda: self._add_view(name, sql))

    def drop_view(self, name: str) -> None:
        self._change(lambda: self._drop_view(name))

    def drop_trigger(self, name: str) -> None:
        self._change(lambda: self._drop_trigger(name))

    def rename_table(self, table: object, new: str) -> None:
        self._change(lambda: self._alter_rename(getattr(table, "name", table), new))

    def truncate(self, table: object) -> None:
        """Remove all rows; neither foreign keys nor triggers have a say."""
        own = self.state.table(getattr(table, "name", table))
        self._change(lambda: setattr(self, "state", self.state.put_table(replace(own, df=self.spark.createDataFrame([], own.schema), parts=(), added=(), steps=0))))

    def add_column(self, table: object, name: str, kind: type) -> None:
        self._change(lambda: self._alter_add(getattr(table, "name", table), Column(name, declared_type(host_type(kind)), host_type(kind))))

    def rename_column(self, table: object, old: str, new: str) -> None:
        self._change(lambda: self._alter_column(getattr(table, "name", table), old, new))

    def drop_column(self, table: object, name: str) -> None:
        self._change(lambda: self._alter_drop(getattr(table, "name", table), name))

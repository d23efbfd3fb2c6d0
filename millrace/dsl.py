"""The query builders: typed ones over dataclasses, and raw ones over names. They make DataFrame plans, never SQL text."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import RID
from .database import Database, Result
from .errors import InvalidSql, TypeMismatch, UnknownColumn
from .functions import patterns, scalar
from .operators import dml
from .sources.store import scratch
from .types import coerce, host_field, row_fields

Condition = Callable[[DataFrame], Column]


def _fixed(value: Any) -> Any:
    return int(value) if isinstance(value, bool) else value


class RawColumn:
    """A column by name, with the predicates of the dialect. A condition is what they return; & | ~ combine conditions."""

    def __init__(self, name: str, table: str | None = None):
        self.name, self.table = name, table

    @property
    def column(self) -> Column:
        return F.col(f"`{self.table}`.`{self.name}`" if self.table else ".".join(f"`{p}`" for p in self.name.split(".")))

    def _value(self, value: Any) -> Column:
        return value.column if isinstance(value, RawColumn) else value if isinstance(value, Column) else F.lit(_fixed(value))

    def eq(self, value: Any) -> Column:
        return self.column == self._value(value)

    def ne(self, value: Any) -> Column:
        return self.column != self._value(value)

    def gt(self, value: Any) -> Column:
        return self.column > self._value(value)

    def ge(self, value: Any) -> Column:
        return self.column >= self._value(value)

    def lt(self, value: Any) -> Column:
        return self.column < self._value(value)

    def le(self, value: Any) -> Column:
        return self.column <= self._value(value)

    gte, lte = ge, le

    def like(self, pattern: str) -> Column:
        return patterns.like(self.column, pattern)

    def not_like(self, pattern: str) -> Column:
        return ~patterns.like(self.column, pattern)

    def glob(self, pattern: str) -> Column:
        return patterns.glob(self.column, pattern)

    def not_glob(self, pattern: str) -> Column:
        return ~patterns.glob(self.column, pattern)

    def contains(self, part: str) -> Column:
        return patterns.contains(self.column, part)

    def not_contains(self, part: str) -> Column:
        return ~patterns.contains(self.column, part)

    def starts_with(self, part: str) -> Column:
        return patterns.starts_with(self.column, part)

    def ends_with(self, part: str) -> Column:
        return patterns.ends_with(self.column, part)

    def is_null(self) -> Column:
        return self.column.isNull()

    def is_not_null(self) -> Column:
        return self.column.isNotNull()

    def is_(self, value: Any) -> Column:
        return self.column.eqNullSafe(self._value(value))

    def is_not(self, value: Any) -> Column:
        return ~self.is_(value)

    is_value, is_not_value, is_distinct_from, is_not_distinct_from = is_, is_not, is_not, is_

    def between(self, low: Any, high: Any) -> Column:
        return self.column.between(self._value(low), self._value(high))

    def not_between(self, low: Any, high: Any) -> Column:
        return ~self.between(low, high)

    def asc(self) -> Column:
        return self.column.asc_nulls_first()

    def desc(self) -> Column:
        return self.column.desc_nulls_last()


class _Columns:
    def __init__(self, table: TypedTable):
        self._table = table

    def __getattr__(self, name: str) -> RawColumn:
        return self._table.column(name)


class TypedTable:
    """A table by name with a dataclass for its rows."""

    def __init__(self, name: str, row: type):
        self.name, self.row = name, row
        self.fields = row_fields(row)
        self.c = _Columns(self)

    def column(self, name: str) -> RawColumn:
        if name not in self.fields:
            raise UnknownColumn(f"{self.name}.{name}")
        return RawColumn(name)

    key = columns = column

    def column_names(self) -> list[str]:
        return list(self.fields)


def _name(field: Any) -> str:
    return field.name if isinstance(field, RawColumn) else field


_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_FUNCTIONS: dict[str, Callable] = {
    "lower": scalar.lower,
    "upper": scalar.upper,
    "trim": scalar.trim,
    "ltrim": scalar.ltrim,
    "rtrim": scalar.rtrim,
    "length": scalar.length,
    "abs": F.abs,
    "round": scalar.round_,
    "typeof": scalar.typeof,
    "instr": scalar.instr,
    "json_extract": scalar.json_extract,
    "substr": scalar.substr,
}


def _operator(op: str) -> Callable[[Column, Any], Column]:
    if op not in _OPERATORS:
        raise InvalidSql(f"no operator {op}")
    return _OPERATORS[op]


@dataclasses.dataclass(frozen=True)
class _Plan:
    """What a builder has gathered; the plan is made when it is asked for."""

    projection: tuple = ()
    conditions: tuple = ()
    steps: tuple = ()  # semi and anti joins
    join: tuple = ()
    group: tuple = ()
    aggregates: tuple = ()
    having: tuple = ()
    order: tuple = ()
    amount: int | None = None
    skip: int = 0
    unique: bool = False


class _Builder:
    def __init__(self, db: Database, source: Any, plan: _Plan | None = None):
        self._db, self._source, self._plan = db, source, plan or _Plan()

    @property
    def _table(self) -> str:
        return getattr(self._source, "name", self._source)

    def _with(self, **changes: Any):
        return type(self)(self._db, self._source, dataclasses.replace(self._plan, **changes))

    def _check(self, field: Any) -> str:
        name = _name(field)
        if isinstance(self._source, TypedTable):
            self._source.column(name)
        return name

    def _frame(self, name: str) -> DataFrame:
        low = name.lower()
        if low in self._db.state.views:
            return self._db.query(f'SELECT * FROM "{name}"')
        return self._db.table_df(name)

    # Projection

    def _project(self, *columns: Column):
        return self._with(projection=(*self._plan.projection, *columns))

    def select(self, *columns: Any):
        """Columns, names, or expressions of Spark SQL; they replace the projection."""
        made = [c.column if isinstance(c, RawColumn) else F.expr(c) if isinstance(c, str) else c for c in columns]
        return self._with(projection=tuple(made))

    def select_all(self):
        return self._with(projection=())

    def distinct(self):
        return self._with(unique=True)

    # Filters

    def where(self, condition: Column):
        """Replaces the conditions so far."""
        return self._with(conditions=(condition,))

    def and_where(self, condition: Column):
        return self._with(conditions=(*self._plan.conditions, condition))

    # Order and page

    def order_by(self, *order: Any, descending: bool = False):
        made = [o if isinstance(o, Column) else RawColumn(_name(o)).desc() if descending else RawColumn(_name(o)).asc() for o in order]
        return self._with(order=tuple(made))

    def limit(self, amount: int):
        return self._with(amount=amount)

    def offset(self, amount: int):
        return self._with(skip=amount)

    # Groups

    def group_by(self, *fields: Any):
        return self._with(group=tuple(self._check(f) for f in fields))

    def having_count(self, op: str, amount: int):
        _operator(op)
        return self._with(having=(op, amount))

    def _aggregate(self, column: Column, name: str):
        return self._with(aggregates=(*self._plan.aggregates, column.alias(name)))

    def count(self, field: Any = None):
        return self._aggregate(F.count("*"), "count(*)") if field is None else self._aggregate(F.count(F.col(f"`{self._check(field)}`")), f"count({_name(field)})")

    # Joins

    def _join(self, other: Any, left: Any, right: Any, how: str):
        return self._with(join=(getattr(other, "name", other), _name(left) if left is not None else None, _name(right) if right is not None else None, how))

    def inner_join(self, other: Any, left: Any, right: Any):
        return self._join(other, left, right, "inner")

    def left_join(self, other: Any, left: Any, right: Any):
        return self._join(other, left, right, "left")

    def right_join(self, other: Any, left: Any, right: Any):
        return self._join(other, left, right, "right")

    def full_join(self, other: Any, left: Any, right: Any):
        return self._join(other, left, right, "full")

    def cross_join(self, other: Any):
        return self._join(other, None, None, "cross")

    inner_join_keys, left_join_keys, right_join_keys, full_join_keys = inner_join, left_join, right_join, full_join

    # Execution

    def to_df(self) -> DataFrame:
        p, df = self._plan, self._frame(self._table).alias(self._table)
        for step in p.steps:
            df = step(df).alias(self._table)
        left_names = df.columns
        if p.join:
            name, left, right, how = p.join
            other = self._frame(name).alias(name)
            last = lambda x: x.split(".")[-1]
            on = None if how == "cross" else F.col(f"`{self._table}`.`{last(left)}`") == F.col(f"`{name}`.`{last(right)}`")
            df = df.crossJoin(other) if on is None else df.join(other, on, how)
        for condition in p.conditions:
            df = df.where(condition)
        keys = [F.col(f"`{g}`") for g in p.group]
        if p.group or p.aggregates:
            made = list(p.aggregates)
            if p.having:
                made.append(F.count("*").alias("_having"))
            df = df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
            if p.having:
                df = df.where(_operator(p.having[0])(F.col("_having"), p.having[1])).drop("_having")
        if p.order and not p.unique:
            df = df.orderBy(*p.order)
        if not (p.group or p.aggregates):
            if p.projection:
                df = df.select(*p.projection)
            elif p.join:
                both = [F.col(f"`{self._table}`.`{c}`") for c in left_names]
                seen = {c.lower() for c in left_names}
                for c in self._frame(p.join[0]).columns:
                    both.append(F.col(f"`{p.join[0]}`.`{c}`").alias(c if c.lower() not in seen else f"{p.join[0]}.{c}"))
                df = df.select(*both)
        if p.unique:
            df = df.distinct()
            df = df.orderBy(*p.order) if p.order else df
        if p.skip:
            df = df.offset(p.skip)
        return df.limit(p.amount) if p.amount is not None else df

    def fetch_all(self) -> Result:
        return Result(self.to_df())

    def row_count(self) -> int:
        return self.to_df().count()


class RawQuery(_Builder):
    """A query over a table by its name; the names in it are looked up when it runs."""

    def __init__(self, db: Database, source: str, plan: _Plan | None = None):
        super().__init__(db, source, plan)
        if plan is None and source.lower() not in db.state.views:
            db.state.table(source)

    def col(self, name: str) -> RawColumn:
        return RawColumn(name)


class Query(_Builder):
    """A query over a typed table; fields are checked when they are named."""

    # Projection

    def select_fields(self, fields: Sequence[Any]):
        return self._with(projection=tuple(F.col(f"`{self._check(f)}`") for f in fields))

    select_field_names = select_columns = select_typed = select_fields

    def _scalar(self, name: str, field: Any, *args: Any, alias: str | None = None):
        own = self._check(field)
        return self._project(_FUNCTIONS[name](F.col(f"`{own}`"), *args).alias(alias or name))

    def lower_column(self, field: Any):
        return self._scalar("lower", field)

    def upper_column(self, field: Any):
        return self._scalar("upper", field)

    def trim_column(self, field: Any):
        return self._scalar("trim", field)

    def ltrim_column(self, field: Any):
        return self._scalar("ltrim", field)

    def rtrim_column(self, field: Any):
        return self._scalar("rtrim", field)

    def length_column(self, field: Any):
        return self._scalar("length", field)

    def abs_column(self, field: Any):
        return self._scalar("abs", field)

    def round_column(self, field: Any, digits: int | None = None):
        return self._scalar("round", field, digits)

    def typeof_column(self, field: Any):
        return self._scalar("typeof", field)

    def instr_column(self, field: Any, part: str):
        return self._scalar("instr", field, part)

    def substr_column(self, field: Any, start: int, length: int | None = None):
        return self._scalar("substr", field, start, length)

    def replace_column(self, field: Any, search: str, replacement: str):
        return self._project(F.replace(F.col(f"`{self._check(field)}`"), F.lit(search), F.lit(replacement)).alias("replace"))

    def cast_column(self, field: Any, target: str):
        return self._project(scalar.cast_(F.col(f"`{self._check(field)}`"), target).alias("cast"))

    def json_extract_column(self, field: Any, path: str):
        return self._scalar("json_extract", field, path)

    def json_set_column(self, field: Any, path: str, value: str):
        text = scalar.render("json_set", [f"`{self._check(field)}`", scalar.quote(path), scalar.quote(value)])
        return self._project(F.expr(text).alias("json_set"))

    def coalesce_column(self, field: Any, fallback: Any):
        return self._project(F.coalesce(F.col(f"`{self._check(field)}`"), F.lit(_fixed(fallback))).alias("coalesce"))

    def if_null_column(self, field: Any, fallback: Any):
        return self._project(F.coalesce(F.col(f"`{self._check(field)}`"), F.lit(_fixed(fallback))).alias("ifnull"))

    # Filters

    def where_function(self, function: str, field: Any, op: str, value: Any):
        return self._where_call(function, field, (), op, value)

    def where_function2(self, function: str, field: Any, argument: Any, op: str, value: Any):
        return self._where_call(function, field, (argument,), op, value)

    def _where_call(self, function: str, field: Any, args: tuple, op: str, value: Any):
        call = _FUNCTIONS.get(function.lower())
        if call is None:
            raise InvalidSql(f"no function {function}")
        return self.and_where(_operator(op)(call(F.col(f"`{self._check(field)}`"), *args), _fixed(value)))

    def where_lower(self, field: Any, value: str):
        return self.where_function("lower", field, "=", value)

    def where_upper(self, field: Any, value: str):
        return self.where_function("upper", field, "=", value)

    def where_trim(self, field: Any, value: str):
        return self.where_function("trim", field, "=", value)

    def where_json_extract(self, field: Any, path: str, op: str, value: Any):
        return self.where_function2("json_extract", field, path, op, value)

    def _membership(self, field: Any, other: Any, other_field: Any, how: str):
        own = self._check(field)

        def step(df: DataFrame) -> DataFrame:
            keys = self._frame(getattr(other, "name", other)).select(F.col(f"`{_name(other_field)}`").alias("_member"))
            return df.join(keys, F.col(f"`{own}`") == F.col("_member"), how)

        return self._with(steps=(*self._plan.steps, step))

    def where_in_column(self, field: Any, other: Any, other_field: Any):
        return self._membership(field, other, other_field, "left_semi")

    def where_not_in_column(self, field: Any, other: Any, other_field: Any):
        return self._membership(field, other, other_field, "left_anti")

    def where_in_values(self, field: Any, values: Sequence):
        return self.and_where(F.col(f"`{self._check(field)}`").isin([_fixed(v) for v in values]))

    def where_not_in_values(self, field: Any, values: Sequence):
        return self.and_where(scalar.not_in(F.col(f"`{self._check(field)}`"), [_fixed(v) for v in values]))

    def _exists(self, other: Any, how: str):
        def step(df: DataFrame) -> DataFrame:
            one = self._frame(getattr(other, "name", other)).limit(1).select(F.lit(True).alias("_any"))
            return df.join(F.broadcast(one), F.col("_any"), how)  # one row at most

        return self._with(steps=(*self._plan.steps, step))

    def where_exists(self, other: Any):
        return self._exists(other, "left_semi")

    def where_not_exists(self, other: Any):
        return self._exists(other, "left_anti")

    def where_exists_key(self, other: Any, other_field: Any, field: Any):
        return self._membership(field, other, other_field, "left_semi")

    def where_not_exists_key(self, other: Any, other_field: Any, field: Any):
        return self._membership(field, other, other_field, "left_anti")

    # Aggregates

    group_by_column = _Builder.group_by
    count_field = count_column = _Builder.count

    def sum(self, field: Any):
        return self._aggregate(F.sum(F.col(f"`{self._check(field)}`")), f"sum({_name(field)})")

    def average(self, field: Any):
        return self._aggregate(F.avg(F.col(f"`{self._check(field)}`")), f"avg({_name(field)})")

    def minimum(self, field: Any):
        return self._aggregate(F.min(F.col(f"`{self._check(field)}`")), f"min({_name(field)})")

    def maximum(self, field: Any):
        return self._aggregate(F.max(F.col(f"`{self._check(field)}`")), f"max({_name(field)})")

    sum_column, average_column, minimum_column, maximum_column = sum, average, minimum, maximum

    # Writing

    def _values(self, row: Any) -> dict[str, Any]:
        values = dataclasses.asdict(row) if dataclasses.is_dataclass(row) else dict(row)
        for k in values:
            self._check(k)
        return {k: _fixed(v) for k, v in values.items()}

    def _insert(self, row: Any, mode: str) -> Result:
        rows = [self._values(r) for r in (row if isinstance(row, (list, tuple)) else [row])]
        names = list(rows[0])
        table = self._db.state.table(self._table)
        kinds = ", ".join(f"`{n}` {table.column(n).type.simpleString()}" for n in names)
        df = self._db.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)
        out = None

        def write() -> None:
            nonlocal out
            incoming = self._db._incoming(table, names, df)
            out = self._db._write(lambda s: dml.insert(s, self._table, incoming, mode))

        self._db._change(write)
        return out

    def insert(self, row: Any) -> Result:
        """A dict or dataclass instance, or a list of them."""
        return self._insert(row, "abort")

    insert_typed = insert

    def insert_ignore(self, row: Any) -> Result:
        return self._insert(row, "ignore")

    def insert_replace(self, row: Any) -> Result:
        return self._insert(row, "replace")

    def update(self, row: Any) -> Mutation:
        """Values, or Spark expressions over the old row, by field."""
        values = dataclasses.asdict(row) if dataclasses.is_dataclass(row) else dict(row)
        for k in values:
            self._check(k)
        return Mutation(self._db, self._table, values, self._plan.conditions)

    update_typed = update

    def delete(self) -> Mutation:
        return Mutation(self._db, self._table, None, self._plan.conditions)

    # Typed reads

    def fetch_typed(self) -> list:
        return [self._typed(r.asDict()) for r in self.to_df().collect()]

    def fetch_one_typed(self) -> Any:
        row = self.limit(1).to_df().first()
        return None if row is None else self._typed(row.asDict())

    def _typed(self, row: dict) -> Any:
        out = {}
        for name, hint in self._source.fields.items():
            plain, optional = host_field(hint)
            if name not in row:
                raise TypeMismatch(f"{self._table}.{name} isn't selected")
            value = row[name]
            if value is None:
                if not optional:
                    raise TypeMismatch(f"{self._table}.{name} is null")
            elif plain is bool:
                value = value != 0
            elif plain is float and isinstance(value, int):
                value = float(value)
            elif plain is bytes:
                value = bytes(value)
            elif not isinstance(value, plain):
                raise TypeMismatch(f"{self._table}.{name} holds {type(value).__name__}")
            out[name] = value
        return self._source.row(**out)


class Mutation:
    """An update or delete, with its conditions; execute() runs it."""

    def __init__(self, db: Database, table: str, values: dict[str, Any] | None, conditions: tuple = ()):
        self._db, self._table, self._values, self._conditions = db, table, values, conditions

    def where(self, condition: Column) -> Mutation:
        return Mutation(self._db, self._table, self._values, (condition,))

    def and_where(self, condition: Column) -> Mutation:
        return Mutation(self._db, self._table, self._values, (*self._conditions, condition))

    def execute(self) -> Result:
        table = self._db.state.table(self._table)
        df, out = table.df, None
        for c in self._conditions:
            df = df.where(c)
        if self._values is not None:
            made = df.select(RID, *((v if isinstance(v, Column) else F.lit(_fixed(v))).alias(f"u_{k}") for k, v in self._values.items()))
            made = made.select(RID, *(coerce(F.col(f"`u_{k}`"), made.schema[f"u_{k}"].dataType, table.column(k).type, k).alias(f"u_{k}") for k in self._values))
            rows = scratch(made)
        else:
            rows = scratch(df.select(RID))

        def write() -> None:
            nonlocal out
            if self._values is not None:
                out = self._db._write(lambda s: dml.update(s, self._table, rows, list(self._values)))
            else:
                out = self._db._write(lambda s: dml.delete(s, self._table, rows))

        self._db._change(write)
        return out

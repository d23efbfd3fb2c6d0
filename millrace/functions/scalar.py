"""The dialect's scalar functions, as SQL that Spark runs and as functions of columns. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSql
from .patterns import SPACES, lower, lower_sql, upper, upper_sql


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c, c) for c in text) + "'"


_WS = quote(SPACES)


def _cast(x: str, target: str) -> str:
    name = target.strip().upper()
    if name in ("INTEGER", "INT", "BIGINT"):
        return f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(try_cast({x} AS BIGINT), 0L) END)"
    if name in ("REAL", "FLOAT", "DOUBLE"):
        return f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(try_cast({x} AS DOUBLE), 0.0D) END)"
    if name in ("TEXT", "VARCHAR", "CHAR"):
        return f"CAST({x} AS STRING)"
    if name == "BLOB":
        return f"CAST(CAST({x} AS STRING) AS BINARY)"
    return f"CAST({x} AS {name})"


def _typeof(x: str) -> str:
    return (
        f"(CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' "
        f"WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END)"
    )


def _json_set(j: str, path: str, value: str) -> str:
    """Set one top-level key to a text value: in place where the key exists, else as the last."""
    key = re.fullmatch(r"'\$\.(\w+)'", path)
    if not key:
        raise InvalidSql("json_set() takes a literal path to a top-level key")
    name = key[1]
    found = quote('("' + name + r'"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}\]]+)')
    quoted = rf"concat('\"', replace(replace({value}, '\\', '\\\\'), '\"', '\\\"'), '\"')"
    safe = rf"regexp_replace({quoted}, '([\\\\$])', '\\\\$1')"
    added = f"concat(regexp_replace({j}, '\\\\s*\\\\}}\\\\s*$', ''), CASE WHEN {j} RLIKE '^\\\\s*\\\\{{\\\\s*\\\\}}\\\\s*$' THEN '' ELSE ',' END, {quote(chr(34) + name + chr(34) + ':')}, {quoted}, '}}')"
    return f"(CASE WHEN array_contains(json_object_keys({j}), {quote(name)}) THEN regexp_replace({j}, {found}, concat('$1', {safe})) WHEN json_object_keys({j}) IS NOT NULL THEN {added} END)"


#: What each function becomes, by its number of arguments.
def _datetime(x: str) -> str:
    """Date and time as text; 'now' is the moment in UTC, and what is no date or time gives null."""
    form = "'yyyy-MM-dd HH:mm:ss'"
    now = f"date_format(to_utc_timestamp(current_timestamp(), current_timezone()), {form})"
    return f"CASE WHEN lower({x}) = 'now' THEN {now} ELSE date_format(try_cast({x} AS timestamp_ntz), {form}) END"


SQL = {
    ("length", 1): lambda x: f"CAST(octet_length({x}) AS BIGINT)",
    ("lower", 1): lower_sql,
    ("upper", 1): upper_sql,
    ("trim", 1): lambda x: f"trim(BOTH {_WS} FROM {x})",
    ("ltrim", 1): lambda x: f"trim(LEADING {_WS} FROM {x})",
    ("rtrim", 1): lambda x: f"trim(TRAILING {_WS} FROM {x})",
    ("trim", 2): lambda x, c: f"trim(BOTH {c} FROM {x})",
    ("ltrim", 2): lambda x, c: f"trim(LEADING {c} FROM {x})",
    ("rtrim", 2): lambda x, c: f"trim(TRAILING {c} FROM {x})",
    ("substr", 2): lambda x, i: f"substr({x}, greatest({i}, 1))",
    ("substr", 3): lambda x, i, n: f"substr({x}, greatest({i}, 1), greatest({n}, 0))",
    ("instr", 2): lambda x, y: f"CAST(instr({x}, {y}) AS BIGINT)",
    ("round", 2): lambda x, n: f"round(CAST({x} AS DOUBLE), {n})",
    ("ifnull", 2): lambda x, y: f"coalesce({x}, {y})",
    ("average", 1): lambda x: f"avg({x})",
    ("typeof", 1): _typeof,
    ("datetime", 1): _datetime,
    ("json_extract", 2): lambda j, p: f"get_json_object({j}, {p})",
    ("json_set", 3): _json_set,
}


def render(name: str, args: list[str]) -> str:
    """A call in Spark SQL; functions that Spark has itself stay as they are."""
    known = SQL.get((name.lower(), len(args)))
    return known(*args) if known else f"{name}({', '.join(args)})"


def cast(x: str, target: str) -> str:
    return _cast(x, target)


# The same on columns.


def length(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def ltrim(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES))


def rtrim(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def substr(x: Column, start: int, n: int | None = None) -> Column:
    return F.substr(x, F.lit(max(start, 1)), *(() if n is None else (F.lit(max(n, 0)),)))


def instr(x: Column, part: str) -> Column:
    return F.instr(x, part).cast("long")


def round_(x: Column, digits: int | None = None) -> Column:
    return F.round(x) if digits is None else F.round(x.cast("double"), digits)


def cast_(x: Column, target: str) -> Column:
    name = target.upper()
    if name in ("INTEGER", "INT", "BIGINT"):
        return F.when(x.isNotNull(), F.coalesce(x.try_cast("bigint"), F.lit(0)))
    if name in ("REAL", "FLOAT", "DOUBLE"):
        return F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return x.cast("string" if name == "TEXT" else "binary" if name == "BLOB" else name.lower())


def typeof(x: Column) -> Column:
    kind = F.typeof(x)
    return (
        F.when(x.isNull(), "null")
        .when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer")
        .when(kind.isin("float", "double") | kind.startswith("decimal"), "real")
        .when(kind == "binary", "blob")
        .otherwise("text")
    )


def json_extract(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def not_in(x: Column, values: list) -> Column:
    """NOT IN as the dialect has it: nulls in the list are passed over, and a null on the left passes."""
    some = [v for v in values if v is not None]
    return F.coalesce(~x.isin(some), F.lit(True)) if some else F.lit(True)


__all__ = ["SQL", "cast", "cast_", "instr", "json_extract", "length", "lower", "ltrim", "not_in", "quote", "render", "round_", "rtrim", "substr", "trim", "typeof", "upper"]

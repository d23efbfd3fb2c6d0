"""Declared column types: affinities, Spark types, and coercion on write."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TypeMismatch

INTEGER, TEXT, REAL, BLOB, NUMERIC = "integer", "text", "real", "blob", "numeric"


def affinity(declared: str) -> str:
    """The affinity that a declared type has, by the parts of its name in this order."""
    name = declared.upper()
    for kind, parts in ((INTEGER, ("INT",)), (TEXT, ("CHAR", "CLOB", "TEXT")), (REAL, ("REAL", "FLOA", "DOUB")), (BLOB, ("BLOB",))):
        if any(p in name for p in parts):
            return kind
    return NUMERIC


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared column. DATE, TIMESTAMP, BOOLEAN and DECIMAL(p, s) keep their own types."""
    name = declared.strip().upper()
    own = {"DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType()}
    if name in own:
        return own[name]
    if name.startswith("DECIMAL(") or name.startswith("NUMERIC("):
        p, _, s = name[name.index("(") + 1 : -1].partition(",")
        return T.DecimalType(int(p), int(s or 0))
    return {INTEGER: T.LongType(), TEXT: T.StringType(), REAL: T.DoubleType(), BLOB: T.BinaryType(), NUMERIC: T.DoubleType()}[affinity(name)]


def declared_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, T.StringType):
        return "TEXT"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "REAL"
    if isinstance(kind, T.BinaryType):
        return "BLOB"
    return kind.simpleString().upper()


def type_name(kind: T.DataType) -> str:
    """What typeof() says of a value of this type that isn't null."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return INTEGER
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return REAL
    return BLOB if isinstance(kind, T.BinaryType) else "null" if isinstance(kind, T.NullType) else TEXT


def coerce(value: Column, found: T.DataType, wanted: T.DataType, name: str) -> Column:
    """value as the column's type, if nothing gets lost; a value that doesn't fit raises when the row is written."""
    if found == wanted or isinstance(found, T.NullType):
        return value.cast(wanted)
    if isinstance(found, T.BooleanType) and isinstance(wanted, T.NumericType):
        return value.cast("int").cast(wanted)
    if isinstance(wanted, T.LongType) and isinstance(found, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = value.cast("double") == F.floor(value.cast("double"))
        return F.when(value.isNull(), F.lit(None).cast(wanted)).when(whole, value.cast(wanted)).otherwise(F.raise_error(F.lit(f"TypeMismatch: {name}")).cast(wanted))
    if isinstance(found, T.BinaryType) != isinstance(wanted, T.BinaryType) and isinstance(found, T.NumericType):
        raise TypeMismatch(f"{name} can't hold {found.simpleString()}")
    return value.cast(wanted)


_HOST = {int: T.LongType(), bool: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}


def host_field(hint: object) -> tuple[type, bool]:
    """The plain type of a dataclass field's annotation, and whether it takes None."""
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(inner) != 1:
            raise TypeMismatch(f"no column type for {hint}")
        return inner[0], True
    return hint, False


def host_type(hint: object) -> T.DataType:
    plain, _ = host_field(hint)
    if plain not in _HOST:
        raise TypeMismatch(f"no column type for {hint}")
    return _HOST[plain]


def row_fields(row: type) -> dict[str, object]:
    if not dataclasses.is_dataclass(row):
        raise TypeMismatch(f"{row} is not a dataclass")
    hints = typing.get_type_hints(row)
    return {f.name: hints[f.name] for f in dataclasses.fields(row)}

"""An embedded SQL dialect, its tables and its query builders, on Spark."""

from .database import Database, Prepared, Result
from .dsl import Query, RawQuery, TypedTable
from .migrate import Migration, Migrator

__all__ = ["Database", "Migration", "Migrator", "Prepared", "Query", "RawQuery", "Result", "TypedTable"]

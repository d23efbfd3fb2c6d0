"""Errors of the engine; each names what was wrong, and all are DatabaseError."""

from __future__ import annotations


class DatabaseError(Exception):
    """Any error that the engine raises itself."""


class InvalidSql(DatabaseError):
    """The statement can't be parsed, or an argument makes no sense."""


class UnexpectedToken(InvalidSql):
    """Another word or sign belongs where this one stands."""


class Unsupported(DatabaseError):
    """The statement is understood but not offered."""


class InvalidParameter(DatabaseError):
    """A parameter has no value, or a number below 1."""


class UnknownTable(DatabaseError):
    pass


class UnknownColumn(DatabaseError):
    pass


class UnknownIndex(DatabaseError):
    pass


class UnknownView(DatabaseError):
    pass


class UnknownTrigger(DatabaseError):
    pass


class UnknownSavepoint(DatabaseError):
    pass


class TableExists(DatabaseError):
    pass


class IndexExists(DatabaseError):
    pass


class ViewExists(DatabaseError):
    pass


class TriggerExists(DatabaseError):
    pass


class ColumnExists(DatabaseError):
    pass


class ColumnCountMismatch(DatabaseError):
    pass


class ConstraintViolation(DatabaseError):
    """A key, NOT NULL or foreign key would be broken."""


class TypeMismatch(DatabaseError):
    """A value doesn't fit the column or field that it is to go into."""


class TransactionActive(DatabaseError):
    pass


class NotInTransaction(DatabaseError):
    pass


class RecursiveCteLimit(DatabaseError):
    pass


class TriggerLimit(DatabaseError):
    pass


class VirtualTableTooLarge(DatabaseError):
    pass


class Corrupt(DatabaseError):
    """A stored database can't be read."""


class InvalidHeader(Corrupt):
    """A file is no database."""


class InvalidRecord(Corrupt):
    """A value of a file doesn't fit its column."""

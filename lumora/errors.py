"""Errors that the engine raises by name, so that a caller can tell a rejected query from a failed one."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all."""


class QueryError(EngineError):
    pass


class SqlParse(QueryError):
    """The text is not SQL."""


class SqlUnsupported(QueryError):
    """SQL outside of the dialect."""


class SqlUnknownColumn(QueryError):
    pass


class SqlAmbiguousColumn(QueryError):
    pass


class SqlInvalidLimitOffset(QueryError):
    """A LIMIT, OFFSET or ordinal that is no integer in range."""


class AggregateProjectionEmpty(QueryError):
    pass


class NonAggregateRequiresGroupBy(QueryError):
    pass


class NonAggregateMustAppearInGroupBy(QueryError):
    pass


class AggregateRequiresGroupByOrFunctions(QueryError):
    pass


class AggregateExprOnlyColOrLit(QueryError):
    pass


class JoinError(EngineError):
    pass


class MissingJoinCondition(JoinError):
    pass


class UnsupportedJoinKeyType(JoinError):
    pass


class UnsupportedJoinStrategy(JoinError):
    pass


class InvalidOrderByColumn(JoinError):
    pass


class InvalidColumnIndex(EngineError):
    def __init__(self, column: int, count: int):
        super().__init__(f"column {column} of {count}")
        self.column, self.count = column, count


class TypeMismatch(EngineError):
    pass


class SchemaMismatch(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class RowDecode(EngineError):
    """A row that can't be read as what was asked for; rowid: its number, where the table has them."""

    def __init__(self, rowid: int | None, why: str):
        super().__init__(f"row {rowid}: {why}")
        self.rowid = rowid

    def __reduce__(self):
        return type(self), (self.rowid, str(self).partition(": ")[2])


class SourceError(EngineError):
    """A file that can't be opened or read as what it should be."""

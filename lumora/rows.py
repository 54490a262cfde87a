"""Rows as typed values: getters that refuse another class, and rows as instances of a class of the caller's."""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Iterator

from pyspark.sql import Row

from lumora.errors import InvalidColumnIndex, RowDecode, SchemaMismatch, TypeMismatch
from lumora.operators.table import ROWID, Table

_CLASSES = {int: "integer", float: "real", str: "text", bytes: "blob"}


def plain(value: object) -> object:
    """A mixed value as the number, text or blob that it holds."""
    if isinstance(value, Row) and set(value.__fields__) == {"rank", "i", "r", "t", "b"}:
        return {1: value["r"] if value["i"] is None else value["i"], 2: value["t"], 3: value["b"]}[value["rank"]]
    return bytes(value) if isinstance(value, bytearray) else value


class RowView:
    """A row by column position."""

    def __init__(self, values: tuple, rowid: int | None = None):
        self.values, self.rowid = values, rowid

    def get(self, index: int) -> object:
        if not 0 <= index < len(self.values):
            raise InvalidColumnIndex(index, len(self.values))
        return plain(self.values[index])

    def _typed(self, index: int, *kinds: type) -> object:
        value = self.get(index)
        if type(value) not in kinds:
            raise TypeMismatch(f"column {index}: {_CLASSES[kinds[0]]}, not {_CLASSES.get(type(value), 'null' if value is None else type(value).__name__)}")
        return value

    def get_i64(self, index: int) -> int:
        return self._typed(index, int)

    def get_f64(self, index: int) -> float:
        return self._typed(index, float)

    def get_text(self, index: int) -> str:
        return self._typed(index, str)

    def get_bytes(self, index: int) -> bytes:
        """Of a text its bytes."""
        value = self._typed(index, bytes, str)
        return value.encode() if isinstance(value, str) else value


def views(table: Table) -> Iterator[RowView]:
    """Streams a table's rows, a partition at a time."""
    at = table.df.columns.index(ROWID) if table.has_rowid else None
    for r in table.df.toLocalIterator(prefetchPartitions=True):
        values = tuple(r)
        yield RowView(values, None) if at is None else RowView(values[:at] + values[at + 1 :], values[at])


def _fits(value: object, kind: object) -> bool:
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        return any(_fits(value, k) for k in typing.get_args(kind))
    return value is None if kind in (None, type(None)) else type(value) is kind


def decoded(table: Table, cls: type) -> Iterator[object]:
    """Rows as instances of a dataclass: fields go by name, whatever the case, and must have the annotated classes (int, float, str, bytes, or one of these or None)."""
    places = {c.lower(): i for i, c in enumerate(table.columns)}
    hints = typing.get_type_hints(cls)
    fields = [(f.name, hints[f.name]) for f in dataclasses.fields(cls)]
    missing = [n for n, _ in fields if n.lower() not in places]
    if missing:
        raise SchemaMismatch(", ".join(missing))
    for row in views(table):
        values = {n: row.get(places[n.lower()]) for n, _ in fields}
        for n, kind in fields:
            if not _fits(values[n], kind):
                raise RowDecode(row.rowid, f"{n}: {values[n]!r} is no {getattr(kind, '__name__', kind)}")
        yield cls(**values)

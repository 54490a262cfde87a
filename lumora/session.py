"""An engine over one database: a folder of Parquet tables or a SQLite file."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from lumora import rows
from lumora.errors import SchemaMismatch, TableNotFound, TypeMismatch
from lumora.functions import values as V
from lumora.operators.table import JoinStrategy, Table, rows_of
from lumora.plans import parser, planner
from lumora.rows import RowView
from lumora.sources import files, sqlite


class PreparedQuery:
    """A planned query; it can run any number of times."""

    def __init__(self, df: DataFrame):
        self.df = df

    def for_each(self, callback: Callable[[Row], object]) -> None:
        rows_of(self.df, callback)

    def collect(self) -> list[Row]:
        return self.df.collect()


class Engine:
    def __init__(self, spark: SparkSession, path: str, promote_sums: bool = False):
        """promote_sums: SUM of integers gives a real that is right beyond 64 bits, instead of an error there."""
        self.spark, self.path, self.promote = spark, path, promote_sums
        self.is_sqlite = os.path.isfile(path)
        self._tables: dict[str, Table] = {}
        if self.is_sqlite:
            sqlite.connect(path).close()

    def table_names(self) -> list[str]:
        return sqlite.tables(self.path) if self.is_sqlite else files.parquet_tables(self.spark, self.path)

    def table(self, name: str) -> Table:
        """By name, whatever the case."""
        key = name.lower()
        if key not in self._tables:
            if self.is_sqlite and key == "sqlite_schema":
                self._tables[key] = sqlite.schema_table(self.spark, self.path)
            elif self.is_sqlite:
                real = next((n for n in self.table_names() if n.lower() == key), None)
                if real is None:
                    raise TableNotFound(name)
                self._tables[key] = Table(real, sqlite.read(self.spark, self.path, real), lambda columns: sqlite.read(self.spark, self.path, real, columns=columns))
            else:
                self._tables[key] = files.parquet_table(self.spark, self.path, key)
        return self._tables[key]

    def register(self, name: str, df: DataFrame) -> None:
        """Adds a DataFrame as a table."""
        self._tables[name.lower()] = Table(name, df)

    def schema(self) -> DataFrame:
        return sqlite.schema_table(self.spark, self.path).df if self.is_sqlite else files.listing(self.spark, self.path)

    def prepare(self, sql: str, strategy: JoinStrategy = JoinStrategy.AUTO) -> PreparedQuery:
        return PreparedQuery(planner.plan(parser.parse(sql), self.table, strategy, self.promote))

    def query(self, sql: str, strategy: JoinStrategy = JoinStrategy.AUTO) -> DataFrame:
        return self.prepare(sql, strategy).df

    def find_schema(self, test: Callable[[dict[str, object]], bool]) -> dict[str, object] | None:
        """The first table or index (type, name, ...) that passes; the search ends there."""
        if self.is_sqlite:
            return sqlite.find_in_schema(self.path, test)
        return next((e for n in self.table_names() if test(e := {"type": "table", "name": n})), None)

    def views(self, name: str) -> Iterator[RowView]:
        """Rows with typed getters."""
        return rows.views(self.table(name))

    def decoded(self, name: str, cls: type) -> Iterator[object]:
        """Rows as instances of a dataclass; a row of other classes is a RowDecode error with its number."""
        return rows.decoded(self.table(name), cls)

    def typed(self, name: str, kinds: dict[str, str], allow_extra: bool = False) -> DataFrame:
        """The table with checked kinds (integer, real, text, blob): nothing is converted. allow_extra: more columns may be there."""
        t = self.table(name)
        if len(t.columns) < len(kinds) or (len(t.columns) > len(kinds) and not allow_extra):
            raise SchemaMismatch(f"{len(kinds)} columns, not {len(t.columns)}")
        have = {f.name.lower(): f for f in t.df.schema.fields}
        for c, k in kinds.items():
            if c.lower() not in have:
                raise SchemaMismatch(c)
            got = V.kind_of(have[c.lower()].dataType)
            if got != k:
                raise TypeMismatch(f"{c}: {k}, not {got}")
        return t.df.select(*kinds)

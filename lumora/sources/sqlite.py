"""SQLite files as a Spark source: partitions are ranges of row numbers, rows come in Arrow batches.

The file must be where all executors can open it. A column has the type of its values; where they
differ in class it is the tagged struct of lumora.functions.values. Integers among reals are reals.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lumora.errors import RowDecode, SourceError, TableNotFound
from lumora.functions.values import MIXED
from lumora.operators.table import ROWID, Table

BATCH = 8192
SCHEMA_COLUMNS = ("type", "name", "tbl_name", "rootpage", "sql")
_MAGIC = b"SQLite format 3\x00"


def connect(path: str) -> sqlite3.Connection:
    """Read-only. Only main files in rollback mode: a write-ahead log would hold rows that the file lacks."""
    try:
        with open(path, "rb") as f:
            head = f.read(100)
    except OSError as e:
        raise SourceError(str(e)) from e
    if len(head) < 100 or not head.startswith(_MAGIC):
        raise SourceError(f"{path} is no SQLite file")
    if head[18] != 1 or head[19] != 1:
        raise SourceError(f"{path} is in write-ahead mode")
    if int.from_bytes(head[56:60], "big") not in (0, 1):
        raise SourceError(f"{path} isn't in UTF-8")
    con = sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro&immutable=1", uri=True)
    con.text_factory = bytes
    return con


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    with connect(path) as con:
        return [r[0].decode() for r in con.execute("SELECT name FROM sqlite_schema WHERE type = 'table' AND rootpage > 0 ORDER BY rowid")]


def _columns(con: sqlite3.Connection, table: str) -> list[str]:
    return [r[1].decode() for r in con.execute(f"PRAGMA table_info({_quote(table)})")]


def _has_rowid(con: sqlite3.Connection, table: str) -> bool:
    try:
        con.execute(f"SELECT rowid FROM {_quote(table)} LIMIT 1").fetchall()
        return True
    except sqlite3.OperationalError:
        return False


def find_in_schema(path: str, test: Callable[[dict[str, object]], bool]) -> dict[str, object] | None:
    """The first entry of the file's own list that passes; nothing after it is read."""
    with connect(path) as con:
        for r in con.execute(f"SELECT {', '.join(SCHEMA_COLUMNS)} FROM sqlite_schema ORDER BY rowid"):
            entry = dict(zip(SCHEMA_COLUMNS, (x.decode() if isinstance(x, bytes) else x for x in r), strict=True))
            if test(entry):
                return entry
    return None


def schema_of(path: str, table: str, columns: list[str] | None = None) -> T.StructType:
    """_rowid, then a field a column (of those that are named, if any are), by the classes of its values; a column without values is text."""
    with connect(path) as con:
        names = _columns(con, table)
        if not names:
            raise TableNotFound(table)
        names = names if columns is None else [n for n in names if n in columns]
        out = T.StructType([T.StructField(ROWID, T.LongType())])
        classes = ("integer", "real", "text", "blob")
        asked = ", ".join(f"max(typeof({_quote(n)}) = '{c}')" for n in names for c in classes)
        seen = iter(con.execute(f"SELECT {asked} FROM {_quote(table)}").fetchone() if names else ())  # one pass for all columns
        for n in names:
            found = {c for c, here in zip(classes, [next(seen) for _ in classes], strict=True) if here}
            single = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}
            kind = single[next(iter(found))] if len(found) == 1 else T.DoubleType() if found == {"integer", "real"} else MIXED if found else T.StringType()
            out.add(n, kind)
        return out


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", "8"))
        self.tests: list[tuple[str, int]] = []

    def pushFilters(self, filters):
        """Conditions on the row number narrow the ranges; Spark evaluates the others."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and f.attribute == (ROWID,) and isinstance(f.value, int):
                self.tests.append((signs[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as con:
            if not _has_rowid(con, self.table):
                return [_Range(None, None)]
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
        for sign, v in self.tests:
            if low is None:
                break
            low = max(low, v + (sign == ">")) if sign in ("=", ">", ">=") else low
            high = min(high, v - (sign == "<")) if sign in ("=", "<", "<=") else high
        if low is None or low > high:
            return []
        step = max(BATCH, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fields = self.schema.fields[1:]
        listed = "".join(f", {_quote(f.name)}" for f in fields)
        with connect(self.path) as con:
            if partition.low is None:
                rows = con.execute(f"SELECT NULL{listed} FROM {_quote(self.table)}")
            else:
                rows = con.execute(f"SELECT rowid{listed} FROM {_quote(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.low, partition.high))
            # blobs and texts both come as bytes: their classes are asked for where it matters
            mixed = [i for i, f in enumerate(fields) if f.dataType == MIXED]
            if mixed:
                kinds = ", ".join(f"typeof({_quote(fields[i].name)})" for i in mixed)
                text = rows_sql(listed, kinds, self.table, partition.low is not None)
                rows = con.execute(text, () if partition.low is None else (partition.low, partition.high))
            while batch := rows.fetchmany(BATCH):
                cols = list(zip(*batch, strict=True))
                arrays = [pa.array(cols[0], pa.int64())]
                for i, f in enumerate(fields):
                    values = cols[1 + i]
                    if f.dataType == MIXED:
                        classes = cols[1 + len(fields) + mixed.index(i)]
                        arrays.append(pa.array([_tagged(v, c, r) for v, c, r in zip(values, classes, cols[0], strict=True)], _MIXED_ARROW))
                    elif isinstance(f.dataType, T.LongType):
                        arrays.append(pa.array(values, pa.int64()))
                    elif isinstance(f.dataType, T.DoubleType):
                        arrays.append(pa.array([None if v is None else float(v) for v in values], pa.float64()))
                    elif isinstance(f.dataType, T.BinaryType):
                        arrays.append(pa.array(values, pa.binary()))
                    else:
                        arrays.append(pa.array(_texts(values, cols[0]), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema.fields])


_MIXED_ARROW = pa.struct([("rank", pa.int32()), ("i", pa.int64()), ("r", pa.float64()), ("t", pa.string()), ("b", pa.binary())])


def rows_sql(listed: str, kinds: str, table: str, numbered: bool) -> str:
    if not numbered:
        return f"SELECT NULL{listed}, {kinds} FROM {_quote(table)}"
    return f"SELECT rowid{listed}, {kinds} FROM {_quote(table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid"


def _text(value: bytes, row: int | None) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError as e:
        raise RowDecode(row, f"text that isn't UTF-8 ({e.reason})") from e


def _texts(values: tuple, rows: tuple) -> list[str | None]:
    try:
        return [None if v is None else v.decode() for v in values]
    except UnicodeDecodeError:
        return [None if v is None else _text(v, r) for v, r in zip(values, rows, strict=True)]


def _tagged(value: object, kind: bytes, row: int | None) -> dict | None:
    if kind == b"null":
        return None
    rank = {b"integer": 1, b"real": 1, b"text": 2, b"blob": 3}[kind]
    return {"rank": rank, "i": value if kind == b"integer" else None, "r": float(value) if rank == 1 else None, "t": _text(value, row) if rank == 2 else None, "b": value if rank == 3 else None}


class SqliteSource(DataSource):
    """Options: path, table, partitions (8), columns (a JSON list; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "lumora_sqlite"

    def schema(self) -> T.StructType:
        named = self.options.get("columns")
        return schema_of(self.options["path"], self.options["table"], None if named is None else json.loads(named))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: list[str] | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("lumora_sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (reader if columns is None else reader.option("columns", json.dumps(columns))).load()


def schema_table(spark: SparkSession, path: str) -> Table:
    """The file's own list of tables and indexes."""
    with connect(path) as con:
        rows = [(r[0], *(x.decode() if isinstance(x, bytes) else x for x in r[1:])) for r in con.execute(f"SELECT rowid, {', '.join(SCHEMA_COLUMNS)} FROM sqlite_schema ORDER BY rowid")]
    return Table("sqlite_schema", spark.createDataFrame(rows, f"{ROWID} long, type string, name string, tbl_name string, rootpage long, sql string"))

"""python -m lumora PATH [TABLE | --sql QUERY]: lists a database, dumps a table, or runs a query."""

from __future__ import annotations

import sys

from pyspark.sql import Row, SparkSession

from lumora.errors import EngineError
from lumora.operators.table import ROWID, rows_of
from lumora.session import Engine


def show(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return "x'" + bytes(value).hex() + "'"
    if isinstance(value, Row) and set(value.asDict()) == {"rank", "i", "r", "t", "b"}:
        return show(next((value[k] for k in ("i", "r", "t", "b") if value[k] is not None), None))
    return str(value)


def line(row: Row, rowid: int | None = None) -> str:
    cells = "".join(f" {show(v)} |" for v in row)
    return f"{'' if rowid is None else f'{rowid:>6} '}|{cells}"


def main(args: list[str]) -> int:
    if not args or len(args) > 3 or (len(args) == 3 and args[1] != "--sql"):
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lumora").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        engine = Engine(spark, args[0])
        if len(args) == 1:
            rows_of(engine.schema(), lambda r: print(line(r)))
        elif args[1] == "--sql":
            if len(args) < 3:
                print(__doc__, file=sys.stderr)
                return 1
            engine.prepare(args[2]).for_each(lambda r: print(line(r)))
        else:
            table = engine.table(args[1])
            print(f"table: {table.name}")
            if table.has_rowid:
                rows_of(table.df.orderBy(ROWID).select(ROWID, *table.columns), lambda r: print(line(Row(*r[1:]), r[0])))
            else:
                rows_of(table.df, lambda r: print(line(r)))
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0

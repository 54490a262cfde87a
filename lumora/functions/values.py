"""Value semantics on Spark columns: kinds, comparisons in three-valued logic, order, LIKE and sums.

A column has one kind. `mixed` is for columns whose values differ in class from row to row: a struct
that carries the class, so that order and comparisons stay inside generated code.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.errors import SqlUnsupported

#: rank: 1 number, 2 text, 3 blob; a null value is a null struct. i: exact integers; r: any number.
MIXED = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType())])

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of points in time; a text literal is read as one of them where it meets one.
TIMES = ("date", "timestamp", "timestamp_ntz")
_PLAIN = frozenset(("mixed", "integer", "real", "text", "blob"))
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Value(NamedTuple):
    """A column with its kind: integer, real, text, blob, null, mixed, boolean, one of TIMES, or other (passed through)."""

    column: Column
    kind: str
    #: A literal other than NaN.
    constant: bool = False
    #: The text of a text literal.
    text: str | None = None


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, _INTEGERS):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "blob"
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return kind.simpleString()
    return "mixed" if kind == MIXED else "other"


_APPLY = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def literal(value: object) -> Value:
    """An integer beyond 64 bits becomes a real."""
    if value is None:
        return Value(F.lit(None), "null")
    if isinstance(value, bool):
        return Value(F.lit(int(value)).cast("long"), "integer")
    if isinstance(value, int):
        return Value(F.lit(value).cast("long"), "integer", True) if -(2**63) <= value < 2**63 else Value(F.lit(float(value)), "real", True)
    if isinstance(value, float):
        return Value(F.lit(value), "real", value == value)
    if isinstance(value, bytes):
        return Value(F.lit(value), "blob")
    return Value(F.lit(str(value)), "text", text=str(value))


def _as_time(v: Value) -> Value:
    """A text literal as a date or a time without zone."""
    try:
        if v.text is None:
            raise ValueError
        moment = datetime.fromisoformat(v.text)
        if moment.tzinfo is not None:
            raise ValueError
    except ValueError:
        raise SqlUnsupported(f"a point in time against {v.text or v.kind!r}") from None
    kind = "date" if len(v.text) == 10 else "timestamp_ntz"
    return Value(F.lit(v.text).cast(kind), kind)


def _as_mixed(v: Value) -> dict[str, Column]:
    """Fields of the value as if it were mixed."""
    null = F.lit(None)
    if v.kind == "mixed":
        return {k: v.column[k] for k in ("rank", "i", "r", "t", "b")}
    rank = {"integer": 1, "real": 1, "text": 2, "blob": 3}[v.kind]
    number = v.column.cast("double") if rank == 1 else null.cast("double")
    whole = v.column.cast("long") if v.kind == "integer" else null.cast("long")
    return {"rank": F.when(v.column.isNotNull(), F.lit(rank)), "i": whole, "r": number, "t": v.column if rank == 2 else null.cast("string"), "b": v.column if rank == 3 else null.cast("binary")}


def compare(op: str, a: Value, b: Value) -> Column:
    """A predicate: null with a null operand; false for different classes and for NaN, whatever the operator."""
    apply = _APPLY[op]
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if a.kind in TIMES or b.kind in TIMES:
        a, b = (v if v.kind in TIMES else _as_time(v) for v in (a, b))
        return apply(a.column, b.column)
    if "mixed" in (a.kind, b.kind) and {a.kind, b.kind} <= _PLAIN:
        x, y = _as_mixed(a), _as_mixed(b)
        exact = x["i"].isNotNull() & y["i"].isNotNull()
        numbers = F.when(exact, apply(x["i"], y["i"])).otherwise(~F.isnan(x["r"]) & ~F.isnan(y["r"]) & apply(x["r"], y["r"]))
        same = F.when(x["rank"] != y["rank"], False).when(x["rank"] == 1, numbers).when(x["rank"] == 2, apply(x["t"], y["t"])).otherwise(apply(x["b"], y["b"]))
        return F.when(a.column.isNotNull() & b.column.isNotNull(), same)
    numeric = {"integer", "real"}
    if a.kind in numeric and b.kind in numeric:
        reals = [v for v in (a, b) if v.kind == "real" and not v.constant]
        if not reals:
            return apply(a.column, b.column)
        if a.constant or b.constant:
            # Spark has NaN above all numbers, so only some operators need a guard; plain ones reach the scan
            number, other, way = (a, b, op) if b.constant else (b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op))
            bound = other.column.cast("double") if number.kind == "real" and other.kind == "integer" else other.column
            plain = _APPLY[way](number.column, bound)
            return plain if way in ("=", "<", "<=") else plain & ~F.isnan(number.column)
        plain = apply(a.column, b.column)
        any_nan = F.isnan(reals[0].column) if len(reals) == 1 else F.isnan(reals[0].column) | F.isnan(reals[1].column)
        return F.when(a.column.isNull() | b.column.isNull(), F.lit(None).cast("boolean")).when(any_nan, False).otherwise(plain)
    if a.kind == b.kind:
        return apply(a.column, b.column)
    return F.when(a.column.isNotNull() & b.column.isNotNull(), False)


def like(a: Value, pattern: Value) -> Column:
    """% is any run and _ any character; ASCII letters match in either case; there is no escape. Null with a null operand, else false off text."""
    if "null" in (a.kind, pattern.kind):
        return F.lit(None).cast("boolean")
    texts = []
    for v in (a, pattern):
        if v.kind == "mixed":
            texts.append(v.column["t"])
        elif v.kind == "text":
            texts.append(v.column)
        else:
            return F.when(a.column.isNotNull() & pattern.column.isNotNull(), False)
    x, p = (F.translate(t, _UPPER, _LOWER) for t in texts)
    found = F.like(x, p, F.lit("\x01"))
    if "mixed" in (a.kind, pattern.kind):
        return F.when(a.column.isNotNull() & pattern.column.isNotNull(), F.coalesce(found, F.lit(False)))
    return found


def _order_fields(c: Column) -> list[Column]:
    """Fields of a mixed value in the order that counts; integers only where reals can't tell them apart."""
    exact = F.when((c["i"] > 2**53) | (c["i"] < -(2**53)), c["i"])
    return [c["rank"], c["r"], exact, c["t"], c["b"]]


def sort_keys(v: Value, descending: bool) -> list[Column]:
    """Total order: null, numbers (NaN last), text, blob."""
    cols = _order_fields(v.column) if v.kind == "mixed" else [v.column]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def group_key(v: Value) -> Column:
    """What rows of one group share: an integer and an equal real are the same."""
    if v.kind != "mixed":
        return v.column
    return F.when(v.column.isNotNull(), F.struct(*_order_fields(v.column)))


def join_on(a: Value, b: Value) -> Column | None:
    """An equi-join condition; None if no values of these kinds are ever equal. NaN and null match nothing."""
    numeric = {"integer", "real"}
    if a.kind == b.kind == "integer" or a.kind == b.kind and a.kind in ("text", "blob", "other", "boolean"):
        return a.column == b.column
    if a.kind in TIMES and b.kind in TIMES:
        return a.column == b.column
    if a.kind in numeric and b.kind in numeric:
        x, y = a.column.cast("double"), b.column.cast("double")
        return (x == y) & ~F.isnan(x)
    if "mixed" in (a.kind, b.kind) and {a.kind, b.kind} <= _PLAIN:
        x, y = _as_mixed(a), _as_mixed(b)
        key = lambda f: F.struct(f["rank"].alias("rank"), F.coalesce(f["r"], F.lit(0.0)).alias("r"), F.coalesce(f["t"], F.lit("")).alias("t"), F.coalesce(f["b"], F.lit(b"")).alias("b"))
        exact = F.coalesce(x["i"] == y["i"], F.lit(True))
        return (key(x) == key(y)) & x["rank"].isNotNull() & y["rank"].isNotNull() & ~F.coalesce(F.isnan(x["r"]), F.lit(False)) & exact
    return None


def _number(v: Value) -> Column:
    return v.column["r"] if v.kind == "mixed" else v.column


def sum_of(v: Value, promote: bool = False) -> Value:
    """The sum of numbers, null without any; text and blobs count for nothing.

    Integers stay integers, and an overflow is an error; with promote they are summed exactly and given as
    a real, which is right beyond 64 bits.
    """
    if v.kind == "integer":
        if promote:
            return Value(F.sum(v.column.cast("decimal(20,0)")).cast("double"), "real")
        return Value(F.sum(v.column), "integer")
    if v.kind in ("real", "mixed"):
        return Value(F.sum(_number(v).cast("double")), "real")
    return Value(F.max(F.lit(None).cast("long")), "integer")


def avg_of(v: Value) -> Value:
    if v.kind in ("integer", "real", "mixed"):
        return Value(F.avg(_number(v).cast("double")), "real")
    return Value(F.max(F.lit(None).cast("double")), "real")


def extreme_of(v: Value, largest: bool) -> Value:
    f = F.max if largest else F.min
    if v.kind == "mixed":  # by the order of classes, not of fields
        by = F.when(v.column.isNotNull(), F.struct(*_order_fields(v.column)))
        return Value((F.max_by if largest else F.min_by)(v.column, by), "mixed")
    if v.kind == "null":
        return Value(F.max(F.lit(None).cast("long")), "integer")
    return Value(f(v.column), v.kind)

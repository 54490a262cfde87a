"""Expressions of the builder API: columns by position, literals, predicates and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumora.errors import AggregateExprOnlyColOrLit, InvalidColumnIndex
from lumora.functions import values as V


class Expr:
    """A value or a predicate over the columns of a row."""

    def eq(self, other: Expr) -> Expr:
        return Compare("=", self, other)

    def ne(self, other: Expr) -> Expr:
        return Compare("!=", self, other)

    def lt(self, other: Expr) -> Expr:
        return Compare("<", self, other)

    def le(self, other: Expr) -> Expr:
        return Compare("<=", self, other)

    def gt(self, other: Expr) -> Expr:
        return Compare(">", self, other)

    def ge(self, other: Expr) -> Expr:
        return Compare(">=", self, other)

    def like(self, pattern: Expr) -> Expr:
        return Like(self, pattern)

    def and_(self, other: Expr) -> Expr:
        return Logic("and", self, other)

    def or_(self, other: Expr) -> Expr:
        return Logic("or", self, other)

    def not_(self) -> Expr:
        return Not(self)

    def is_null(self) -> Expr:
        return IsNull(self)

    def is_not_null(self) -> Expr:
        return Not(IsNull(self))

    def __and__(self, other: Expr) -> Expr:
        return self.and_(other)

    def __or__(self, other: Expr) -> Expr:
        return self.or_(other)

    def __invert__(self) -> Expr:
        return self.not_()


Resolve = Callable[[int], V.Value]


@dataclass(frozen=True)
class Col(Expr):
    index: int


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Like(Expr):
    left: Expr
    pattern: Expr


@dataclass(frozen=True)
class Logic(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    inner: Expr


@dataclass(frozen=True)
class Const(Expr):
    """A truth value."""

    value: bool


@dataclass(frozen=True)
class In(Expr):
    left: Expr
    choices: tuple[Expr, ...]


def col(index: int) -> Expr:
    return Col(index)


def lit_i64(value: int) -> Expr:
    return Lit(int(value))


def lit_f64(value: float) -> Expr:
    return Lit(float(value))


def lit_bytes(value: bytes | str) -> Expr:
    """A text literal."""
    return Lit(value.decode() if isinstance(value, bytes) else value)


def lit_null() -> Expr:
    return Lit(None)


def value(e: Expr, resolve: Resolve) -> V.Value:
    """An operand; a predicate used as one is null."""
    if isinstance(e, Col):
        return resolve(e.index)
    if isinstance(e, Lit):
        return V.literal(e.value)
    return V.literal(None)


def predicate(e: Expr, resolve: Resolve) -> Column:
    """A boolean column in three-valued logic; a bare column or literal has no truth value."""
    if isinstance(e, Const):
        return F.lit(e.value)
    if isinstance(e, Compare):
        return V.compare(e.op, value(e.left, resolve), value(e.right, resolve))
    if isinstance(e, Like):
        return V.like(value(e.left, resolve), value(e.pattern, resolve))
    if isinstance(e, Logic):
        a, b = predicate(e.left, resolve), predicate(e.right, resolve)
        return a & b if e.op == "and" else a | b
    if isinstance(e, Not):
        return ~predicate(e.inner, resolve)
    if isinstance(e, IsNull):
        if isinstance(e.inner, (Col, Lit)):
            return value(e.inner, resolve).column.isNull()
        return predicate(e.inner, resolve).isNull()
    if isinstance(e, In):
        return _in(e, resolve)
    return F.lit(None).cast("boolean")


def _in(e: In, resolve: Resolve) -> Column:
    if not e.choices:
        return F.lit(False)
    left = value(e.left, resolve)
    choices = [value(c, resolve) for c in e.choices]
    if left.kind in ("integer", "text") and all(c.kind == left.kind for c in choices):
        return left.column.isin(*[c.column for c in choices])
    out = None
    for c in choices:
        one = V.compare("=", left, c)
        out = one if out is None else out | one
    return out


def resolver(columns: Sequence[V.Value]) -> Resolve:
    def find(index: int) -> V.Value:
        if not 0 <= index < len(columns):
            raise InvalidColumnIndex(index, len(columns))
        return columns[index]

    return find


@dataclass(frozen=True)
class OrderBy:
    index: int
    descending: bool = False


def asc(index: int) -> OrderBy:
    return OrderBy(index)


def desc(index: int) -> OrderBy:
    return OrderBy(index, True)


@dataclass(frozen=True)
class AggExpr:
    """function: value (a group key), count_star, count, sum, avg, min or max."""

    function: str
    argument: Expr | None = None

    def __post_init__(self) -> None:
        if self.argument is not None and not isinstance(self.argument, (Col, Lit)):
            raise AggregateExprOnlyColOrLit(self.function)


def group(e: Expr) -> AggExpr:
    return AggExpr("value", e)


def count_star() -> AggExpr:
    return AggExpr("count_star")


def count(e: Expr) -> AggExpr:
    return AggExpr("count", e)


def sum_(e: Expr) -> AggExpr:
    return AggExpr("sum", e)


def avg(e: Expr) -> AggExpr:
    return AggExpr("avg", e)


def min_(e: Expr) -> AggExpr:
    return AggExpr("min", e)


def max_(e: Expr) -> AggExpr:
    return AggExpr("max", e)


def aggregate(a: AggExpr, resolve: Resolve, promote: bool = False) -> V.Value:
    if a.function == "count_star":
        return V.Value(F.count(F.lit(1)), "integer")
    v = value(a.argument, resolve)
    if a.function == "count":
        return V.Value(F.count(v.column), "integer")
    if a.function == "sum":
        return V.sum_of(v, promote)
    if a.function == "avg":
        return V.avg_of(v)
    return V.extreme_of(v, a.function == "max")

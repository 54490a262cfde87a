"""From a parsed SELECT to a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora import errors as E
from lumora.functions import values as V
from lumora.operators import expr as X
from lumora.operators.table import JoinStrategy, JoinType, Table, grouped, joined
from lumora.plans import parser as P


@dataclass
class _Side:
    source: P.Source
    columns: list[str]
    base: int  # position of its first column among all


class _Names:
    """Finds columns by name, whatever the case; positions run over all sides."""

    def __init__(self, sides: list[_Side]):
        self.sides = sides
        self.used: set[int] = set()  # positions that were found

    def used_of(self, side: int) -> set[int]:
        s = self.sides[side]
        return {at - s.base for at in self.used if s.base <= at < s.base + len(s.columns)}

    def find(self, name: P.Name) -> int:
        column, qualifier = name.parts[-1].lower(), name.parts[-2].lower() if len(name.parts) > 1 else None
        sides = [s for s in self.sides if qualifier is None or qualifier in s.source.names]
        if qualifier is not None and len(sides) > 1:
            raise E.SqlAmbiguousColumn(".".join(name.parts))
        found = [s.base + i for s in sides for i, c in enumerate(s.columns) if c.lower() == column]
        if not found:
            raise E.SqlUnknownColumn(".".join(name.parts))
        if len(found) > 1:
            raise E.SqlAmbiguousColumn(".".join(name.parts))
        self.used.add(found[0])
        return found[0]

    def all_of(self, star: P.Star) -> list[tuple[int, str]]:
        sides = self.sides
        if star.table is not None:
            sides = [s for s in sides if star.table.lower() in s.source.names]
            if not sides:
                raise E.SqlUnknownColumn(f"{star.table}.*")
            if len(sides) > 1:
                raise E.SqlAmbiguousColumn(f"{star.table}.*")
        out = [(s.base + i, c) for s in sides for i, c in enumerate(s.columns)]
        self.used.update(at for at, _ in out)
        return out


def _operand(e: object, find: Callable[[object], X.Expr]) -> X.Expr:
    if isinstance(e, P.Literal):
        return X.Lit(e.value)
    if isinstance(e, P.Truth):
        return X.Lit(int(e.value))
    if isinstance(e, (P.Name, P.Call)):
        return find(e)
    if isinstance(e, P.Star):
        raise E.SqlUnsupported("*")
    return X.Lit(None)  # a truth value isn't an operand


def _condition(e: object, find: Callable[[object], X.Expr], lists: bool = True) -> X.Expr:
    """A predicate. find: gives the columns and calls. lists: whether IN, BETWEEN and LIKE are allowed."""
    if isinstance(e, P.Truth):
        return X.Const(e.value)
    if isinstance(e, (P.Name, P.Call)):
        find(e)
        raise E.SqlUnsupported("a value as a condition")
    if isinstance(e, P.Literal):
        raise E.SqlUnsupported("a literal as a condition")
    if isinstance(e, P.Negated):
        return X.Not(_condition(e.inner, find, lists))
    if isinstance(e, P.NullTest):
        if isinstance(e.inner, (P.Name, P.Call, P.Literal, P.Truth)):
            return X.IsNull(_operand(e.inner, find))
        return X.IsNull(_condition(e.inner, find, lists))
    if isinstance(e, P.Among):
        if not lists:
            raise E.SqlUnsupported("IN here")
        return X.In(_operand(e.left, find), tuple(_operand(c, find) for c in e.choices))
    if isinstance(e, P.Binary):
        if e.op in ("and", "or"):
            return X.Logic(e.op, _condition(e.left, find, lists), _condition(e.right, find, lists))
        if e.op == "like":
            if not lists:
                raise E.SqlUnsupported("LIKE here")
            return X.Like(_operand(e.left, find), _operand(e.right, find))
        return X.Compare(e.op, _operand(e.left, find), _operand(e.right, find))
    raise E.SqlUnsupported(str(e))


def _has_call(e: object) -> bool:
    return isinstance(e, P.Call)


def _ordinal(e: object, count: int) -> int | None:
    """The position that an ORDER BY literal names."""
    if isinstance(e, P.Literal):
        if isinstance(e.value, int) and not isinstance(e.value, bool) and 1 <= e.value <= count:
            return e.value - 1
        raise E.SqlInvalidLimitOffset(str(e.value))
    if isinstance(e, P.Truth):
        raise E.SqlInvalidLimitOffset("a truth value")
    return None


def _slice(df: DataFrame, s: P.Select) -> DataFrame:
    if s.offset:
        df = df.offset(s.offset)
    if s.limit is not None:
        df = df.limit(s.limit)
    return df


def plan(s: P.Select, table: Callable[[str], Table], strategy: JoinStrategy = JoinStrategy.AUTO, promote: bool = False) -> DataFrame:
    """strategy: the hint for a join. promote: sums of integers as reals, right beyond 64 bits."""
    tables = [table(s.table.name)] + ([table(s.join.name)] if s.join else [])
    sides, base = [], 0
    for t, source in zip(tables, [s.table, s.join], strict=False):
        sides.append(_Side(source, t.columns, base))
        base += len(t.columns)
    names = _Names(sides)
    if s.join is not None and sides[0].source.names & sides[1].source.names and (sides[0].source.alias or sides[0].source.name).lower() == (sides[1].source.alias or sides[1].source.name).lower():
        raise E.SqlAmbiguousColumn(s.join.name)
    if any(_has_call(i.expr) for i in s.items) or s.group:
        if s.join is not None:
            raise E.SqlUnsupported("aggregation of a join")
        return _aggregate(s, tables[0], names, promote)
    if s.having is not None or any(_has_call(o.expr) for o in s.order):
        raise E.SqlUnsupported("an aggregate without GROUP BY")
    items: list[tuple[int, str]] = []
    aliases: dict[str, list[int]] = {}
    for i in s.items:
        if isinstance(i.expr, P.Star):
            items += names.all_of(i.expr)
        elif isinstance(i.expr, P.Name):
            at = names.find(i.expr)
            items.append((at, i.alias or sides[_side(sides, at)].columns[at - sides[_side(sides, at)].base]))
            if i.alias:
                aliases.setdefault(i.alias.lower(), []).append(at)
        else:
            raise E.SqlUnsupported("an expression in the list")
    where = None if s.where is None else _condition(s.where, lambda e: _column(e, names))
    order: list[tuple[int, bool]] = []
    for o in s.order:
        at = _ordinal(o.expr, len(items))
        if at is not None:
            order.append((items[at][0], o.descending))
        elif isinstance(o.expr, P.Name):
            own = aliases.get(o.expr.parts[0].lower(), []) if len(o.expr.parts) == 1 else []
            if len(set(own)) > 1:
                raise E.SqlAmbiguousColumn(o.expr.parts[0])
            order.append((own[0] if own else names.find(o.expr), o.descending))
        else:
            raise E.SqlUnsupported("ORDER BY an expression")
    a, b = _keys(s.on, names, sides) if s.join is not None else (0, 0)
    left, columns, l_id = tables[0].numbered("l" if s.join else "c", names.used_of(0))
    ids = [l_id]
    if s.join is None:
        df = left
    else:
        right, more, r_id = tables[1].numbered("r", names.used_of(1))
        columns = columns + more
        ids.append(r_id)
        df = joined(left, right, columns[a], columns[b], JoinType.LEFT if s.left_join else JoinType.INNER, strategy)
    find = X.resolver(columns)
    if where is not None:
        df = df.where(X.predicate(where, find))
    rowids = [c for c in ids if c is not None]
    keys = [k for at, down in order for k in V.sort_keys(columns[at], down)]
    if s.distinct:
        df = _distinct(df, [columns[at] for at, _ in items], keys, {at for at, _ in order} <= {at for at, _ in items}, rowids, bool(s.join))
        rowids = rowids if not s.order and rowids else []
    if keys:
        df = df.orderBy(*keys, *rowids)
    elif rowids and (s.limit is not None or s.offset or s.distinct):
        df = df.orderBy(*rowids)
    return _slice(df, s).select(*[columns[at].column.alias(name) for at, name in items])


def _side(sides: list[_Side], at: int) -> int:
    return max(i for i, s in enumerate(sides) if s.base <= at)


def _column(e: object, names: _Names) -> X.Expr:
    if isinstance(e, P.Name):
        return X.Col(names.find(e))
    raise E.SqlUnsupported("an aggregate here")


def _keys(on: object, names: _Names, sides: list[_Side]) -> tuple[int, int]:
    if not isinstance(on, P.Binary) or on.op != "=" or not isinstance(on.left, P.Name) or not isinstance(on.right, P.Name):
        raise E.SqlUnsupported("a join on anything but column = column")
    a, b = names.find(on.left), names.find(on.right)
    if a > b:
        a, b = b, a
    if _side(sides, a) == _side(sides, b):
        raise E.SqlUnsupported("a join on one side's columns")
    return a, b


def _distinct(df: DataFrame, shown: list[V.Value], keys: list[Column], covered: bool, rowids: list[Column], join: bool) -> DataFrame:
    """One row for each combination of the shown columns: the first in order for a table, the first joined one for a join.

    Where the order reads shown columns only, any row will do, and partial aggregation serves.
    """
    grouping = [V.group_key(v) for v in shown]
    first = rowids if join and rowids else [*keys, *rowids]
    if covered and not rowids and all(v.kind != "mixed" for v in shown):
        return df.select(*[v.column for v in shown]).distinct()
    w = Window.partitionBy(*grouping).orderBy(*(first or [F.lit(0)]))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def _aggregate(s: P.Select, table: Table, names: _Names, promote: bool) -> DataFrame:
    group: list[X.Expr] = []
    for g in s.group:
        if isinstance(g, P.Name):
            group.append(X.Col(names.find(g)))
        elif isinstance(g, (P.Literal, P.Truth)):
            group.append(X.Lit(int(g.value) if isinstance(g, P.Truth) else g.value))
        else:
            raise E.SqlUnsupported("GROUP BY an expression")
    items: list[X.AggExpr] = []
    titles: list[str] = []

    def call(c: P.Call) -> X.AggExpr:
        if isinstance(c.argument, P.Star):
            if c.argument.table is not None:
                names.all_of(c.argument)
            return X.count_star()
        if isinstance(c.argument, P.Name):
            argument: X.Expr = X.Col(names.find(c.argument))
        elif isinstance(c.argument, (P.Literal, P.Truth)):
            argument = X.Lit(int(c.argument.value) if isinstance(c.argument, P.Truth) else c.argument.value)
        else:
            raise E.SqlUnsupported(f"{c.name}() of an expression")
        return X.AggExpr(c.name, argument)

    outputs: dict[str, list[int]] = {}
    for i in s.items:
        if isinstance(i.expr, P.Star):
            raise E.SqlUnsupported("* with GROUP BY")
        if isinstance(i.expr, P.Call):
            items.append(call(i.expr))
            text = "*" if isinstance(i.expr.argument, P.Star) else ".".join(i.expr.argument.parts) if isinstance(i.expr.argument, P.Name) else str(getattr(i.expr.argument, "value", ""))
            titles.append(i.alias or f"{i.expr.name.upper()}({text})")
        elif isinstance(i.expr, P.Name):
            key = X.Col(names.find(i.expr))
            if not group:
                raise E.NonAggregateRequiresGroupBy(i.expr.parts[-1])
            if key not in group:
                raise E.NonAggregateMustAppearInGroupBy(i.expr.parts[-1])
            items.append(X.group(key))
            titles.append(i.alias or i.expr.parts[-1])
        else:
            raise E.SqlUnsupported("an expression in the list")
        if i.alias or isinstance(i.expr, P.Name):
            outputs.setdefault(titles[-1].lower(), []).append(len(items) - 1)
    shown = len(items)

    def place(item: X.AggExpr) -> int:
        if item in items:
            return items.index(item)
        items.append(item)
        return len(items) - 1

    def output(e: object) -> X.Expr:
        """An alias or shown column, a group column, or an aggregate, hidden if need be."""
        if isinstance(e, P.Call):
            return X.Col(place(call(e)))
        if len(e.parts) == 1 and (own := outputs.get(e.parts[0].lower())):
            if len({items[i] for i in own}) > 1:
                raise E.SqlAmbiguousColumn(e.parts[0])
            return X.Col(own[0])
        key = X.Col(names.find(e))
        if key not in group:
            raise E.NonAggregateMustAppearInGroupBy(e.parts[-1]) if group else E.NonAggregateRequiresGroupBy(e.parts[-1])
        return X.Col(place(X.group(key)))

    having = None if s.having is None else _condition(s.having, output, lists=False)
    order: list[tuple[int, bool]] = []
    for o in s.order:
        at = _ordinal(o.expr, shown)
        if at is None:
            if not isinstance(o.expr, (P.Name, P.Call)):
                raise E.SqlUnsupported("ORDER BY an expression")
            at = output(o.expr).index
        order.append((at, o.descending))
    where = None if s.where is None else _condition(s.where, lambda e: _column(e, names))
    df, columns, rowid = table.numbered("c", names.used_of(0))
    find = X.resolver(columns)
    if where is not None:
        df = df.where(X.predicate(where, find))
    first = rowid is not None and bool(group)
    df, values = grouped(df, find, items, group, rowid if first else None, promote)
    if having is not None:
        df = df.where(X.predicate(having, X.resolver(values)))
    keys = [k for at, down in order for k in V.sort_keys(values[at], down)]
    ties = [F.col("_first")] if first else []
    if s.distinct:
        df = _distinct(df, values[:shown], keys, all(at < shown for at, _ in order), ties, True)
    if keys:
        df = df.orderBy(*keys, *ties)
    elif ties and s.distinct:
        df = df.orderBy(*ties)
    return _slice(df, s).select(*[v.column.alias(t) for v, t in zip(values[:shown], titles, strict=True)])

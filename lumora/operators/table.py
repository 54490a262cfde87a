"""Tables and the builder operators on them: Scan, Aggregate and Join. All are lazy DataFrames underneath.

A table may carry a row number (`_rowid`), which isn't among its columns. With one, ties and first-seen
orders follow it; without one they are Spark's to choose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from enum import Enum

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora import errors as E
from lumora.functions import values as V
from lumora.operators import expr as X

ROWID = "_rowid"


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame
    #: Where the source can't prune columns by itself: reads the row number and the named columns only.
    narrow: Callable[[list[str]], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROWID]

    @property
    def has_rowid(self) -> bool:
        return ROWID in self.df.columns

    def numbered(self, prefix: str, used: set[int] | None = None) -> tuple[DataFrame, list[V.Value], Column | None]:
        """The rows under unique names, the columns as values, and the row number. used: positions that matter; others may be null."""
        if used is not None and self.narrow is not None and len(used) < len(self.columns):
            few = self.narrow([c for i, c in enumerate(self.columns) if i in used])
            kinds = {f.name: f.dataType for f in self.df.schema.fields}
            return Table(self.name, few.select(*[F.col(f"`{c}`") if c in few.columns else F.lit(None).cast(kinds[c]).alias(c) for c in self.df.columns])).numbered(prefix)
        names = [f"{prefix}{i}" for i in range(len(self.columns))]
        renamed = dict(zip(self.columns, names, strict=True))
        types = [f.dataType for f in self.df.schema.fields if f.name != ROWID]
        df = self.df.toDF(*[renamed.get(c, f"{prefix}_id") for c in self.df.columns])
        return df, [V.Value(F.col(n), V.kind_of(t)) for n, t in zip(names, types, strict=True)], F.col(f"{prefix}_id") if self.has_rowid else None

    def scan(self) -> Scan:
        return Scan(self)


def rows_of(df: DataFrame, callback: Callable[[Row], object] | None = None) -> Iterator[Row] | None:
    """Streams rows to the caller, a partition at a time."""
    it = df.toLocalIterator(prefetchPartitions=True)
    if callback is None:
        return it
    for r in it:
        callback(r)
    return None


@dataclass(frozen=True)
class Scan:
    table: Table
    projection: tuple[int, ...] | None = None
    predicate: X.Expr | None = None
    function: Callable[[Row], bool] | None = None
    batches: Callable[[pa.RecordBatch], pa.Array] | None = None
    order: tuple[X.OrderBy, ...] = ()
    rows: int | None = None

    def project(self, columns: Sequence[int]) -> Scan:
        return replace(self, projection=tuple(columns))

    def filter(self, predicate: X.Expr) -> Scan:
        """The last filter, filter_fn or filter_batch counts."""
        return replace(self, predicate=predicate, function=None, batches=None)

    def filter_fn(self, function: Callable[[Row], bool]) -> Scan:
        """Any Python condition on a row; it reaches Python in Arrow batches, with all columns."""
        return replace(self, function=function, predicate=None, batches=None)

    def filter_batch(self, function: Callable[[pa.RecordBatch], pa.Array]) -> Scan:
        """As filter_fn, for whole Arrow batches: gives a boolean a row, null for false. There is no Python call a row."""
        return replace(self, batches=function, predicate=None, function=None)

    def order_by(self, order: Sequence[X.OrderBy]) -> Scan:
        return replace(self, order=tuple(order))

    def limit(self, rows: int) -> Scan:
        return replace(self, rows=rows)

    def aggregate(self, items: Sequence[X.AggExpr]) -> Aggregate:
        return Aggregate(self, tuple(items))

    def base(self, prefix: str = "c") -> tuple[DataFrame, list[V.Value], Column | None]:
        """Filtered, ordered and limited rows under unique names."""
        df, columns, rowid = self.table.numbered(prefix)
        find = X.resolver(columns)
        if self.predicate is not None:
            df = df.where(X.predicate(self.predicate, find))
        if self.function is not None:
            function = self.function
            names = self.table.columns
            test = F.udf(lambda r: bool(function(Row(*names)(*r))), T.BooleanType(), useArrow=True)
            df = df.where(test(F.struct(*[v.column for v in columns])))
        if self.batches is not None:
            test_all, titles = self.batches, self.table.columns

            def passes(x: pa.Array) -> pa.Array:
                return pc.fill_null(test_all(pa.RecordBatch.from_arrays(x.flatten(), names=titles)), False)

            df = df.where(F.arrow_udf(passes, T.BooleanType())(F.struct(*[v.column for v in columns])))
        if self.order:
            keys = [k for o in self.order for k in V.sort_keys(find(o.index), o.descending)]
            df = df.orderBy(*keys, *([rowid] if rowid is not None else []))
        if self.rows is not None:
            df = df.limit(self.rows)
        return df, columns, rowid

    def compile(self) -> DataFrame:
        df, columns, rowid = self.base()
        chosen = range(len(columns)) if self.projection is None else self.projection
        find, names = X.resolver(columns), self.table.columns
        return df.select(*[find(i).column.alias(names[i]) for i in chosen])

    def for_each(self, callback: Callable[[Row], object]) -> None:
        rows_of(self.compile(), callback)


@dataclass(frozen=True)
class Aggregate:
    scan: Scan
    items: tuple[X.AggExpr, ...]
    keys: tuple[X.Expr, ...] = ()
    condition: X.Expr | None = None
    promote: bool = False

    def group_by(self, keys: Sequence[X.Expr]) -> Aggregate:
        return replace(self, keys=tuple(keys))

    def having(self, condition: X.Expr) -> Aggregate:
        """Columns in it are positions among the items."""
        return replace(self, condition=condition)

    def promoted(self) -> Aggregate:
        """Sums of integers as reals, right beyond 64 bits."""
        return replace(self, promote=True)

    def compile(self) -> DataFrame:
        if not self.items:
            raise E.AggregateProjectionEmpty
        for k in self.keys:
            if not isinstance(k, (X.Col, X.Lit)):
                raise E.AggregateExprOnlyColOrLit
        for i in self.items:
            if i.function == "value":
                if not self.keys:
                    raise E.NonAggregateRequiresGroupBy
                if i.argument not in self.keys:
                    raise E.NonAggregateMustAppearInGroupBy
        if not self.keys and not any(i.function != "value" for i in self.items):
            raise E.AggregateRequiresGroupByOrFunctions
        df, columns, rowid = self.scan.base()
        df, outputs = grouped(df, X.resolver(columns), list(self.items), list(self.keys), rowid, self.promote)
        if self.condition is not None:
            df = df.where(X.predicate(self.condition, X.resolver(outputs)))
        return df.select(*[v.column for v in outputs])

    def for_each(self, callback: Callable[[Row], object]) -> None:
        rows_of(self.compile(), callback)


def grouped(df: DataFrame, find: X.Resolve, items: list[X.AggExpr], keys: list[X.Expr], rowid: Column | None, promote: bool = False) -> tuple[DataFrame, list[V.Value]]:
    """One row a group with columns a0, a1, ... (and _first, the least row number, where there is one)."""
    key_values = [X.value(k, find) for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    aggs, outputs = [], []
    for n, item in enumerate(items):
        if item.function == "value":
            at = keys.index(item.argument)
            if key_values[at].kind == "mixed":
                aggs.append(F.first(key_values[at].column).alias(f"a{n}"))
                outputs.append(V.Value(F.col(f"a{n}"), "mixed"))
            else:
                outputs.append(V.Value(F.col(names[at]), key_values[at].kind))
        else:
            v = X.aggregate(item, find, promote)
            aggs.append(v.column.alias(f"a{n}"))
            outputs.append(V.Value(F.col(f"a{n}"), v.kind))
    if rowid is not None and keys:
        aggs.append(F.min(rowid).alias("_first"))
    if not aggs:
        aggs.append(F.count(F.lit(1)).alias("_n"))
    if not keys:
        return df.agg(*aggs), outputs
    out = df.groupBy(*[V.group_key(v).alias(n) for v, n in zip(key_values, names, strict=True)]).agg(*aggs)
    if rowid is not None:
        out = out.orderBy("_first")
    return out, outputs


class JoinType(Enum):
    INNER = "inner"
    LEFT = "left"


class JoinStrategy(Enum):
    """Hints: Spark keeps the right to another way, and spills where memory ends."""

    AUTO = None
    HASH = "shuffle_hash"
    HASH_JOIN = "shuffle_hash"  # another name of HASH
    INDEX_NESTED_LOOP = "broadcast"
    INDEX_MERGE = "merge"
    NESTED_LOOP_SCAN = "_"


#: Right sides are broadcast on request only up to this estimated size.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class JoinKey:
    index: int | None

    @classmethod
    def col(cls, index: int) -> JoinKey:
        return cls(index)

    @classmethod
    def rowid(cls) -> JoinKey:
        return cls(None)


@dataclass(frozen=True)
class JoinOrderBy:
    left: bool
    index: int
    descending: bool = False


def left_asc(index: int) -> JoinOrderBy:
    return JoinOrderBy(True, index)


def left_desc(index: int) -> JoinOrderBy:
    return JoinOrderBy(True, index, True)


def right_asc(index: int) -> JoinOrderBy:
    return JoinOrderBy(False, index)


def right_desc(index: int) -> JoinOrderBy:
    return JoinOrderBy(False, index, True)


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def joined(left: DataFrame, right: DataFrame, a: V.Value, b: V.Value, kind: JoinType, strategy: JoinStrategy = JoinStrategy.AUTO) -> DataFrame:
    condition = V.join_on(a, b)
    if condition is None:  # values of these kinds are never equal
        if kind is JoinType.INNER:
            return left.where(F.lit(False)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
        return left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    hint = strategy.value
    if hint == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES:
        hint = None
    if hint and hint != "_":
        right = right.hint(hint)
    return left.join(right, condition, kind.value)


@dataclass(frozen=True)
class Join:
    left_scan: Scan
    right_scan: Scan
    kind: JoinType
    keys: tuple[JoinKey, JoinKey] | None = None
    how: JoinStrategy = JoinStrategy.AUTO
    left_columns: tuple[int, ...] | None = None
    right_columns: tuple[int, ...] | None = None
    order: tuple[JoinOrderBy, ...] = ()

    @classmethod
    def inner(cls, left: Scan, right: Scan) -> Join:
        return cls(left, right, JoinType.INNER)

    @classmethod
    def left(cls, left: Scan, right: Scan) -> Join:
        return cls(left, right, JoinType.LEFT)

    def on(self, left: JoinKey, right: JoinKey) -> Join:
        return replace(self, keys=(left, right))

    def strategy(self, how: JoinStrategy) -> Join:
        if not isinstance(how, JoinStrategy):
            raise E.UnsupportedJoinStrategy(str(how))
        return replace(self, how=how)

    def hash_mem_limit(self, _bytes: int) -> Join:
        """Without effect: Spark spills."""
        return self

    def project_left(self, columns: Sequence[int]) -> Join:
        return replace(self, left_columns=tuple(columns))

    def project_right(self, columns: Sequence[int]) -> Join:
        return replace(self, right_columns=tuple(columns))

    def order_by(self, order: Sequence[JoinOrderBy]) -> Join:
        return replace(self, order=tuple(order))

    def compile(self) -> DataFrame:
        """Left columns, then right ones; with row numbers also _left_rowid and _right_rowid (0 for none)."""
        if self.keys is None:
            raise E.MissingJoinCondition
        left, l_cols, l_id = self.left_scan.base("l")
        right, r_cols, r_id = self.right_scan.base("r")

        def key(k: JoinKey, columns: list[V.Value], rowid: Column | None) -> V.Value:
            if k.index is not None:
                return X.resolver(columns)(k.index)
            if rowid is None:
                raise E.UnsupportedJoinKeyType("the table has no row number")
            return V.Value(rowid, "integer")

        a, b = key(self.keys[0], l_cols, l_id), key(self.keys[1], r_cols, r_id)
        if self.keys[1].index is None and a.kind != "integer":  # only integers are row numbers
            a = V.Value(a.column["i"], "integer") if a.kind == "mixed" else V.Value(F.lit(None).cast("long"), "integer")
        df = joined(left, right, a, b, self.kind, self.how)
        if self.order:
            keys: list[Column] = []
            for o in self.order:
                cols = l_cols if o.left else r_cols
                if not 0 <= o.index < len(cols):
                    raise E.InvalidOrderByColumn(o.index)
                keys += V.sort_keys(cols[o.index], o.descending)
            df = df.orderBy(*keys, *[c for c in (l_id, r_id) if c is not None])
        ln, rn = self.left_scan.table.columns, self.right_scan.table.columns
        find_l, find_r = X.resolver(l_cols), X.resolver(r_cols)
        out = [find_l(i).column.alias(ln[i]) for i in (range(len(ln)) if self.left_columns is None else self.left_columns)]
        out += [find_r(i).column.alias(rn[i]) for i in (range(len(rn)) if self.right_columns is None else self.right_columns)]
        if l_id is not None:
            out.append(l_id.alias("_left_rowid"))
        if r_id is not None:
            out.append(F.coalesce(r_id, F.lit(0)).alias("_right_rowid"))
        return df.select(*out)

    def explain(self) -> str:
        """The join's node in Spark's plan."""
        plan = self.compile()._jdf.queryExecution().executedPlan().toString()
        names = ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
        return next((n for line in plan.splitlines() for n in names if n in line), "None")

    def for_each(self, callback: Callable[[Row], object]) -> None:
        rows_of(self.compile(), callback)

"""Registered queries over the test tables: one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.errors import SourceError
from lumora.operators import expr as X
from lumora.operators.table import Join, JoinKey, JoinStrategy, Scan, Table, left_asc, right_desc
from lumora.session import Engine


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Sums of reals depend on their order in the last digits."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _sql(text: str, oracle: str | None = None, rounded: bool = False, strategy: JoinStrategy = JoinStrategy.AUTO, **options) -> Entry:
    """A query in the dialect; oracle: where DuckDB needs other words for the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(spark, sf_dir, **options).query(text, strategy)
        return _rounded(df) if rounded else df

    return Entry(run, oracle or text)


def _built(build: Callable[[Callable[[str], Scan]], DataFrame], oracle: str) -> Entry:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, sf_dir)
        return build(lambda name: engine.table(name).scan())

    return Entry(run, oracle)


def _at(scan: Scan, *names: str) -> list[int]:
    return [scan.table.columns.index(n) for n in names]


LINE = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity"
JOINED = "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer AS c {kind} JOIN orders AS o ON c.c_custkey = o.o_custkey"
FLAGSHIP = (
    "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey "
    "WHERE o.o_totalprice > 1000 AND c.c_acctbal > 0 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 100"
)


def _left_some(scan: Callable[[str], Scan], strategy: JoinStrategy = JoinStrategy.AUTO) -> DataFrame:
    """Customers, and their orders above a price: many customers have none."""
    c, o = scan("customer"), scan("orders")
    key, price, order = _at(o, "o_custkey", "o_totalprice", "o_orderkey")
    o = o.filter(X.col(price).gt(X.lit_f64(400000.0)))
    return Join.left(c, o).on(JoinKey.col(_at(c, "c_custkey")[0]), JoinKey.col(key)).strategy(strategy).project_left(_at(c, "c_custkey", "c_name")).project_right([order, price]).compile()


def _with_nulls(scan: Callable[[str], Scan]) -> Scan:
    """orders with a null status where it is F, and a null customer where the key ends in 0."""
    return Scan(Table("orders", _nulled(scan("orders").table.df)))


def _nulled(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("o_orderstatus"), "o_totalprice")


NULLED = "(SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_totalprice FROM orders)"


def _filtered(predicate: Callable[[list[int]], X.Expr]) -> Callable[[Callable[[str], Scan]], DataFrame]:
    def build(scan: Callable[[str], Scan]) -> DataFrame:
        s = _with_nulls(scan)
        return s.filter(predicate(_at(s, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))).project([0, 1, 2]).compile()

    return build


def _grouped_nulls(scan: Callable[[str], Scan]) -> DataFrame:
    s = _with_nulls(scan)
    df = s.aggregate([X.group(X.col(2)), X.count_star(), X.count(X.col(1)), X.min_(X.col(0)), X.max_(X.col(0))]).group_by([X.col(2)]).compile()
    return df.toDF("status", "n", "n_cust", "lo", "hi")


def _having_built(scan: Callable[[str], Scan]) -> DataFrame:
    s = scan("lineitem")
    supp, qty = _at(s, "l_suppkey", "l_quantity")
    df = s.aggregate([X.group(X.col(supp)), X.sum_(X.col(qty)), X.count_star()]).group_by([X.col(supp)]).having(X.col(2).gt(X.lit_i64(20)).and_(X.col(1).lt(X.lit_f64(20000.0)))).compile()
    return df.toDF("l_suppkey", "qty", "n")


def _input_limit(scan: Callable[[str], Scan]) -> DataFrame:
    s = scan("nation").order_by([X.asc(0)]).limit(10)
    return s.aggregate([X.count_star(), X.sum_(X.col(0)), X.avg(X.col(0))]).compile().toDF("n", "s", "a")


def _udf(scan: Callable[[str], Scan]) -> DataFrame:
    s = scan("part")
    return s.filter_fn(lambda r: r.p_size % 7 == 3 and r.p_brand.endswith("3")).project(_at(s, "p_partkey", "p_size", "p_brand")).compile()


def _batches(scan: Callable[[str], Scan]) -> DataFrame:
    s = scan("part")
    return s.filter_batch(lambda b: pc.and_(pc.ends_with(b["p_brand"], "3"), pc.greater(b["p_size"], 40))).project(_at(s, "p_partkey", "p_size", "p_brand")).compile()


def _ordered_scan(scan: Callable[[str], Scan]) -> DataFrame:
    s = scan("customer")
    bal, key = _at(s, "c_acctbal", "c_custkey")
    return s.filter(X.col(bal).ge(X.lit_f64(0.0)).not_()).order_by([X.desc(bal), X.asc(key)]).limit(50).project([key, bal]).compile()


def _join_sides(scan: Callable[[str], Scan]) -> DataFrame:
    c, o = scan("customer"), scan("orders")
    ck, ok, oc = *_at(c, "c_custkey"), *_at(o, "o_orderkey", "o_custkey")
    c = c.filter(X.col(ck).le(X.lit_i64(300)))
    o = o.order_by([X.asc(ok)]).limit(500)
    return Join.inner(c, o).on(JoinKey.col(ck), JoinKey.col(oc)).order_by([left_asc(ck), right_desc(ok)]).project_left([ck]).project_right([ok]).compile()


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).query("SELECT o_orderkey FROM orders WHERE o_orderkey = 'x' OR o_orderstatus != 7 OR o_orderstatus > 1")


def _null_key_join(scan: Callable[[str], Scan]) -> DataFrame:
    o, c = _with_nulls(scan), scan("customer")
    return Join.left(o, c).on(JoinKey.col(1), JoinKey.col(0)).project_left([0, 1]).project_right([1]).compile()


def _overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums far beyond 64 bits, as reals; all terms are multiples of 2**60, so they are exact."""
    engine = Engine(spark, sf_dir, promote_sums=True)
    t = engine.table("nation")
    engine.register("big", t.df.select(F.col("n_regionkey"), F.lit(1 << 62).cast("long").alias("v")))
    return engine.query("SELECT n_regionkey, SUM(v) AS s FROM big GROUP BY n_regionkey")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).schema().select("type", "name")


def _registered(make: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]], text: str, oracle: str) -> Entry:
    """A query over tables that are derived from those of the folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, sf_dir)
        for name, df in make(lambda n: engine.table(n).df).items():
            engine.register(name, df)
        return engine.query(text)

    return Entry(run, oracle)


def _file_dir(spark: SparkSession) -> str:
    """Where all executors can open a file: the shared folder, if it is one of the file system."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if base.startswith("file:"):
        return "/" + base.removeprefix("file:").lstrip("/")
    if base.startswith("/"):
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise SourceError("a SQLite file needs a shared folder of the file system in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="lumora-")


def _sqlite(query: Callable[[Engine], DataFrame], oracle: str) -> Entry:
    """Over a SQLite file with nation and region, two tables of fixed size, in the order of their keys; `mixed` has values of all classes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = Engine(spark, sf_dir)
        nation, region = ([tuple(r) for r in source.table(t).df.collect()] for t in ("nation", "region"))
        folder = _file_dir(spark)
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"lumora-{uuid.uuid4().hex}.db")
        con = sqlite3.connect(path)
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER, n_real REAL)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?, ?)", [(k, n, r, r + 0.0) for k, n, r in sorted(nation)])
        con.execute("CREATE TABLE region (r_regionkey INTEGER, r_name TEXT)")
        con.executemany("INSERT INTO region VALUES (?, ?)", sorted(region))
        con.execute("CREATE TABLE mixed (k INTEGER, v)")
        con.executemany("INSERT INTO mixed VALUES (?, ?)", [(k, (None, k, k + 0.5, n)[k % 4]) for k, n, _ in sorted(nation)])
        con.commit()
        con.close()
        return query(Engine(spark, path))

    return Entry(run, oracle)


def _row_join(kind: Callable[..., Join], column: str) -> Callable[[Engine], DataFrame]:
    """Nations with the region of the row number that a column names."""

    def query(engine: Engine) -> DataFrame:
        n, r = engine.table("nation").scan(), engine.table("region").scan()
        df = kind(n, r).on(JoinKey.col(_at(n, column)[0]), JoinKey.rowid()).project_left(_at(n, "n_name")).project_right(_at(r, "r_name")).compile()
        return df.withColumnsRenamed({"_left_rowid": "l", "_right_rowid": "r"})

    return query


def _keys_of(left: str, right: str) -> Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]:
    return lambda t: {"a": t("nation").selectExpr(f"{left} AS k", "n_name"), "b": t("nation").selectExpr(f"{right} AS k", "n_name")}


KEYED = "SELECT a.n_name AS a_name, b.n_name AS b_name FROM a JOIN b ON a.k = b.k"


ENTRIES: dict[str, Entry] = {
    # projection
    "scan_project": _sql("SELECT o_orderkey, o_totalprice FROM orders"),
    "scan_project_reorder_dup": _sql("SELECT o_totalprice, o_orderkey, o_totalprice AS price_again FROM orders"),
    "scan_wildcard": _sql("SELECT * FROM nation"),
    "scan_qualified_wildcard": _sql("SELECT r.*, r.r_name AS again FROM region AS r"),
    "scan_join_wildcard": _sql("SELECT n.*, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey"),
    # predicates
    "filter_eq": _sql(LINE + " = 10"),
    "filter_ne": _sql(LINE + " != 10"),
    "filter_lt": _sql(LINE + " < 10"),
    "filter_le": _sql(LINE + " <= 10"),
    "filter_gt": _sql(LINE + " > 40.5"),
    "filter_ge": _sql(LINE + " >= 40"),
    "filter_literal_left": _sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE 45 < l_quantity AND -1 < l_tax"),
    "filter_and_or_not": _sql("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE (l_returnflag = 'A' OR l_returnflag = 'N') AND NOT (l_linestatus = 'O')"),
    "filter_col_col": _sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount AND NOT (l_returnflag = 'R')"),
    "filter_in": _sql("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 13, 50)"),
    "filter_not_in": _sql("SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 7, 13, 50)"),
    "filter_not_in_null": _sql("SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)"),
    "filter_between": _sql("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "filter_not_between": _sql("SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 300000"),
    "filter_like_prefix": _sql("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'pRoMo%'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'promo%'"),
    "filter_like_underscore": _sql("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '_-h%'", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority ILIKE '_-h%'"),
    "filter_not_like": _sql("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%a%'", "SELECT p_partkey FROM part WHERE NOT (p_name ILIKE '%a%')"),
    "filter_is_null": _built(_filtered(lambda c: X.col(c[2]).is_null()), f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {NULLED} t WHERE o_orderstatus IS NULL"),
    "filter_is_not_null": _built(_filtered(lambda c: X.col(c[1]).is_not_null()), f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {NULLED} t WHERE o_custkey IS NOT NULL"),
    "filter_three_valued": _built(_filtered(lambda c: X.col(c[2]).eq(X.lit_bytes("O")).or_(X.col(c[1]).lt(X.lit_i64(50)))), f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {NULLED} t WHERE o_orderstatus = 'O' OR o_custkey < 50"),
    "filter_not_null_comparison": _built(_filtered(lambda c: X.col(c[2]).eq(X.lit_bytes("O")).not_()), f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {NULLED} t WHERE NOT (o_orderstatus = 'O')"),
    "filter_mixed_type_false": Entry(_mixed, "SELECT o_orderkey FROM orders WHERE FALSE"),
    "filter_udf": _built(_udf, "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size % 7 = 3 AND p_brand LIKE '%3'"),
    "filter_time_ge": _sql("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= '1996-06-01'"),
    "filter_time_not_between": _sql("SELECT o_orderkey FROM orders WHERE o_orderdate NOT BETWEEN '1994-01-01' AND '1996-12-31 12:00:00'"),
    "filter_time_columns": _sql("SELECT o.o_orderkey, l.l_linenumber FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate < o.o_orderdate"),
    "filter_batch": _built(_batches, "SELECT p_partkey, p_size, p_brand FROM part WHERE p_brand LIKE '%3' AND p_size > 40"),
    # aggregates
    "agg_global": _sql(
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS n_tax, SUM(l_linenumber) AS s, SUM(l_extendedprice) AS price, AVG(l_quantity) AS q, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem",
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS n_tax, CAST(SUM(l_linenumber) AS BIGINT) AS s, round(SUM(l_extendedprice), 2) AS price, round(AVG(l_quantity), 2) AS q, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem",
        rounded=True,
    ),
    "agg_global_empty": _sql(
        "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, SUM(o_custkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderkey) AS lo, MAX(o_orderstatus) AS hi FROM orders WHERE FALSE",
        "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderkey) AS lo, MAX(o_orderstatus) AS hi FROM orders WHERE FALSE",
    ),
    "agg_count_literals": _sql("SELECT COUNT(1) AS ones, COUNT(NULL) AS nothing FROM nation"),
    "agg_group": _sql("SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_group_multi": _sql(
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_discount) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS q, round(AVG(l_discount), 2) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
        rounded=True,
    ),
    "agg_group_null_key": _built(_grouped_nulls, f"SELECT o_orderstatus AS status, COUNT(*) AS n, COUNT(o_custkey) AS n_cust, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM {NULLED} t GROUP BY o_orderstatus"),
    "agg_group_literal": _sql("SELECT COUNT(*) AS n FROM nation GROUP BY 1", "SELECT COUNT(*) AS n FROM nation GROUP BY 'x'"),
    "agg_having": _sql("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "agg_having_hidden": _sql("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 450000 AND NOT (COUNT(*) < 3)"),
    "agg_having_group_key": _sql("SELECT SUM(o_orderkey) AS s FROM orders GROUP BY o_orderstatus HAVING o_orderstatus = 'F' OR o_orderstatus IS NULL", "SELECT CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus HAVING o_orderstatus = 'F' OR o_orderstatus IS NULL"),
    "agg_having_built": _built(_having_built, "SELECT l_suppkey, SUM(l_quantity) AS qty, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 20 AND SUM(l_quantity) < 20000"),
    "agg_order_alias": _sql("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3"),
    "agg_order_hidden_topk": _sql("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY MAX(o_totalprice) DESC, o_custkey LIMIT 128"),
    "agg_distinct": _sql("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey"),
    "agg_input_limit": _built(_input_limit, "SELECT COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS s, AVG(n_nationkey) AS a FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10) t"),
    "sum_overflow_promotes": Entry(_overflow, "SELECT n_regionkey, CAST(SUM(CAST(4611686018427387904 AS HUGEINT)) AS DOUBLE) AS s FROM nation GROUP BY n_regionkey"),
    # order and limits
    "sort_multi": _sql("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey LIMIT 100"),
    "sort_ordinal": _sql("SELECT c_name, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 20"),
    "sort_unprojected": _sql("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20"),
    "sort_alias": _sql("SELECT p_partkey AS k, p_retailprice AS r FROM part ORDER BY r DESC, k LIMIT 15"),
    "sort_built": _built(_ordered_scan, "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0) ORDER BY c_acctbal DESC, c_custkey LIMIT 50"),
    "topk": _sql("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 200"),
    "limit_offset": _sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200"),
    "limit_comma": _sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200, 50", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200"),
    "offset_only": _sql("SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20"),
    "limit_zero": _sql("SELECT o_orderkey FROM orders LIMIT 0"),
    "sort_nulls_ascending": _registered(lambda t: {"t": _nulled(t("orders"))}, "SELECT o_orderkey, o_orderstatus FROM t ORDER BY o_orderstatus, o_orderkey DESC LIMIT 8000", f"SELECT o_orderkey, o_orderstatus FROM {NULLED} t ORDER BY o_orderstatus ASC NULLS FIRST, o_orderkey DESC LIMIT 8000"),
    "sort_nulls_descending": _registered(lambda t: {"t": _nulled(t("orders"))}, "SELECT o_orderkey, o_custkey FROM t ORDER BY o_custkey DESC, o_orderkey LIMIT 14000", f"SELECT o_orderkey, o_custkey FROM {NULLED} t ORDER BY o_custkey DESC NULLS LAST, o_orderkey LIMIT 14000"),
    # distinct
    "distinct_single": _sql("SELECT DISTINCT p_brand FROM part"),
    "distinct_multi": _sql("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_order_limit": _sql("SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 10 OFFSET 2"),
    "distinct_order_unprojected": _sql(
        "SELECT DISTINCT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40",
        "SELECT o_custkey FROM (SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40",
    ),
    "distinct_high_card": _sql("SELECT DISTINCT c_name FROM customer"),
    # joins
    "join_inner": _sql(JOINED.format(kind="INNER")),
    "join_inner_where_pushdown": _sql(JOINED.format(kind="INNER") + " WHERE o.o_totalprice >= 200000 AND c.c_acctbal > 5000"),
    "join_left": _built(_left_some, "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey"),
    "join_left_residual": _sql("SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice IS NULL OR o.o_totalprice >= 300000"),
    "join_left_null_key": _built(_null_key_join, f"SELECT o.o_orderkey, o.o_custkey, c.c_name FROM {NULLED} o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_self": _sql("SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey"),
    "join_int_real_key": _sql("SELECT p.p_partkey, l.l_orderkey, l.l_linenumber FROM part AS p JOIN lineitem AS l ON p.p_partkey = l.l_quantity"),
    "join_text_number_key": _sql("SELECT n.n_name, r.r_name FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_name", "SELECT n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation"),
    "join_broadcast": _sql(JOINED.format(kind="INNER"), strategy=JoinStrategy.INDEX_NESTED_LOOP),
    "join_merge": _sql(JOINED.format(kind="INNER"), strategy=JoinStrategy.INDEX_MERGE),
    "join_shuffle_hash": _sql(JOINED.format(kind="INNER"), strategy=JoinStrategy.HASH),
    "join_nested_loop": _sql(JOINED.format(kind="INNER"), strategy=JoinStrategy.NESTED_LOOP_SCAN),
    "join_left_merge": _built(lambda s: _left_some(s, JoinStrategy.INDEX_MERGE), "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey"),
    "join_keys_beyond_2_53": _registered(_keys_of("n_nationkey + 9007199254740992L", "n_nationkey + 9007199254740993L"), KEYED, "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1"),
    "join_negative_zero": _registered(_keys_of("if(n_nationkey < 3, -0.0D, n_nationkey)", "if(n_nationkey < 2, 0.0D, -1 - n_nationkey)"), KEYED, "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < 3 AND b.n_nationkey < 2"),
    "join_nan": _registered(_keys_of(*["if(n_regionkey = 0, double('NaN'), n_nationkey)"] * 2), KEYED, "SELECT n_name AS a_name, n_name AS b_name FROM nation WHERE n_regionkey <> 0"),
    "join_distinct_order_unprojected": _sql(
        "SELECT DISTINCT c.c_nationkey FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey ORDER BY o.o_totalprice DESC LIMIT 7",
        "SELECT c_nationkey FROM (SELECT c_nationkey, max(o_totalprice) AS m FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey) t ORDER BY m DESC LIMIT 7",
    ),
    "join_distinct": _sql("SELECT DISTINCT c.c_nationkey, o.o_orderstatus FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey"),
    "join_topk": _sql(FLAGSHIP),
    "join_in_between_like": _sql(
        "SELECT c.c_name, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey IN (1, 2, 4) AND o.o_totalprice BETWEEN 1000 AND 90000 AND o.o_orderpriority LIKE '1-%'",
    ),
    "join_limited_sides": _built(
        _join_sides,
        "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_custkey <= 300) c JOIN (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) o ON c.c_custkey = o.o_custkey",
    ),
    # SQLite files
    "sqlite_scan": _sqlite(lambda e: e.query("SELECT * FROM nation WHERE n_real >= 2 AND n_name LIKE '%a%'"), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_regionkey AS DOUBLE) AS n_real FROM nation WHERE n_regionkey >= 2 AND n_name ILIKE '%a%'"),
    "sqlite_row_lookup": _sqlite(lambda e: e.table("nation").df.where("_rowid = 7").select("_rowid", "n_name").toDF("r", "n_name"), "SELECT CAST(n_nationkey + 1 AS BIGINT) AS r, n_name FROM nation WHERE n_nationkey = 6"),
    "sqlite_row_join": _sqlite(_row_join(Join.inner, "n_regionkey"), "SELECT n_name, r_name, CAST(n_nationkey + 1 AS BIGINT) AS l, CAST(n_regionkey AS BIGINT) AS r FROM nation JOIN region ON r_regionkey + 1 = n_regionkey"),
    "sqlite_row_join_left": _sqlite(_row_join(Join.left, "n_regionkey"), "SELECT n_name, r_name, CAST(n_nationkey + 1 AS BIGINT) AS l, CAST(CASE WHEN r_name IS NULL THEN 0 ELSE n_regionkey END AS BIGINT) AS r FROM nation LEFT JOIN region ON r_regionkey + 1 = n_regionkey"),
    "sqlite_row_join_real_key": _sqlite(_row_join(Join.left, "n_real"), "SELECT n_name, CAST(NULL AS VARCHAR) AS r_name, CAST(n_nationkey + 1 AS BIGINT) AS l, CAST(0 AS BIGINT) AS r FROM nation"),
    "sqlite_mixed_order": _sqlite(lambda e: e.query("SELECT k FROM mixed ORDER BY v DESC, k LIMIT 17"), "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation ORDER BY CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END DESC, CASE WHEN n_nationkey % 4 = 3 THEN n_name END DESC, n_nationkey + CASE WHEN n_nationkey % 4 = 2 THEN 0.5 ELSE 0 END DESC LIMIT 17"),
    "sqlite_mixed_filter": _sqlite(lambda e: e.query("SELECT k FROM mixed WHERE v > 9 OR v = 5"), "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey % 4 IN (1, 2) AND (n_nationkey > 8.6 AND NOT (n_nationkey = 9) OR n_nationkey = 5)"),
    "sqlite_mixed_extremes": _sqlite(lambda e: e.query("SELECT COUNT(v) AS n, SUM(v) AS s FROM mixed"), "SELECT COUNT(*) AS n, SUM(CASE n_nationkey % 4 WHEN 1 THEN n_nationkey WHEN 2 THEN n_nationkey + 0.5 ELSE 0 END)::DOUBLE AS s FROM nation WHERE n_nationkey % 4 <> 0"),
    "sqlite_first_seen_groups": _sqlite(lambda e: e.query("SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS lo FROM nation GROUP BY n_regionkey LIMIT 3"), "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n, MIN(n_name) AS lo FROM nation GROUP BY n_regionkey ORDER BY MIN(n_nationkey) LIMIT 3"),
    "sqlite_distinct_first": _sqlite(lambda e: e.query("SELECT DISTINCT n_regionkey FROM nation LIMIT 2 OFFSET 1"), "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation GROUP BY n_regionkey ORDER BY MIN(n_nationkey) LIMIT 2 OFFSET 1"),
    "sqlite_limit_in_row_order": _sqlite(lambda e: e.query("SELECT n_name FROM nation LIMIT 5 OFFSET 4"), "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 4"),
    "sqlite_typed": _sqlite(lambda e: e.typed("nation", {"n_name": "text", "n_real": "real"}, allow_extra=True), "SELECT n_name, CAST(n_regionkey AS DOUBLE) AS n_real FROM nation"),
    "sqlite_schema": _sqlite(lambda e: e.query("SELECT name, rootpage FROM sqlite_schema WHERE type = 'table'"), "SELECT name, CAST(rootpage AS BIGINT) AS rootpage FROM (VALUES ('nation', 2), ('region', 3), ('mixed', 4)) t(name, rootpage)"),
    # catalogue
    "schema_listing": Entry(
        _listing,
        "SELECT 'table' AS type, name FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) t(name)",
    ),
}

QUERIES = {name: e.run for name, e in ENTRIES.items()}
ORACLE_SQL = {name: e.sql for name, e in ENTRIES.items() if e.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).query(FLAGSHIP)

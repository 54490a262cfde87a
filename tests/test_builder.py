"""Builder operators, join strategies, and value semantics."""

import math
import random
import sqlite3

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lumora import errors as E
from lumora.functions import values as V
from lumora.operators import expr as X
from lumora.operators.table import Join, JoinKey, JoinStrategy, Table, left_asc, right_asc, right_desc
from lumora.plans import catalog
from lumora.session import Engine

SMALL = "/root/testdata/sf0.001"


def table(spark, name, schema, rows, numbered=True):
    if numbered:
        return Table(name, spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "_rowid long, " + schema))
    return Table(name, spark.createDataFrame(rows, schema))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def items(spark):
    return table(spark, "items", "grp string, val long", [("a", 1), ("a", None), ("b", 2), ("b", 2), (None, 5), (None, None)])


def test_scan(items):
    s = items.scan()
    assert rows(s.project([1, 0]).filter(X.col(1).ge(X.lit_i64(2))).order_by([X.desc(1), X.asc(0)]).compile()) == [(5, None), (2, "b"), (2, "b")]
    assert rows(s.filter(X.col(0).is_null() | X.col(1).is_null()).project([0, 1]).compile()) == [("a", None), (None, 5), (None, None)]
    assert rows(s.filter(X.col(1).eq(X.lit_null())).compile()) == []
    assert rows(s.filter(X.col(0)).compile()) == []
    assert rows(s.filter(X.col(0).like(X.lit_bytes("A%"))).project([1]).compile()) == [(1,), (None,)]
    assert rows(s.filter_fn(lambda r: r.val == 2).compile()) == [("b", 2), ("b", 2)]
    assert rows(s.filter_batch(lambda b: pc.greater_equal(b["val"], 2)).project([1]).compile()) == [(2,), (2,), (5,)]
    assert rows(s.filter_batch(lambda b: b["val"]).filter(X.col(1).eq(X.lit_i64(5))).project([1]).compile()) == [(5,)]
    assert rows(s.limit(0).compile()) == []
    seen = []
    s.order_by([X.asc(0)]).limit(3).for_each(lambda r: seen.append(tuple(r)))
    assert seen == [(None, 5), (None, None), ("a", 1)]
    with pytest.raises(E.InvalidColumnIndex):
        s.project([7]).compile()


def test_aggregate(items, spark):
    s = items.scan()
    every = [X.group(X.col(0)), X.count_star(), X.count(X.col(1)), X.sum_(X.col(1)), X.avg(X.col(1)), X.min_(X.col(1)), X.max_(X.col(1))]
    assert rows(s.aggregate(every).group_by([X.col(0)]).compile()) == [("a", 2, 1, 1, 1.0, 1, 1), ("b", 2, 2, 4, 2.0, 2, 2), (None, 2, 1, 5, 5.0, 5, 5)]
    assert rows(s.filter(X.col(1).gt(X.lit_i64(99))).aggregate(every[1:]).compile()) == [(0, 0, None, None, None, None)]
    assert rows(s.aggregate(every[:2]).group_by([X.col(0)]).having(X.col(0).is_null()).compile()) == [(None, 2)]
    assert rows(s.aggregate([X.sum_(X.col(0)), X.count(X.lit_null()), X.count(X.lit_i64(1))]).compile()) == [(None, 0, 6)]
    with pytest.raises(E.AggregateProjectionEmpty):
        s.aggregate([]).compile()
    with pytest.raises(E.NonAggregateRequiresGroupBy):
        s.aggregate([X.group(X.col(0))]).compile()
    with pytest.raises(E.NonAggregateMustAppearInGroupBy):
        s.aggregate([X.group(X.col(1))]).group_by([X.col(0)]).compile()
    with pytest.raises(E.AggregateExprOnlyColOrLit):
        X.sum_(X.col(0).eq(X.col(1)))


CASES = {
    "one to one": ([1, 2, 3], [2, 3, 4]),
    "many to many": ([1, 1, 2, 2, None], [2, 2, 1, None, 3]),
    "no match": ([1], [2]),
    "empty": ([], [1]),
    "nulls": ([None, None], [None]),
}


@pytest.mark.parametrize("case", CASES)
def test_join_strategies_agree(spark, case):
    left, right = (table(spark, n, "k long, v long", [(k, i) for i, k in enumerate(ks)]) for n, ks in zip("lr", CASES[case], strict=True))
    for join, outer in ((Join.inner, False), (Join.left, True)):
        want = sorted((a, i, b, j) for i, a in enumerate(CASES[case][0]) for j, b in enumerate(CASES[case][1]) if a == b and a is not None)
        if outer:
            want += [(a, i, None, None) for i, a in enumerate(CASES[case][0]) if a is None or a not in CASES[case][1]]
        for how in JoinStrategy:
            got = [r[:4] for r in rows(join(left.scan(), right.scan()).on(JoinKey.col(0), JoinKey.col(0)).strategy(how).hash_mem_limit(1).compile())]
            assert sorted(got, key=repr) == sorted(want, key=repr), how


def test_join_order_projection_and_row_numbers(spark):
    left = table(spark, "l", "k long, name string", [(1, "bob"), (2, "alice")])
    right = table(spark, "r", "k long, score long, tag string", [(1, 5, "x"), (1, 3, "y"), (2, 4, "z")])
    j = Join.inner(left.scan(), right.scan()).on(JoinKey.col(0), JoinKey.col(0))
    assert [r[:2] for r in rows(j.project_left([1]).project_right([2]).order_by([left_asc(1), right_asc(1)]).compile())] == [("alice", "z"), ("bob", "y"), ("bob", "x")]
    assert [r[0] for r in rows(j.project_left([]).project_right([1]).order_by([right_desc(1)]).compile())] == [5, 4, 3]
    by_row = Join.left(left.scan(), right.scan().filter(X.col(1).lt(X.lit_i64(5)))).on(JoinKey.col(0), JoinKey.rowid()).project_left([0]).project_right([2])
    assert rows(by_row.order_by([left_asc(0)]).compile()) == [(1, None, 1, 0), (2, "y", 2, 2)]
    reals = table(spark, "f", "k double", [(1.0,), (2.0,)])
    assert Join.inner(reals.scan(), right.scan()).on(JoinKey.col(0), JoinKey.rowid()).compile().count() == 0
    assert rows(Join.left(reals.scan(), right.scan()).on(JoinKey.col(0), JoinKey.rowid()).project_right([2]).compile()) == [(1.0, None, 1, 0), (2.0, None, 2, 0)]
    assert JoinStrategy.HASH_JOIN is JoinStrategy.HASH
    with pytest.raises(E.UnsupportedJoinStrategy):
        j.strategy("hash")
    with pytest.raises(E.MissingJoinCondition):
        Join.inner(left.scan(), right.scan()).compile()
    with pytest.raises(E.InvalidOrderByColumn):
        j.order_by([left_asc(9)]).compile()


def test_join_keys(spark):
    pair = lambda kind, a, b: [table(spark, "l", f"k {kind[0]}", [(x,) for x in a]), table(spark, "r", f"k {kind[1]}", [(x,) for x in b])]
    count = lambda kind, a, b: Join.inner(*(t.scan() for t in pair(kind, a, b))).on(JoinKey.col(0), JoinKey.col(0)).compile().count()
    assert count(("long", "long"), [2**53], [2**53 + 1]) == 0
    assert count(("double", "double"), [-0.0], [0.0]) == 1
    assert count(("double", "double"), [math.nan], [math.nan]) == 0
    assert count(("long", "double"), [2, 3], [2.0, 3.5]) == 1
    assert count(("string", "string"), ["a" * 64, "b"], ["a" * 64]) == 1
    assert count(("string", "long"), ["1"], [1]) == 0


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    engine = Engine(spark, SMALL)
    p = plan(engine.query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 5"))
    assert "TakeOrderedAndProject" in p and "PushedFilters: [IsNotNull(o_totalprice)" in p and "o_comment" not in p
    key = JoinKey.col(0)
    scans = [engine.table("customer").scan(), engine.table("orders").scan()]
    names = {how: Join.inner(*scans).on(key, JoinKey.col(1)).strategy(how).explain() for how in JoinStrategy}
    assert names[JoinStrategy.INDEX_MERGE] == "SortMergeJoin" and names[JoinStrategy.HASH] == "ShuffledHashJoin" and names[JoinStrategy.INDEX_NESTED_LOOP] == "BroadcastHashJoin"


def test_three_valued_comparisons_with_nan(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (None, 1.0), (2.0, 1.0), (math.nan, None)], "a double, b double")
    a, b = V.Value(F.col("a"), "real"), V.Value(F.col("b"), "real")
    for op, last in (("=", False), ("!=", True), ("<", False), (">", True)):
        assert [r[0] for r in df.select(V.compare(op, a, b)).collect()] == [False, None, last, None]
        assert [r[0] for r in df.select(~V.compare(op, a, b)).collect()] == [True, None, not last, None]
        for x, y in ((a, V.literal(1)), (V.literal(1.0), a)):
            want = last if x is a or op in ("=", "!=") else not last
            assert [r[0] for r in df.select(V.compare(op, x, y)).collect()] == [False, None, want, False]


def test_like(spark):
    df = spark.createDataFrame([("Alpha",), ("a\\b",), ("É",), ("é",), (None,), ("100%",)], "s string")
    like = lambda p: [r[0] for r in df.select(V.like(V.Value(F.col("s"), "text"), V.literal(p))).collect()]
    assert like("aLPH_") == [True, False, False, False, None, False]
    assert like("a\\b") == [False, True, False, False, None, False]
    assert like("é") == [False, False, False, True, None, False]
    assert like("%%") == [True, True, True, True, None, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables_against_sqlite(spark, tmp_path, seed):
    """Integers of every stored width, and tables of many pages."""
    rng = random.Random(seed)
    path = str(tmp_path / "r.db")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE a (k INTEGER, t TEXT); CREATE TABLE b (k INTEGER, r REAL); CREATE INDEX bk ON b (k);")
    number = lambda: rng.choice([None, 0, 1, rng.randint(-128, 127), rng.randint(-(2**15), 2**15), rng.randint(-(2**31), 2**31), rng.randint(-(2**62), 2**62), rng.randint(0, 40)])
    con.executemany("INSERT INTO a VALUES (?, ?)", [(number(), rng.choice([None, "x", "Xy", "y" * 3000, "é"])) for _ in range(1500)])
    con.executemany("INSERT INTO b VALUES (?, ?)", [(number(), rng.choice([None, 0.5, -1.25, 1e300])) for _ in range(1500)])
    con.commit()
    engine = Engine(spark, path)
    for sql in (
        "SELECT k, t FROM a WHERE k > 5 AND NOT (t LIKE 'x%')",
        "SELECT a.k, b.r FROM a JOIN b ON a.k = b.k WHERE a.k > 1",
        "SELECT a.k, b.r FROM a LEFT JOIN b ON a.k = b.k WHERE b.r IS NULL",
        "SELECT k, COUNT(*) AS n, MIN(r) AS lo FROM b GROUP BY k HAVING COUNT(*) > 2",
        "SELECT DISTINCT t FROM a",
    ):
        assert sorted(map(repr, rows(engine.query(sql)))) == sorted(map(repr, con.execute(sql).fetchall())), sql
    ordered = "SELECT k, r FROM b ORDER BY r DESC, k LIMIT 20 OFFSET 3"
    assert rows(engine.query(ordered)) == con.execute(ordered).fetchall()


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalogue_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    q = con.execute(catalog.ORACLE_SQL[name])
    titles = [d[0] for d in q.description]
    assert sorted(df.columns) == sorted(titles)
    assert sorted(map(repr, rows(df.select(*titles)))) == sorted(map(repr, q.fetchall()))


def test_join_on_integer_and_real_reads_whole_tables(spark):
    parts = {float(k): k for (k,) in rows(spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey"))}
    lines = rows(spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_quantity", "l_orderkey", "l_linenumber"))
    want = sorted((parts[q], o, n) for q, o, n in lines if q in parts)
    assert sorted(rows(catalog.QUERIES["join_int_real_key"](spark, SMALL))) == want and len(want) == len(lines)


def test_command_line(spark, tmp_path, capsys):
    from lumora import cli

    path = str(tmp_path / "c.db")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE t (a INTEGER, b TEXT, c BLOB); INSERT INTO t VALUES (1, 'x', X'00ff'), (NULL, 'y', NULL);")
    con.commit()
    con.close()
    assert cli.main([path, "t"]) == 0
    assert capsys.readouterr().out == "table: t\n     1 | 1 | x | x'00ff' |\n     2 | NULL | y | NULL |\n"
    assert cli.main([path, "--sql", "SELECT b FROM t ORDER BY b DESC"]) == 0
    assert capsys.readouterr().out == "| y |\n| x |\n"
    assert cli.main([path]) == 0
    assert "| table | t | t |" in capsys.readouterr().out
    assert cli.main([path, "--sql", "SELECT nope FROM t"]) == 1
    assert cli.main([]) == 1

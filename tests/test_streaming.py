from lumora.session import Engine
from lumora.streaming.tables import start, stream_table

SMALL = "/root/testdata/sf0.001"


def test_filters_and_joins_stream_and_resume(spark, tmp_path):
    engine = Engine(spark, SMALL)
    orders = engine.table("orders").df
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    orders.where("o_orderkey % 2 = 0").write.parquet(folder)
    stream_table(engine, "arriving", folder, like="orders")
    sql = "SELECT a.o_orderkey, c.c_name FROM arriving AS a JOIN customer AS c ON a.o_custkey = c.c_custkey WHERE a.o_totalprice > 100000"
    want = {tuple(r) for r in engine.query(sql.replace("arriving", "orders")).collect()}
    for part in (0, 1):
        if part:
            orders.where("o_orderkey % 2 = 1").write.mode("append").parquet(folder)
        start(engine, sql, "parquet", mark, path=out).awaitTermination(120)
        got = [tuple(r) for r in spark.read.parquet(out).collect()]
        assert len(got) == len(set(got)) and set(got) == (want if part else {r for r in want if r[0] % 2 == 0})


def test_groups_stream_in_complete_mode(spark, tmp_path):
    engine = Engine(spark, SMALL)
    engine.table("nation").df.write.parquet(str(tmp_path / "in"))
    stream_table(engine, "arriving", str(tmp_path / "in"), like="nation")
    q = start(engine, "SELECT n_regionkey, COUNT(*) AS n FROM arriving GROUP BY n_regionkey", "memory", str(tmp_path / "mark"), mode="complete", queryName="regions")
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM regions").collect()} == {tuple(r) for r in engine.query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey").collect()}

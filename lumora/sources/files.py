"""Folders of Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumora.errors import TableNotFound
from lumora.operators.table import Table


def parquet_table(spark: SparkSession, folder: str, name: str) -> Table:
    """folder/name.parquet, a file or a folder of files, wherever Spark's readers can open it."""
    try:
        return Table(name, spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))
    except AnalysisException as e:
        raise TableNotFound(name) from e


def parquet_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder, by the file system that Spark uses for it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))


def listing(spark: SparkSession, folder: str):
    """type, name and columns of every table."""
    rows = []
    for n in parquet_tables(spark, folder):
        t = parquet_table(spark, folder, n)
        rows.append(("table", n, ", ".join(t.columns)))
    return spark.createDataFrame(rows, "type string, name string, columns string").orderBy(F.col("name"))

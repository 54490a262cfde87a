"""Helpers that the training-data operators share: words, folds, stored stages and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The same set as bytes: bytes.split() without arguments splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where the setting is absent, as in tests, a temporary folder takes its place on a local master; on a
    cluster, whose executors would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumora-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumora-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the folders of stored() frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/lumora-" in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: str | int | None) -> int:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def fold_column(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null gives b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (A-Z in lower case), one after another, and how many each text has; null has none."""
    own = texts.take(pa.array(np.arange(len(texts))))  # a copy: ascii_lower goes wrong on some slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own.cast(pa.large_string()).fill_null("")))
    flat, n = lists.flatten(), np.asarray(lists.value_lengths(), np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # around white space at an end of a text
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        flat = flat.filter(pa.array(full))
    return flat, n


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str, start: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with one function call a batch. start: runs once a task, before the first batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start is not None:
            start()
        for b in batches:
            if b.num_rows:
                out = function(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def sample_of_rows(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most `rows` rows of df, the same each time: those of the smallest distinct hashes of the columns `by`.

    Only hashes are sorted; the rows themselves stay where they are. Rows that agree in `by` count as one.
    """
    h = fresh(df, "h")
    hashed = df.withColumn(h, F.xxhash64(*by))
    cut = hashed.select(h).distinct().orderBy(h).limit(rows).agg(F.max(h)).first()[0]
    kept = hashed.where(F.col(h) <= cut) if cut is not None else hashed.where("false")
    return kept.groupBy(h).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("x")).select("x.*")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_of_labels(labels: DataFrame, column: str, rows: int, skip_fold: int | None = None) -> DataFrame:
    """At most `rows` labelled ids, the same each time: those of the smallest hashes. Null ids or labels are left out.

    An id that occurs several times counts once, with its largest label.
    """
    kept = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if skip_fold is not None:
        kept = kept.where(fold_column() != skip_fold)
    return kept.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

"""Dialect queries over growing folders of Parquet files, by Structured Streaming. An extension: there is nothing to match.

A query plans the same way over a stream. What Spark can run without state (projection, filters, joins
with a fixed right side) streams in append mode; GROUP BY streams in complete mode. ORDER BY, LIMIT and
DISTINCT over a stream are Spark's to refuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumora.session import Engine


def stream_table(engine: Engine, name: str, folder: str, like: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Registers the files in `folder`, now and later, as table `name`; their schema is that of table `like` (or `name`)."""
    schema = engine.table(like or name).df.schema
    df = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    engine.register(name, df)
    return df


def start(engine: Engine, sql: str, sink: str, checkpoint: str, mode: str = "append", **options: str) -> StreamingQuery:
    """Runs a query over registered streams until what is there now is done; run again it goes on from its checkpoint."""
    writer = engine.query(sql).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.format(sink).start()

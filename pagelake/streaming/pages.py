"""Pages from a folder that grows: each micro-batch of whole pages runs through a pipeline and is appended.

A page's rows arrive together (one nested row a page), so that no state or watermark is needed; a
batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet rows of ``source`` through ``plan`` into ``target``/batch=N; with ``once``, what is there now, then the query ends."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

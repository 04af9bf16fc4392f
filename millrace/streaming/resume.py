"""Incremental resume as a stream: an extension of the batch anti-join, for inputs that arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def resume_stream(spark: SparkSession, source: str, schema, key: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on rows of newly arrived Parquet files whose key the sink does not have yet, and appends its result.

    Each micro-batch is made unique by key and anti-joined with the sink, so a batch that is replayed after a
    failure, or a row that arrives twice, is not done twice.
    """

    def one(batch: DataFrame, _: int) -> None:
        fresh = batch.where(f"`{key}` is not null").dropDuplicates([key])
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            fresh = fresh.join(spark.read.parquet(sink).select(key), key, "left_anti")
        work(fresh).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

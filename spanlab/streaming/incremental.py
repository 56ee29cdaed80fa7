"""Incremental runs over growing inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def remaining(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys an earlier run hasn't written."""
    return rows.join(done.select(*keys), list(keys), "left_anti")


def append_new(source: DataFrame, sink: str, keys: Sequence[str], checkpoint: str):
    """Runs a streaming source into a Parquet sink once, each batch without what the sink already has."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = remaining(fresh, spark.read.parquet(sink), keys)
        fresh.write.mode("append").parquet(sink)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental loads: new records of a stream, once each, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.writes import content_hash, new_records


def add_batch(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], content: list[str]) -> None:
    """Append the records of a batch that the table at ``path`` doesn't hold, by content hash. Safe to repeat."""
    hashed = batch.withColumn("content_hash", content_hash(*content))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = new_records(hashed, spark.read.parquet(path), [*keys, "content_hash"])
    else:
        fresh = hashed.dropDuplicates([*keys, "content_hash"])
    fresh.write.mode("append").parquet(path)


def ingest(source: DataFrame, path: str, checkpoint: str, keys: list[str], content: list[str]) -> StreamingQuery:
    """Run ``add_batch`` over what a streaming source has now; a redelivered batch adds nothing."""
    return (
        source.writeStream.foreachBatch(lambda batch, _: add_batch(batch.sparkSession, batch, path, keys, content))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

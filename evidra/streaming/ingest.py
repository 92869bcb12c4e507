"""Uploads as a stream: beyond what a batch rebuild gives, but with the same outcome as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reconcile


def read_uploads(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path).withColumn("_at", F.current_timestamp())


def ingest(uploads: DataFrame, base_path: str, log_path: str, key: str, checkpoint: str, natural: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is reconciled with all rows kept so far; new rows and outcomes are appended under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so that it counts once.
    """
    spark = uploads.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.drop("_at").persist()
        kept = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(rows.schema).parquet(base_path)
        kept = kept.where(~F.contains(F.col("_metadata.file_path"), F.lit(f"/batch={number}/")))
        # of rows of one batch that share a new key one is new, see classify()
        marked = reconcile.classify(kept, rows, key, natural).persist()
        marked.where("outcome = 'new'").select(*rows.columns).write.mode("overwrite").parquet(f"{base_path}/batch={number}")
        marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        marked.unpersist()
        rows.unpersist()

    writer = uploads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def distinct_rows(uploads: DataFrame, event_time: str, delay: str, columns: list[str]) -> DataFrame:
    """A stream without repeated rows that arrive within the delay."""
    return uploads.withWatermark(event_time, delay).withColumn("_h", F.xxhash64(*columns)).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def counts(uploads: DataFrame, event_time: str, delay: str, window: str, key: str) -> DataFrame:
    """Rows by window and key; late rows within the delay are counted."""
    return uploads.withWatermark(event_time, delay).groupBy(F.window(event_time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")

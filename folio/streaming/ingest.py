"""Incremental ingest: contents that arrive as a stream are stored once, whatever is delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions.identity import content_hash_column

CONTENTS = "content_hash string, content string, byte_size bigint"


def keyed(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select(content_hash_column(F.col(content)).alias("content_hash"), F.col(content).cast("string").alias("content"), F.octet_length(content).cast("bigint").alias("byte_size"))


def store_new(spark: SparkSession, batch: DataFrame, batch_id: int, target: str) -> None:
    """Writes a batch's new contents to a folder of its own: a batch that is run again replaces what it wrote."""
    found = keyed(batch).dropDuplicates(["content_hash"])
    try:
        stored = spark.read.schema(CONTENTS + ", batch bigint").parquet(target).where(F.col("batch") != batch_id)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], CONTENTS)
    found.join(stored.select("content_hash"), "content_hash", "left_anti").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that stores what is there and ends; started again it goes on from its checkpoint."""
    return (
        stream.writeStream.foreachBatch(lambda batch, i: store_new(batch.sparkSession, batch, i, target))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def arrivals(events: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of streamed events by window and type; events later than ``late`` are left out, and state is dropped with them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").count().select("w.start", "w.end", "event_type", "count")

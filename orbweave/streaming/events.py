"""Streams: deduplicated ingestion and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.store import shared_dir


def event_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(stream: DataFrame, key: str, *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once; state is dropped once the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, *, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): counts and sums of each window; works on streams and tables."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream holds now, as a table in the shared folder."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    schema = stream.schema
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def merge_new(batch: DataFrame, path: str, key: str) -> None:
    """For foreachBatch: append the rows whose key is not stored yet; a repeated batch adds nothing.

    A batch that was cut short left no committed files, so that it is whole when it comes again."""
    spark = batch.sparkSession
    spark.createDataFrame([], batch.schema).write.mode("ignore").parquet(path)
    stored = spark.read.schema(batch.schema).parquet(path).select(key)
    batch.dropDuplicates([key]).join(stored, key, "left_anti").write.mode("append").parquet(path)


def micro_batches(stream: DataFrame, sink, folder: str, *, every: str | None = None):
    """A running query that hands each micro-batch to ``sink(batch, number)``; without ``every`` it ends with what is there.

    How much a batch holds is the source's ``maxFilesPerTrigger``."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", folder).trigger(**trigger).start()

"""Structured Streaming: deduplicated and windowed counts, appended with restart from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def deduplicated(stream: DataFrame, at: str, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within the lateness allowed."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def counted_windows(stream: DataFrame, at: str, keys: list[str], size: str, lateness: str | None = None) -> DataFrame:
    """window_start, keys and events of each window. With a lateness, windows older than it leave the state between batches."""
    timed = stream if lateness is None else stream.withWatermark(at, lateness)
    counts = timed.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "events")


def drained(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """All that the source holds now, run to its end: of each key the row of the last batch that changed it.

    A batch writes what it changed, under its own number, so that one run again after a failure replaces its rows.
    """
    out, spark = f"{folder}/out", stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return changes.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest)).select(*stream.columns)


def appended(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new since the checkpoint as Parquet, and stop. Running it again adds nothing twice."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

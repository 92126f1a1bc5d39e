"""Structured Streaming over an event log: windowed counts with late data, and duplicates within the watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.sources import store

#: How late an event may come before its window is closed.
LATENESS = "2 hours"


def windowed_counts(stream: DataFrame, time: str, length: str, *keys: str, lateness: str = LATENESS) -> DataFrame:
    """`start`, `end`, keys, `n` per tumbling window; events later than the watermark do not count, null times drop out."""
    timed = stream.where(F.col(time).isNotNull()).withWatermark(time, lateness)
    counted = timed.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(stream: DataFrame, key: str, time: str, lateness: str = LATENESS) -> DataFrame:
    """The first event of every key; state is kept as long as the watermark allows repeats."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def as_timestamps(df: DataFrame, time: str) -> DataFrame:
    """Event times with a time zone (watermarks need it); times without one mean UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def run_to_end(df: DataFrame, transform, time: str, mode: str = "complete") -> DataFrame:
    """Runs `transform` over the rows of `df` as a stream until all are read, and returns what the sink holds.

    The rows are written once to the shared scratch folder, which is the stream's source; progress lies beside it, so a
    run that breaks off can be taken up again.
    """
    spark = df.sparkSession
    folder = store.scratch(spark, f"stream-{uuid.uuid4().hex[:6]}")
    as_timestamps(df, time).write.parquet(f"{folder}/source")
    schema = spark.read.parquet(f"{folder}/source").schema
    stream = transform(spark.readStream.schema(schema).parquet(f"{folder}/source"))
    if mode == "append":
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/sink").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/sink")
    target = f"{folder}/sink"
    run = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)

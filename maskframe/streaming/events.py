"""Metric streams: windowed phase means, and decayed averages as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The events table, a file or a folder of part files, as a stream; ``ts`` becomes a timestamp, which watermarks need.

    Files come in the order of their modification times; None takes all that are there in one trigger.
    """
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{sf_dir}/events*.parquet")  # a pattern is needed: a stream refuses the path of a single file
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_means(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, event_type, n and mean value of tumbling windows; works on streams and tables alike."""
    source = events.withWatermark("ts", late) if events.isStreaming else events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = source.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def decayed_average(events: DataFrame, decay: float) -> DataFrame:
    """event_type, n, shadow after each batch: shadow = d * shadow + (1 - d) * value in id order, the first value copied.

    Ids are sorted within a batch; a type's ids in a later batch must not be lower, or the stream fails.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, shadow, last = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values("event_id")
        if last is not None and rows["event_id"].iloc[0] < last:
            raise ValueError(f"event {rows['event_id'].iloc[0]} of type {key[0]} comes after event {last} was averaged")
        for v in rows["value"]:
            shadow = float(v) if n == 0 else decay * shadow + (1 - decay) * float(v)
            n += 1
        top = rows["event_id"].max()
        state.update((n, shadow, last if pd.isna(top) else int(top)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "shadow": [shadow]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, shadow double", "n long, shadow double, last long", "update", "NoTimeout")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet under ``folder``, and read that."""

    def store(batch: DataFrame, epoch: int) -> None:  # an epoch that is run again overwrites itself; a complete result, the one before
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={0 if mode == 'complete' else epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out/*")

"""Structured Streaming forms of the batch windows, over a folder of event files.

A run reads what is there (trigger availableNow), keeps its state in a checkpoint folder and writes final windows once:
append mode closes a window when the watermark passes its end, update mode writes a window whenever it changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visitlens.sources.storage import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, late: str = "10 minutes") -> DataFrame:
    """events, one file or a folder of them, as a stream with a watermark on their time."""
    raw = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a plain path must be a folder
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, with the epoch that wrote it; nothing where no batch ran."""
    spark = stream.sparkSession
    out, state, epochs = scratch(spark, name), scratch(spark, f"{name}-state"), []

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same epoch again replaces itself
        epochs.append(epoch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out) if epochs else spark.createDataFrame([], schema)


def tumbling(stream: DataFrame, size: str) -> DataFrame:
    return stream.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, size: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users"))


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame) -> DataFrame:
    """Each event once, whatever a source repeats within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def running_totals(stream: DataFrame) -> DataFrame:
    """Per user the running count and sum, kept as state across batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    grouped: Callable = stream.select("user_id", "value").groupBy("user_id").applyInPandasWithState
    return grouped(update, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)

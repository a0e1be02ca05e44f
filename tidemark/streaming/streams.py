"""Bars and exponential volatility over streams of ticks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Study
from ..sources import stores


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a Parquet file of events, or a folder of them.

    All files that are there make one trigger unless ``files_per_trigger`` is given, which is right
    only for files in order of time: ticks of later files may be late or out of order otherwise.
    """
    schema = spark.read.parquet(path).schema
    one_or_many = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a path may also name a single file
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(one_or_many)


def tumbling_bars(events: DataFrame, study: Study = DEFAULT, late: str = "10 minutes") -> DataFrame:
    """Bars of fixed windows; a bar comes out once the watermark has passed it, later ticks are dropped."""
    order = F.struct("ts", "event_id")
    live = events.where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        live.groupBy(F.window("ts", f"{study.bar_minutes} minutes").alias("w"), F.col("event_type").alias("symbol"))
        .agg(
            F.count("*").alias("n"), F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.sum("value").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("start"), "n", "open", "high", "low", "close", "volume")
    )


def sliding_bars(events: DataFrame, study: Study = DEFAULT, bars: int = 2, late: str = "10 minutes") -> DataFrame:
    """(symbol, start, n, high, low, volume) of windows of ``bars`` bars that start at every bar."""
    live = events.where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", f"{bars * study.bar_minutes} minutes", f"{study.bar_minutes} minutes").alias("w")
    found = live.groupBy(window, F.col("event_type").alias("symbol")).agg(
        F.count("*").alias("n"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("volume")
    )
    return found.select("symbol", F.col("w.start").alias("start"), "n", "high", "low", "volume")


def ewma_state(events: DataFrame, decay: float = 0.94) -> DataFrame:
    """(symbol, event_id, v): running exponential mean of squared log changes, kept as state by symbol."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import numpy as np

        last, v = state.get if state.exists else (float("nan"), 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, value in zip(rows["event_id"], rows["value"]):
            if value > 0:
                if last == last:
                    v = decay * v + (1 - decay) * float(np.log(value / last)) ** 2
                last = float(value)
            out.append((key[0], event_id, v))
        state.update((last, v))
        yield pd.DataFrame(out, columns=["symbol", "event_id", "v"])

    keyed = events.select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    return keyed.groupBy("symbol").applyInPandasWithState(step, "symbol string, event_id long, v double", "last double, v double", "append", "NoTimeout")


def drain(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append", report: dict | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it put out so far, from Parquet.

    Every batch has a folder of its own, replaced if the batch runs again, so each of its rows is
    there exactly once whatever fails. With a ``checkpoint`` a later call of the same ``name`` goes
    on where the last one ended. Mode ``complete`` closes the stream: windows that the watermark has
    not passed come out too. ``report`` gets the number of batches and of late rows that were dropped.
    """
    spark = stream.sparkSession
    base = f"{stores.shared(spark)}/tidemark-stream-{name}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/batch={'all' if mode == 'complete' else batch}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    if report is not None:
        progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
        report["batches"] = len(progress)
        report["late"] = sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p.get("stateOperators", []))
    if not stores.exists(spark, base):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(base)

"""Ticks to session-aware bars, complete coarse bars and causal forecast samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Study


def ticks(events: DataFrame) -> DataFrame:
    """(symbol, ts, event_id, value) of positive finite values; an event type is a symbol."""
    return events.select(F.col("event_type").alias("symbol"), "ts", "event_id", "value").where("value > 0 and value < double('infinity')")


def fine_bars(tick: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Open, high, low, close, volume by symbol, day, session and slot; ties in time go by event id."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    order = F.struct("ts", "event_id")
    return (
        tick.withColumns(
            {
                "d": F.to_date("ts"),
                "slot": F.floor(minute / study.bar_minutes).cast("int"),
                "session": F.when(minute < study.session_split_minute, "am").otherwise("pm"),
            }
        )
        .groupBy("symbol", "d", "session", "slot")
        .agg(
            F.count("*").alias("n"),
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.sum("value").alias("volume"),
        )
    )


def coarse_bars(fine: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Bars of several fine bars; ``complete`` only if every slot is there."""
    k = study.coarse_bars
    return (
        fine.withColumn("bucket", F.floor(F.col("slot") / k).cast("int"))
        .groupBy("symbol", "d", "session", "bucket")
        .agg(
            F.count("*").alias("source_bars"),
            F.min_by("open", "slot").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "slot").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumn("complete", F.col("source_bars") == k)
    )


def index_days(rows: DataFrame) -> DataFrame:
    """Adds day_idx (rank of the day) and seq (place of the row) within each symbol, from 0.

    Rows are numbered within their day and days are numbered on a table of one row a day, so
    no window holds more than a day of rows or the days of a symbol.
    """
    days = rows.groupBy("symbol", "d").agg(F.count("*").alias("_n"))
    along = W.partitionBy("symbol").orderBy("d")
    days = days.select(
        "symbol", "d", (F.row_number().over(along) - 1).alias("day_idx"), (F.sum("_n").over(along) - F.col("_n")).alias("_before")
    )
    own = F.row_number().over(W.partitionBy("symbol", "d").orderBy("slot")) - 1
    return rows.withColumn("_own", own).join(days, ["symbol", "d"]).withColumn("seq", F.col("_before") + F.col("_own")).drop("_own", "_before")


def samples(fine: DataFrame) -> DataFrame:
    """A row for each bar whose next bar of the same day and session follows at once: r = ln(next close / close)."""
    ahead = W.partitionBy("symbol", "d", "session").orderBy("slot")
    rows = fine.select(
        "symbol", "d", "session", "slot", "close", F.lead("slot").over(ahead).alias("next_slot"), F.lead("close").over(ahead).alias("next_close")
    ).where("next_slot = slot + 1")
    return index_days(rows.select("symbol", "d", "session", "slot", "close", F.ln(F.col("next_close") / F.col("close")).alias("r")))


def overlapped(df: DataFrame, reach: int, chunk: int = 100_000) -> DataFrame:
    """Copies rows so that windows of up to ``reach`` rows back can run within (symbol, part).

    A row belongs to part floor(seq / chunk) and is lent to the next part if that may look back
    at it. Keep rows with ``part = floor(seq / chunk)`` afterwards. One long series thus becomes
    many tasks.
    """
    parts = F.array_distinct(F.array(F.floor(F.col("seq") / chunk), F.floor((F.col("seq") + reach) / chunk)))
    return df.withColumn("part", F.explode(parts))

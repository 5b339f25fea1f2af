"""Bars of fixed length from a stream of ticks (market, code, ts, price, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, length: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars by event time; ticks later than the watermark are dropped by Spark. Works on streams and tables alike."""
    out = ticks.withWatermark("ts", late).groupBy("market", "code", F.window("ts", length))
    bars = out.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"))
    return bars.select("market", "code", F.to_date("window.start").alias("date"), F.col("window.start").alias("opens"), "open", "high", "low", "close", "volume", "amount")

"""Weekly and monthly bars from daily ones, and minutes as one array a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("market", "code")


def resample(bars: DataFrame, timeframe) -> DataFrame:
    """Bars of a timeframe: Daily as they are, Weekly by ISO week, Monthly by month, minutes none.

    A bar has the first open, highest high, lowest low, last close, summed volume and amount, and the date of
    its last day. One hash aggregation; partial results are combined before the shuffle.
    """
    if timeframe == "Daily":
        return bars
    if timeframe not in ("Weekly", "Monthly"):
        return bars.limit(0)
    period = F.date_trunc("week" if timeframe == "Weekly" else "month", "date")
    out = bars.groupBy(*KEY, period.alias("__period")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.max("date").alias("date")
    )
    return out.select(*KEY, "date", "open", "high", "low", "close", "volume", "amount")


def minute_days(minutes: DataFrame) -> DataFrame:
    """One row for each series and day: its minutes as an array sorted by slot (at most one session's rows)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("minute").cast("int").alias("minute"), F.col("price").cast("double").alias("price"), F.col("avg").cast("double").alias("avg"), F.col("volume").cast("double").alias("volume"))))
    return minutes.groupBy(*KEY, "date").agg(rows.alias("day"))

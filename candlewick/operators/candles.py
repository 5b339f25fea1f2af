"""Runs of candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import series
from ..functions.scalars import candle, yes


def with_run_lengths(bars: DataFrame) -> DataFrame:
    """bars with run_up, run_down and run_neutral: how many bars from each one on are of that kind without a break; and bars_left, those after it.

    A run ends where the next bar of another kind stands: windows over one exchange by series.
    """
    rows = bars.withColumn("__candle", candle(F.col("open"), F.col("close"))).withColumn("__rn", F.row_number().over(series())).withColumn("__n", F.count("*").over(Window.partitionBy("market", "code")))
    ahead = series().rowsBetween(0, Window.unboundedFollowing)
    run = lambda letter: (F.coalesce(F.min(F.when(~yes(F.col("__candle") == letter), F.col("__rn"))).over(ahead), F.col("__n") + 1) - F.col("__rn")).cast("int")
    return rows.withColumns({"run_up": run("U"), "run_down": run("D"), "run_neutral": run("N"), "bars_left": (F.col("__n") - F.col("__rn")).cast("int")}).drop("__candle", "__rn", "__n")

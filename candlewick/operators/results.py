"""Result tables: traces, counts, order, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_trace(results: DataFrame) -> DataFrame:
    """results with stage_trace: each stage's passed conditions or its reason."""
    text = lambda r: F.when(r["passed"], F.concat(r["stage_name"], F.lit("✓("), F.array_join(r["passed_conditions"], ","), F.lit(")"))).otherwise(F.concat(r["stage_name"], F.lit("✗("), F.coalesce(r["failed_condition"], F.lit("")), F.lit(")")))
    return results.withColumn("stage_trace", F.array_join(F.transform("stage_results", text), " → "))


def counts(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def ranked(results: DataFrame, column: str, descending: bool = False, n: int | None = None) -> DataFrame:
    """Sorted by a column, nulls first when ascending and last when descending; n: the first so many."""
    out = results.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_first(column), "market", "code")
    return out if n is None else out.limit(n)


def result_rows(results: DataFrame) -> DataFrame:
    """The flat result table: (market, code, symbol, passed, eliminated_reason, eliminated_stage, stage_trace, date)."""
    from .screen import symbol_of

    return with_trace(results).select("market", "code", symbol_of(F.col("market"), F.col("code")).alias("symbol"), "passed", "eliminated_reason", "eliminated_stage", "stage_trace", "date")


def chart_ranges(bars: DataFrame, *by: str) -> DataFrame:
    """The ranges of a chart of bars, for each series or by other columns: lowest low, highest high, and volumes."""
    return bars.groupBy(*(by or ("market", "code"))).agg(F.min("low").alias("min_price"), F.max("high").alias("max_price"), F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume"), F.count("*").alias("bars"))


def minute_ranges(minutes: DataFrame) -> DataFrame:
    """The price range of each series' chart of a day: as far below the first row's price as above it, so that it stands in the middle.

    A day without a move, and one whose first price is not above 0, get a narrow range round their price.
    """
    days = minutes.groupBy("market", "code", "date").agg(F.min_by("price", "minute").alias("before"), F.least(F.min("price"), F.min("avg")).alias("lo"), F.greatest(F.max("price"), F.max("avg")).alias("hi"))
    lo, hi = F.least("lo", "before"), F.greatest("hi", "before")
    wide = F.greatest(hi - F.col("before"), F.col("before") - lo)
    wide = F.when(wide == 0, F.greatest(F.lit(0.01), F.col("before") * 0.002)).otherwise(wide)
    centred, flat = F.col("before") > 0, F.when(lo == hi, 1.0).otherwise(0.0)
    return days.select("market", "code", "date", F.when(centred, F.col("before") - wide).otherwise(lo - flat).alias("min_price"), F.when(centred, F.col("before") + wide).otherwise(hi + flat).alias("max_price"))


def renamed(results: DataFrame, names: dict[str, str]) -> DataFrame:
    return results.withColumnsRenamed(names)


def write_csv(results: DataFrame, path: str) -> None:
    """Rows without nested columns, with a header; values with commas are quoted."""
    flat = [f.name for f in results.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    results.select(*flat).write.option("header", True).csv(path)


def write_scan(results: DataFrame, path: str) -> None:
    """A scan's rows in a folder for each date."""
    results.write.partitionBy("date").parquet(path)

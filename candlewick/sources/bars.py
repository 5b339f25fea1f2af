"""Bars, minutes and universes from files, tables in memory and other tables."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from contextlib import contextmanager
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "market int, code int, date date, open double, high double, low double, close double, volume double, amount double"
MINUTES = "market int, code int, date date, minute int, price double, avg double, volume double"
#: Stored prices and amounts are whole numbers of ten-thousandths.
SCALE = 10_000.0


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def as_bars(raw: DataFrame) -> DataFrame:
    """Stored bars in engine form; dates may be days since 1970 or dates."""
    day = F.date_from_unix_date("date") if dict(raw.dtypes)["date"] in ("int", "bigint", "smallint") else F.col("date").cast("date")
    scaled = [(F.col(c) / SCALE).alias(c) for c in ("open", "high", "low", "close")]
    return raw.select(F.col("market").cast("int"), F.col("code").cast("int"), day.alias("date"), *scaled, F.col("volume").cast("double"), (F.col("amount") / SCALE).alias("amount"))


class BarSource(ABC):
    """Where bars and minutes come from. Answers are tables of all series asked for; nothing is read before they are."""

    @abstractmethod
    def bars(self, frm: date, to: date, universe: DataFrame | None = None) -> DataFrame:
        """Daily bars of the dates, of the (market, code) rows of a universe."""

    @abstractmethod
    def minutes(self, frm: date, to: date, keys: DataFrame | None = None) -> DataFrame:
        """Minutes of the dates, of the (market, code, date) rows of keys: below all else, so that only survivors' rows go on."""

    def timeframe(self, timeframe, frm: date, to: date, universe: DataFrame | None = None) -> DataFrame:
        """Bars of a timeframe, from the daily ones."""
        from ..operators.resample import resample

        return resample(self.bars(frm, to, universe), timeframe)

    def series(self, market: int, code: int, frm: date, to: date) -> DataFrame:
        """One series' daily bars, such as an index."""
        return self.bars(frm, to).where((F.col("market") == market) & (F.col("code") == code))


def _of(rows: DataFrame, keys: DataFrame | None, by: list[str]) -> DataFrame:
    return rows if keys is None else rows.join(keys.select(*by).distinct(), by, "left_semi")


class TableBars(BarSource):
    """Bars and minutes that are tables already."""

    def __init__(self, bars: DataFrame, minutes: DataFrame | None = None):
        self._bars, self._minutes = bars, minutes

    def bars(self, frm: date, to: date, universe: DataFrame | None = None) -> DataFrame:
        return _of(self._bars.where(F.col("date").between(F.lit(frm), F.lit(to))), universe, ["market", "code"])

    def minutes(self, frm: date, to: date, keys: DataFrame | None = None) -> DataFrame:
        if self._minutes is None:
            return self._bars.sparkSession.createDataFrame([], MINUTES)
        return _of(self._minutes.where(F.col("date").between(F.lit(frm), F.lit(to))), keys, ["market", "code", "date"])


@contextmanager
def kept(rows: DataFrame):
    """rows held for as long as a block lasts, such as the survivors' minutes for a stage that reads them several times."""
    rows = rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


class ParquetBars(BarSource):
    """klines/YYYY.parquet and minutes/YYYY/MM.parquet below a folder. Files outside the dates asked for are not opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _paths(self, glob: str) -> list[str]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{glob}")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(x.getPath().toString() for x in found) if found else []

    def years(self) -> list[int]:
        names = [Path(p).stem for p in self._paths("klines/*.parquet")]
        return sorted(int(n) for n in names if n.isdigit())

    def bars(self, frm: date, to: date, universe: DataFrame | None = None) -> DataFrame:
        paths = [f"{self.folder}/klines/{y}.parquet" for y in self.years() if frm.year <= y <= to.year]
        if not paths:
            return empty_bars(self.spark)
        raw = self.spark.read.parquet(*paths)
        days = dict(raw.dtypes)["date"] in ("int", "bigint", "smallint")
        lo, hi = (((d - date(1970, 1, 1)).days for d in (frm, to)) if days else (F.lit(frm), F.lit(to)))
        raw = raw.where(F.col("date").between(lo, hi))
        return as_bars(_of(raw, universe, ["market", "code"]))

    def minutes(self, frm: date, to: date, keys: DataFrame | None = None) -> DataFrame:
        months = [p for p in self._paths("minutes/*/*.parquet") if (frm.year, frm.month) <= (int(Path(p).parent.name), int(Path(p).stem)) <= (to.year, to.month)]
        if not months:
            return self.spark.createDataFrame([], MINUTES)
        raw = _of(self.spark.read.parquet(*months).where(F.col("date").between(F.lit(frm), F.lit(to))), keys, ["market", "code", "date"])
        return raw.select(F.col("market").cast("int"), F.col("code").cast("int"), F.col("date").cast("date"), F.col("minute").cast("int"), (F.col("price") / SCALE).alias("price"), (F.col("avg") / SCALE).alias("avg"), F.col("volume").cast("double"))


def stocks(catalog: DataFrame) -> DataFrame:
    """The universe: series of kind stock."""
    return catalog.where("security_kind = 'stock'").select(F.col("market").cast("int"), F.col("code").cast("int"))


def on_boards(universe: DataFrame, markets=None, star: bool = True, growth: bool = True, watched: DataFrame | None = None) -> DataFrame:
    """The universe by exchange, with or without the boards of codes 688 and 689, and 300 and 301; of a watchlist."""
    board = F.substring(F.lpad(F.col("code").cast("string"), 6, "0"), 1, 3)
    out = universe if markets is None else universe.where(F.col("market").isin(list(markets)))
    out = out if star else out.where(~board.isin("688", "689"))
    out = out if growth else out.where(~board.isin("300", "301"))
    return out if watched is None else out.join(watched.select("market", "code").distinct(), ["market", "code"], "left_semi")


def sampled(universe: DataFrame, n: int) -> DataFrame:
    """The same n series each time, by hash of their keys."""
    return universe.orderBy(F.md5(F.concat_ws(":", F.col("market").cast("string"), F.col("code").cast("string"))), "market", "code").limit(n)


class StrategyStore:
    """Pipelines by name, as JSON files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, name: str, pipeline_json: str) -> None:
        """Writes a pipeline, in place of one of the same name."""
        where, system = self._at(name)
        out = system.create(where, True)
        out.write(bytearray(json.dumps(json.loads(pipeline_json), ensure_ascii=False).encode()))
        out.close()

    def load(self, name: str) -> str:
        where, system = self._at(name)
        if not system.exists(where):
            raise KeyError(name)
        return self.spark.read.option("wholetext", True).text(f"{self.folder}/{name}.json").first()[0]

    def names(self) -> list[str]:
        where, system = self._at("*")
        found = system.globStatus(where)
        return sorted(Path(x.getPath().toString()).stem for x in found) if found else []


def event_bars(events: DataFrame) -> DataFrame:
    """Daily bars of an event table (event_id, ts, user_id, value): a series for each user, on market user_id mod 3."""
    when = F.struct("ts", "event_id")
    out = events.groupBy(F.pmod("user_id", F.lit(3)).cast("int").alias("market"), F.col("user_id").cast("int").alias("code"), F.to_date("ts").alias("date"))
    return out.agg(F.min_by("value", when).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))


def event_index(events: DataFrame) -> DataFrame:
    """Daily bars of each market over all its users, with code -1."""
    when = F.struct("ts", "event_id")
    out = events.groupBy(F.pmod("user_id", F.lit(3)).cast("int").alias("market"), F.to_date("ts").alias("date"))
    out = out.agg(F.min_by("value", when).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))
    return out.select("market", F.lit(-1).alias("code"), "date", "open", "high", "low", "close", "volume", "amount")


def event_minutes(events: DataFrame) -> DataFrame:
    """Each user's events of a day as minutes: slot by minute of day mod 240, last price, mean price so far, count."""
    from pyspark.sql import Window

    slot = F.pmod(F.hour("ts") * 60 + F.minute("ts"), F.lit(240)).cast("int")
    rows = events.groupBy(F.pmod("user_id", F.lit(3)).cast("int").alias("market"), F.col("user_id").cast("int").alias("code"), F.to_date("ts").alias("date"), slot.alias("minute"))
    rows = rows.agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"), F.sum("value").alias("s"), F.count("*").alias("n"))
    so_far = Window.partitionBy("market", "code", "date").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("market", "code", "date", "minute", "price", (F.sum("s").over(so_far) / F.sum("n").over(so_far)).alias("avg"), F.col("n").cast("double").alias("volume"))

"""Calls of a screen by JSON: run, scan, validate, symbols, registry. Their answers are plain values for a caller, so rows come to the driver."""

from __future__ import annotations

import json
import time
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import default_registry
from ..plans.ast import pipeline_from_json, registry_from_json, registry_to_json
from ..plans.needs import needs_market, stocks
from .results import counts, result_rows
from .screen import Screen, symbol_of

COLUMNS = ("market", "code", "symbol", "passed", "eliminated_reason", "eliminated_stage", "stage_trace")


def screen_of(pipeline_json: str, bars: DataFrame, frm: date, to: date, registry_json: str | None = None, **more) -> Screen:
    return Screen(pipeline_from_json(pipeline_json), bars, frm, to, registry=registry_from_json(registry_json) if registry_json else None, **more)


def _row(r) -> dict:
    return {c: r[c] for c in COLUMNS} | {"date": r["date"].isoformat() if r["date"] else None}


def run_call(screen: Screen) -> dict:
    """{elapsed_ms, passed, total, rows}: rows in the order of market and code."""
    began = time.monotonic()
    rows = [_row(r) for r in result_rows(screen.run()).orderBy("market", "code").collect()]
    return {"elapsed_ms": int(1000 * (time.monotonic() - began)), "passed": sum(r["passed"] for r in rows), "total": len(rows), "rows": rows}


def scan_call(screen: Screen, lookback: int = 120) -> dict:
    """{dates, results: {date: {passed, total, rows}}}: of each day the totals, and the rows that pass."""
    found = screen.scan(lookback).persist()
    try:
        totals = {r["date"].isoformat(): {"passed": r["passed"], "total": r["total"], "rows": []} for r in counts(found, "date").orderBy("date").collect()}
        for r in result_rows(found.where("passed")).orderBy("date", "market", "code").toLocalIterator():
            totals[r["date"].isoformat()]["rows"].append(_row(r))
    finally:
        found.unpersist()
    return {"dates": list(totals), "results": totals}


def validate_call(pipeline_json: str, bars: DataFrame, registry_json: str | None = None) -> list[str]:
    """What keeps a pipeline from running; nothing if it can."""
    try:
        return screen_of(pipeline_json, bars, date.min, date.max, registry_json).validate()
    except (KeyError, TypeError, ValueError) as error:
        return [f"{type(error).__name__}: {error}"]


def needs_call(pipeline_json: str) -> dict:
    """{market, stocks}: whether a pipeline reads a market's index, and the symbols of other series that it names."""
    stages = pipeline_from_json(pipeline_json).stages
    named = {s.args[0] for stage in stages for s in stocks(stage) if s.args} | {x for stage in stages for x in stage.extra_stocks}
    return {"market": any(map(needs_market, stages)), "stocks": sorted(named)}


def symbols_call(bars: DataFrame) -> list[str]:
    """All symbols of a table, sorted."""
    return [r["symbol"] for r in bars.select("market", "code").distinct().select(symbol_of(F.col("market"), F.col("code")).alias("symbol")).orderBy("symbol").collect()]


def registry_call() -> str:
    return json.dumps(json.loads(registry_to_json(default_registry())), sort_keys=True)

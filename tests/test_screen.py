"""Expressions, screens and minutes on small tables, in both forms; and plans."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick import catalog
from candlewick.functions.minutes import Day, day_test
from candlewick.functions.scalars import divide, round2
from candlewick.operators.resample import minute_days, resample
from candlewick.functions.indicators import default_registry, with_indicators
from candlewick.operators import calls
from candlewick.operators.results import counts, with_trace, write_csv, write_scan
from candlewick.operators.screen import Screen, symbol_key, symbol_of
from candlewick.plans.ast import Block, MARKET, Node, Pattern, Pipeline, Registry, Stage, each, end, ex, mx, pipeline_from_json, pipeline_to_json, start, tm, val
from candlewick.plans.forms import condition_from, engulfing_stage
from candlewick.sources.bars import MINUTES as MINUTE_COLUMNS
from candlewick.sources.bars import BarSource, ParquetBars, StrategyStore, TableBars, empty_bars, kept, sampled, stocks
from candlewick.streaming.rollup import tick_bars

D0 = date(2024, 1, 1)


def series(spark, opens, closes, market=0, code=1):
    rows = [(market, code, D0 + timedelta(days=i), float(o), float(max(o, c)), float(min(o, c)), float(c), 100.0 + i, 1.0) for i, (o, c) in enumerate(zip(opens, closes))]
    return spark.createDataFrame(rows, "market int, code int, date date, open double, high double, low double, close double, volume double, amount double")


def verdicts(bars, stage, array=False, **more):
    screen = Screen(Pipeline([stage]), bars, D0, D0 + timedelta(days=400), **more)
    if array:
        screen._forms = lambda *stage: None
    return [r.passed for r in screen.scan(lookback=400).orderBy("market", "code", "date").collect()]


C, O = val(end(), "close"), val(end(), "open")
EXPRESSIONS = [
    ("close_gt_open", [10, 11, 10], [11, 10, 11], ex("Gt", C, O), [True, False, True]),
    ("shifted", [10] * 3, [11, 12, 10], ex("Gt", val(end(-1), "close"), C), [False, False, True]),
    ("and", [10, 11], [11, 10], ex("And", ex("Gt", C, O), ex("Bool", True)), [True, False]),
    ("between", [10] * 3, [9, 12, 16], ex("Between", C, 10, 15), [False, True, False]),
    ("cross_up", [10] * 4, [9, 11, 10, 12], ex("CrossUp", at=end(), col="close", threshold=10), [False, True, False, True]),
    ("cross_down", [10] * 4, [12, 9, 11, 8], ex("CrossDown", at=end(), col="close", threshold=10), [False, True, False, True]),
    ("candle_up", [10, 11], [11, 10], ex("CandleIs", at=end(), candle="Up"), [True, False]),
    ("mean_3", [10] * 5, [1, 2, 3, 4, 5], ex("Gte", ex("Agg", from_=end(-2), to=end(), col="close", func="Mean"), 3), [False, False, False, True, True]),
    ("not_of_missing", [10] * 2, [1, 2], ex("Not", ex("Gt", val(end(-5), "close"), 0)), [True, True]),
    ("divide_by_zero", [10] * 2, [0, 2], ex("Gt", ex("Div", 1, C), 0), [False, True]),
    ("reversed_range", [10] * 3, [1, 3, 2], ex("Eq", ex("Agg", from_=end(), to=end(-1), col="close", func="Max"), 3), [False, True, True]),
    ("stddev", [10] * 2, [1, 3], ex("Eq", ex("Agg", from_=end(-1), to=end(), col="close", func="StdDev"), 1), [False, True]),
    ("ahead", [10] * 3, [1, 2, 3], ex("Gt", val(end(1), "close"), C), [True, True, False]),
    ("any_with_end", [10] * 4, [5, 1, 2, 9], ex("Any", from_=end(-2), to=end(-1), pred=ex("Gt", val(each(), "close"), C)), [False, False, True, False]),
    ("all_mixed", [1, 1, 5], [2, 3, 4], ex("All", from_=end(-1), to=end(), pred=ex("Gt", val(each(), "close"), val(each(), "open"))), [False, True, False]),
    ("count", [1, 5, 1], [2, 3, 4], ex("CountBars", from_=end(-2), to=end(), pred=ex("CandleIs", at=each(), candle="Up"), op="Eq", n=2), [False, False, True]),
    ("monotone", [1] * 4, [1, 2, 3, 3], ex("Monotone", from_=end(-2), to=end(), col="close", dir="StrictInc"), [False, False, True, False]),
    ("one_bar_monotone", [1], [1], ex("Monotone", from_=end(), to=end(), col="close", dir="NonDec"), [False]),
    ("numbers_as_tests", [1, 1], [0, 2], ex("And", C, ex("Gt", ex("Add", ex("Gt", C, 1), 1), 1)), [False, True]),
    ("implies", [1, 1], [2, 1], ex("Implies", ex("Gt", C, O), ex("Bool", False)), [False, True]),
]


@pytest.mark.parametrize("array", [False, True])
def test_expressions(spark, array):
    bars = None
    for i, (_, opens, closes, _, _) in enumerate(EXPRESSIONS):
        own = series(spark, opens, closes, 0, i + 1)
        bars = own if bars is None else bars.unionAll(own)
    bars = bars.persist()
    for i, (name, _, _, expr, want) in enumerate(EXPRESSIONS):
        assert verdicts(bars.where(F.col("code") == i + 1), Stage("s", conditions=[("c", expr)]), array) == want, name
    bars.unpersist()


def random_bars(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for code in range(6):
        day = D0
        for _ in range(rng.randint(5, 30)):
            day += timedelta(days=rng.randint(1, 3))
            o, c = rng.randint(1, 9), rng.randint(1, 9)
            rows.append((code % 2, code, day, float(o), float(max(o, c) + 1), float(min(o, c)), float(c), float(rng.randint(1, 5)), 1.0))
    return spark.createDataFrame(rows, "market int, code int, date date, open double, high double, low double, close double, volume double, amount double")


def test_both_forms_agree(spark):
    bars = random_bars(spark).persist()
    index = {0: (0, 0), 1: (1, 1), 2: (1, 1)}
    c = lambda k=0: val(end(k), "close")
    exprs = [
        ex("Gt", c(), val(end(-2, MARKET), "close")),
        ex("SyncWithMarket", end(-1), end()),
        ex("CrossUp", at=end(), col="close", threshold=val(each(), "sma_3")),
        ex("CrossDown", MARKET, end(), "close", 5),
        ex("Monotone", from_=end(-2), to=end(), col="volume", dir="NonInc"),
        ex("CountBars", from_=end(-3), to=end(), pred=ex("Gt", val(each(-1), "close"), val(each(), "close")), op="Gte", n=2),
        ex("Gt", ex("Agg", MARKET, end(-2), end(), "close", "Sum"), ex("Agg", from_=end(-2), to=end(), col="close", func="Sum")),
        ex("CandleIs", MARKET, end(), "Up"),
        ex("All", from_=end(-2), to=end(), pred=ex("Gte", val(each(), "high"), val(end(), "low"))),
        ex("Gt", ex("RangeVal", from_=end(-2), to=end(), col="close", func="First"), ex("PctChange", c(-1), c())),
    ]
    stage = Stage("s", indicators=[("sma", {"period": 3})], conditions=[])
    for e in exprs:
        stage.conditions = [("c", e)]
        assert verdicts(bars, stage, index=index) == verdicts(bars, stage, True, index=index), e
    stage.kline_pattern = Pattern("p", [Block("A", "Up", 1, 1), Block("B", "Any", 1, 1), Block("C", "Down", 1, 1)])
    stage.points = [("b", Node("point", "BlockEnd", ("B",))), ("x", Node("point", "Offset", {"from": "b", "delta": -1}))]
    stage.vars = [("v", val(catalog.point("x"), "close"))]
    stage.conditions = [("c", ex("Gt", Node("expr", "Var", ("v",)), C))]
    assert verdicts(bars, stage, index=index) == verdicts(bars, stage, True, index=index)
    bars.unpersist()


def test_scan_equals_single_runs(spark):
    bars = random_bars(spark, 4).persist()
    stages = [Stage("one", conditions=[("up", ex("Gt", C, O))]), Stage("two", vars=[("g", ex("PctChange", val(start(), "close"), C))], conditions=[("gain", ex("Gt", Node("expr", "Var", ("g",)), 0))])]
    scan = {(r.market, r.code, r.date): (r.passed, r.eliminated_stage, r.eliminated_reason) for r in Screen(Pipeline(stages), bars, D0, D0 + timedelta(days=100)).scan(lookback=10_000).collect()}
    for day in (D0 + timedelta(days=9), D0 + timedelta(days=21)):
        for r in Screen(Pipeline(stages), bars, D0, day).run().collect():
            if r.date is not None:
                assert (r.passed, r.eliminated_stage, r.eliminated_reason) == scan[r.market, r.code, r.date]
    bars.unpersist()


def test_padding_changes_nothing(spark):
    bars = random_bars(spark, 5)
    stage = Stage("s", indicators=[("sma", {"period": 3})], conditions=[("c", ex("Gt", C, val(end(-1), "sma_3")))])
    day = D0 + timedelta(days=25)
    full, pad = (sorted(map(str, Screen(Pipeline([stage]), bars, D0, day, pad=p).run().collect())) for p in (False, True))
    assert full == pad


def test_edges(spark, tmp_path):
    bars = series(spark, [1, 2], [2, 1])
    universe = spark.createDataFrame([(0, 1), (0, 999999)], "market int, code int")
    got = {r.code: r for r in Screen(Pipeline([Stage("s", conditions=[("a", ex("Gt", O, 0)), ("b", ex("Gt", C, O))])]), bars, D0, D0 + timedelta(days=5), universe=universe).run().collect()}
    assert got[999999].eliminated_reason == "no_data" and got[1].eliminated_reason == "b"
    assert got[1].stage_results[0].passed_conditions == ["a"]
    assert [r.passed for r in Screen(Pipeline([]), bars, D0, D0).run().collect()] == [True]
    assert [r.passed for r in Screen(Pipeline([Stage("s")]), bars, D0, D0).run().collect()] == [True]
    assert Screen(Pipeline([Stage("s")]), empty_bars(spark), D0, D0).run().count() == 0
    assert symbol_key("invalid") is None and symbol_key("SZ.000001") == (0, 1)
    null_var = Stage("s", vars=[("v", val(end(-9), "close"))], conditions=[("c", ex("Bool", True))])
    assert Screen(Pipeline([null_var]), bars, D0, D0 + timedelta(days=5)).run().first().eliminated_reason == "var:v"
    pattern = Stage("s", kline_pattern=Pattern("p", [Block("A", "Up", 2, 3)]))
    assert Screen(Pipeline([pattern]), bars, D0, D0 + timedelta(days=5)).run().first().eliminated_reason == "kline_pattern"
    assert Screen(Pipeline([Stage("s", indicators=[("nothing", {})])]), bars, D0, D0).validate()
    early = Stage("s", start_date=D0, conditions=[("c", ex("Gt", C, O))])
    assert Screen(Pipeline([early]), bars, D0, D0 + timedelta(days=5)).run().first().passed
    out = with_trace(Screen(Pipeline([Stage("s", conditions=[("a", ex("Gt", O, 0))])]), bars, D0, D0 + timedelta(days=5)).run())
    assert out.first().stage_trace == "s✓(a)" and counts(out).first().passed == 1
    write_csv(out, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 1


def test_marks_and_matches(spark):
    bars = series(spark, [3, 3, 1, 1], [2, 2, 2, 2])
    stage = Stage("s", kline_pattern=Pattern("p", [Block("A", "Down", 1, 2), Block("F", "Any", 0, None), Block("C", "Up", 1, 1)]), windowsize=(4, 4))
    stage.points = [("down", Node("point", "BlockEnd", ("A",)))]
    stage.marks = [("m", catalog.point("down"), val(each(), "close"), "low"), ("gone", end(9), None, None)]
    r = Screen(Pipeline([stage]), bars, D0, D0 + timedelta(days=9)).run().first()
    result = r.stage_results[0]
    assert r.passed and len(result.matches) == 2 and set(result.marks) == {"m"}
    assert {m.points["down"] for m in result.matches} == {D0, D0 + timedelta(days=1)}
    assert result.marks["m"].value == 2.0 and result.marks["m"].label == "low"


def test_scalars(spark):
    r = spark.range(1).select(round2(F.lit(1.005)).alias("a"), round2(F.lit(-1.236)).alias("b"), divide(F.lit(1.0), F.lit(0.0)).alias("c")).first()
    assert r.a == 1.0 and r.b == -1.24 and r.c is None


PRICE, AVG, YESTERDAY = mx("White", tm("EachMinute")), mx("Yellow", tm("EachMinute")), mx("YesterdayOpen")
WHOLE = tm("RangeStart"), tm("RangeEnd")
T = lambda k, *a: Node("test", k, a)
ABOVE = T("Gt", PRICE, AVG)
MINUTES = [
    ([11, 10.5, 11.2, 10.3, 11.1], [10.8] * 5, mx("AnyMinute", ABOVE, *WHOLE), True),
    ([11, 10.5, 11.2, 10.3, 11.1], [10.8] * 5, mx("AllMinutes", ABOVE, *WHOLE), False),
    ([11, 10.5, 11.2, 10.3, 11.1], [10.8] * 5, mx("DurationGte", ABOVE, *WHOLE, mx("Lit", 3.0)), True),
    ([11, 10.5, 11.2, 10.3, 11.1], [10.8] * 5, mx("DurationGte", ABOVE, *WHOLE, mx("Lit", 4.0)), False),
    ([11] * 35, [10.8] * 35, mx("DurationGte", ABOVE, tm("RangeStart"), tm("At", "10:00"), mx("Lit", 30.0)), True),
    ([11] * 35, [10.8] * 35, mx("DurationLte", ABOVE, tm("RangeStart"), tm("At", "10:00"), mx("Lit", 29.0)), False),
    ([10, 12, 9, 12], [11] * 4, T("Eq", mx("CrossCount", "White", "Yellow", *WHOLE), mx("Lit", 2.0)), True),
    ([10, 12, 9, 12], [11] * 4, T("Eq", mx("CrossAbove", "White", mx("Lit", 12.0), *WHOLE), mx("Lit", 2.0)), True),
    ([10, 12, 9, 13], [11] * 4, T("Eq", mx("Slope", "White", *WHOLE), mx("Lit", 1.0)), True),
    ([10, 11], [10, 10], mx("AnyMinute", T("Gte", PRICE, mx("LimitUpPrice")), *WHOLE), True),
    ([10, 9.5], [10, 10], mx("AnyMinute", T("Lt", PRICE, YESTERDAY), *WHOLE), True),
    ([10, 9.5], [10, 10], mx("AllMinutes", T("Not", T("Or", ABOVE, T("Lt", PRICE, mx("LimitDownPrice")))), *WHOLE), True),
    ([10, 9.5], [10, 10], mx("AllMinutes", ABOVE, tm("At", "10:00"), tm("At", "09:40")), True),
    ([10, 9.5], [10, 10], T("Gt", mx("Duration", ABOVE, *WHOLE), mx("Abs", mx("Sub", mx("Param", "x"), mx("Lit", 3.0)))), False),
]


def test_minutes(spark):
    for prices, avgs, test, want in MINUTES:
        rows = [(0, 1, D0, i, float(p), float(a), 1.0) for i, (p, a) in enumerate(zip(prices, avgs))]
        days = minute_days(spark.createDataFrame(rows, "market int, code int, date date, minute int, price double, avg double, volume double"))
        assert days.select(day_test(F.col("day"), test, 0, 239, {"x": 2.0}, F.lit(0.1))).first()[0] == want, test
    days = days.select(Day(F.col("day"), 0, 239, {}, F.lit(0.1)).streak(T("Lte", PRICE, AVG)))
    assert days.first()[0] == 2


def test_resample_and_files(spark, tmp_path):
    bars = series(spark, range(1, 41), range(2, 42))
    week = resample(bars, "Weekly").orderBy("date").first()
    assert (week.open, week.close, week.date) == (1.0, 8.0, D0 + timedelta(days=6))
    assert resample(bars, "Monthly").count() == 2 and resample(bars, {"Minutes": 5}).count() == 0
    raw = bars.select("market", "code", F.datediff("date", F.lit("1970-01-01")).alias("date"), *[(F.col(c) * 10000).cast("int").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"), (F.col("amount") * 10000).cast("long").alias("amount"))
    raw.coalesce(1).write.parquet(f"file://{tmp_path}/klines/2024.parquet")
    source = ParquetBars(spark, f"file://{tmp_path}")
    assert source.years() == [2024]
    got = source.bars(D0, D0 + timedelta(days=3)).orderBy("date").collect()
    assert len(got) == 4 and got[0].date == D0 and got[0].close == 2.0
    assert source.bars(date(2020, 1, 1), date(2020, 2, 1)).count() == 0 and source.minutes(D0, D0).count() == 0
    ticks = spark.createDataFrame([(0, 1, datetime(2024, 1, 1, 10), 5.0, 2.0), (0, 1, datetime(2024, 1, 1, 11), 6.0, 1.0)], "market int, code int, ts timestamp, price double, volume double")
    bar = tick_bars(ticks).first()
    assert (bar.open, bar.close, bar.volume, bar.amount) == (5.0, 6.0, 3.0, 16.0)


def test_one_exchange_and_filters_below_windows(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    random_bars(spark, 7).write.parquet(path)
    bars = spark.read.parquet(path)
    stage = Stage("s", indicators=[("sma", {"period": 5}), ("boll", {"period": 8, "k": 2.0})], conditions=[("a", ex("Gt", C, val(end(), "sma_5"))), ("b", ex("CrossUp", at=end(), col="close", threshold=val(each(), "boll_mid_8")))])
    screen = Screen(Pipeline([stage]), bars, D0, D0 + timedelta(days=30), pad=True)
    text = screen.run()._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(market" in line]
    assert len(exchanges) <= 3  # the bars, and the keys of all series, as padding may leave out some
    assert "PushedFilters: [IsNotNull(date)" in text and "GreaterThanOrEqual(date" in text


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stages_run_in_one_pass(spark, tmp_path):
    """Window stages share one scan and one exchange by series, however many they are."""
    path = f"file://{tmp_path}/bars"
    random_bars(spark, 7).write.parquet(path)
    bars = spark.read.parquet(path)
    stage = lambda k: Stage(f"s{k}", indicators=[("sma", {"period": 2 + k})], vars=[("v", val(end(-k), "close"))], conditions=[("c", ex("Gt", C, val(end(), f"sma_{2 + k}")))])
    for n in (1, 2, 5):
        for frame in (Screen(Pipeline([stage(k) for k in range(n)]), bars, D0, D0 + timedelta(days=60)).scan(), Screen(Pipeline([stage(k) for k in range(n)]), bars, D0, D0 + timedelta(days=60)).run()):
            text = plan_of(frame)
            assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "Join" not in text
    mixed = [stage(0), Stage("a", points=[("p", Node("point", "Where", {"stock": catalog.CURRENT, "from": end(-3), "to": end(), "pred": ex("Gt", val(each(), "close"), val(each(), "open")), "select": "Last"}))]), stage(1)]
    scans = [plan_of(Screen(Pipeline(mixed[:n]), bars, D0, D0 + timedelta(days=60)).scan()).count("Scan") for n in (1, 2, 3)]
    assert scans[2] <= 3 * scans[1]


def test_later_stages_see_the_same_however_they_run(spark):
    """One pass, and a stage at a time on arrays, come to the same results."""
    bars = random_bars(spark, 9).persist()
    stages = [Stage("one", conditions=[("up", ex("Gt", C, O))]), Stage("two", windowsize=(2, 3), kline_pattern=Pattern("p", [Block("A", "Any", 1, 2), Block("B", "Up", 1, 1)]), points=[("a", Node("point", "BlockStart", ("A",)))], vars=[("low", val(catalog.point("a"), "low"))], conditions=[("rises", ex("Gt", C, Node("expr", "Var", ("low",))))], marks=[("m", catalog.point("a"), Node("expr", "Var", ("low",)), None)]), Stage("three", conditions=[("more", ex("Gt", val(end(), "volume"), 2))])]
    rows = []
    for array in (False, True):
        screen = Screen(Pipeline(stages), bars, D0, D0 + timedelta(days=90))
        if array:
            screen._forms = lambda *a: None
        rows.append(sorted(str((r.market, r.code, r.date, r.passed, r.eliminated_stage, r.eliminated_reason, [(x.passed, x.failed_condition, x.passed_conditions, x.points if x.passed else None, x.marks if x.passed else None, x.matches) for x in r.stage_results])) for r in screen.scan(400).collect()))
    assert rows[0] == rows[1]
    bars.unpersist()


def test_minutes_are_read_for_survivors_only(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    bars = series(spark, [1, 2], [2, 1])
    spark.createDataFrame([(0, 1, D0 + timedelta(days=d), k, 10.0 + k, 10.0, 1.0) for d in range(2) for k in range(5)], "market int, code int, date date, minute int, price double, avg double, volume double").write.parquet(path)
    test = Node("expr", "Intraday", ({"anchor_point": "today", "stock": catalog.CURRENT, "time_from": "09:31:00", "time_to": "15:00:00", "module_id": "price_above_avg", "params": {}},))
    today = ("today", Node("point", "Where", {"stock": catalog.CURRENT, "from": end(), "to": end(), "pred": ex("Bool", True), "select": "Last"}))
    stage = Stage("s", points=[today], conditions=[("up", ex("Gt", C, O)), ("minutes", test)])
    found = Screen(Pipeline([stage]), bars, D0, D0 + timedelta(days=5), minutes=spark.read.parquet(path)).scan()
    text = plan_of(found)
    assert "LeftSemi" in text and "GreaterThanOrEqual(date" in text  # below the grouping of minutes
    assert [r.eliminated_reason for r in found.orderBy("date").collect()] == ["minutes", "up"]


def test_slope_and_as_of_rows_where_minutes_are_missing(spark):
    rows = [(0, 1, D0, m, p, 1.0, 1.0) for m, p in ((0, 10.0), (2, 14.0), (4, 18.0))]
    days = minute_days(spark.createDataFrame(rows, "market int, code int, date date, minute int, price double, avg double, volume double"))
    slope = lambda a, b: days.select(Day(F.col("day"), a, b, {}, F.lit(0.1)).value(mx("Slope", "White", *WHOLE))).first()[0]
    assert [slope(1, 4), slope(0, 4), slope(3, 3), slope(1, 3)] == [4.0, 4.0, 0.0, 4.0]
    at = lambda ref, params=None: days.select(Day(F.col("day"), 1, 3, params or {}, F.lit(0.1)).value(mx("White", ref))).first()[0]
    assert [at(tm("At", "09:32")), at(tm("At", "09:33")), at(tm("Param", "t"), {"t": "09:36"}), at(tm("RangeStart")), at(tm("RangeEnd"))] == [10.0, 14.0, 18.0, 10.0, 14.0]
    size = lambda a, b: days.select(F.size(Day(F.col("day"), a, b, {}, F.lit(0.1)).rows(F.lit(a), F.lit(b)))).first()[0]
    assert [size(1, 3), size(5, 9), size(3, 1), size(0, 239)] == [1, 1, 0, 3]


def test_long_windows_and_many_ways(spark):
    bars = random_bars(spark, 11).persist()
    pattern = Pattern("p", [Block("A", "Up", 1, 12), Block("F", "Any", 0, 12), Block("B", "Down", 1, 12)])
    stage = Stage("s", windowsize=(1, 36), kline_pattern=pattern, points=[("a", Node("point", "BlockEnd", ("A",)))])
    out = Screen(Pipeline([stage]), bars, D0, D0 + timedelta(days=90)).scan().collect()
    from candlewick.operators import screen as module

    assert any(len(r.stage_results[0].matches) > 3 for r in out)
    searched = module.Screen._fitting
    module.Screen._fitting = lambda self, stage, blocks: self._searched(stage.kline_pattern, stage.windowsize, blocks)
    try:
        again = Screen(Pipeline([stage]), bars, D0, D0 + timedelta(days=90)).scan().collect()
    finally:
        module.Screen._fitting = searched
    assert sorted(map(str, out)) == sorted(map(str, again))
    bars.unpersist()


def test_symbols_of_any_length(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1234567), (2, 123456)], "market int, code int").select(symbol_of(F.col("market"), F.col("code"))).collect()
    assert [r[0] for r in rows] == ["SZ.000001", "SH.1234567", "BJ.123456"]


def test_periods_are_checked(spark):
    bars = series(spark, [1, 2], [2, 1])
    for period in (0, -3):
        with pytest.raises(ValueError):
            Screen(Pipeline([Stage("s", indicators=[("sma", {"period": period})], conditions=[("c", ex("Gt", C, 0))])]), bars, D0, D0).run()
    with pytest.raises(KeyError):
        Screen(Pipeline([Stage("s", indicators=[("sma", {})], conditions=[("c", ex("Gt", C, 0))])]), bars, D0, D0).run()


def test_sources(spark, tmp_path):
    folder = f"file://{tmp_path}"
    bars = series(spark, range(1, 41), range(2, 42)).unionAll(series(spark, range(1, 41), range(2, 42), 1, 7))
    raw = bars.select("market", "code", "date", *[(F.col(c) * 10000).cast("int").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"), (F.col("amount") * 10000).cast("long").alias("amount"))
    raw.where("date < '2024-01-20'").withColumn("date", F.date_sub("date", 365)).write.parquet(f"{folder}/klines/2023.parquet")
    raw.write.parquet(f"{folder}/klines/2024.parquet")
    minute = spark.createDataFrame([(0, 1, D0, 0, 100000, 100000, 5), (1, 7, D0, 0, 110000, 110000, 6), (0, 1, D0 + timedelta(days=40), 0, 1, 1, 1)], "market int, code int, date date, minute int, price int, avg int, volume long")
    minute.where("date < '2024-02-01'").write.parquet(f"{folder}/minutes/2024/01.parquet")
    minute.where("date >= '2024-02-01'").write.parquet(f"{folder}/minutes/2024/02.parquet")
    one = spark.createDataFrame([(1, 7), (1, 7), (9, 9)], "market int, code int")
    table = TableBars(bars, spark.createDataFrame([(0, 1, D0, 0, 10.0, 10.0, 5.0), (1, 7, D0, 0, 11.0, 11.0, 6.0)], MINUTE_COLUMNS))
    for source in (ParquetBars(spark, folder), table):
        assert isinstance(source, BarSource)
        got = source.bars(D0, D0 + timedelta(days=9), one).collect()
        assert len(got) == 10 and {(r.market, r.code) for r in got} == {(1, 7)}
        assert source.series(0, 1, D0, D0 + timedelta(days=2)).count() == 3
        assert source.timeframe("Weekly", D0, D0 + timedelta(days=13), one).count() == 2
        keys = spark.createDataFrame([(1, 7, D0)], "market int, code int, date date")
        with kept(source.minutes(D0, D0 + timedelta(days=20), keys)) as rows:
            assert [(r.market, r.price, r.volume) for r in rows.collect()] == [(1, 11.0, 6.0)]
        assert source.minutes(D0, D0 + timedelta(days=20)).count() == 2
    assert ParquetBars(spark, folder).bars(date(2023, 1, 1), date(2024, 12, 31)).count() == 2 * 19 + 2 * 40  # years together
    catalog_table = spark.createDataFrame([(0, "000001", "a", "stock"), (1, "000007", "b", "index")], "market int, code string, name string, security_kind string")
    assert [tuple(r) for r in stocks(catalog_table).collect()] == [(0, 1)]
    many = spark.createDataFrame([(i % 3, i) for i in range(100)], "market int, code int")
    assert sampled(many, 7).collect() == sampled(many.repartition(5), 7).collect() and sampled(many, 200).count() == 100
    assert TableBars(bars).minutes(D0, D0).count() == 0


def test_strategies_and_calls(spark, tmp_path):
    bars = series(spark, [1, 2, 3], [2, 1, 4]).unionAll(series(spark, [1, 1, 1], [1, 1, 1], 1, 1234567))
    pipeline = Pipeline([Stage("s", conditions=[("up", ex("Gt", C, O))], extra_stocks=["SZ.000001"])])
    text = pipeline_to_json(pipeline)
    store = StrategyStore(spark, f"file://{tmp_path}/strategies")
    assert store.names() == []
    store.save("first", text)
    store.save("first", text)
    assert store.names() == ["first"]
    with pytest.raises(KeyError):
        store.load("second")
    screen = calls.screen_of(store.load("first"), bars, D0, D0 + timedelta(days=5))
    got = calls.run_call(screen)
    assert (got["passed"], got["total"]) == (1, 2) and [r["symbol"] for r in got["rows"]] == ["SZ.000001", "SH.1234567"] and got["rows"][1]["eliminated_reason"] == "up" and got["elapsed_ms"] >= 0
    days = calls.scan_call(screen)
    assert days["dates"] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert [(d["passed"], d["total"], len(d["rows"])) for d in days["results"].values()] == [(1, 2, 1), (0, 2, 0), (1, 2, 1)]
    assert json.loads(json.dumps(days)) == days
    assert calls.validate_call(text, bars) == [] and calls.validate_call('{"stages": [{"name": "s", "conditions": [["a", {"t": "No"}]]}]}', bars)
    assert calls.needs_call(text) == {"market": False, "stocks": ["SZ.000001"]} and calls.symbols_call(bars) == ["SH.1234567", "SZ.000001"]
    assert set(json.loads(calls.registry_call())["indicators"]) == set(default_registry().indicators)
    write_scan(screen.scan().select("market", "code", "date", "passed"), f"{tmp_path}/scan")
    assert sorted(p.name for p in (tmp_path / "scan").glob("date=*")) == ["date=2024-01-01", "date=2024-01-02", "date=2024-01-03"]


def test_numbers_and_tests_stand_for_each_other(spark):
    bars = series(spark, [1, 2, 0], [2, 1, 0])
    expr = ex("Eq", ex("Add", ex("Gt", C, O), ex("Bool", True)), ex("Add", ex("Not", C), 2))
    for array in (False, True):
        assert verdicts(bars, Stage("s", conditions=[("c", expr)]), array) == [True, False, False]


def test_engulfing_forms_agree(spark):
    bars = random_bars(spark, 13).persist()
    for direction in ("up", "down"):
        one = verdicts(bars, engulfing_stage(direction))
        assert one == verdicts(bars, Stage("s", conditions=[("c", condition_from({"type": "engulfing", "direction": direction}))])) and any(one)
    with pytest.raises(ValueError):
        condition_from({"type": "nothing"})
    bars.unpersist()


def test_gaps_from_zero(spark, tmp_path):
    """A gap's form says whether a close of zero before counts; q_form_groups, as in its SQL, counts it, with an infinite rise."""
    closes = [0.0, 1.0, 0.0, 0.0, -1.0, -0.0, 1.0, 1.04, 1.1]
    bars = series(spark, [1] * 9, closes).persist()
    want = {("up", False): [8], ("up", True): [1, 3, 8], ("down", False): [2, 5], ("down", True): [2, 4, 5, 6]}
    for (direction, from_zero), days in want.items():
        stage = Stage("s", conditions=[("c", condition_from({"type": "gap", "direction": direction, "percent": 5, "from_zero": from_zero}))])
        assert pipeline_from_json(pipeline_to_json(Pipeline([stage]))).stages[0].conditions == stage.conditions
        for array in (False, True):
            assert [i for i, passed in enumerate(verdicts(bars, stage, array)) if passed] == days, (direction, from_zero, array)
    bars.unpersist()
    at = lambda day, hour: datetime(2024, 1, day, hour)
    rows = [(0, at(1, 9), 1, 0.0), (1, at(2, 9), 1, 2.0), (2, at(2, 10), 1, 3.0), (3, at(1, 9), 2, 2.99), (4, at(2, 9), 2, 2.0), (5, at(2, 10), 2, 3.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    got = catalog.QUERIES["q_form_groups"](spark, f"file://{tmp_path}").orderBy("code", "date").collect()
    assert [r.passed for r in got] == [False, True, False, False]


def test_exponential_mean_of_a_long_series(spark):
    closes = [float(i * 7919 % 101) for i in range(900)]
    bars = series(spark, closes, closes)
    got = [r.ema_3 for r in with_indicators(bars, [("ema", {"period": 3})], default_registry()).orderBy("date").collect()]
    mean, want = closes[0], []
    for x in closes:
        mean += 0.5 * (x - mean)
        want.append(mean)
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:], abs=1e-9)


def test_registered_queries_have_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    assert isinstance(Registry(), Registry)

"""Indicator formulas as window columns, and the modules that come with the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ast import Node, Registry, fx, mx, tm
from ..plans.needs import ewma_bars, period_of
from .scalars import clean, divide

KEY = ("market", "code")


def series():
    """The bars of one series by date."""
    return Window.partitionBy(*KEY).orderBy("date")


_ROLLING = {"RollingMean": F.avg, "RollingStd": F.stddev_samp, "RollingMax": F.max, "RollingMin": F.min, "RollingSum": F.sum}


def formula_column(f: Node, params: dict) -> Column:
    """A formula at each bar; a rolling value is null until its period is full."""
    own = lambda x: formula_column(x, params)
    if f.kind == "Col":
        return F.col(f.args[0])
    if f.kind == "Lit":
        return F.lit(float(f.args[0]))
    if f.kind == "Param":
        if f.args[0] not in params:
            raise KeyError(f"no parameter {f.args[0]!r}")
        return F.lit(float(params[f.args[0]]))
    if f.kind in _ROLLING:
        n = period_of(f["period"], params)
        if n < 1:
            raise ValueError("a period is 1 or more")
        frame = series().rowsBetween(1 - n, 0)
        src = own(f["src"])
        return F.when(F.count(src).over(frame) == n, _ROLLING[f.kind](src).over(frame))
    if f.kind == "Ewma":
        # By the recursion from the oldest bar that still counts: m + 2 / (n + 1) * (x - m), null until the period is full.
        n = period_of(f["period"], params)
        if n < 1:
            raise ValueError("a period is 1 or more")
        held = F.collect_list(own(f["src"])).over(series().rowsBetween(1 - max(n, ewma_bars(n)), 0))
        return F.when(F.size(held) >= n, F.aggregate(F.slice(held, 2, F.size(held)), F.get(held, F.lit(0)), lambda m, x: m + F.lit(2.0 / (n + 1)) * (x - m)))
    if f.kind == "Shift":
        n = period_of(f["periods"], params)
        return F.lag(own(f["src"]), n).over(series()) if n >= 0 else F.lead(own(f["src"]), -n).over(series())
    if f.kind == "IfElse":
        return F.when(F.coalesce(own(f["cond"]) != 0, F.lit(False)), own(f["then_val"])).otherwise(own(f["else_val"]))
    a = [own(x) for x in f.args]
    return {"Add": lambda: a[0] + a[1], "Sub": lambda: a[0] - a[1], "Mul": lambda: a[0] * a[1], "Div": lambda: divide(a[0], a[1]), "Abs": lambda: F.abs(a[0]), "Neg": lambda: -a[0], "Sqrt": lambda: F.sqrt(F.when(a[0] >= 0, a[0]))}[f.kind]()


def output_name(template: str, params: dict) -> str:
    for k, v in params.items():
        template = template.replace("{" + k + "}", str(int(v)) if isinstance(v, float) and v.is_integer() else str(v))
    return template


def with_indicators(bars: DataFrame, calls: list[tuple[str, dict]], registry: Registry) -> DataFrame:
    """bars with each call's columns; a later call may read an earlier one's."""
    for module, params in calls:
        if module not in registry.indicators:
            raise KeyError(f"no indicator module {module!r}")
        own = {output_name(t, params): clean(formula_column(f, params)) for t, f in registry.indicators[module]["outputs"]}
        if set(own) - set(bars.columns):
            bars = bars.withColumns(own)
    return bars


def default_registry() -> Registry:
    """Simple and exponential moving averages, Bollinger bands, highs and lows; and the minute modules."""
    period, k, close = fx("Param", "period"), fx("Param", "k"), fx("Col", "close")
    mean, spread = fx("RollingMean", close, period), fx("Mul", fx("RollingStd", close, period), k)
    high, low = fx("RollingMax", fx("Col", "high"), period), fx("RollingMin", fx("Col", "low"), period)
    modules = {
        "sma": (["period"], [("sma_{period}", mean)]),
        "boll": (["period", "k"], [("boll_mid_{period}", mean), ("boll_upper_{period}", fx("Add", mean, spread)), ("boll_lower_{period}", fx("Sub", mean, spread))]),
        "ema": (["period"], [("ema_{period}", fx("Ewma", close, period))]),
        "vol_ma": (["period"], [("vol_ma_{period}", fx("RollingMean", fx("Col", "volume"), period))]),
        "high_n": (["period"], [("high_{period}", high), ("high_n_{period}", high)]),
        "low_n": (["period"], [("low_{period}", low), ("low_n_{period}", low)]),
    }
    price, avg = mx("White", tm("EachMinute")), mx("Yellow", tm("EachMinute"))
    whole = tm("RangeStart"), tm("RangeEnd")
    test = lambda kind, a, b: Node("test", kind, (a, b))
    minute = {
        "price_above_avg": mx("AllMinutes", test("Gt", price, avg), *whole),
        "price_below_avg": mx("AllMinutes", test("Lt", price, avg), *whole),
        "price_cross_avg": Node("test", "And", (mx("AnyMinute", test("Gt", price, avg), *whole), mx("AnyMinute", test("Lt", price, avg), *whole))),
        "limit_up_touch": mx("AnyMinute", test("Gte", price, mx("LimitUpPrice")), *whole),
        "limit_up_sealed": mx("AllMinutes", test("Gte", price, mx("LimitUpPrice")), *whole),
    }
    return Registry({i: {"id": i, "param_names": p, "outputs": o} for i, (p, o) in modules.items()}, {i: {"id": i, "param_names": [], "expr": e} for i, e in minute.items()})

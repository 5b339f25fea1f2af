"""Tests of one day's minutes, as higher-order functions over a sorted array of (minute, price, avg, volume)."""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import Node, time_of
from .scalars import COMPARE, COUNTS, divide, yes

#: The session's last slot.
LAST = 239


def slot(t: time) -> int:
    """The slot of a clock time. The morning 09:31 to 11:30 is 0 to 119, the afternoon 13:01 to 15:00 is 120 to 239;
    earlier times are 0, later ones 239, the break up to 12:00 is 119 and after it 120."""
    m = t.hour * 60 + t.minute
    if m <= 9 * 60 + 31:
        return 0
    if m <= 11 * 60 + 30:
        return m - (9 * 60 + 31)
    if m <= 12 * 60:
        return 119
    return min(max(m - (13 * 60 + 1) + 120, 120), LAST)


def strip(test: Node) -> Node:
    """The test of one minute within AllMinutes and AnyMinute."""
    while test.kind in ("AllMinutes", "AnyMinute"):
        test = test["pred"]
    return test


class Day:
    """One day's array `m`, a range of slots (numbers), parameters, and the price limits' rate."""

    def __init__(self, m: Column, first, last, params: dict, rate: Column):
        self.m, self.first, self.last, self.params, self.rate = m, first, last, params, rate
        self.before = F.get(m, F.lit(0))["price"]

    def time(self, ref: Node, minute) -> Column:
        if ref.kind == "EachMinute":
            return minute if minute is not None else F.lit(self.first)
        if ref.kind in ("At", "Param"):
            text = ref.args[0] if ref.kind == "At" else self.params.get(ref.args[0])
            return F.lit(slot(time_of(text)) if isinstance(text, str) else int(text))
        return F.lit(self.first if ref.kind == "RangeStart" else self.last)

    def row(self, at: Column) -> Column:
        """The last row up to a slot, or the first row if none is."""
        return F.coalesce(F.try_element_at(F.filter(self.m, lambda x: x["minute"] <= at), F.lit(-1)), F.get(self.m, F.lit(0)))

    def place(self, at: Column) -> Column:
        """The number of the row that row() gives."""
        return F.greatest(F.size(F.filter(self.m, lambda x: x["minute"] <= at)), F.lit(1))

    def rows(self, frm: Column, to: Column) -> Column:
        """The rows from the first at or after `frm` (the last if none is) to the last up to `to` (the first if none is); none if reversed."""
        lo = F.coalesce(F.array_min(F.transform(F.filter(self.m, lambda x: x["minute"] >= frm), lambda x: x["minute"])), F.array_max(F.transform(self.m, lambda x: x["minute"])))
        hi = F.coalesce(F.array_max(F.transform(F.filter(self.m, lambda x: x["minute"] <= to), lambda x: x["minute"])), F.array_min(F.transform(self.m, lambda x: x["minute"])))
        return F.filter(self.m, lambda x: (frm <= to) & (x["minute"] >= lo) & (x["minute"] <= hi))

    def series(self, row: Column, name: str) -> Column:
        return row[{"White": "price", "Close": "price", "Open": "price", "Yellow": "avg", "Volume": "volume"}[name]]

    def count(self, pred: Node, frm: Node, to: Node, minute) -> Column:
        return F.size(F.filter(self.rows(self.time(frm, minute), self.time(to, minute)), lambda x: self.test(pred, x["minute"])))

    def turns(self, frm: Node, to: Node, minute, above) -> Column:
        """How often `above` of a row turns from false to true."""
        zero = F.struct(F.lit(None).cast("boolean").alias("was"), F.lit(0).alias("n"))

        def step(a, x):
            now = above(x)
            return F.struct(now.alias("was"), (a["n"] + F.when(yes(~a["was"] & now), 1).otherwise(0)).alias("n"))

        return F.aggregate(self.rows(self.time(frm, minute), self.time(to, minute)), zero, step)["n"]

    def value(self, v: Node, minute=None) -> Column:
        kind = v.kind
        if kind == "Lit":
            return F.lit(float(v.args[0]))
        if kind == "Param":
            if v.args[0] not in self.params:
                raise KeyError(f"no parameter {v.args[0]!r}")
            return F.lit(float(self.params[v.args[0]]))
        if kind in ("White", "Yellow", "Close", "Open", "Volume"):
            return self.series(self.row(self.time(v.args[0], minute)), kind)
        if kind == "YesterdayOpen":
            return self.before
        if kind in ("LimitUpPrice", "LimitDownPrice"):
            from .scalars import limit_price

            return limit_price(self.before, self.rate, kind == "LimitUpPrice")
        if kind == "Slope":
            frm, to = self.time(v["from"], minute), self.time(v["to"], minute)
            steps = F.greatest(self.place(to) - self.place(frm), F.lit(1))
            return (self.series(self.row(to), v["series"]) - self.series(self.row(frm), v["series"])) / steps
        if kind == "Duration":
            return self.count(v["pred"], v["from"], v["to"], minute).cast("double")
        if kind == "CrossCount":
            return self.turns(v["from"], v["to"], minute, lambda x: yes(self.series(x, v["a"]) > self.series(x, v["b"]))).cast("double")
        if kind == "CrossAbove":
            level = self.value(v["threshold"], minute)
            return self.turns(v["from"], v["to"], minute, lambda x: yes(self.series(x, v["series"]) >= level)).cast("double")
        a = [self.value(x, minute) for x in v.args]
        return {"Add": lambda: a[0] + a[1], "Sub": lambda: a[0] - a[1], "Mul": lambda: a[0] * a[1], "Div": lambda: divide(a[0], a[1]), "Abs": lambda: F.abs(a[0])}[kind]()

    def test(self, t: Node, minute=None) -> Column:
        kind = t.kind
        if kind in COMPARE:
            return COMPARE[kind](self.value(t.args[0], minute), self.value(t.args[1], minute))
        if kind == "And":
            return self.test(t.args[0], minute) & self.test(t.args[1], minute)
        if kind == "Or":
            return self.test(t.args[0], minute) | self.test(t.args[1], minute)
        if kind == "Not":
            return ~self.test(t.args[0], minute)
        rows = self.rows(self.time(t["from"], minute), self.time(t["to"], minute))
        if kind == "AllMinutes":
            return F.forall(rows, lambda x: self.test(t["pred"], x["minute"]))
        if kind == "AnyMinute":
            return F.exists(rows, lambda x: self.test(t["pred"], x["minute"]))
        n, least = self.count(t["pred"], t["from"], t["to"], minute), F.floor(self.value(t["minutes"], minute))
        return yes(n >= least) if kind == "DurationGte" else yes(n <= least)

    def streak(self, pred: Node) -> Column:
        """The longest run of rows of the range that pass."""
        zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

        def step(a, x):
            now = F.when(self.test(pred, x["minute"]), a["now"] + 1).otherwise(0)
            return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

        return F.aggregate(self.rows(F.lit(self.first), F.lit(self.last)), zero, step)["most"]


def day_test(m: Column, module: Node, first: int, last: int, params: dict, rate: Column) -> Column:
    """A module's test of a day; a missing day fails."""
    return yes(F.when(F.size(m) > 0, Day(m, first, last, params, rate).test(module)))


def day_streak(m: Column, module: Node, first: int, last: int, params: dict, rate: Column, op: str, minutes: int) -> Column:
    return yes(F.when(F.size(m) > 0, COUNTS[op](Day(m, first, last, params, rate).streak(strip(module)), F.lit(minutes))))

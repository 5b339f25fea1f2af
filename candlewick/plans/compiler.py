"""Translation of expressions to columns, in two forms that agree wherever both apply.

BarColumns: each bar of a series is a window's end; places are fixed offsets, so values are lag, lead and
framed window aggregates. It refuses (Dynamic) what has no fixed offset.
BarArrays: a row has an array of bars, the window's end at index `a`, its start at `s`, points in columns of
their own; places are index columns, so values are array look-ups and higher-order functions.

Values of other stocks stand in columns of the screened stock's own bars, joined by date: a path's offset
counts the other stock's bars. `fields` collects which of them are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.indicators import series
from ..functions.minutes import day_streak, day_test, slot
from ..functions.scalars import COMPARE, COUNTS, change, divide, is_candle, limit_rate, quotient, yes
from .ast import CURRENT, MARKET, Node, Path, Registry, time_of

TESTS = frozenset("Bool Gt Lt Gte Lte Eq Between And Or Not Implies All Any CountBars CrossUp CrossDown CandleIs PointExists Monotone SyncWithMarket Intraday IntradayDuration".split())
STEPS = {"StrictInc": lambda a, b: a < b, "StrictDec": lambda a, b: a > b, "NonDec": lambda a, b: a <= b, "NonInc": lambda a, b: a >= b}
#: Bars of a range whose test mixes each bar with the window's ends: one copy of the test for each.
UNROLL = 64


class Dynamic(Exception):
    """An expression without a fixed offset."""


class Compiler:
    """What both forms share. Subclasses give places, look-ups and ranges."""

    def __init__(self, registry: Registry):
        self.registry = registry
        self.vars: dict[str, tuple[Column, bool]] = {}
        self.fields: dict[tuple[Node, str, int], str] = {}
        self.days: dict[tuple[str, Node], str] = {}
        self.prefix = "_"

    def field(self, stock: Node, name: str, offset: int = 0) -> str:
        if stock.kind == "Current":
            return name
        return self.fields.setdefault((stock, name, offset), f"__other{len(self.fields)}")

    def read(self, stock: Node, name: str, place, offset: int = 0) -> Column:
        """A field at a place; the offset counts the stock's own bars."""
        if stock.kind == "Current":
            return self.at(name, self.moved(place, offset))
        return self.at(self.field(stock, name, offset), place)

    def is_test(self, e: Node) -> bool:
        return e.kind in TESTS or e.kind == "Var" and e.args[0] in self.vars and self.vars[e.args[0]][1]

    def number(self, e: Node, each=None) -> Column:
        if self.is_test(e):
            return self.test(e, each).cast("double")
        k = e.kind
        if k == "Num":
            return F.lit(float(e.args[0]))
        if k == "Path":
            p = e.args[0]
            if p.field is None:
                raise ValueError("a path in an expression names a field")
            return self.read(p.stock, p.field, self.place(p, each), p.offset)
        if k == "Var":
            return self.variable(e.args[0], each)
        if k in ("Agg", "RangeVal"):
            return self.aggregate(e, each)
        if k == "PctChange":
            return change(self.number(e["from"], each), self.number(e["to"], each))
        a = [self.number(x, each) for x in e.args]
        return {"Neg": lambda: -a[0], "Abs": lambda: F.abs(a[0]), "Add": lambda: a[0] + a[1], "Sub": lambda: a[0] - a[1], "Mul": lambda: a[0] * a[1], "Div": lambda: divide(a[0], a[1]), "Quotient": lambda: quotient(a[0], a[1])}[k]()

    def variable(self, name: str, each) -> Column:
        if name in self.vars:
            return self.vars[name][0]
        return self.at(name, self.here(each))  # a column of the bars, such as an indicator's

    def test(self, e: Node, each=None) -> Column:
        k = e.kind
        if not self.is_test(e):
            return yes(self.number(e, each) != 0)
        if k == "Bool":
            return F.lit(bool(e.args[0]))
        if k == "Var":
            return self.variable(e.args[0], each)
        if k in COMPARE:
            return COMPARE[k](self.number(e.args[0], each), self.number(e.args[1], each))
        if k == "Between":
            v = self.number(e["val"], each)
            return yes((v >= self.number(e["low"], each)) & (v <= self.number(e["high"], each)))
        if k == "And":
            return self.test(e.args[0], each) & self.test(e.args[1], each)
        if k == "Or":
            return self.test(e.args[0], each) | self.test(e.args[1], each)
        if k == "Not":
            return ~self.test(e.args[0], each)
        if k == "Implies":
            return ~self.test(e["antecedent"], each) | self.test(e["consequent"], each)
        if k in ("CrossUp", "CrossDown"):
            return self.cross(e, each)
        if k == "CandleIs":
            p = e["at"]
            return yes(is_candle(self.read(e["stock"], "candle", self.place(p, each), p.offset), e["candle"]))
        if k == "PointExists":
            return self.point_exists(e.args[0])
        if k == "All":
            return yes(self.holds(e, each, every=True))
        if k == "Any":
            return yes(self.holds(e, each, every=False))
        if k == "CountBars":
            return COUNTS[e["op"]](self.count(e, each), F.lit(int(e["n"])))
        if k == "Monotone":
            return yes(self.monotone(e, each))
        if k == "SyncWithMarket":
            same = lambda place: yes((self.at("close", place) > self.at("open", place)) == (self.read(MARKET, "close", place) > self.read(MARKET, "open", place)))
            return yes(self.all_of(e, each, same))
        return self.minute_test(e)

    def cross(self, e: Node, each) -> Column:
        """The bar before at or below the threshold and this one above it; a threshold that names each bar is taken at either."""
        p = e["at"]
        here = self.moved(self.place(p, each), p.offset)
        before = self.moved(here, -1)
        stock = e["stock"]
        now = self.read(stock, e["col"], here) if stock.kind == "Current" else self.read(stock, e["col"], self.place(p, each), p.offset)
        was = self.read(stock, e["col"], before) if stock.kind == "Current" else self.read(stock, e["col"], self.place(p, each), p.offset - 1)
        t = e["threshold"]
        level, level_was = self.number(t, here), self.number(t, before)
        return yes((was <= level_was) & (now > level)) if e.kind == "CrossUp" else yes((was >= level_was) & (now < level))

    def minute_test(self, e: Node) -> Column:
        own = e.args if isinstance(e.args, dict) else e.args[0]
        module = self.registry.intraday.get(own["module_id"])
        if module is None:
            return F.lit(False)
        stock = own["stock"] if e.kind == "Intraday" else CURRENT
        name = self.days.setdefault((own["anchor_point"], stock), f"{self.prefix}_day{len(self.days)}")
        first, last = slot(time_of(own["time_from"])), slot(time_of(own["time_to"]))
        rate = limit_rate(F.col("market"), F.col("code"))
        if e.kind == "Intraday":
            return day_test(F.col(name), module["expr"], first, last, own["params"], rate)
        return day_streak(F.col(name), module["expr"], first, last, own["params"], rate, own["op"], int(own["minutes"]))


class BarColumns(Compiler):
    """Places are offsets from the current row."""

    def __init__(self, registry: Registry, window: int | None = None, points: dict[str, int] | None = None):
        super().__init__(registry)
        self.window, self.points, self.free = window, points or {}, True

    def place(self, p: Path, each) -> int:
        kind = p.anchor.kind
        if kind == "EachBar":
            return self.here(each)
        if not self.free:
            raise Dynamic("an end of the window within a test of each bar")
        if kind == "WindowEnd":
            return 0
        if kind == "WindowStart" and self.window is not None:
            return 1 - self.window
        if kind == "Point" and p.anchor.args[0] in self.points:
            return self.points[p.anchor.args[0]]
        raise Dynamic(kind)

    def here(self, each) -> int:
        return 0 if each is None else each

    def moved(self, place: int, by: int) -> int:
        return place + by

    def at(self, name: str, place: int) -> Column:
        c = F.col(name)
        return c if not place else F.lag(c, -place).over(series()) if place < 0 else F.lead(c, place).over(series())

    def shifted(self, c: Column, place: int) -> Column:
        return c if not place else F.lag(c, -place).over(series()) if place < 0 else F.lead(c, place).over(series())

    def variable(self, name: str, each) -> Column:
        if name in self.vars and not self.free:
            raise Dynamic("a variable within a test of each bar")
        return super().variable(name, each)

    def span(self, e: Node, each) -> tuple[int, int]:
        a, b = (self.moved(self.place(e[x], each), e[x].offset) for x in ("from", "to"))
        return min(a, b), max(a, b)

    def frame(self, lo: int, hi: int):
        return series().rowsBetween(lo, hi)

    def full(self, lo: int, hi: int) -> Column:
        return F.count(F.lit(1)).over(self.frame(lo, hi)) == hi - lo + 1

    def aggregate(self, e: Node, each) -> Column:
        lo, hi = self.span(e, each)
        if e["func"] in ("First", "Last"):
            return F.when(self.full(lo, hi), self.read(e["stock"], e["col"], lo if e["func"] == "First" else hi))
        func = {"Max": F.max, "Min": F.min, "Mean": F.avg, "Sum": F.sum, "StdDev": F.stddev_pop}[e["func"]]
        return F.when(self.full(lo, hi), func(F.col(self.field(e["stock"], e["col"]))).over(self.frame(lo, hi)))

    def per_bar(self, e: Node, each):
        """The test of each bar as a column of that bar; None if it also names the window's ends."""
        if each not in (None, 0):
            return None
        was, self.free = self.free, False
        try:
            return self.test(e["pred"], 0)
        except Dynamic:
            return None
        finally:
            self.free = was

    def unrolled(self, e: Node, each, lo: int, hi: int) -> list[Column]:
        if hi - lo >= UNROLL:
            raise Dynamic("a long range whose test also names the window's ends")
        return [self.test(e["pred"], k) for k in range(lo, hi + 1)]

    def holds(self, e: Node, each, every: bool) -> Column:
        lo, hi = self.span(e, each)
        own = self.per_bar(e, each)
        if own is not None:
            return self.full(lo, hi) & (F.bool_and(own) if every else F.bool_or(own)).over(self.frame(lo, hi))
        out = self.full(lo, hi)
        tests = self.unrolled(e, each, lo, hi)
        whole = tests[0]
        for t in tests[1:]:
            whole = whole & t if every else whole | t
        return out & whole

    def count(self, e: Node, each) -> Column:
        lo, hi = self.span(e, each)
        own = self.per_bar(e, each)
        if own is not None:
            n = F.sum(own.cast("int")).over(self.frame(lo, hi))
        else:
            n = sum((t.cast("int") for t in self.unrolled(e, each, lo, hi)), F.lit(0))
        return F.when(self.full(lo, hi), n)

    def all_of(self, e: Node, each, test) -> Column:
        lo, hi = self.span(e, each)
        return self.full(lo, hi) & F.bool_and(test(0)).over(self.frame(lo, hi))

    def monotone(self, e: Node, each) -> Column:
        lo, hi = self.span(e, each)
        if lo == hi:
            return F.lit(False)
        name = self.field(e["stock"], e["col"])
        return self.full(lo, hi) & F.bool_and(yes(STEPS[e["dir"]](F.lag(name, 1).over(series()), F.col(name)))).over(self.frame(lo + 1, hi))

    def point_exists(self, name: str) -> Column:
        if name not in self.points:
            raise Dynamic(name)
        return self.at("date", self.points[name]).isNotNull()


class BarArrays(Compiler):
    """Places are indices into the array `bars`."""

    def __init__(self, registry: Registry):
        super().__init__(registry)
        self.points: dict[str, Column] = {}

    def place(self, p: Path, each) -> Column:
        kind = p.anchor.kind
        if kind == "EachBar":
            return self.here(each)
        if kind == "Point":
            return self.points.get(p.anchor.args[0], F.lit(None).cast("int"))
        return F.col("a" if kind == "WindowEnd" else "s")

    def here(self, each) -> Column:
        return F.col("a") if each is None else each

    def moved(self, place: Column, by: int) -> Column:
        return place + by if by else place

    def at(self, name: str, place: Column) -> Column:
        return F.get(F.col("bars"), place)[name]

    def indices(self, e: Node, each) -> Column:
        """The indices of a range, turned round if it is reversed; null if an end is missing."""
        a, b = (self.moved(self.place(e[x], each), e[x].offset) for x in ("from", "to"))
        lo, hi = F.least(a, b), F.greatest(a, b)
        fits = a.isNotNull() & b.isNotNull() & (lo >= 0) & (hi < F.size("bars"))
        return F.when(fits, F.sequence(F.coalesce(lo, F.lit(0)), F.greatest(F.coalesce(hi, F.lit(0)), F.coalesce(lo, F.lit(0)))))

    def aggregate(self, e: Node, each) -> Column:
        idx = self.indices(e, each)
        v = F.filter(F.transform(idx, lambda i: self.read(e["stock"], e["col"], i)), lambda x: x.isNotNull())
        func = e["func"]
        if func in ("First", "Last"):
            return self.read(e["stock"], e["col"], F.array_min(idx) if func == "First" else F.array_max(idx))
        if func in ("Max", "Min"):
            return (F.array_max if func == "Max" else F.array_min)(v)
        n, total = F.size(v), F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        if func == "Sum":
            return F.when(n > 0, total)
        mean = F.when(n > 0, F.try_divide(total, n))
        if func == "Mean":
            return mean
        squares = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        return F.when(n > 0, F.sqrt(F.try_divide(squares, n)))

    def holds(self, e: Node, each, every: bool) -> Column:
        return (F.forall if every else F.exists)(self.indices(e, each), lambda i: self.test(e["pred"], i))

    def count(self, e: Node, each) -> Column:
        idx = self.indices(e, each)
        return F.when(idx.isNotNull(), F.size(F.filter(idx, lambda i: self.test(e["pred"], i))))

    def all_of(self, e: Node, each, test) -> Column:
        return F.forall(self.indices(e, each), test)

    def monotone(self, e: Node, each) -> Column:
        idx = self.indices(e, each)
        first = F.array_min(idx)
        step = lambda i: (i == first) | yes(STEPS[e["dir"]](self.read(e["stock"], e["col"], i - 1), self.read(e["stock"], e["col"], i)))
        return (F.size(idx) > 1) & F.forall(idx, step)

    def point_exists(self, name: str) -> Column:
        return self.points[name].isNotNull() if name in self.points else F.lit(False)


__all__ = ["BarArrays", "BarColumns", "Compiler", "Dynamic", "Window"]

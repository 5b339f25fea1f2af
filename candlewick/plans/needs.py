"""What a stage needs of the data: bars before and after its anchor, other stocks, points and minute days."""

from __future__ import annotations

import math
from datetime import date, timedelta

from .ast import Node, Path, Registry, Stage
from .pattern import longest


def walk(x):
    """All nodes and paths below x, itself included."""
    if isinstance(x, Node | Path):
        yield x
    if isinstance(x, Node):
        for a in x.args.values() if isinstance(x.args, dict) else x.args:
            yield from walk(a)
    elif isinstance(x, dict):
        for a in x.values():
            yield from walk(a)


def stage_nodes(stage: Stage):
    for _, e in [*stage.vars, *stage.points, *stage.conditions]:
        yield from walk(e)
    for _, anchor, value, _ in stage.marks:
        yield from walk(anchor)
        if value is not None:
            yield from walk(value)


def stocks(stage: Stage) -> set[Node]:
    """Stocks other than the screened one that a stage refers to."""
    out = set()
    for x in stage_nodes(stage):
        if isinstance(x, Path):
            out.add(x.stock)
        elif isinstance(x.args, dict) and isinstance(x.args.get("stock"), Node) and x.kind not in ("Intraday", "IntradayDuration"):
            out.add(x.args["stock"])
        elif x.kind == "SyncWithMarket":
            out.add(Node("stock", "Market"))
    return {s for s in out if s.kind != "Current"}


def needs_market(stage: Stage) -> bool:
    """Whether a stage reads its market's index, in daily bars or minutes."""
    minute = any(isinstance(x, Node) and x.kind in ("Intraday",) and x.args[0]["stock"].kind.startswith("Market") for x in stage_nodes(stage))
    return minute or any(s.kind.startswith("Market") for s in stocks(stage))


def formula_lookback(f: Node, params: dict) -> int:
    """Bars before the current one that a formula reads."""
    own = f.args.values() if isinstance(f.args, dict) else f.args
    deep = max((formula_lookback(a, params) for a in own if isinstance(a, Node)), default=0)
    if f.kind.startswith("Rolling"):
        return formula_lookback(f["src"], params) + period_of(f["period"], params) - 1
    if f.kind == "Ewma":
        return formula_lookback(f["src"], params) + ewma_bars(period_of(f["period"], params)) - 1
    if f.kind == "Shift":
        return formula_lookback(f["src"], params) + max(0, period_of(f["periods"], params))
    return deep


def ewma_bars(period: int) -> int:
    """Bars after which an exponential mean's older values weigh less than a double's last bit."""
    share = 2 / (period + 1)
    return 1 if period <= 1 else math.ceil(-41.5 / math.log1p(-share))


def period_of(f: Node, params: dict) -> int:
    """A period: a literal or a parameter, nothing else."""
    if f.kind == "Lit":
        return int(f.args[0])
    if f.kind == "Param":
        if f.args[0] not in params:
            raise KeyError(f"no parameter {f.args[0]!r}")
        return int(params[f.args[0]])
    raise ValueError("a period is a literal or a parameter")


def reach(stage: Stage, registry: Registry) -> tuple[int, int]:
    """(lookback, lookahead) of a stage in bars, one bar to spare; a stage that reads its window's start without a pattern has no bound: its lookback is below 0, minus the bars that it may read before the start."""
    back = ahead = 0
    indicator = 0
    for module, params in stage.indicators:  # later ones may read earlier ones' outputs
        indicator += max((formula_lookback(f, params) for _, f in registry.indicators[module]["outputs"]), default=0)
    window = longest(stage.kline_pattern, stage.windowsize) if stage.kline_pattern else 0
    deltas = sum(abs(d["delta"]) for _, d in stage.points if d.kind == "Offset")
    start = False
    for x in stage_nodes(stage):
        if isinstance(x, Path):
            back, ahead = max(back, -x.offset), max(ahead, x.offset)
            start |= x.anchor.kind == "WindowStart" and not stage.kline_pattern
        elif x.kind in ("CrossUp", "CrossDown"):
            back = max(back, 1 - min(0, x["at"].offset))
    nested = 2 if any(isinstance(x, Node) and x.kind in ("All", "Any", "CountBars", "Where") for x in stage_nodes(stage)) else 1
    if start:
        return (back * nested + deltas + 1) * -1, ahead * nested + deltas
    return back * nested + indicator + max(0, window - 1) + deltas + 1, ahead * nested + deltas


def padded(frm: date, to: date, timeframe, back: int, ahead: int) -> tuple[date, date]:
    """The dates to load so that so many bars stand before `frm` and after `to`."""
    days = lambda n: 0 if n <= 0 else {"Weekly": 7 * n + 14, "Monthly": 31 * n + 31}.get(timeframe if isinstance(timeframe, str) else "Daily", 2 * n + 7)
    return frm - timedelta(days=days(max(0, back))), to + timedelta(days=days(ahead))

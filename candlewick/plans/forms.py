"""Screens from form conditions: comparisons, crosses, candles and gaps in groups, and the indicators that names ask for."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .ast import MARKET, Block, Node, Pattern, Pipeline, Registry, Stage, each, end, ex, val
from .needs import walk

OPERATORS = {"gt": "Gt", "gte": "Gte", "lt": "Lt", "lte": "Lte", "eq": "Eq"}
#: The module that gives the mean of a field, and the name that its output begins with.
MEANS = {("sma", "close"): "sma", ("sma", "volume"): "vol_ma", ("ema", "close"): "ema"}
#: Parameters that an output's name doesn't tell.
DEFAULTS = {"k": 2.0}
PERIOD = 20


@dataclass(frozen=True)
class Metric:
    """A field of the last bar, its mean over a window (simple: sma, exponential: ema), or a column of an own module ("module.column" or "column")."""

    field: str = "close"
    transform: str = "raw"
    window: int = 1
    column: str | None = None

    @property
    def name(self) -> str:
        if self.column:
            return self.column.split(".")[-1]
        if self.transform == "raw":
            return self.field
        if (self.transform, self.field) not in MEANS:
            raise ValueError(f"no {self.transform} of {self.field}")
        return f"{MEANS[self.transform, self.field]}_{self.window}"

    def value(self, offset: int = 0) -> Node:
        return val(end(offset), self.name)


def compare(left: Metric, op: str, right: Metric | float, multiplier: float = 1.0) -> Node:
    """left op right * multiplier; neq is the negation of eq, so it holds where a value is missing."""
    other = right.value() if isinstance(right, Metric) else ex("Num", float(right))
    if isinstance(right, Metric) and abs(multiplier - 1.0) >= 1e-6:
        other = ex("Mul", other, multiplier)
    if op == "neq":
        return ex("Not", ex("Eq", left.value(), other))
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}")
    return ex(OPERATORS[op], left.value(), other)


def cross(direction: str, left: Metric, right: Metric) -> Node:
    """left passes right between the bar before and the last one; right is taken at either."""
    return ex({"up": "CrossUp", "down": "CrossDown"}[direction], at=end(), col=left.name, threshold=val(each(), right.name))


def candle(kind: str) -> Node:
    return ex("CandleIs", at=end(), candle=kind)


def gap(direction: str, percent: float, from_zero: bool = False) -> Node:
    """The close rises, or falls, by more than so many percent from the bar before. From a close of nearly zero there is no gap, or, from_zero, one of the plain quotient's size: from zero itself an infinite one."""
    before, now = val(end(-1), "close"), val(end(), "close")
    change = ex("Mul", ex("Quotient", ex("Sub", now, before), before), 100) if from_zero else ex("PctChange", before, now)
    return ex("Gt", change, percent) if direction == "up" else ex("Lt", change, -percent)


def _engulfing(direction: str) -> tuple[str, str, Node]:
    """The two candles, and the test that the second's body covers the first's."""
    low, high = ("open", "close") if direction == "up" else ("close", "open")
    covers = ex("And", ex("Lte", val(end(), low), val(end(-1), high)), ex("Gte", val(end(), high), val(end(-1), low)))
    return ("Down", "Up", covers) if direction == "up" else ("Up", "Down", covers)


def engulfing(direction: str) -> Node:
    """A candle against the one before, whose body covers that one's: as one test."""
    before, now, covers = _engulfing(direction)
    return ex("And", ex("And", ex("CandleIs", at=end(-1), candle=before), ex("CandleIs", at=end(), candle=now)), covers)


def engulfing_stage(direction: str, name: str = "engulfing") -> Stage:
    """The same as a pattern of two blocks with a condition on their bodies."""
    before, now, covers = _engulfing(direction)
    return Stage(name, windowsize=(2, 2), kline_pattern=Pattern(name, [Block("before", before, 1, 1), Block("now", now, 1, 1)]), conditions=[("covers", covers)])


def counter_market(offset: int = 0) -> Node:
    """The series rises while its market's index doesn't, or the other way round; an index without a bar of that day doesn't rise."""
    up, other = ex("Gt", val(end(offset), "close"), val(end(offset), "open")), ex("Gt", val(end(offset, MARKET), "close"), val(end(offset, MARKET), "open"))
    return ex("Or", ex("And", up, ex("Not", other)), ex("And", ex("Not", up), other))


def group(logic: str, conditions: list[Node]) -> Node | None:
    """All (and) or any (or) of the conditions, from left to right; none of none."""
    out = None
    for c in conditions:
        out = c if out is None else ex({"and": "And", "or": "Or"}[logic], out, c)
    return out


def condition_from(x: dict) -> Node:
    """A condition from its JSON: {"type": compare, cross, candle, engulfing, gap or counter_market, ...}."""
    metric = lambda m: Metric(m.get("field", "close"), m.get("transform", "raw"), int(m.get("window", 1)), m.get("column"))
    kind = x["type"]
    if kind == "compare":
        right = x["right"]
        return compare(metric(x["left"]), x["op"], float(right["literal"]) if "literal" in right else metric(right["metric"]), float(right.get("multiplier", 1.0)))
    if kind == "cross":
        return cross(x["direction"], metric(x["left"]), metric(x["right"]))
    if kind == "candle":
        return candle(x["candle"])
    if kind == "engulfing":
        return engulfing(x["direction"])
    if kind == "gap":
        return gap(x["direction"], float(x["percent"]), bool(x.get("from_zero", False)))
    if kind == "counter_market":
        return counter_market()
    raise ValueError(f"no condition {kind!r}")


def form_stage(groups: list[dict], registry: Registry, name: str = "form") -> Stage:
    """A stage of groups {"logic": and or or, "conditions": [...]}, one condition for each that isn't empty, with the indicators that they name."""
    made = [(f"group_{i}", group(g.get("logic", "and"), [condition_from(c) for c in g["conditions"]])) for i, g in enumerate(groups, 1)]
    return collected(Stage(name, conditions=[(n, e) for n, e in made if e is not None]), registry)


def form_pipeline(groups: list[dict], registry: Registry) -> Pipeline:
    return Pipeline([form_stage(groups, registry)])


def _templates(registry: Registry):
    for module, own in registry.indicators.items():
        for template, _ in own["outputs"]:
            text = re.escape(template)
            for p in own["param_names"]:
                text = text.replace(re.escape("{" + p + "}"), rf"(?P<{p}>\d+(?:\.\d+)?)")
            yield module, own["param_names"], re.compile(text)


def indicator_calls(names, registry: Registry) -> list[tuple[str, dict]]:
    """The calls that give columns of these names, each once. Parameters that a name doesn't tell have their default."""
    out: list[tuple[str, dict]] = []
    templates = list(_templates(registry))
    for name in names:
        for module, params, pattern in templates:
            if m := pattern.fullmatch(name):
                told = m.groupdict()
                number = lambda v: float(v) if "." in v else int(v)
                call = module, {p: number(told[p]) if told.get(p) else DEFAULTS.get(p, PERIOD) for p in params}
                if call not in out:
                    out.append(call)
                break
    return out


def named_columns(stage: Stage) -> list[str]:
    """Names that a stage's expressions use as columns or variables, in order, each once."""
    own = [e for _, e in [*stage.vars, *stage.points, *stage.conditions]] + [x for _, anchor, value, _ in stage.marks for x in (anchor, value) if x is not None]
    out: dict[str, None] = {}
    for e in own:
        for n in walk(e):
            if not isinstance(n, Node):
                out |= {n.field: None} if n.field else {}
            elif n.kind == "Var":
                out[n.args[0]] = None
            elif isinstance(n.args, dict) and isinstance(n.args.get("col"), str):
                out[n.args["col"]] = None
    return list(out)


def collected(stage: Stage, registry: Registry) -> Stage:
    """The stage with the indicator calls that its names ask for, before those that it lists itself."""
    found = [c for c in indicator_calls(named_columns(stage), registry) if c not in stage.indicators]
    return replace(stage, indicators=[*found, *stage.indicators])

"""The nodes of a screen and their JSON form.

A node is a variant's name and its fields. Variants are written as {"t": name, "v": fields}: fields in a
list for unnamed ones (one alone stands by itself), in an object for named ones, none for a variant without.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date, time
from typing import Any

# The wire format's variants and their fields. An int counts unnamed fields.
EXPRESSIONS = {
    "Num": 1, "Bool": 1, "Path": 1, "Var": 1, "Neg": 1, "Add": 2, "Sub": 2, "Mul": 2, "Div": 2, "Quotient": 2, "Abs": 1,
    "PctChange": ("from", "to"), "Gt": 2, "Lt": 2, "Gte": 2, "Lte": 2, "Eq": 2, "Between": ("val", "low", "high"),
    "And": 2, "Or": 2, "Not": 1, "Implies": ("antecedent", "consequent"),
    "Agg": ("stock", "from", "to", "col", "func"), "All": ("stock", "from", "to", "pred"), "Any": ("stock", "from", "to", "pred"),
    "CountBars": ("from", "to", "pred", "op", "n"), "RangeVal": ("stock", "from", "to", "col", "func"),
    "CrossUp": ("stock", "at", "col", "threshold"), "CrossDown": ("stock", "at", "col", "threshold"),
    "CandleIs": ("stock", "at", "candle"), "PointExists": 1, "Monotone": ("stock", "from", "to", "col", "dir"),
    "SyncWithMarket": ("from", "to"), "Intraday": 1,
    "IntradayDuration": ("anchor_point", "stock", "time_from", "time_to", "module_id", "params", "op", "minutes"),
}
FORMULAS = {
    "Col": 1, "Lit": 1, "Param": 1, "RollingMean": ("src", "period"), "RollingStd": ("src", "period"), "RollingMax": ("src", "period"),
    "RollingMin": ("src", "period"), "RollingSum": ("src", "period"), "Ewma": ("src", "period"), "Shift": ("src", "periods"), "Add": 2, "Sub": 2, "Mul": 2, "Div": 2,
    "Abs": 1, "Neg": 1, "Sqrt": 1, "IfElse": ("cond", "then_val", "else_val"),
}
MINUTE_VALUES = {
    "Lit": 1, "Param": 1, "White": 1, "Yellow": 1, "Close": 1, "Open": 1, "Volume": 1, "YesterdayOpen": 0, "LimitUpPrice": 0, "LimitDownPrice": 0,
    "Slope": ("series", "from", "to"), "Duration": ("pred", "from", "to"), "CrossCount": ("a", "b", "from", "to"),
    "CrossAbove": ("series", "threshold", "from", "to"), "Add": 2, "Sub": 2, "Mul": 2, "Div": 2, "Abs": 1,
}
MINUTE_TESTS = {
    "Gt": 2, "Lt": 2, "Gte": 2, "Lte": 2, "Eq": 2, "And": 2, "Or": 2, "Not": 1, "AllMinutes": ("pred", "from", "to"),
    "AnyMinute": ("pred", "from", "to"), "DurationGte": ("pred", "from", "to", "minutes"), "DurationLte": ("pred", "from", "to", "minutes"),
}
STOCKS = {"Current": 0, "Named": 1, "Market": 0, "MarketNamed": 1}
ANCHORS = {"Point": 1, "WindowStart": 0, "WindowEnd": 0, "EachBar": 0}
TIMES = {"RangeStart": 0, "RangeEnd": 0, "At": 1, "EachMinute": 0, "Param": 1}
POINTS = {"Where": ("stock", "from", "to", "pred", "select"), "Offset": ("from", "delta"), "BlockStart": 1, "BlockEnd": 1}

FAMILIES = {"expr": EXPRESSIONS, "formula": FORMULAS, "value": MINUTE_VALUES, "test": MINUTE_TESTS, "stock": STOCKS, "anchor": ANCHORS, "time": TIMES, "point": POINTS}


@dataclass(frozen=True)
class Node:
    """A variant: its family, its name and its fields (a tuple, or a dict for named ones)."""

    family: str
    kind: str
    args: Any = ()

    def __getitem__(self, name):
        return self.args[name]


@dataclass(frozen=True)
class Path:
    """A bar: `offset` bars after an anchor (a negative one is older), of a stock; with a field, its value."""

    stock: Node = Node("stock", "Current")
    anchor: Node = Node("anchor", "WindowEnd")
    offset: int = 0
    field: str | None = None


@dataclass
class Block:
    block_name: str
    pattern: str
    least: int
    most: int | None
    optional: bool = False
    allow_overlap_next: bool = False


@dataclass
class Pattern:
    name: str
    pattern: list[Block]


@dataclass
class Stage:
    name: str
    timeframe: Any = "Daily"
    start_date: date | None = None
    windowsize: Any = None
    indicators: list[tuple[str, dict]] = field(default_factory=list)
    kline_pattern: Pattern | None = None
    vars: list[tuple[str, Node]] = field(default_factory=list)
    points: list[tuple[str, Node]] = field(default_factory=list)
    conditions: list[tuple[str, Node]] = field(default_factory=list)
    marks: list[tuple[str, Path, Node | None, str | None]] = field(default_factory=list)
    extra_stocks: list[str] = field(default_factory=list)


@dataclass
class Pipeline:
    stages: list[Stage] = field(default_factory=list)


@dataclass
class Registry:
    """Indicator and minute modules by id. An indicator has outputs (name template, formula); a minute module has a test."""

    indicators: dict[str, dict] = field(default_factory=dict)
    intraday: dict[str, dict] = field(default_factory=dict)

    def merged(self, other: Registry) -> Registry:
        return Registry(self.indicators | other.indicators, self.intraday | other.intraday)


#: The family or kind of each named field; all others are plain values.
_FIELDS = {
    "expr": dict.fromkeys(("val", "low", "high", "antecedent", "consequent", "pred", "threshold"), "expr") | {"stock": "stock", "at": "path", "params": "params"},
    "formula": dict.fromkeys(("src", "period", "periods", "cond", "then_val", "else_val"), "formula"),
    "value": {"pred": "test", "threshold": "value", "from": "time", "to": "time"},
    "test": {"pred": "test", "minutes": "value", "from": "time", "to": "time"},
    "point": {"stock": "stock", "pred": "expr"},
    "stock": {}, "anchor": {}, "time": {},
}
_LEAVES = {"Num", "Bool", "Var", "PointExists", "Col", "Lit", "Param", "Named", "MarketNamed", "Point", "At", "BlockStart", "BlockEnd"}


def _field_kind(family: str, kind: str, name: str) -> str:
    if name in ("from", "to"):
        if family == "expr":
            return "expr" if kind == "PctChange" else "path"
        if family == "point":
            return "path" if kind == "Where" else "plain"
    return _FIELDS[family].get(name, "plain")


def _position_kind(family: str, kind: str) -> str:
    if kind in _LEAVES:
        return "plain"
    if family == "expr":
        return "path" if kind == "Path" else "minute" if kind == "Intraday" else "expr"
    if family == "value":
        return "time" if kind in ("White", "Yellow", "Close", "Open", "Volume") else "value"
    if family == "test":
        return "test" if kind in ("And", "Or", "Not") else "value"
    return family


def params_from(x: dict) -> dict:
    return {k: v["value"] if isinstance(v, dict) else v for k, v in (x or {}).items()}


def params_to(x: dict) -> dict:
    name = lambda v: "Bool" if isinstance(v, bool) else "Int" if isinstance(v, int) else "Float" if isinstance(v, float) else "Str"
    return {k: {"type": name(v), "value": v} for k, v in x.items()}


def _read(kind: str, x):
    if kind in FAMILIES:
        return node_from(kind, x)
    if kind == "path":
        return Path(node_from("stock", x["stock"]), node_from("anchor", x["anchor"]), int(x.get("offset", 0)), x.get("field"))
    if kind == "params":
        return params_from(x)
    if kind == "minute":
        return {k: _read({"stock": "stock", "params": "params"}.get(k, "plain"), v) for k, v in x.items()}
    return x


def _write(kind: str, x):
    if isinstance(x, Node):
        return node_to(x)
    if isinstance(x, Path):
        return {"stock": node_to(x.stock), "anchor": node_to(x.anchor), "offset": x.offset, "field": x.field}
    if kind == "params":
        return params_to(x)
    if kind == "minute":
        return {k: _write({"params": "params"}.get(k, "plain"), v) for k, v in x.items()}
    return x


def node_from(family: str, x) -> Node:
    """A node from its JSON; an unknown variant or a wrong number of fields is an error."""
    kind = x["t"] if isinstance(x, dict) else x
    shape = FAMILIES[family].get(kind)
    if shape is None:
        raise ValueError(f"no {family} is named {kind!r}")
    value = x.get("v") if isinstance(x, dict) else None
    if shape == 0:
        return Node(family, kind)
    if isinstance(shape, tuple):
        if missing := [n for n in shape if n not in value]:
            raise ValueError(f"{kind} lacks {missing}")
        return Node(family, kind, {n: _read(_field_kind(family, kind, n), value[n]) for n in shape})
    own = [value] if shape == 1 else value
    if len(own) != shape:
        raise ValueError(f"{kind} has {shape} fields")
    return Node(family, kind, tuple(_read(_position_kind(family, kind), v) for v in own))


def node_to(n: Node):
    shape = FAMILIES[n.family][n.kind]
    if shape == 0:
        return {"t": n.kind}
    if isinstance(shape, tuple):
        return {"t": n.kind, "v": {k: _write(_field_kind(n.family, n.kind, k), v) for k, v in n.args.items()}}
    own = [_write(_position_kind(n.family, n.kind), v) for v in n.args]
    return {"t": n.kind, "v": own[0] if shape == 1 else own}


def size_from(x) -> tuple[int, int | None]:
    """Least and greatest of a window size; None: no bound."""
    if "Exact" in x:
        return int(x["Exact"]), int(x["Exact"])
    own = x["Range"]
    return int(own.get("min") or 0), None if own.get("max") is None else int(own["max"])


def size_to(least: int, most: int | None):
    return {"Exact": least} if least == most else {"Range": {"min": least, "max": most}}


def time_of(text: str) -> time:
    """HH:MM or HH:MM:SS."""
    return time.fromisoformat(text)


def stage_from(x: dict) -> Stage:
    pattern = x.get("kline_pattern")
    blocks = [Block(b["block_name"], b["pattern"], *size_from(b["block_size"]), b.get("optional", False), b.get("allow_overlap_next", False)) for b in pattern["pattern"]] if pattern else []
    return Stage(
        x["name"],
        x.get("timeframe", "Daily"),
        date.fromisoformat(x["start_date"]) if x.get("start_date") else None,
        size_from(x["windowsize"]) if x.get("windowsize") else None,
        [(c["module_id"], params_from(c.get("params"))) for c in (x.get("prepare") or {}).get("indicators", [])],
        Pattern(pattern["name"], blocks) if pattern else None,
        [(v["name"], node_from("expr", v["expr"])) for v in x.get("vars", [])],
        [(p["name"], node_from("point", p["def"])) for p in x.get("points", [])],
        [(n, node_from("expr", e)) for n, e in x.get("conditions", [])],
        [(m["name"], _read("path", m["anchor"]), node_from("expr", m["value"]) if m.get("value") else None, m.get("label")) for m in x.get("marks", [])],
        list(x.get("extra_stocks", [])),
    )


def stage_to(s: Stage) -> dict:
    return {
        "name": s.name,
        "timeframe": s.timeframe,
        "start_date": s.start_date.isoformat() if s.start_date else None,
        "windowsize": size_to(*s.windowsize) if s.windowsize else None,
        "prepare": {"indicators": [{"module_id": m, "params": params_to(p)} for m, p in s.indicators]},
        "kline_pattern": {"name": s.kline_pattern.name, "pattern": [{"block_name": b.block_name, "pattern": b.pattern, "block_size": size_to(b.least, b.most), "optional": b.optional, "allow_overlap_next": b.allow_overlap_next} for b in s.kline_pattern.pattern]} if s.kline_pattern else None,
        "vars": [{"name": n, "expr": node_to(e)} for n, e in s.vars],
        "points": [{"name": n, "def": node_to(d)} for n, d in s.points],
        "conditions": [[n, node_to(e)] for n, e in s.conditions],
        "marks": [{"name": n, "anchor": _write("path", a), "value": node_to(v) if v else None, "label": l} for n, a, v, l in s.marks],
        "extra_stocks": s.extra_stocks,
    }


def pipeline_from_json(text: str) -> Pipeline:
    return Pipeline([stage_from(s) for s in json.loads(text)["stages"]])


def pipeline_to_json(p: Pipeline) -> str:
    return json.dumps({"stages": [stage_to(s) for s in p.stages]})


def registry_from_json(text: str) -> Registry:
    own = json.loads(text)
    indicators = {i: {"id": d["id"], "param_names": d["param_names"], "outputs": [(o["col_name_template"], node_from("formula", o["formula"])) for o in d["outputs"]]} for i, d in own.get("indicators", {}).items()}
    return Registry(indicators, {i: {"id": d["id"], "param_names": d["param_names"], "expr": node_from("test", d["expr"])} for i, d in own.get("intraday", {}).items()})


def registry_to_json(r: Registry) -> str:
    indicators = {i: {"id": d["id"], "param_names": d["param_names"], "outputs": [{"col_name_template": t, "formula": node_to(f)} for t, f in d["outputs"]]} for i, d in r.indicators.items()}
    return json.dumps({"indicators": indicators, "intraday": {i: {"id": d["id"], "param_names": d["param_names"], "expr": node_to(d["expr"])} for i, d in r.intraday.items()}})


# Short forms for writing screens in Python.

CURRENT, MARKET = Node("stock", "Current"), Node("stock", "Market")


def named(symbol: str) -> Node:
    return Node("stock", "Named", (symbol,))


def end(offset: int = 0, stock: Node = CURRENT) -> Path:
    return Path(stock, Node("anchor", "WindowEnd"), offset)


def start(offset: int = 0, stock: Node = CURRENT) -> Path:
    return Path(stock, Node("anchor", "WindowStart"), offset)


def each(offset: int = 0, stock: Node = CURRENT) -> Path:
    return Path(stock, Node("anchor", "EachBar"), offset)


def point(name: str, offset: int = 0, stock: Node = CURRENT) -> Path:
    return Path(stock, Node("anchor", "Point", (name,)), offset)


def val(path: Path, name: str) -> Node:
    return Node("expr", "Path", (Path(path.stock, path.anchor, path.offset, name),))


def _expr(x) -> Any:
    if isinstance(x, bool):
        return Node("expr", "Bool", (x,))
    return Node("expr", "Num", (float(x),)) if isinstance(x, int | float) else x


def ex(kind: str, *args, **named_args) -> Node:
    """An expression of a kind; Python numbers and booleans become literals where an expression is due."""
    shape = EXPRESSIONS[kind]
    if isinstance(shape, tuple):
        out = dict(zip(shape, args, strict=False)) | {k.rstrip("_"): v for k, v in named_args.items()}
        if "stock" in shape:
            out.setdefault("stock", CURRENT)
        return Node("expr", kind, {k: _expr(out[k]) if _field_kind("expr", kind, k) == "expr" else out[k] for k in shape})
    return Node("expr", kind, tuple(_expr(a) if _position_kind("expr", kind) == "expr" else a for a in args))


def fx(kind: str, *args) -> Node:
    """A formula of a kind; Python numbers become literals."""
    wrap = lambda a: Node("formula", "Lit", (float(a),)) if isinstance(a, int | float) else a
    shape = FORMULAS[kind]
    if kind in ("Col", "Param", "Lit"):
        return Node("formula", kind, args)
    return Node("formula", kind, dict(zip(shape, map(wrap, args), strict=True)) if isinstance(shape, tuple) else tuple(map(wrap, args)))


def mx(kind: str, *args) -> Node:
    """A minute value or test of a kind."""
    family = "test" if kind in MINUTE_TESTS and not (kind in MINUTE_VALUES) else "value"
    shape = FAMILIES[family][kind]
    wrap = lambda a: Node("value", "Lit", (float(a),)) if isinstance(a, int | float) and kind not in ("Lit", "Param") else a
    return Node(family, kind, dict(zip(shape, map(wrap, args), strict=True)) if isinstance(shape, tuple) else tuple(map(wrap, args)))


def tm(kind: str, *args) -> Node:
    return Node("time", kind, args)

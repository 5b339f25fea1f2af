"""JSON, patterns and needs: no session."""

import json
import random
from datetime import date, time
from itertools import product

import pytest

from candlewick.functions.indicators import default_registry, output_name
from candlewick.functions.minutes import slot
from candlewick.plans import ast
from candlewick.plans.ast import Block, Node, Path, Pattern, Pipeline, Stage, each, end, ex, fx, mx, named, point, tm, val
from candlewick.plans.needs import needs_market, padded, reach
from candlewick.plans.pattern import Matcher, TooMany, longest, partitions


def sample(family, kind, depth=0):
    """A node of each variant with plain fields."""
    fill = {"expr": ex("Num", 1.5), "formula": fx("Col", "close"), "value": mx("Lit", 2.0), "test": Node("test", "Gt", (mx("Lit", 1.0), mx("YesterdayOpen"))), "path": end(-1), "stock": ast.MARKET, "time": tm("At", "10:00"), "params": {"n": 3, "x": 1.5, "s": "t", "b": True}, "plain": "x", "minute": {"anchor_point": "p", "stock": ast.CURRENT, "time_from": "09:31:00", "time_to": "15:00:00", "module_id": "m", "params": {"n": 1}}, "anchor": Node("anchor", "EachBar"), "point": None}
    shape = ast.FAMILIES[family][kind]
    if shape == 0:
        return Node(family, kind)
    if isinstance(shape, tuple):
        return Node(family, kind, {n: fill[ast._field_kind(family, kind, n)] for n in shape})
    return Node(family, kind, tuple(fill[ast._position_kind(family, kind)] for _ in range(shape)))


@pytest.mark.parametrize("family", ast.FAMILIES)
def test_every_variant_round_trips(family):
    for kind in ast.FAMILIES[family]:
        n = sample(family, kind)
        text = json.dumps(ast.node_to(n))
        assert ast.node_from(family, json.loads(text)) == n


def test_wire_format():
    e = ex("Gt", val(end(), "close"), val(end(), "sma_20"))
    path = lambda f: {"t": "Path", "v": {"stock": {"t": "Current"}, "anchor": {"t": "WindowEnd"}, "offset": 0, "field": f}}
    assert ast.node_to(e) == {"t": "Gt", "v": [path("close"), path("sma_20")]}
    with pytest.raises(ValueError):
        ast.node_from("expr", {"t": "Nothing", "v": 1})
    with pytest.raises(ValueError):
        ast.node_from("expr", {"t": "Gt", "v": [path("close")]})


def test_pipeline_and_registry_round_trip():
    stage = Stage("s", "Weekly", date(2024, 3, 1), (1, 5), [("sma", {"period": 5})], Pattern("p", [Block("A", "Up", 1, None, True, False), Block("B", "Down", 2, 2)]), [("v", ex("Num", 1))], [("q", Node("point", "Where", {"stock": ast.CURRENT, "from": end(-3), "to": end(), "pred": ex("Bool", True), "select": {"Nth": 2}})), ("r", Node("point", "Offset", {"from": "q", "delta": -1}))], [("c", ex("PointExists", "q"))], [("m", point("q"), ex("Num", 2), "here"), ("m2", end(), None, None)], ["SZ.000001"])
    p = Pipeline([stage])
    assert ast.pipeline_from_json(ast.pipeline_to_json(p)) == p
    r = default_registry()
    assert ast.registry_from_json(ast.registry_to_json(r)) == r


def by_hand(codes, blocks):
    """The windows of a pattern that end at the last candle, by trying all sizes."""
    letters = {"Up": "U", "Down": "D", "Neutral": "N", "Doji": "N"}
    out = set()
    for sizes in product(*[[*([0] if b.optional else []), *range(b.least if b.least or b.pattern == "Any" else 1, (len(codes) if b.most is None else b.most) + 1)] for b in blocks]):
        at, places, shares = 0, [], False
        for b, n in zip(blocks, sizes):
            if not n:
                shares = False
                continue
            first = at - 1 if shares and at else at
            places.append((b, first, first + n))
            at, shares = first + n, b.allow_overlap_next
        if not 0 < at <= len(codes):
            continue
        base = len(codes) - at
        if all(b.pattern == "Any" or all(c == letters[b.pattern] for c in codes[base + s : base + e]) for b, s, e in places):
            out.add((at, tuple((b.block_name, s, e - 1) for b, s, e in places)))
    return out


CASES = [
    ("UUUDU", [("A", "Up", 1, 1), ("B", "Down", 1, 1), ("C", "Up", 1, 1)], None),
    ("UUUUU", [("A", "Up", 1, 1), ("F", "Any", 2, 4), ("C", "Up", 1, 1)], None),
    ("UUU", [("A", "Up", 2, 2, False, True), ("B", "Up", 2, 2)], None),
    ("UUUD", [("A", "Up", 2, 3), ("B", "Down", 1, 1)], None),
    ("UUDD", [("A", "Up", 2, 3), ("B", "Down", 1, 1)], (4, 4)),
    ("NUDU", [("A", "Any", 1, 1), ("B", "Up", 1, 1), ("C", "Down", 1, 1), ("D", "Up", 1, 1)], (1, 120)),
    ("DUUUU", [("A", "Down", 1, 2), ("F", "Any", 1, None), ("C", "Up", 1, 1)], (5, 5)),
    ("DUUU", [("A", "Down", 1, 1), ("F", "Any", 0, None), ("C", "Up", 1, 1)], (4, 4)),
    ("UUUU", [("A", "Down", 1, 1), ("F", "Any", 0, None), ("C", "Up", 1, 1)], (4, 4)),
    ("DUDDU", [("A", "Down", 1, 2), ("F", "Any", 0, None), ("C", "Up", 1, 1)], (5, 5)),
    ("UDUUU", [("F", "Any", 0, None), ("A", "Up", 3, 3), ("G", "Any", 0, None)], (5, 5)),
    ("UDU", [("A", "Up", 1, 1), ("B", "Down", 1, 1, True), ("C", "Up", 1, 1)], None),
    ("UUUDUU", [("A", "Up", 1, 3, True, True), ("F", "Any", 1, 2, False, True), ("C", "Up", 1, 2)], (1, 5)),
]


@pytest.mark.parametrize("codes,specs,size", CASES)
def test_partitions_by_trying_all_sizes(codes, specs, size):
    blocks = [Block(n, k, lo, hi, *rest) for n, k, lo, hi, *rest in specs]
    lo, hi = size or (1, len(codes))
    want = {x for x in by_hand(codes, blocks) if lo <= x[0] <= hi}
    got = {(p.length, p.blocks) for p in partitions(Pattern("p", blocks), size) if p.length <= len(codes) and all(a in (".", b) for a, b in zip(p.letters, codes[len(codes) - p.length :]))}
    assert got == want
    assert set(Matcher(Pattern("p", blocks), size or (1, len(codes))).windows(codes)) == want


def test_windows_in_random_candles():
    rng = random.Random(7)
    for _ in range(400):
        blocks = [Block(f"b{i}", rng.choice(["Up", "Down", "Doji", "Any"]), least := rng.randint(0, 2), rng.choice([None, least + rng.randint(0, 2)]), rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randint(1, 4))]
        codes = "".join(rng.choice("UUDN") for _ in range(rng.randint(1, 7)))
        lo, hi = (1, len(codes)) if rng.random() < 0.5 else (2, rng.randint(2, 7))
        want = {x for x in by_hand(codes, blocks) if lo <= x[0] <= hi}
        assert set(Matcher(Pattern("p", blocks), (lo, hi)).windows(codes)) == want, (codes, blocks)
        listed = {(p.length, p.blocks) for p in partitions(Pattern("p", blocks), (lo, hi)) if p.length <= len(codes) and all(a in (".", b) for a, b in zip(p.letters, codes[len(codes) - p.length :]))}
        assert listed == want, (codes, blocks)


def test_too_many_partitions_are_not_listed():
    blocks = [Block(f"b{i}", "Any", 0, None) for i in range(4)]
    with pytest.raises(TooMany):
        partitions(Pattern("p", blocks), None)
    own = Matcher(Pattern("p", [Block("a", "Up", 1, 400), Block("b", "Down", 1, 400), Block("c", "Up", 1, 400)]), (1, 1000))
    assert len(own.windows("U" * 30 + "D" * 20 + "U" * 10)) == 30


def test_bounds_of_windows():
    one = lambda *size: Pattern("p", [Block("a", "Any", *size)])
    assert [p.length for p in partitions(one(1, None), (600, 600))] == [600] and longest(one(1, None), (600, 600)) == 600
    assert longest(one(1, None), None) == 500 and longest(one(1, 700), None) == 500 and longest(one(1, 700), (1, 650)) == 650
    assert longest(one(1, None), (700, None)) == 700 and partitions(one(5, 5), (6, 6)) == []


def test_needs():
    r = default_registry()
    cross = Stage("s", indicators=[("boll", {"period": 20, "k": 2.0})], conditions=[("c", ex("CrossUp", at=end(), col="close", threshold=val(each(), "boll_upper_20")))])
    back, ahead = reach(cross, r)
    assert back >= 20 and ahead == 0 and not needs_market(cross)
    assert needs_market(Stage("s", conditions=[("c", ex("SyncWithMarket", end(-1), end()))]))
    assert needs_market(Stage("s", conditions=[("c", ex("All", from_=end(-1), to=end(), pred=ex("Gt", val(each(0, ast.MARKET), "close"), 1)))]))
    assert not needs_market(Stage("s", conditions=[("c", ex("Gt", val(end(0, named("SZ.000001")), "close"), 1))]))
    assert padded(date(2024, 3, 1), date(2024, 3, 5), "Daily", 5, 0) == (date(2024, 2, 13), date(2024, 3, 5))


def test_slots_of_all_minutes():
    for m in range(1440):
        t = time(m // 60, m % 60)
        want = 0 if m <= 571 else m - 571 if m <= 690 else 119 if m <= 720 else 120 if m <= 781 else m - 781 + 120 if m <= 900 else 239
        assert slot(t) == want
    assert output_name("x_{period}_{k}", {"period": 5, "k": 2.0}) == "x_5_2"
    assert Path().anchor.kind == "WindowEnd"

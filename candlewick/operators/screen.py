"""Running a screen: for each series, whether the window that ends at its anchor bar passes all stages.

Stages whose places are fixed offsets run on window columns over the bars. Those that follow each other run in one
pass, one exchange by series for all of them, and a fold over their verdicts keeps what a chain of stages would:
the stages up to the first that fails. Other stages run on one array of bars for each anchor, on the series that
passed those before.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import KEY, default_registry, output_name, series, with_indicators
from ..functions.scalars import both, candle, either, yes
from ..plans.ast import Node, Pipeline, Registry, Stage
from ..plans.compiler import BarArrays, BarColumns, Compiler, Dynamic
from ..plans.needs import padded, reach, walk
from ..plans.pattern import Matcher, Partition, TooMany, longest, partitions
from ..session import ship
from .resample import minute_days, resample

MARKETS = {"SZ": 0, "SH": 1, "BJ": 2}
#: The index of each market, and that of all others.
INDEX = {0: (0, 399001), 2: (2, 899050)}
OTHER_INDEX = (1, 1)

NO_DATA, NO_PATTERN = "no_data", "kline_pattern"
#: Ways of a pattern up to which each is a set of window columns; more are matched on arrays.
WAYS = 32
RESULT = (
    "struct<stage_name:string,date:date,passed:boolean,passed_conditions:array<string>,failed_condition:string,points:map<string,date>,"
    "marks:map<string,struct<date:date,value:double,label:string>>,matches:array<struct<window:int,window_start:date,window_end:date,points:map<string,date>>>>"
)


def symbol_key(symbol: str) -> tuple[int, int] | None:
    """(market, code) of 'SZ.000001'; none for anything else."""
    market, _, code = symbol.partition(".")
    return (MARKETS[market], int(code)) if market in MARKETS and code.isdigit() else None


def symbol_of(market, code):
    names = F.create_map(*[F.lit(x) for n, m in MARKETS.items() for x in (m, n)])
    return F.concat(names[market], F.lit("."), F.when(F.length(code.cast("string")) < 6, F.lpad(code.cast("string"), 6, "0")).otherwise(code.cast("string")))


def _texts(x):
    """All strings in a node's or path's fields."""
    for n in walk(x):
        if isinstance(n, Node):
            yield from (a for a in (n.args.values() if isinstance(n.args, dict) else n.args) if isinstance(a, str))
        elif n.field:
            yield n.field


def _entries(pairs: list, kind: str) -> Column:
    """A map of the (name, column) pairs whose column is not null."""
    if not pairs:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in pairs]), lambda x: x["value"].isNotNull()))


_MARK = "struct<date:date,value:double,label:string>"
_MATCHES = "array<struct<window:int,window_start:date,window_end:date,points:map<string,date>>>"


@dataclass
class Form:
    """A stage in window columns, for one of its pattern's ways. Columns stand under names of their own."""

    own: Compiler
    part: Partition | None
    vars: list[tuple[str, str, Column]] = field(default_factory=list)
    conditions: list[tuple[str, str, Column, bool]] = field(default_factory=list)
    marks: list[tuple[str, Column, Column, str | None]] = field(default_factory=list)


@dataclass
class Segment:
    """Stages that run in one pass: window forms of each, or one stage on arrays (forms: none)."""

    stages: list[Stage]
    forms: list[list[Form]] | None
    fields: dict = field(default_factory=dict)


class Screen:
    """A pipeline over daily bars (market, code, date, open, high, low, close, volume, amount).

    universe: (market, code) rows to screen, by default all series of bars; a series without bars fails with
    no_data. frm, to: the requested dates. minutes: (market, code, date, minute, price, avg, volume).
    index: the index series of each market. index_bars: where index and named series are, by default bars.
    pad: load only dates that the stages can need, by calendar days for each bar; leave it off for series with
    long gaps.
    """

    def __init__(self, pipeline: Pipeline, bars: DataFrame, frm: date, to: date, registry: Registry | None = None, universe: DataFrame | None = None, minutes: DataFrame | None = None, index: dict[int, tuple[int, int]] | None = None, index_bars: DataFrame | None = None, pad: bool = False):
        self.pipeline, self.bars, self.frm, self.to = pipeline, bars, frm, to
        self.registry = default_registry().merged(registry or Registry())
        self.universe, self.minutes, self.index = universe, minutes, index
        self.index_bars, self.pad = index_bars if index_bars is not None else bars, pad

    # What a stage's expressions come to.

    def _forms(self, stage: Stage, prefix: str = "__0", fields: dict | None = None) -> list[Form] | None:
        """The stage on window columns, a form for each way of its pattern, or none if it has places without a fixed offset."""
        ways: list[Partition | None] = [None]
        if stage.kline_pattern:
            try:
                ways = list(partitions(stage.kline_pattern, stage.windowsize))
            except TooMany:
                return None
        if len(ways) > WAYS:
            return None
        out, known = [], {}
        for j, part in enumerate(ways):
            points = self._offsets(stage, part)
            if points is None:
                return None
            own = BarColumns(self.registry, part.length if part else None, points)
            own.fields, own.prefix = fields if fields is not None else {}, f"{prefix}_{j}"
            form = Form(own, part)
            try:
                self._compile(form, stage, f"{prefix}_{j}", known)
            except Dynamic:
                return None
            out.append(form)
        return out

    @staticmethod
    def _offsets(stage: Stage, part: Partition | None) -> dict[str, int] | None:
        """The points' offsets from the window's end, or none if one of them has to be searched."""
        points: dict[str, int] = {}
        blocks = {n: (a, b) for n, a, b in part.blocks} if part else {}
        for name, d in stage.points:
            if d.kind == "Offset" and d["from"] in points:
                points[name] = points[d["from"]] + d["delta"]
            elif d.kind in ("BlockStart", "BlockEnd") and d.args[0] in blocks:
                points[name] = blocks[d.args[0]][d.kind == "BlockEnd"] - (part.length - 1)
            elif d.kind == "Where" and d["from"] == d["to"] and d["from"].anchor.kind == "WindowEnd" and d["from"].stock.kind == "Current" and (d["pred"].kind, d["pred"].args) == ("Bool", (True,)) and d["select"] in ("First", "Last"):
                points[name] = d["from"].offset  # the one bar itself
            else:
                return None
        return points

    def _compile(self, form: Form, stage: Stage, prefix: str, known: dict | None = None) -> None:
        """Fills in the form's columns. known: names of columns that other forms of the stage have in the same words."""
        own = form.own

        def name_of(kind: str, i: int, c: Column) -> str:
            return f"{prefix}_{kind}{i}" if known is None else known.setdefault((kind, i, str(c)), f"{prefix}_{kind}{i}")

        for i, (name, e) in enumerate(stage.vars):
            test = own.is_test(e)
            c = own.test(e) if test else own.number(e)
            column = name_of("var", i, c)
            form.vars.append((column, name, c))
            own.vars[name] = F.col(column), test
        minute = lambda e: any(isinstance(x, Node) and x.kind in ("Intraday", "IntradayDuration") for x in walk(e))
        for i, (name, e) in enumerate(stage.conditions):
            c, late = own.test(e), minute(e)
            form.conditions.append((f"{prefix}_cond{i}" if late else name_of("cond", i, c), name, c, late))
        for name, anchor, value, label in stage.marks:
            at = own.moved(own.place(anchor, None), anchor.offset)
            form.marks.append((name, own.at("date", at), own.number(value, at) if value is not None else F.lit(None).cast("double"), label))

    def _outputs(self, stage: Stage) -> dict[str, tuple]:
        """What each indicator column of a stage comes from."""
        return {output_name(t, params): (f, tuple(sorted(params.items()))) for module, params in stage.indicators for t, f in self.registry.indicators.get(module, {"outputs": []})["outputs"]}

    def _segments(self, scan: bool) -> list[Segment]:
        out: list[Segment] = []
        until = lambda s: None if scan else s.start_date or self.to
        for k, stage in enumerate(self.pipeline.stages):
            last = out[-1] if out else None
            outputs = self._outputs(stage)
            fits = last is not None and last.forms is not None and last.stages[0].timeframe == stage.timeframe and until(last.stages[0]) == until(stage)
            fits = fits and all(outputs.get(n, o) == o for s in last.stages for n, o in self._outputs(s).items())
            fields = dict(last.fields) if fits else {}
            forms = self._forms(stage, f"__{k}", fields)
            if forms is None:
                out.append(Segment([stage], None))
            elif fits:
                last.stages.append(stage)
                last.forms.append(forms)
                last.fields = fields
            else:
                out.append(Segment([stage], [forms], fields))
        return out

    # What a segment reads.

    def _series(self, stages: list[Stage], fields: dict, keys: DataFrame | None) -> DataFrame:
        """The bars that the stages read of the series to screen (none given: of all), with indicators and other stocks' values."""
        bars, first, last = self.bars, None, None
        if self.pad:
            spans = [reach(s, self.registry) for s in stages]
            dates = [padded(min(self.frm, s.start_date or self.frm), self.to, s.timeframe, back, ahead) for s, (back, ahead) in zip(stages, spans, strict=True)]
            first, last = min(d for d, _ in dates), max(d for _, d in dates)
            if all(back >= 0 for back, _ in spans):
                bars = bars.where(F.col("date") >= F.lit(first))
            bars = bars.where(F.col("date") <= F.lit(last))
        if keys is not None:
            bars = bars.join(keys.select(*KEY).distinct(), list(KEY), "left_semi")
        out = self._prepared(bars, stages)
        by_stock: dict[Node, list] = {}
        for (stock, name, offset), column in fields.items():
            by_stock.setdefault(stock, []).append((name, offset, column))
        for stock, wanted in by_stock.items():
            out = self._with_other(out, stages, stock, wanted, first, last)
        return out

    def _prepared(self, bars: DataFrame, stages: list[Stage]) -> DataFrame:
        own = resample(bars.select(*KEY, "date", "open", "high", "low", "close", "volume", "amount"), stages[0].timeframe)
        own = own.withColumn("candle", candle(F.col("open"), F.col("close")))
        before = F.lag("close", 1).over(series())
        names = {t for s in stages for _, e in s.conditions + s.vars + s.points for t in _texts(e)} | {t for s in stages for _, anchor, value, _ in s.marks for x in (anchor, value) if x is not None for t in _texts(x)}
        if "pct_change" in names:
            own = own.withColumn("pct_change", (F.col("close") - before) / F.when(before != 0, before) * 100)
        if "amplitude" in names:
            own = own.withColumn("amplitude", (F.col("high") - F.col("low")) / F.when(before != 0, before) * 100)
        return with_indicators(own, [c for s in stages for c in s.indicators], self.registry)

    def index_key(self, market: int) -> tuple[int, int]:
        return (self.index or INDEX).get(market, OTHER_INDEX)

    def _with_other(self, out: DataFrame, stages: list[Stage], stock: Node, wanted, first, last) -> DataFrame:
        """Another stock's values joined by date. It is broadcast: one series for each market has one row a day, some 10,000 for forty years."""
        if stock.kind == "Market":
            keys = {m: self.index_key(m) for m in ({*MARKETS.values()} | set(self.index or ()))}
        else:
            key = symbol_key(stock.args[0])
            keys = {None: key if key is not None else (-1, -1)}
        rows = self.index_bars.where(F.struct(*KEY).isin([F.struct(F.lit(m).cast("int"), F.lit(c).cast("int")) for m, c in {*keys.values()}]))
        if first is not None:
            rows = rows.where(F.col("date").between(F.lit(first - timedelta(days=400)), F.lit(last)))
        rows = self._prepared(rows, stages)
        shift = lambda name, k: F.col(name) if not k else F.lag(name, -k).over(series()) if k < 0 else F.lead(name, k).over(series())
        rows = rows.select(*KEY, "date", *[shift(n, k).alias(c) for n, k, c in wanted])
        if None in keys:
            return out.join(F.broadcast(rows.drop(*KEY)), "date", "left")
        of = F.explode(F.array(*[F.struct(F.lit(m).cast("int").alias("m"), F.lit(k[0]).cast("int").alias("im"), F.lit(k[1]).cast("int").alias("ic")) for m, k in keys.items()]))
        rows = rows.withColumn("of", of).where("market = of.im and code = of.ic").drop(*KEY).withColumn("market", F.col("of.m")).drop("of")
        return out.join(F.broadcast(rows), ["market", "date"], "left")

    def _within(self, stage: Stage, scan: bool) -> Column:
        until = stage.start_date if stage.start_date and not scan else self.to
        return F.col("date").between(F.lit(self.frm), F.lit(until))

    def _last(self, stage: Stage) -> Column:
        """The date of a series' last bar up to the stage's date."""
        return F.max(F.when(self._within(stage, False), F.col("date"))).over(Window.partitionBy(*KEY))

    # Minutes.

    def _with_days(self, rows: DataFrame, own: Compiler, dates: dict[str, Column], alive: Column, some: bool, until: date) -> DataFrame:
        """rows with the minute arrays that tests read; only rows still alive look theirs up. some: whether `alive` is worth a semi-join below the grouping of minutes."""
        for (point, stock), column in own.days.items():
            empty = F.lit(None).cast("array<struct<minute:int,price:double,avg:double,volume:double>>")
            if self.minutes is None or point not in dates:
                rows = rows.withColumn(column, empty)
                continue
            minutes = self.minutes.select(*KEY, "date", "minute", "price", "avg", "volume")
            if isinstance(own, BarColumns) and own.points.get(point) == 0:
                minutes = minutes.where(F.col("date").between(F.lit(self.frm), F.lit(until)))
            if stock.kind == "Current":
                market, code = F.col("market"), F.col("code")
            elif stock.kind == "Market":
                at = F.create_map(*[F.lit(x) for m in {*MARKETS.values()} | set(self.index or ()) for x in (m, F.struct(*[F.lit(v).cast("int") for v in self.index_key(m)]))])[F.col("market")]
                market, code = at["col1"], at["col2"]
            else:
                key = symbol_key(stock.args[0]) or (-1, -1)
                market, code = F.lit(key[0]), F.lit(key[1])
            rows = rows.withColumn("__k_market", F.when(alive, market)).withColumn("__k_code", F.when(alive, code)).withColumn("__k_date", F.when(alive, dates[point]))
            if some or stock.kind != "Current":
                wanted = rows.select(*[F.col(f"__k_{k}").alias(k) for k in (*KEY, "date")]).where("market is not null").distinct()
                minutes = minutes.join(wanted, [*KEY, "date"], "left_semi")
            days = minute_days(minutes).select(*[F.col(k).alias(f"__d_{k}") for k in (*KEY, "date")], F.col("day").alias(column))
            on = (F.col("__k_market") == F.col("__d_market")) & (F.col("__k_code") == F.col("__d_code")) & (F.col("__k_date") == F.col("__d_date"))
            rows = rows.join(days, on, "left").drop("__d_market", "__d_code", "__d_date", "__k_market", "__k_code", "__k_date")
        return rows

    # Verdicts.

    @staticmethod
    def _piece(form: Form, points: list[tuple[str, Column]], begins: Column, marks: list[tuple[str, Column, Column, str | None]]) -> Column:
        """What one window comes to: the first of variables and conditions, in order, that fails, and the names before it."""
        early = [F.when(F.col(c).isNull(), F.lit(f"var:{n}")) for c, n, _ in form.vars]
        late = [(F.col(c), n) for c, n, _, _ in form.conditions]
        failed = F.coalesce(*early, *[F.when(~c, F.lit(n)) for c, n in late], F.lit(None).cast("string"))
        upto, names = F.lit(len(late)), F.array(*[F.lit(n) for _, n in late]).cast("array<string>")
        for k, (c, _) in reversed([*enumerate(late)]):
            upto = F.when(~c, F.lit(k)).otherwise(upto)
        if early:
            upto = F.when(F.coalesce(*early).isNotNull(), F.lit(0)).otherwise(upto)
        mark = lambda d, v, l: F.when(d.isNotNull(), F.struct(d.alias("date"), F.coalesce(v, F.lit(0.0)).alias("value"), F.lit(l).cast("string").alias("label")))
        return F.struct(failed.isNull().alias("passed"), failed.alias("failed"), F.slice(names, 1, upto).alias("names"), _entries(points, "date").alias("points"), _entries([(n, mark(d, v, l)) for n, d, v, l in marks], _MARK).alias("marks"), begins.alias("begins"))

    @staticmethod
    def _single(stage: Stage, window: Column) -> Column:
        """A stage's result from its one window."""
        good = window["passed"]
        return F.struct(
            F.lit(stage.name).alias("stage_name"), F.col("date").alias("date"), good.alias("passed"), window["names"].alias("passed_conditions"), window["failed"].alias("failed_condition"),
            window["points"].alias("points"), (F.when(good, window["marks"]).otherwise(_entries([], _MARK)) if stage.marks else window["marks"]).alias("marks"), F.array().cast(_MATCHES).alias("matches"),
        ).cast(RESULT)

    @staticmethod
    def _folded(stage: Stage, windows: Column) -> Column:
        """A stage's result from its windows (pieces): it passes if one does, and the first that does gives points and marks."""
        passed = F.filter(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.cast("int").alias("window"))), lambda y: y["x"]["passed"])
        best = F.coalesce(F.get(passed, F.lit(0))["x"], F.get(windows, F.lit(0)))
        matches = F.transform(passed, lambda y: F.struct(y["window"].alias("window"), y["x"]["begins"].alias("window_start"), F.col("date").alias("window_end"), y["x"]["points"].alias("points")))
        good = yes(best["passed"])
        return F.struct(
            F.lit(stage.name).alias("stage_name"), F.col("date").alias("date"), good.alias("passed"), F.coalesce(best["names"], F.array().cast("array<string>")).alias("passed_conditions"),
            F.when(best.isNull(), F.lit(NO_PATTERN)).otherwise(best["failed"]).alias("failed_condition"), F.coalesce(best["points"], _entries([], "date")).alias("points"),
            F.when(good, best["marks"]).otherwise(_entries([], _MARK)).alias("marks"), (matches if stage.kline_pattern is not None else F.array().cast(_MATCHES)).alias("matches"),
        ).cast(RESULT)

    @staticmethod
    def _missing(stage: Stage) -> Column:
        """The result of a stage without a bar to look at."""
        none = F.lit(None)
        return F.struct(F.lit(stage.name).alias("stage_name"), none.cast("date").alias("date"), F.lit(False).alias("passed"), F.array().cast("array<string>").alias("passed_conditions"), F.lit(NO_DATA).alias("failed_condition"), none.cast("map<string,date>").alias("points"), none.cast(f"map<string,{_MARK}>").alias("marks"), none.cast(_MATCHES).alias("matches")).cast(RESULT)

    # Segments: (market, code, date, passed, results).

    def _window_rows(self, seg: Segment, keys: DataFrame | None, scan: bool, whole: bool) -> DataFrame:
        """Stages in window form, in one pass. whole: a series without an anchor gives a row as well (no date)."""
        lead = seg.stages[0]
        bars = self._series(seg.stages, seg.fields, keys)
        if scan:
            bars = bars.withColumn("is_anchor", self._within(lead, scan))
        else:
            bars = bars.withColumn("__last", self._last(lead))
            bars = bars.withColumn("is_anchor", yes(F.col("date") == F.col("__last")))
        forms = [f for own in seg.forms for f in own]
        most = max((f.part.length for f in forms if f.part), default=0)
        if most:
            bars = bars.withColumn("__codes", F.array_join(F.collect_list(F.coalesce("candle", F.lit("_"))).over(series().rowsBetween(1 - most, 0)), ""))
        for i in range(max((len(f.vars) for f in forms), default=0)):
            bars = bars.withColumns({f.vars[i][0]: f.vars[i][2] for f in reversed(forms) if i < len(f.vars)})
        columns: dict[str, Column] = {}
        for f in forms:
            pre = f.own.prefix
            columns |= {c: v for c, _, v, late in f.conditions if not late and c not in columns}
            columns |= {f"{pre}_pt{i}": f.own.at("date", o) for i, o in enumerate(f.own.points.values())}
            for i, (_, d, v, _) in enumerate(f.marks):
                columns |= {f"{pre}_mark{i}": d, f"{pre}_markv{i}": v}
            if f.part:
                columns[f"{pre}_start"] = f.own.at("date", 1 - f.part.length)
        keep = F.col("is_anchor")
        if whole:
            keep = keep | (F.col("__last").isNull() & (F.col("date") == F.max("date").over(Window.partitionBy(*KEY))))
        rows = bars.withColumns(columns | {"__keep": keep}).where("__keep")
        alive, some = F.col("is_anchor") if not scan else F.lit(True), keys is not None
        for k, (stage, own) in enumerate(zip(seg.stages, seg.forms, strict=True)):
            pieces, fine = [], []
            for f in own:
                pre = f.own.prefix
                matched = self._matches(f.part)
                dates = {n: F.col(f"{pre}_pt{i}") for i, n in enumerate(f.own.points)}
                cheap = [F.col(c) for c, _, _, late in f.conditions if not late]
                if f.own.days:
                    live = both([alive, *([matched] if matched is not None else []), *[F.col(c).isNotNull() for c, _, _ in f.vars], *cheap])
                    rows = self._with_days(rows, f.own, dates, live, some or bool(cheap) or matched is not None, stage.start_date if stage.start_date and not scan else self.to)
                rows = rows.withColumns({c: v for c, _, v, late in f.conditions if late})
                marks = [(n, F.col(f"{pre}_mark{i}"), F.col(f"{pre}_markv{i}"), l) for i, (n, _, _, l) in enumerate(f.marks)]
                piece = self._piece(f, list(dates.items()), F.col(f"{pre}_start") if f.part else F.lit(None).cast("date"), marks)
                pieces.append(piece if matched is None else F.when(matched, piece))
                fine.append(both([*([matched] if matched is not None else []), *[F.col(c).isNotNull() for c, _, _ in f.vars], *[F.col(c) for c, _, _, _ in f.conditions]]))
            if stage.kline_pattern is None:
                rows = rows.withColumns({f"__w{k}": pieces[0], f"__p{k}": fine[0]}).withColumn(f"__r{k}", self._single(stage, F.col(f"__w{k}")))
                alive, some = alive & F.col(f"__p{k}"), True
                continue
            kind = "array<struct<passed:boolean,failed:string,names:array<string>,points:map<string,date>,marks:map<string," + _MARK + ">,begins:date>>"
            windows = F.filter(F.array(*pieces), lambda x: x.isNotNull()) if pieces else F.array().cast(kind)
            rows = rows.withColumns({f"__w{k}": windows, f"__p{k}": either(fine)}).withColumn(f"__r{k}", self._folded(stage, F.col(f"__w{k}")))
            alive, some = alive & F.col(f"__p{k}"), True
        n, upto = len(seg.stages), F.lit(len(seg.stages))
        for k in reversed(range(n - 1)):
            upto = F.when(~F.col(f"__p{k}"), F.lit(k + 1)).otherwise(upto)
        results, day = F.array(*[F.col(f"__r{k}") for k in range(n)]), F.col("date")
        results = F.slice(results, 1, upto) if n > 1 else results
        if whole:
            results, day = F.when(F.col("is_anchor"), results).otherwise(F.array(self._missing(lead))), F.when(F.col("is_anchor"), day)
        return rows.select(*KEY, day.alias("date"), alive.alias("passed"), results.alias("results"))

    @staticmethod
    def _matches(part: Partition | None) -> Column | None:
        """Whether the candles up to a bar end with a way's letters."""
        if part is None:
            return None
        if "." not in part.letters:
            return F.col("__codes").endswith(part.letters)
        return F.col("__codes").rlike(part.letters + "$")

    def _array_rows(self, seg: Segment, keys: DataFrame | None, scan: bool, lookback: int, wanted: DataFrame | None) -> DataFrame:
        """One stage on arrays. wanted: in a scan, the (series, date) rows to look at, by default all."""
        (stage,) = seg.stages
        own = BarArrays(self.registry)
        pattern = stage.kline_pattern
        blocks = list(dict.fromkeys(b.block_name for b in pattern.pattern)) if pattern else []
        steps = []  # of points: (column, expression), later ones may name earlier ones
        for i, (name, d) in enumerate(stage.points):
            steps.append((f"__pt{i}", name, self._point(own, d, blocks)))
            own.points[name] = F.col(f"__pt{i}")
        form = Form(own, None)
        self._compile(form, stage, "_")
        bars = self._series([stage], own.fields, keys)
        if not scan:
            bars = bars.withColumn("is_anchor", yes(F.col("date") == self._last(stage)))
        elif wanted is None:
            bars = bars.withColumn("is_anchor", self._within(stage, scan))
        else:
            flags = wanted.select(*KEY, "date", F.lit(True).alias("__wanted"))
            bars = bars.join(flags, [*KEY, "date"], "left").withColumn("is_anchor", self._within(stage, scan) & yes(F.col("__wanted"))).drop("__wanted")
        rows = self._with_arrays(bars, stage, scan, lookback)
        matched = None
        if pattern:
            lo = F.greatest(F.col("a") + 1 - longest(pattern, stage.windowsize), F.lit(0))
            rows = rows.withColumn("__codes", F.array_join(F.transform(F.slice("bars", lo + 1, F.col("a") + 1 - lo), lambda x: F.coalesce(x["candle"], F.lit("_"))), ""))
            rows = rows.select("*", F.posexplode_outer(self._fitting(stage, blocks)).alias("__w", "__part"))
            rows = rows.withColumn("s", F.col("a") + 1 - F.col("__part.len")).withColumn("__match", F.col("__part").isNotNull())
            matched = F.col("__match")
        else:
            rows = rows.withColumn("__w", F.lit(0))
        for column, _, c in steps:
            rows = rows.withColumn(column, c)
        for column, _, c in form.vars:
            rows = rows.withColumn(column, c)
        dates = {n: F.get("bars", F.col(c))["date"] for c, n, _ in steps}
        rows = rows.withColumns({c: v for c, _, v, late in form.conditions if not late} | {"__start": F.get("bars", F.col("s"))["date"]})
        cheap = [F.col(c) for c, _, _, late in form.conditions if not late]
        if own.days:
            live = both([*([matched] if matched is not None else []), *[F.col(c).isNotNull() for c, _, _ in form.vars], *cheap])
            rows = self._with_days(rows, own, dates, live, True, self.to)
        rows = rows.withColumns({c: v for c, _, v, late in form.conditions if late})
        piece = self._piece(form, list(dates.items()), F.col("__start"), form.marks)
        rows = rows.withColumn("__piece", piece if matched is None else F.when(matched, piece))
        if pattern:
            found = F.array_sort(F.collect_list(F.when(F.col("__piece").isNotNull(), F.struct(F.col("__w").alias("w"), F.col("__piece").alias("x")))), lambda p, q: p["w"] - q["w"])
            rows = rows.groupBy(*KEY, "date").agg(F.transform(found, lambda y: y["x"]).alias("__windows"))
        else:
            rows = rows.withColumn("__windows", F.array("__piece"))
        return rows.withColumn("__r", self._folded(stage, F.col("__windows"))).select(*KEY, "date", F.col("__r")["passed"].alias("passed"), F.array("__r").alias("results"))

    def _fitting(self, stage: Stage, blocks: list[str]) -> Column:
        """The ways (len, first, last) in which the candles end with the pattern; first and last: the blocks' places, -1 for an absent one."""
        pattern = stage.kline_pattern
        try:
            parts = partitions(pattern, stage.windowsize)
        except TooMany:
            return self._searched(pattern, stage.windowsize, blocks)
        spec = json.dumps([{"len": p.length, "letters": p.letters, **_places(p.blocks, blocks)} for p in parts])
        every = F.from_json(F.lit(spec), "array<struct<len:int,letters:string,first:array<int>,last:array<int>>>")
        fits = F.filter(every, lambda p: (F.length("__codes") >= p["len"]) & F.rlike(F.substring(F.col("__codes"), F.length("__codes") - p["len"] + 1, p["len"]), F.concat(F.lit("^"), p["letters"], F.lit("$"))))
        return F.transform(fits, lambda p: F.struct(p["len"].alias("len"), p["first"].alias("first"), p["last"].alias("last")))

    def _searched(self, pattern, windowsize, blocks: list[str]) -> Column:
        """The same for a pattern of very many ways, by search in each string of candles, once for equal ones of a batch."""
        import pandas as pd

        ship(self.bars.sparkSession)
        kind = "array<struct<len:int,first:array<int>,last:array<int>>>"

        def search(codes):
            own, known = Matcher(pattern, windowsize), {}
            for c in codes.dropna().unique():
                known[c] = [{"len": n, **_places(b, blocks)} for n, b in own.windows(c)]
            return codes.map(lambda c: known.get(c, []))

        search.__annotations__ = {"codes": pd.Series, "return": pd.Series}
        return F.pandas_udf(search, kind)(F.col("__codes"))

    def _point(self, own: BarArrays, d: Node, blocks: list[str]):
        if d.kind in ("BlockStart", "BlockEnd"):
            if d.args[0] not in blocks:
                return F.lit(None).cast("int")
            at = F.get(F.col("__part")["first" if d.kind == "BlockStart" else "last"], F.lit(blocks.index(d.args[0])))
            return F.when(at >= 0, F.col("s") + at)
        if d.kind == "Offset":
            p = own.points.get(d["from"], F.lit(None).cast("int")) + d["delta"]
            return F.when((p >= 0) & (p < F.size("bars")), p)
        found = F.filter(own.indices(d, None), lambda i: own.test(d["pred"], i))
        select = d["select"]
        if select in ("First", "Last"):
            return F.try_element_at(found, F.lit(1 if select == "First" else -1))
        (kind, n), = select.items()
        return F.get(found, F.lit(int(n))) if kind == "Nth" else F.try_element_at(found, F.lit(-int(n) - 1))

    def _with_arrays(self, bars: DataFrame, stage: Stage, scan: bool, lookback: int) -> DataFrame:
        """One row for each anchor: (market, code, date, bars, a, s). Bars hold the columns that the stage names."""
        back, ahead = reach(stage, self.registry)
        named = {t for _, e in [*stage.vars, *stage.points, *stage.conditions] for t in _texts(e)} | {t for _, anchor, value, _ in stage.marks for x in (anchor, value) if x is not None for t in _texts(x)}
        named |= {"open", "close", "candle"}
        bar = F.struct("date", *[c for c in bars.columns if c in named or c.startswith("__other")])
        if scan:
            if back >= 0:
                bars = bars.withColumn("__rn", F.row_number().over(series()))
                rows = bars.withColumn("bars", F.collect_list(bar).over(series().rowsBetween(-back, ahead))).where("is_anchor").withColumn("a", F.least(F.col("__rn") - 1, F.lit(back)).cast("int"))
                return rows.withColumn("s", F.size(F.filter("bars", lambda x: x["date"] < F.date_sub("date", lookback)))).select(*KEY, "date", "bars", "a", "s")
            # The window's first bar is that of so many days ago; each bar has those before it at hand, for the first one to give.
            days = Window.partitionBy(*KEY).orderBy("__day").rangeBetween(-lookback, 0)
            bars = bars.withColumn("__day", F.datediff("date", F.lit("1970-01-01"))).withColumn("__pre", F.collect_list(bar).over(series().rowsBetween(back, -1)))
            rows = bars.withColumn("__own", F.collect_list(F.struct(bar.alias("bar"), "__pre")).over(days)).withColumn("__next", F.collect_list(bar).over(series().rowsBetween(1, ahead)) if ahead else F.array()).where("is_anchor")
            pre, own = F.get("__own", F.lit(0))["__pre"], F.transform("__own", lambda x: x["bar"])
            joined = F.concat(pre, own, F.col("__next")) if ahead else F.concat(pre, own)
            return rows.withColumns({"bars": joined, "a": F.size(pre) + F.size("__own") - 1, "s": F.size(pre)}).select(*KEY, "date", "bars", "a", "s")
        bars = bars.withColumn("__rn", F.row_number().over(series()))
        at = F.max(F.when(F.col("is_anchor"), F.col("__rn"))).over(Window.partitionBy(*KEY))
        rows = bars.withColumn("__at", at).where((F.col("__rn") <= F.col("__at") + ahead) & ((F.col("__rn") >= F.col("__at") - back) if back >= 0 else F.lit(True)))
        rows = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(bar)).alias("bars"), F.max(F.when(F.col("is_anchor"), F.col("date"))).alias("date")).where("date is not null")
        rows = rows.withColumn("a", F.size(F.filter("bars", lambda x: x["date"] < F.col("date"))))
        return rows.withColumn("s", F.size(F.filter("bars", lambda x: x["date"] < F.lit(self.frm)))).select(*KEY, "date", "bars", "a", "s")

    # Whole screens.

    def _keys(self) -> DataFrame:
        own = self.universe if self.universe is not None else self.bars
        return own.select(*KEY).distinct()

    def run(self) -> DataFrame:
        """(market, code, date, passed, eliminated_stage, eliminated_reason, stage_results): one row for each series of the universe."""
        return self._stages(scan=False)

    def scan(self, lookback: int = 120, only_passed: bool = False) -> DataFrame:
        """The same for every bar of the requested dates as anchor, in one job."""
        out = self._stages(scan=True, lookback=lookback)
        return out.where("passed") if only_passed else out

    def _start(self, scan: bool) -> DataFrame:
        """All rows of the result, with no stage looked at yet."""
        if scan:
            state = self.bars.where(F.col("date").between(F.lit(self.frm), F.lit(self.to)))
            if self.universe is not None:
                state = state.join(self._keys(), list(KEY), "left_semi")
            state = state.select(*KEY, "date").distinct()
        else:
            state = self._keys().withColumn("date", F.lit(None).cast("date"))
        return state.withColumn("passed", F.lit(True)).withColumn("results", F.array().cast(f"array<{RESULT}>"))

    def _stages(self, scan: bool, lookback: int = 120) -> DataFrame:
        """All segments. The rows of the first are those of the result where it looks at all of them; others are joined to what passed."""
        by, state = [*KEY, "date"] if scan else list(KEY), None
        segments = self._segments(scan)
        for n, seg in enumerate(segments):
            daily = seg.stages[0].timeframe == "Daily"
            direct = n == 0 and (daily if scan else seg.forms is not None and self.universe is None and not self.pad)
            if n == 0 and not direct:
                state = self._start(scan)
            alive = None if n == 0 else state.where("passed")
            keys = self.universe if n == 0 else alive
            if seg.forms is not None:
                rows = self._window_rows(seg, keys, scan, whole=direct and not scan)
            else:
                rows = self._array_rows(seg, keys, scan, lookback, alive if scan else None)
            if direct:
                state = rows
            else:
                rows = rows.select(*by, *([] if scan else [F.col("date").alias("__date")]), F.col("passed").alias("__passed"), F.col("results").alias("__results"))
                missing = F.array(self._missing(seg.stages[0]))
                state = state.join(rows, by, "left").withColumn("results", F.when(F.col("passed"), F.concat("results", F.coalesce("__results", missing))).otherwise(F.col("results")))
                state = state.withColumn("passed", F.col("passed") & yes(F.col("__passed")))
                if not scan:
                    state = state.withColumn("date", F.coalesce("__date", "date"))
                state = state.drop("__passed", "__results", "__date")
            if n + 1 < len(segments) and state.sparkSession.sparkContext.getCheckpointDir():
                state = state.checkpoint()  # else each segment would carry the plans of all before it three times
        state = self._start(scan) if state is None else state
        last = F.try_element_at("results", F.lit(-1))
        failed = ~F.col("passed")
        return state.select(*KEY, "date", "passed", F.when(failed, last["stage_name"]).alias("eliminated_stage"), F.when(failed, last["failed_condition"]).alias("eliminated_reason"), F.col("results").alias("stage_results"))

    def extra(self, stage: Stage) -> DataFrame:
        """The bars, with indicators, of the series that a stage lists by symbol; unknown symbols have none."""
        keys = [symbol_key(s) for s in stage.extra_stocks]
        wanted = [F.struct(F.lit(m).cast("int"), F.lit(c).cast("int")) for m, c in filter(None, keys)]
        return self._prepared(self.bars.where(F.struct(*KEY).isin(wanted) if wanted else F.lit(False)), [stage])

    def survivors(self) -> DataFrame:
        """The series that pass."""
        return self.run().where("passed").select(*KEY)

    def validate(self) -> list[str]:
        """What keeps the pipeline from running: unknown modules, parameters, points, symbols."""
        out = []
        for stage in self.pipeline.stages:
            try:
                reach(stage, self.registry)
                points = {n for n, _ in stage.points}
                for e in [e for _, e in stage.vars + stage.conditions]:
                    for x in walk(e):
                        if hasattr(x, "anchor") and x.anchor.kind == "Point" and x.anchor.args[0] not in points:
                            out.append(f"{stage.name}: no point {x.anchor.args[0]!r}")
                out += [f"{stage.name}: no symbol {s!r}" for s in stage.extra_stocks if symbol_key(s) is None]
            except (KeyError, ValueError) as error:
                out.append(f"{stage.name}: {error}")
        return out


def _places(found, blocks: list[str]) -> dict[str, list[int]]:
    first, last = {n: a for n, a, _ in found}, {n: z for n, _, z in found}
    return {"first": [first.get(b, -1) for b in blocks], "last": [last.get(b, -1) for b in blocks]}

"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (its share of all blocks) has for its i-th block (from 1) the release time
floor((i - 1) / w) and the deadline ceil(i / w). In each slot one block runs: of the released ones that
with the earliest deadline, which for a total weight of 1 meets all deadlines, so that after t slots each
source has had more than w t - 1 and less than w t + 1 blocks.

Weights are exact fractions, so this holds however long the schedule is. It is made in one pass by one task, a row
for each block, and rows of documents meet it by source and chunk of blocks. When a source has no blocks left, the
others are scheduled on with weights in the same proportions.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from itertools import islice
from math import ceil, gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow, plainly_named, stage, tasks

PERIOD = 1_000
BLOCK = 64
#: Rows that one group ranks, at most about so many.
BUCKET_ROWS = 50_000
#: Blocks of a source in one row of the plan, and the blocks up to which a plan (24 bytes each) is broadcast.
CHUNK = 1_024
PLAN_BLOCKS = 1_000_000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares that sum to the period and are at least 1, in the weights' proportions by largest remainders (ties by name).

    The period grows until the smallest weight gets a share.
    """
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights lie above 0")
    own = {s: Fraction(w) for s, w in weights.items()}
    total = sum(own.values())
    period = max(period, ceil(total / min(own.values(), default=1)))
    exact = {s: w * period / total for s, w in own.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the weights' proportions."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights lie above 0")
    own = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(w.denominator for w in own.values()))
    out = {s: w.numerator * (unit // w.denominator) for s, w in own.items()}
    least = gcd(*out.values())
    return {s: n // least for s, n in out.items()}


def fair(parts: dict[str, int]):
    """Without end: (source, block from 1, slot, release, deadline) for each block, by earliest deadline first.

    Ties of deadlines go to the earlier next deadline (the block whose source waits for less), then to the smaller name.
    """
    period = sum(parts.values())
    release = lambda s, i: (i - 1) * period // parts[s]
    deadline = lambda s, i: -(-i * period // parts[s])
    waiting = [(0, s, 1) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, i), deadline(s, i + 1), s, i))
        due, _, s, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline is missed")
        yield s, i, slot, release(s, i), due
        heapq.heappush(waiting, (release(s, i + 1), s, i + 1))
        slot += 1


def edf(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The blocks of one period of fair()."""
    return list(islice(fair(parts), sum(parts.values())))


def plan(blocks: dict[str, int], weights: dict[str, float], period: int | None = None):
    """(source, block, slot, release, deadline) for each block of the whole schedule, ascending by slot.

    When a source that has no blocks left would run, a new phase begins in that slot with the others.
    """
    left, at = {s: n for s, n in blocks.items() if n}, 0
    done = dict.fromkeys(left, 0)
    while left:
        live = {s: weights[s] for s in left}
        for s, _, slot, release, due in fair(shares(live, period) if period else whole(live)):
            if not left[s]:
                break
            yield s, done[s], at + slot, at + release, at + due
            done[s] += 1
            left[s] -= 1
        at += slot
        left = {s: n for s, n in left.items() if n}


def _plan(counts: DataFrame, weights: dict[str, float] | None, block: int, period: int | None) -> DataFrame:
    """(__s, __chunk, __slots, __releases, __dues): the plan in arrays of CHUNK blocks of a source, made by one task from the sources' counts."""
    import pyarrow as pa

    names = ["__s", "__chunk", "__slots", "__releases", "__dues"]

    def batch(rows):
        kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches):
        held = {s: n for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        own = default_weights(held) if weights is None else {s: weights[s] for s in held}
        open_, full = {}, []
        for s, i, *place in plan({s: -(-n // block) for s, n in held.items()}, own, period):
            row = open_.setdefault(s, (s, i // CHUNK, [], [], []))
            for to, x in zip(row[2:], place, strict=True):
                to.append(x)
            if len(row[2]) == CHUNK:
                full.append(open_.pop(s))
            if len(full) == 64:
                yield batch(full)
                full = []
        rows = full + list(open_.values())
        for k in range(0, len(rows), 1_000):
            yield batch(rows[k : k + 1_000])

    return stage(counts.select("__s", "n").coalesce(1).transform(arrow, run, "__s string, __chunk long, __slots array<long>, __releases array<long>, __dues array<long>"), "plan")


def default_weights(counts: dict[str, int], power: float = 0.7) -> dict[str, float]:
    """Target weights where none are given: sizes to a power below 1, which raises small sources."""
    return {s: float(n) ** power for s, n in counts.items()}


def _keyed(docs: DataFrame, id_col: str, source_col: str, carry: list[str]) -> DataFrame:
    """(__id, __source, __s, __h, __u, __k0, ...): the source as text, a hash of the id and its upper half, and the carried columns."""
    rows, names = plainly_named(docs)
    at = dict(zip(docs.columns, names, strict=True))
    source = F.col(at[source_col])
    own = rows.select(F.col(at[id_col]).alias("__id"), source.alias("__source"), F.coalesce(source.cast("string"), F.lit("")).alias("__s"), *[F.col(at[c]).alias(f"__k{i}") for i, c in enumerate(carry)])
    return own.withColumn("__h", F.xxhash64(F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit(17))).withColumn("__u", F.shiftrightunsigned("__h", 32))


def _order(own: DataFrame) -> list:
    """The order of a source's rows: by hash, then id, then a hash of the carried columns but maps."""
    plain = [F.col(c) for c, k in own.dtypes if c.startswith("__k") and "map<" not in k and "variant" not in k]
    return [F.col("__u"), F.col("__h"), F.col("__id"), *([F.xxhash64(*plain)] if plain else [])]


def _scheduled(docs: DataFrame, weights: dict[str, float] | None, block: int, period: int | None, id_col: str, source_col: str, carry: list[str]) -> DataFrame:
    """(__id, __source, __s, __block, __slot, __release, __due, __u, __h, __k0, __k1, ...) for each row of docs; __k: the carried columns."""
    own = _keyed(docs, id_col, source_col, carry)
    counts = stage(own.groupBy("__s").agg(F.count("*").alias("n")), "counts")
    if weights is not None:
        missing = [r["__s"] for r in counts.toLocalIterator() if r["__s"] not in weights]
        if missing:
            raise ValueError(f"no weight for {sorted(missing)[:5]}")
    total, sources, blocks = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.ceil(F.col("n") / block)), F.lit(0))).first()
    parts = tasks(docs)
    # Each source is cut into as many ranges of hashes as its rows ask for: ranges are ranked by themselves, in even tasks.
    each = min(BUCKET_ROWS, max(256, -(-total // (4 * parts))))
    few = sources + total // each <= BROADCAST_ROWS
    cut = counts.select("__s", F.ceil(F.col("n") / each).alias("__cuts"))
    own = own.join(F.broadcast(cut) if few else cut, "__s").withColumn("__b", F.shiftright(F.col("__u") * F.col("__cuts"), 32)).drop("__cuts")
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("__s", "__b").agg(F.count("*").alias("m")).withColumn("__start", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    order = Window.partitionBy("__s", "__b").orderBy(*_order(own))
    ranked = own.withColumn("__r", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(starts) if few else starts, ["__s", "__b"]).withColumn("__block", F.floor((F.col("__start") + F.col("__r")) / block))
    ranked = ranked.withColumn("__chunk", F.floor(F.col("__block") / CHUNK).cast("long")).drop("__b", "__start", "__r")
    table = _plan(counts, weights, block, period)
    found = ranked.join(F.broadcast(table) if blocks <= PLAN_BLOCKS else table, ["__s", "__chunk"])
    place = F.pmod(F.col("__block"), F.lit(CHUNK)).cast("int")
    return found.withColumns({"__slot": F.get("__slots", place), "__release": F.get("__releases", place), "__due": F.get("__dues", place)}).drop("__slots", "__releases", "__dues", "__chunk")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, block, slot, release, deadline) for each row of docs; slots are those of one long schedule.

    block: rows of a block, in an order by hash of the id (ties by id); a source's last block may hold fewer.
    weights: target weights by source, by default by size to the power 0.7; each source of docs must have one.
    period: round the weights to whole shares of so many slots; by default they are taken as they are. A null
    source is a source of its own, named "". Nothing is dropped and nothing repeated: when a source ends, the
    others go on in their proportions. Rows that repeat are rows of their own. An empty table gives an empty
    result. Extra columns may have any names and types and are not read.

    Ranks within a source come from counts of ranges of hashes plus ranks within a range, so a source that holds a
    third of all rows is dealt out evenly; only rows of one id, or of none, stay together. The plan is made by one task, which holds the sources' counts and
    heaps (some 500 bytes a source) and gives blocks one by one; a source that ends costs a pass over those left.
    It is broadcast up to PLAN_BLOCKS blocks; beyond it rows are shuffled once more, by source and chunk.
    """
    found = _scheduled(docs, weights, block, period, id_col, source_col, [])
    return found.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__block").cast("long").alias("block"), F.col("__slot").alias("slot"), F.col("__release").alias("release"), F.col("__due").alias("deadline"))


def _places(docs: DataFrame, weights, block: int, period, id_col: str, source_col: str, parts: int):
    """Where rows go when the schedule is cut into `parts` runs of slots, from ids and sources alone: (cells, cuts, index).

    cells: (__s, __p, first, slots, base): of each source and run its first block, the slots of its blocks, and the rows of
    the source before it. cuts: (__s, __cuts): into how many ranges of hashes a source is cut. index: (__s, __b, ends): for each
    range the runs that its rows go to, by the least hash that goes there. None where two rows of one hash go to unlike runs.
    """
    ids = _scheduled(docs, weights, block, period, id_col, source_col, []).select("__s", "__u", "__h", "__block", "__slot")
    ids = stage(ids, "slots")
    total, rows = ids.agg(F.coalesce(F.max("__slot") + 1, F.lit(1)), F.count("*")).first()
    run, key = F.floor(F.col("__slot") * parts / total).cast("int"), F.struct("__u", "__h")
    cells = ids.groupBy("__s", run.alias("__p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"), F.min("__block").alias("first"), F.array_sort(F.collect_set(F.struct("__block", "__slot"))).alias("slots"))
    by = Window.partitionBy("__s").orderBy("__p")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"tied": F.lag("hi").over(by) == F.col("lo"), "base": F.coalesce(F.sum("n").over(before), F.lit(0)), "slots": F.transform("slots", lambda x: x["__slot"])})
    cells = stage(cells, "cells")
    many, ties = cells.agg(F.count("*"), F.coalesce(F.bool_or("tied"), F.lit(False))).first()
    if ties or many > BROADCAST_ROWS:
        return None
    each = max(256, -(-rows // BROADCAST_ROWS))
    cuts = ids.groupBy("__s").agg(F.ceil(F.count("*") / each).alias("__cuts"))
    range_of = lambda c: F.shiftright(F.col(c)["__u"] * F.col("__cuts"), 32)
    spans = cells.join(cuts, "__s").withColumn("__b", F.explode(F.sequence(range_of("lo"), range_of("hi"))))
    index = spans.groupBy("__s", "__b").agg(F.array_sort(F.collect_list(F.struct("lo", "__p"))).alias("ends"))
    return cells, stage(cuts, "cuts"), stage(index, "index")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs in the order of the schedule: partitions, and rows within them, ascend by slot, so files written from it are in mixed order.

    All rows and columns of docs stay, whatever the columns' names and types; in every prefix that no source has
    run out before, each source's blocks are within one of its target share. Null sources, repeated rows and
    empty tables are as in schedule().

    Ids and sources are ranked first, and tell for each range of hashes which run of slots its rows go to. Whole rows are
    then shuffled once, to their run, where they meet its slots. Where rows of one id stand at a run's border, or runs
    and sources are too many to broadcast, whole rows are shuffled twice: to be ranked, and into the schedule's order.
    """
    columns, parts = docs.columns, tasks(docs)
    others = [c for c in columns if c not in (id_col, source_col)]
    own = {id_col: "__id", source_col: "__source"} | {c: f"__k{i}" for i, c in enumerate(others)}
    places = _places(docs, weights, block, period, id_col, source_col, parts)
    if places is None:
        placed = _scheduled(docs, weights, block, period, id_col, source_col, others)
        ordered = placed.repartitionByRange(parts, "__slot", "__u", "__h").sortWithinPartitions("__slot", "__u", "__h", "__id")
        return ordered.select(*[F.col(own[c]).alias(c) for c in columns])
    cells, cuts, index = places
    rows = _keyed(docs, id_col, source_col, others)
    rows = rows.join(F.broadcast(cuts), "__s").withColumn("__b", F.shiftright(F.col("__u") * F.col("__cuts"), 32)).join(F.broadcast(index), ["__s", "__b"])
    run = F.try_element_at(F.filter("ends", lambda e: e["lo"] <= F.struct("__u", "__h")), F.lit(-1))["__p"]
    rows = rows.withColumn("__p", run).drop("__cuts", "__b", "ends")
    # A run's slots come first among the rows of their source, and each row takes them from there.
    heads = cells.select("__s", "__p", F.lit(-1).cast("long").alias("__u"), "first", "base", "slots")
    by = Window.partitionBy("__p", "__s").orderBy(*_order(rows))
    met = rows.unionByName(heads, allowMissingColumns=True).repartitionById(parts, F.col("__p"))
    head = lambda c: F.first(c, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumns({"__r": F.row_number().over(by) - 2, "__first": head("first"), "__base": head("base"), "__slots": head("slots")}).where("__u >= 0")
    met = met.withColumn("__slot", F.get("__slots", (F.floor((F.col("__base") + F.col("__r")) / block) - F.col("__first")).cast("int")))
    return met.sortWithinPartitions("__slot", "__u", "__h", "__id").select(*[F.col(own[c]).alias(c) for c in columns])

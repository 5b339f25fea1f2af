"""Exact top-k by inner product with pivot-table elimination.

With one more component, sqrt(M^2 - |x|^2) for a stored vector of norm at most M and 0 for a query, the
greatest inner products belong to the nearest points: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. For each pivot p,
|d(q, p) - d(x, p)| is a lower bound of d(q, x); the table of distances to all pivots gives each pair its
greatest lower bound. A query evaluates candidates in order of that bound, in growing waves, and stops as
soon as the bound of the next one exceeds its k-th best distance.

Candidates lie in cells round anchors, and a cell knows the least and greatest distance of its members to each
pivot. A query first searches a block of its own cell; with the k-th best score found there it goes only to cells
whose bounds allow a better one, so most pairs are ruled out before anything is shuffled for them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, stage, tasks

PIVOTS = 24
SAMPLE = 2_000
#: Anchors of cells, at most, and the rows for each.
ANCHORS = 256
ANCHOR_ROWS = 512
#: Queries that are searched at a time, and candidates that a task holds.
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 16_384


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Pivots by the farthest-first rule, from a bounded sample: any choice gives exact results."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(((sample - sample.mean(0)) ** 2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def padded(x: np.ndarray, norm: float) -> np.ndarray:
    """Stored vectors with the component that brings them to one norm."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(1)))[:, None]])


def margin_of(norm: float) -> float:
    """Far above the rounding error of a bound."""
    return 1e-6 * max(1.0, norm) + 1e-3


def search_block(q_ids, q, x_ids, x, pivots, norm: float, k: int, stats: dict | None = None, table: np.ndarray | None = None, least: np.ndarray | None = None):
    """The k best of one block of candidates for each query of one block: (query, candidate, score), each exact.

    Bounds are floating point, so a margin far above their rounding error is left before a pair is eliminated.
    table: the candidates' distances to the pivots. least: for each query a score (-inf: none) that so many candidates
    elsewhere reach that lesser ones are not wanted.
    """
    out = []
    table = _distances(padded(x, norm), pivots) if table is None else table
    own = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
    margin, columns = margin_of(norm), np.ascontiguousarray(table.T)
    least = np.full(len(q), -np.inf) if least is None else least
    repeats = len(np.unique(x_ids)) < len(x_ids)
    for i in range(len(q)):
        q2 = float(q[i] @ q[i])
        radius = lambda score: np.sqrt(max(0.0, q2 + norm * norm - 2 * score)) + margin  # noqa: B023, E731
        bound = np.zeros(len(x))
        for c, d in zip(columns, own[i], strict=True):
            np.maximum(bound, np.abs(c - d), out=bound)
        live = np.flatnonzero((x_ids != q_ids[i]) & (bound <= (radius(least[i]) if np.isfinite(least[i]) else np.inf)))
        order = live[np.argsort(bound[live], kind="stable")]
        top_ids, top = np.empty(0, np.int64), np.empty(0)
        at, wave = 0, max(64, 4 * k)
        while at < len(order):
            if len(top) == k and bound[order[at]] > radius(top[-1]):
                break
            if len(top) == k:  # those that the k-th best so far rules out are never evaluated
                order = order[: np.searchsorted(bound[order], radius(top[-1]), side="right")]
            # Where bounds rule out little, the rest costs less as one product than by single rows.
            whole = 8 * wave > len(x) and 2 * (len(order) - at) > len(x)
            some = order[at:] if whole else order[at : at + wave]
            found = (x @ q[i])[some] if whole else x[some] @ q[i]
            if len(found) > 8 * k and not repeats:
                near = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k])
                at, some, found = at + len(some) - len(near), some[near], found[near]
            ids, score = np.concatenate([top_ids, x_ids[some]]), np.concatenate([top, found])
            best = np.lexsort((ids, -score))
            if repeats:  # an id's best row stands for it
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
            best = best[:k]
            top_ids, top = ids[best], score[best]
            at, wave = at + len(some), wave * 2
        if stats is not None:
            stats["evaluated"] = stats.get("evaluated", 0) + min(at, len(order))
            stats["pairs"] = stats.get("pairs", 0) + len(x) - int((x_ids == q_ids[i]).sum())
        wanted = top >= least[i]
        out.append((np.full(int(wanted.sum()), q_ids[i]), top_ids[wanted], top[wanted]))
    parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 3
    return parts[0].astype(np.int64), parts[1].astype(np.int64), np.rint(parts[2]).astype(np.int64)


def _meet(asked: DataFrame, stored: DataFrame, facts, k: int, query_block: int, parts: int) -> DataFrame:
    """(query_id, vec_id, score): what each query finds in the block (dim, cell, block) that it asks.

    Blocks stream through sorted partitions, candidates before queries: a task holds one block and a batch of queries.
    """
    import pyarrow as pa

    def numbers(column, dim):
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)

    def run(batches):
        key, own, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            is_query = b.column(3).to_numpy(zero_copy_only=False)
            marks = np.column_stack([keys, is_query])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if key != tuple(keys[s]):
                    key, own, block = tuple(keys[s].tolist()), [], None
                dim, (pivots, norm) = key[0], facts.value[key[0]]
                ids, v = b.column(4).slice(s, e - s).to_numpy(), numbers(b.column(5).slice(s, e - s), key[0])
                if not is_query[s]:
                    own.append((ids, v, numbers(b.column(6).slice(s, e - s), len(pivots)) if len(pivots) else np.zeros((len(ids), 0))))
                    block = None
                    continue
                if own:
                    block = block or tuple(np.concatenate(c) for c in zip(*own, strict=True))
                    least = b.column(7).slice(s, e - s).to_numpy(zero_copy_only=False).astype(float)
                    for at in range(0, len(ids), query_block):
                        to = at + query_block
                        a, x, score = search_block(ids[at:to], v[at:to], block[0], block[1], pivots, norm, k, None, block[2], np.where(np.isnan(least[at:to]), -np.inf, least[at:to]))
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(x), pa.array(score)], names=["query_id", "vec_id", "score"])

    columns = ["dim", "cell", "block", "query", "id", "v", "t", "least"]
    rows = asked.select(columns).unionAll(stored.select(columns)).repartition(parts, "dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "query")
    return rows.transform(arrow, run, "query_id long, vec_id long, score long")


def usable(vector: str):
    """Whether a vector column is neither null nor empty nor holds a null or a non-finite component."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query with all other rows.

    Components are floor(scale * c). Queries: rows whose id is divisible by `every`; candidates: all rows
    but those of the query's own id; ties go to the smaller id. Rows with a null id, and vectors that are
    null, empty, or hold null or non-finite components take no part; vectors of other lengths than a
    query's are no candidates of it; an empty table gives an empty result; rows that repeat an id are one
    candidate, by their greatest score. Scores are exact while they are below 2^53. Columns besides the two are not read.

    Each candidate is shuffled twice, once for the queries of its own cell and once for all others that its cell's
    bounds let through; a query is copied to the blocks that it asks. Only k rows for each query and block leave it.
    """
    import pyarrow as pa

    spark, parts = vectors.sparkSession, tasks(vectors)
    scaled = F.transform(vec_col, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double"))
    rows = vectors.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v")).withColumn("dim", F.size("v"))
    # A few numbers for each length of vectors: rows and the greatest norm.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()}
    kept: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("dim", "v").collect():
        kept.setdefault(r["dim"], []).append(r["v"])
    fitted = {}
    for dim, f in sizes.items():
        sample = padded(np.array(kept.get(dim, []), float).reshape(-1, dim), float(f["norm"]))
        anchors = np.unique(sample[: max(1, min(ANCHORS, f["n"] // ANCHOR_ROWS))], axis=0) if len(sample) else sample
        fitted[dim] = choose_pivots(sample).reshape(-1, dim + 1), float(f["norm"]), anchors
    shared = spark.sparkContext.broadcast(fitted)
    facts = spark.sparkContext.broadcast({d: x[:2] for d, x in fitted.items()})
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float64()))

    def place(batches):
        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                pivots, most, anchors = shared.value[dim]
                v = b.column(1).take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                x = padded(v, most)
                cell = np.argmin((anchors * anchors).sum(1)[None] - 2 * x @ anchors.T, axis=1) if len(anchors) else np.zeros(len(at))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), lists(v), lists(_distances(x, pivots))], names=["id", "dim", "cell", "v", "t"])

    placed = stage(rows.transform(arrow, place, "id long, dim int, cell int, v array<double>, t array<double>"), "placed")
    span = [f(F.get("t", F.lit(i))).alias(f"{n}{i}") for i in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = stage(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / candidate_block).cast("int").alias("blocks"), *span), "cells")
    # At most ANCHORS rows for each length of vectors.
    ranges: dict[int, list] = {}
    for r in cells.collect():
        own = len(fitted[r["dim"]][0])
        ranges.setdefault(r["dim"], []).append((r["cell"], [r[f"lo{i}"] for i in range(own)], [r[f"hi{i}"] for i in range(own)]))
    bounds = spark.sparkContext.broadcast({d: tuple(np.array(c, float).reshape(len(x), -1) for c in zip(*x, strict=True)) for d, x in ranges.items()})
    blocks = F.broadcast(cells.select("dim", "cell", "blocks"))
    held = placed.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    stored = held.withColumn("query", F.lit(False)).withColumn("least", F.lit(None).cast("double"))
    asks = held.where(F.col("id") % every == 0).withColumn("query", F.lit(True)).withColumn("t", F.lit(None).cast("array<double>")).withColumnRenamed("cell", "home")
    first = stage(_meet(asks.withColumn("cell", F.col("home")).withColumn("least", F.lit(None).cast("double")), stored, facts, k, query_block, parts), "first")

    from pyspark.sql import Window

    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place_of).where(F.col("rank") <= k)
    least = best(first).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))

    def targets(batches):
        for b in batches:
            dims, least = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            chosen: list = [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                pivots, most, _ = shared.value[dim]
                number, lo, hi = bounds.value[dim]
                q = b.column(1).take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                own = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                t = np.where(np.isnan(least[at]), -np.inf, least[at])
                radius = np.sqrt(np.maximum(0.0, (q * q).sum(1) + most * most - 2 * t)) + margin_of(most)
                for i, d in zip(at.tolist(), range(len(at)), strict=True):
                    far = np.maximum(lo - own[d], own[d] - hi).max(1) if len(pivots) else np.zeros(len(number))
                    chosen[i] = number[far <= radius[d], 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chosen, pa.list_(pa.int32()))], names=["dim", "v", "least", "id", "home", "block", "cells"])

    asks = asks.join(least, "id", "left").select("dim", "v", "least", "id", "home", "block").transform(arrow, targets, "dim int, v array<double>, least double, id long, home int, block int, cells array<int>")
    wide = asks.withColumnRenamed("block", "home_block").withColumn("cell", F.explode("cells")).join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.where((F.col("cell") != F.col("home")) | (F.col("block") != F.col("home_block"))).withColumn("query", F.lit(True)).withColumn("t", F.lit(None).cast("array<double>"))
    second = _meet(wide, stored, facts, k, query_block, parts)
    return best(first.unionAll(second)).select("query_id", "rank", "vec_id", "score")

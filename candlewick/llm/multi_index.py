"""Embedding near-duplicates by an inverted multi-index.

The vectors' two halves have codebooks of their own; their product is a grid of cells, and each vector is
stored in the cell of its two nearest codes. A vector visits cells in order of the sum of its halves'
squared distances to the codes (the multi-sequence order), as many as reach the target recall, and what
it meets there is verified by the exact cosine in double precision.

The number of cells visited is settled on pairs made for the purpose: sampled vectors and partners turned
away from them by a random direction to just the threshold, the hardest pairs that count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow, forget, ship, stage
from .graph import components
from .topk import usable

#: Vectors that codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 8_000
#: Codes of a half, at most; and cells that a vector visits, at most.
CODES = 1_024
MOST_CELLS = 512
#: Vectors of a cell that one task holds, at most.
CELL = 1_024


def fit_codebook(x: np.ndarray, codes: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """k-means centres of a bounded sample."""
    own = np.unique(x, axis=0)
    if len(own) <= codes:
        return own
    rng = np.random.default_rng(seed)
    c = own[rng.choice(len(own), codes, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=codes)
        sums = np.stack([np.bincount(near, x[:, j], minlength=codes) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def visits(v: np.ndarray, one: np.ndarray, two: np.ndarray, cells: int) -> np.ndarray:
    """The numbers of the cells nearest to each vector, nearest first (ties to the smaller number).

    Of the (i+1)-th nearest code of one half and the (j+1)-th of the other only those with (i+1)(j+1) <= cells
    can be among the first: that is the part of the grid that the multi-sequence order can reach.
    """
    half = one.shape[1]
    d = [(c * c).sum(1)[None] - 2 * x @ c.T + (x * x).sum(1)[:, None] for x, c in ((v[:, :half], one), (v[:, half:], two))]
    cells = min(cells, len(one) * len(two))
    order = [np.argsort(x, axis=1, kind="stable")[:, :cells] for x in d]
    near = [np.take_along_axis(x, o, axis=1) for x, o in zip(d, order, strict=True)]
    i, j = (x.ravel() for x in np.meshgrid(range(near[0].shape[1]), range(near[1].shape[1]), indexing="ij"))
    reach = (i + 1) * (j + 1) <= cells
    i, j = i[reach], j[reach]
    sums, number = near[0][:, i] + near[1][:, j], order[0][:, i] * len(two) + order[1][:, j]
    best = np.lexsort((number, sums), axis=1)[:, :cells]
    return np.take_along_axis(number, best, axis=1)


def settle_visits(sample: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float, recall: float, seed: int = 2, pairs: int = 4_000) -> int | None:
    """The least number of cells by which a pair at just the threshold is met, from either side, with the target recall; none if MOST_CELLS don't reach it."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), pairs)]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * away
    most, met = min(MOST_CELLS, len(one) * len(two)), []
    for k in range(0, pairs, 250):
        a, b = visits(x[k : k + 250], one, two, most), visits(y[k : k + 250], one, two, most)
        at = [np.where((m := s == c[:, :1]).any(1), m.argmax(1), most) for s, c in ((a, b), (b, a))]
        met.append(np.minimum(*at))
    least = int(np.sort(np.concatenate(met))[min(pairs, int(np.ceil(recall * pairs))) - 1]) + 1
    return least if least <= most else None


def fit_index(sample: np.ndarray, codes: int, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Two codebooks and the number of cells to visit. Where that many cells don't reach the recall, codebooks of half as many codes are taken, down to one cell of everything."""
    half = max(1, sample.shape[1] // 2)
    while True:
        one = fit_codebook(sample[:, :half], codes)
        two = fit_codebook(sample[:, half:], codes) if sample.shape[1] > 1 else np.zeros((1, 0))
        n = settle_visits(sample, one, two, threshold, recall)
        if n is not None:
            return one, two, n
        codes = max(1, codes // 2)


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; first by the greatest component, as squares of very large or small ones leave the range of doubles."""
    v = v / np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Rows link when the cosine of their vectors, in double precision, is the threshold or more; that of equal vectors
    is 1. Pairs are met with about the target recall or better, and none below the threshold links. n_links counts
    the other rows linked directly; component_id is the smallest id reachable, the row's own included; kept says
    that it is the row's own. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do rows with a null id or vectors of different lengths. Rows that repeat an id are rows of
    their own and link if their vectors do; each returns with the links of all rows of its id. An empty table gives an
    empty result. Columns besides the two are not read.

    Rows of equal vectors are one from the start, with their number. Each such class goes to the cells it visits,
    so it is copied some ten times; a cell of many classes is dealt out in blocks, each pair of blocks in one group.
    Links are counted where they are found, and leave it as one sum for each class and a forest that connects them,
    never as pairs.
    """
    import pyarrow as pa

    spark = ship(vectors.sparkSession)
    vectors = vectors.select(F.col(f"`{id_col}`").alias("own"), F.col(f"`{vec_col}`").alias("e"))
    live = usable("e") & F.exists("e", lambda c: c != 0) & F.col("own").isNotNull()
    rows = vectors.where(F.coalesce(live, F.lit(False))).select(F.col("own").cast("long").alias("id"), F.col("e").cast("array<double>").alias("v"))
    rows = rows.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v", F.lit(1)).alias("k1"), F.xxhash64("v", F.lit(2)).alias("k2"))
    classes = stage(rows.groupBy("dim", "k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")), "classes")
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    drawn: dict[int, list] = {}
    for r in classes.orderBy("k1", "k2").limit(sample).select("dim", "v").collect():
        drawn.setdefault(r["dim"], []).append(r["v"])
    books = {}
    for dim in counts:
        own = _unit(np.array(drawn.get(dim) or np.eye(dim)[:1], float))
        books[dim] = fit_index(own, int(min(CODES, max(1, round(np.sqrt(counts[dim] / 256))) * 2)), threshold, recall)
    shared = spark.sparkContext.broadcast(books)

    def place(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                one, two, n = shared.value[dim]
                v = _unit(b.column(3).take(at).flatten().to_numpy().reshape(-1, dim))
                seen = visits(v, one, two, n).astype(np.int32)
                flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), flat(v, pa.float64()), flat(seen, pa.int32()), b.column(4).take(at), b.column(5).take(at)], names=["id", "m", "dim", "v", "cells", "k1", "k2"])

    placed = classes.select("id", "m", "dim", "v", "k1", "k2").transform(arrow, place, "id long, m long, dim int, v array<double>, cells array<int>, k1 long, k2 long")
    placed = stage(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    forget(classes)
    home = F.element_at("cells", 1)
    sizes = stage(placed.groupBy("dim", home.alias("cell")).agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    spread = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")
    all_of = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = placed.withColumn("cell", F.explode("cells")).join(sizes, ["dim", "cell"])
    asked = asked.select(F.lit(True).alias("asks"), "id", "m", "row", "dim", "v", "cells", "cell", spread(F.col("blocks"), 1).alias("ask_block"), all_of.alias("block"))
    stored = placed.withColumn("cell", home).join(sizes, ["dim", "cell"])
    stored = stored.select(F.lit(False).alias("asks"), "id", "m", "row", "dim", "v", "cells", "cell", all_of.alias("ask_block"), spread(F.col("blocks"), 2).alias("block"))

    def verify(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        asks = t["asks"].to_numpy()
        row, ids, m = t["row"].to_numpy(), t["id"].to_numpy(), t["m"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        cells = t["cells"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        a, s = np.flatnonzero(asks), np.flatnonzero(~asks)
        links, root = np.zeros(len(row), np.int64), np.arange(len(row))
        # Both directions meet a pair whose cells are visited by each other's rows; the smaller row's counts.
        a_home, s_cells = cells[a, 0], cells[s]
        for start in range(0, len(a), 512):
            some = a[start : start + 512]
            i, j = np.nonzero(v[some] @ v[s].T >= threshold - 1e-12)
            if not len(i):
                continue
            close = (v[some[i]] * v[s[j]]).sum(1) >= threshold
            i, j = i[close], j[close]
            both = (s_cells[j] == a_home[start + i][:, None]).any(1)
            mine = (row[some[i]] != row[s[j]]) & (~both | (row[some[i]] < row[s[j]]))
            i, j = some[i[mine]], s[j[mine]]
            np.add.at(links, i, m[j])
            np.add.at(links, j, m[i])
            while len(i):  # hooks roots and halves paths until all found links are within trees
                x, y = root[i], root[j]
                least = np.minimum(x, y)
                np.minimum.at(root, x, least)
                np.minimum.at(root, y, least)
                while not np.array_equal(root, root[root]):
                    root = root[root]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
        out = np.flatnonzero((links > 0) | (root != np.arange(len(row))))
        return pa.table({"row": row[out], "links": links[out], "a": ids[out], "b": ids[root[out]]})

    found = asked.unionByName(stored).groupBy("dim", "cell", "ask_block", "block").applyInArrow(verify, "row long, links long, a long, b long")
    found = stage(found, "links")
    links = placed.select("row", "dim", "k1", "k2", "m", F.col("id").alias("rep")).join(found.groupBy("row").agg(F.sum("links").alias("links")), "row", "left")
    links = links.select("dim", "k1", "k2", "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    of_row = stage(rows.select("id", "dim", "k1", "k2").join(links, ["dim", "k1", "k2"]).select("id", "rep", "n_links"), "rows")
    # A class's smallest id stands for it; an id of several rows connects their classes.
    several = of_row.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("id")
    bridges = of_row.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = components(found.select("a", "b").unionAll(bridges)).select(F.col("node").alias("rep"), "root")
    forget(found, placed)
    of_id = of_row.join(roots, "rep", "left").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min(F.least(F.coalesce("root", "rep"), "id")).alias("root"))
    kind = dict(vectors.dtypes)["own"]
    out = vectors.select("own", F.col("own").cast("long").alias("id")).join(of_id, "id", "left")
    component = F.coalesce("root", "id").cast(kind)
    return out.select(F.col("own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("own") == component, F.lit(True)).alias("kept"))

"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (two columns of one orderable type); root: the smallest node reachable.

    Nulls and loops are left out, so a node with only those is not in the result. Every round is
    written to the shared folder. Rounds go on until an edge table repeats itself, which it does after some
    log^2 of the nodes, as each round lowers an edge's end or leaves all as they are; hot nodes are joined by
    AQE's split of skewed joins, and minima are taken before shuffling.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct()
    now, print_ = stage(edges, "edges"), None
    while True:
        after = stage(_small_star(_large_star(now)), "edges")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if tuple(row) == print_:
            break
        print_ = tuple(row)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._staged = now._staged
    return out

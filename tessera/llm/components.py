"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum (partially aggregated before its shuffle, so that a hub with a third of all edges is one
row per task) and an equi-join on the node, in which hubs are split. The number of edges never grows beyond the input's;
each step's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL_ROWS, materialize, release, split_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return split_join(both, least, ["a"], "n", 2 * n, F.col("b"), SMALL_ROWS).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = split_join(down, least, ["a"], "n", n, F.col("b"), SMALL_ROWS).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any ordered type, nulls and loops ignored -> (node, component), component = the smallest node
    reachable. Nodes without an edge to another node don't appear. An empty input gives an empty table."""
    edges = materialize(edges.select("a", "b").where("a is not null and b is not null and a != b").distinct(), "edges")
    before = (edges.count(), None, None)
    while before[0]:
        starred = materialize(_large_star(edges, before[0]), "stars")
        release(edges)
        edges = materialize(_small_star(starred, before[0]), "edges")
        release(starred)
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

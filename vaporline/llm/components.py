"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporline.llm.common import join_counted, settle

#: Up to so many nodes of two longs are broadcast, more are joined by shuffle.
BROADCAST_NODES = 500_000
#: Edges that a task reads.
EDGES_A_TASK = 50_000


def in_tasks(edges: DataFrame, rows: int) -> DataFrame:
    """Edges, read by as many tasks as their number asks for, without a shuffle. What
    one task reads is grouped by that task: a round of few edges is a few tasks, not
    as many for each shuffle as there are partitions, all of which the driver keeps."""
    return edges.coalesce(rows // EDGES_A_TASK + 1)


def with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """The edges with m of their node a; least has a row a node, n of the total edges."""
    if total <= BROADCAST_NODES:  # there are no more nodes than edges
        return edges.join(F.broadcast(least.select("a", "m")), "a")
    return join_counted(edges, least, "a", "n", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long and unequal; root is
    the smallest node of the component, which itself is left out. The result is settled.
    A null is no node: an edge with one links nothing.

    A large star hangs each larger neighbour of a node on the smallest of all its
    neighbours, a small star each smaller one. Edges stay as many or become fewer
    and the paths to the root halve, so some log2 of the longest path rounds do. They
    end when every node with a smaller neighbour has that neighbour alone, which the
    large star's counts tell before it is made.
    Each round is settled in the shared folder; a hub's edges are spread over all
    tasks. The edges never come to the driver, which sees counts.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = edges.count()
    edges = in_tasks(edges, rows)
    while rows:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = in_tasks(settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") < F.col("a")).alias("smaller"))), 2 * rows)
        if least.where("smaller > 0 AND n > 1").isEmpty():
            break
        large = with_least(both, least, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = in_tasks(settle(large.distinct()), 2 * rows)
        rows = large.count()
        least = in_tasks(settle(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))), rows)
        hung = with_least(large, least, rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(in_tasks(hung.unionByName(least.select("a", F.col("m").alias("b"))), 2 * rows).distinct())
        edges, rows = in_tasks(edges, 2 * rows), edges.count()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

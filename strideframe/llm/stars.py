"""Connected components by alternating large-star and small-star steps.

Large-star hangs the larger neighbours of every node below the smallest one it
knows, small-star hangs a node and its smaller neighbours below the smallest of
these. Both keep the components; when a round of the two changes nothing, each
component is a star around its smallest node.

The centre of a large star has many edges. Nodes with more than a thousandth
of all edges, a thousand nodes at most, are joined by broadcast, so that no
task gets all edges of one node.

Nodes may be of any type with an order; null nodes are left out, and an empty
table of edges gives no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import settle

#: Keys with more than this part of the rows, 1 / PART of them at most, and with more rows than LEAST are hot.
PART, LEAST = 1000, 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, one row for each ``key`` with the number of ``rows`` that have it.

    ``total`` is the number of rows. Hot keys, ``PART`` at most, go by broadcast,
    the others by a merge join at every size: the table grows with the rows.
    """
    most = max(LEAST, total // PART)
    if total <= most:
        return rows.join(table.drop(count).hint("merge"), key)
    hot = F.broadcast(table.where(F.col(count) > most))
    usual = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= most).drop(count).hint("merge"), key)
    return usual.unionByName(rows.join(hot.drop(count), key))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v), v below u: each node's larger neighbours below the smallest of it and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("low"), F.count(F.lit(1)).alias("n"))
    return spread_join(both.where("v > u"), low, "u", "n", total).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v), v below u: each node and its smaller neighbours below the smallest of these."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
    hung = spread_join(edges, low, "u", "n", total).select("v", "low").union(low.select("u", "low"))
    return hung.toDF("u", "v").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v) between different nodes; component is its smallest node."""
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while True:
        edges = settle(small_star(large_star(edges, state[0]), state[0]))
        if state == (state := _state(edges)):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())

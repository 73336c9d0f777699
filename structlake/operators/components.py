"""Connected components of any graph, by alternating star contractions.

Each round replaces edges so that nodes hang from smaller ones: first every
node's larger neighbours move to its smallest neighbour, then its smaller ones
do.  The edges end as stars around the smallest node of each component, after
O(log^2) rounds, and the loop runs until they no longer change: there is no
bound on rounds or on a component's size.  A node's neighbours are never
gathered; only their minimum is, which combines before the shuffle.

Each shuffle leaves some files a task, so a round over few edges runs in few
tasks, whatever the number of shuffle partitions: one for every ``EDGES`` edges,
and no fewer than the session runs at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from ..session import checkpoint

#: Edges of a task, where the session has more tasks than it runs at a time.
EDGES = 20_000


def _from_smallest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with ``low``, the smallest of u and its v."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return edges.join(lowest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _from_smallest(both).where(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _from_smallest(down)
    return moved.select(F.explode(F.array(
        F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))
    )).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v"))


def _mark(edges: DataFrame) -> Row:
    """Count and sum of hashes: equal for equal edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) of every node but the roots.

    ``edges`` has two columns of one orderable type, in any direction and with
    repeats; rows with a null or with equal ends are ignored.
    """
    first, second = edges.columns
    now = checkpoint(edges.select(F.col(first).alias("u"), F.col(second).alias("v"))
                     .where(F.col("u") != F.col("v")).distinct())
    sign = _mark(now)
    while True:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-sign[0] // EDGES))
        large = _large_star(now.coalesce(tasks)).coalesce(tasks).distinct().coalesce(tasks)
        now = checkpoint(_small_star(large).coalesce(tasks).distinct().coalesce(tasks))
        mark = _mark(now)
        if mark == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = mark

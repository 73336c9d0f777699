"""Linked points: cells by boxes, halves of crowded ones, and an existence test."""

import math
import random

import pytest
from pyspark.sql import functions as F

from structlake.operators import graph


def by_hand(points, link):
    sizes = {}
    for s in {p[0] for p in points}:
        own = [p[1:] for p in points if p[0] == s]
        root = list(range(len(own)))
        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i in range(len(own)):
            for j in range(i):
                if math.sqrt(sum((a - b) * (a - b) for a, b in zip(own[i], own[j]))) <= link:
                    root[find(i)] = find(j)
        count = {}
        for i in range(len(own)):
            count[find(i)] = count.get(find(i), 0) + 1
        sizes[s] = max(n if n > 1 else 0 for n in count.values())
    return sizes


@pytest.mark.parametrize("spread,n", [(40, 60), (90, 80), (15, 50)])
def test_components_equal_brute_force(spark, spread, n):
    pick = random.Random(spread)
    points = [(s, *(round(pick.uniform(-spread, spread), 1) for _ in range(3))) for s in range(6) for _ in range(n)]
    points += [(0, 500.0, 500.0, 500.0), (7, 1.0, 1.0, 1.0), (8, 0.0, 0.0, 0.0), (8, 10.0, 0.0, 0.0), (9, 0.0, 0.0, 0.0), (9, 10.0000001, 0.0, 0.0),
               (10, 3.0, 3.0, 3.0), (10, 3.0, 3.0, 3.0)]
    frame = spark.createDataFrame(points, "structure_id int, cx double, cy double, cz double")
    found = {r.structure_id: r.largest_component for r in graph.largest_component(frame).collect()}
    assert found == by_hand(points, 10.0)


@pytest.mark.parametrize("gap,linked", [(0.0, True), (1e-4, False)])
def test_crowded_cells_are_halved(spark, gap, linked):
    # Two sheets of points that face each other across one link, and one pair of them at most within it.
    edge, link = 10 / math.sqrt(3) * 0.9999, 10.0
    pick = random.Random(3)
    # The sheets lie in the cells 0 and 2 of x, just over a link apart but for one pair.
    sheet = [(0.0 + edge * 0.26, pick.uniform(0, edge * 0.99), pick.uniform(0, edge * 0.99)) for _ in range(400)]
    near = sheet[7]
    other = [(near[0] + link + 1e-3, y, z) for _, y, z in sheet[8:]] + [(near[0] + link + gap, near[1], near[2])]
    points = spark.createDataFrame([(1, *p) for p in sheet + other], "structure_id int, x double, y double, z double")
    got = graph.linked_cells(points, link, edge, crowd=8).collect()
    assert bool(got) == linked and len(got) <= 1


def test_many_points_of_a_cell_pair_leave_few_rows(spark):
    points = spark.range(20_000).select(F.lit(1).alias("structure_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 250).alias("x"),
                                        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 250).alias("y"), F.lit(0.0).alias("z"))
    both = points.union(points.withColumn("x", F.col("x") + 7.0))
    assert graph.largest_component(both.toDF("structure_id", "cx", "cy", "cz")).collect() == [(1, 40_000)]

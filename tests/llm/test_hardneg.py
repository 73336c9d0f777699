"""Hard negatives against brute force over all pairs of an anchor and a row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlake.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=50):
    sound = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        sound[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    out = []
    for anchor in sound:
        if anchor[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], r[1], r) for r in sound if r != anchor)
        for p in [r for r in scored if r[2] == anchor[1]][:5]:
            inside = [r for r in scored if r[2] != anchor[1] and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]][:3]
            out += [(anchor[0], p[1], k + 1, r[1], -p[0], -r[0]) for k, r in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = hardneg.integer_rows(frame.select("vec_id", moved.alias("label"), "embedding"))
    return sorted(tuple(r) for r in hardneg.mine(whole, F.col("vec_id") % 50 == 0, **sizes).collect())


def random_rows(n, dims, seed, clusters=12):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        v = [c + pick.gauss(0, 0.5) for c in pick.choice(centres)]
        size = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / size for x in v], pick.randrange(4)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 100, "part": 3}, {"block": 7, "part": 1}])
def test_equal_to_brute_force(spark, sizes):
    rows = random_rows(400, 8, 3)
    expected = brute(rows)
    assert len(expected) > 60
    assert mined(spark, rows, **sizes) == expected


def test_odd_rows(spark):
    rows = random_rows(120, 4, 5) + [
        (None, [1.0, 0.0, 0.0, 0.0], 1), (200, None, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [float("nan"), 0.0, 0.0, 0.0], 1),
        (350, [float("inf"), 0.0, 0.0, 0.0], 1), (400, [1.0, 0.0, 0.0, 0.0], None), (450, [], 1), (500, [0.0] * 4, 2),
        (550, [0.5, 0.5], 3), (600, [-1.0, -1.0, 0.5, 0.5], 77), (-50, [0.3, 0.3, 0.3, 0.3], 1),
        (650, [1e-9, -1e-9, 0.0, 0.0], 0)] + [(701 + k, [0.6, 0.6, 0.3, 0.3], 1) for k in range(40)] + [(702, [0.6, 0.6, 0.3, 0.3], 1)] * 3
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, block=20, part=2) == brute(rows)


def test_report_and_empty_table(spark):
    rows = random_rows(150, 8, 9)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", score string, mark int")
    out = hardneg.hard_negative_report(frame)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)
    assert hardneg.hard_negative_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_components_are_held(spark):
    rows = [(50, [3e38, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.1], 2)]
    held = 1 << 28
    assert mined(spark, rows) == [(50, 1, 1, 2, 256 * held + 256 ** 2, 179 * held + 256 * 25)]


def test_reading_stops_before_the_lists_end():
    pick = np.random.default_rng(0)
    vectors = pick.integers(-20, 20, (5000, 6))
    vectors[:10] += 300
    block = hardneg.Block(np.arange(5000), vectors)
    anchor = np.full(6, 100)
    read = [len(places) for places, _, _ in block.accesses(anchor)]
    assert sum(read) == 5000
    seen = []
    original = block.accesses
    block.accesses = lambda a: (seen.append(len(x[0])) or x for x in original(a))
    ids, scores = hardneg.search(block, anchor, np.ones(5000, bool), [(-np.inf, np.inf)], 5)[0]
    assert sum(seen) < 1000
    assert scores.tolist() == sorted((vectors @ anchor).tolist())[:-6:-1]


def test_ties_at_the_threshold_go_to_the_smaller_id():
    vectors = np.ones((600, 3), np.int64)
    block = hardneg.Block(np.arange(600)[::-1].copy(), vectors)
    ids, _ = hardneg.search(block, np.ones(3, np.int64), np.ones(600, bool), [(-np.inf, np.inf)], 5)[0]
    assert ids.tolist() == [0, 1, 2, 3, 4]

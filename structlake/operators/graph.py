"""Connected components of points linked by a distance threshold."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import cell_index, pack_cell, squared_distance
from ..session import checkpoint
from .components import connected_components
from .scanner import RESIDUE_NAMES
from .spatial import steady_mean

#: Cells of a pair are halved while one of them holds more points than this, at most so many times.
CROWD, HALVINGS = 64, 10
_SLACK = 1e-9


def tryptophan_nodes(atoms: DataFrame, proximal: DataFrame) -> DataFrame:
    """Centroids of the proximal tryptophans, one row per residue."""
    centroids = atoms.where(F.col("resn") == "TRP").groupBy(*RESIDUE_NAMES).agg(
        *(steady_mean(a).alias(f"c{a}") for a in "xyz"))
    return centroids.join(
        proximal.where(F.col("resn") == "TRP"), RESIDUE_NAMES, "left_semi"
    ).select("structure_id", F.concat_ws(":", "chain", "resi").alias("node"),
             "cx", "cy", "cz")


def _boxed(points: DataFrame, edge: float, *more: str) -> DataFrame:
    """Occupied cells with their number of points and the points' bounding box."""
    indices = {f"i{a}": cell_index(F.col(a), edge) for a in "xyz"}
    return points.withColumns(indices).withColumn("cell", pack_cell(*(F.col(i) for i in indices))).groupBy(
        "structure_id", *more, "cell").agg(
        F.count("*").alias("n"), *(F.first(i).alias(i) for i in indices),
        *(F.min(a).alias(f"lo_{a}") for a in "xyz"), *(F.max(a).alias(f"hi_{a}") for a in "xyz"))


def _side(cells: DataFrame, tag: str, *keys: str) -> DataFrame:
    kept = ["cell", "n", *(f"{end}_{a}" for end in ("lo", "hi") for a in "xyz")]
    return cells.select(*keys, *(F.col(c).alias(f"{c}_{tag}") for c in kept))


def _box_distances() -> tuple[Column, Column]:
    """Squares of the least and the largest distance that points of two boxes can have."""
    def spans(a):
        return F.col(f"lo_{a}_b") - F.col(f"hi_{a}_a"), F.col(f"hi_{a}_b") - F.col(f"lo_{a}_a")

    near, far = F.lit(0.0), F.lit(0.0)
    for a in "xyz":
        ahead, across = spans(a)
        behind = -across
        gap = F.greatest(ahead, behind, F.lit(0.0))
        reach = F.greatest(F.abs(across), F.abs(ahead))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def _sorted_out(pairs: DataFrame, link: float) -> DataFrame:
    """Pairs of boxes that can hold a linked pair; ``sure`` where all their points are linked."""
    near, far = _box_distances()
    square = link * link
    return pairs.withColumn("sure", far <= square * (1 - _SLACK)).where(near <= square * (1 + _SLACK))


def linked_cells(points: DataFrame, link: float, edge: float, crowd: int = CROWD) -> DataFrame:
    """``structure_id``, ``cell``, ``other``: pairs of grid cells with points within ``link`` of each other.

    Bounding boxes settle most pairs.  Cells of the pairs still open are halved
    while they are crowded, and pairs settled on the way are dropped; then an
    existence test asks for each point of one cell whether the other has one
    near, so no join gives more rows than there are points in open cells.
    """
    places = checkpoint(points.select("structure_id", "x", "y", "z").distinct())
    top = checkpoint(_boxed(places, edge))
    reach = math.ceil(link / edge)
    ahead = [step for step in product(range(-reach, reach + 1), repeat=3) if step > (0, 0, 0)]
    steps = F.explode(F.array(*(F.struct(*(F.lit(s).cast("bigint").alias(n) for s, n in zip(step, "xyz"))) for step in ahead)))
    looking = _side(top.withColumn("_step", steps).withColumn("goal", pack_cell(
        *(F.col(f"i{a}") + F.col(f"_step.{a}") for a in "xyz"))), "a", "structure_id", "goal")
    there = _side(top, "b", "structure_id").withColumn("goal", F.col("cell_b"))
    pairs = _sorted_out(looking.join(there, ["structure_id", "goal"]), link)
    found = checkpoint(pairs.select("structure_id", F.col("cell_a").alias("cell"), F.col("cell_b").alias("other"), "cell_a", "cell_b",
                                    "n_a", "n_b", "sure"))
    tops = ["structure_id", "cell", "other"]
    sure = found.where("sure").select(*tops)
    still = found.where(~F.col("sure"))
    level = 0
    while level < HALVINGS and still.where(F.greatest("n_a", "n_b") > crowd).take(1):
        level += 1
        # Only points of cells in open pairs are boxed again.
        upper, lower = edge / 2 ** (level - 1), edge / 2 ** level
        held = still.select("structure_id", F.explode(F.array("cell_a", "cell_b")).alias("up")).distinct()
        inner = places.withColumn("up", pack_cell(*(cell_index(F.col(a), upper) for a in "xyz"))).join(held, ["structure_id", "up"], "left_semi")
        cells = checkpoint(_boxed(inner, lower, "up"))
        open_pairs = still.select(*tops, F.col("cell_a").alias("up_a"), F.col("cell_b").alias("up_b"))
        halves = open_pairs.join(_side(cells.withColumn("up_a", F.col("up")), "a", "structure_id", "up_a"), ["structure_id", "up_a"]).join(
            _side(cells.withColumn("up_b", F.col("up")), "b", "structure_id", "up_b"), ["structure_id", "up_b"])
        finer = checkpoint(_sorted_out(halves, link).select(*tops, "cell_a", "cell_b", "n_a", "n_b", "sure"))
        newly = checkpoint(finer.where("sure").select(*tops).distinct())
        sure = sure.union(newly)
        still = finer.where(~F.col("sure")).join(newly, tops, "left_anti")
    fine = edge / 2 ** level
    at = places.withColumn("own", pack_cell(*(cell_index(F.col(a), fine) for a in "xyz")))
    asked = still.select(*tops, F.col("cell_a").alias("own"), "cell_b").join(
        at.select("structure_id", "own", *(F.col(a).alias(f"c{a}") for a in "xyz")), ["structure_id", "own"])
    others = at.select(F.col("structure_id").alias("_s"), F.col("own").alias("_cell"), "x", "y", "z")
    near = F.sqrt(squared_distance(("x", "y", "z"), ("cx", "cy", "cz"))) <= link
    met = asked.join(others, (F.col("structure_id") == F.col("_s")) & (F.col("cell_b") == F.col("_cell")) & near, "left_semi")
    return sure.union(met.select(*tops)).distinct()


def largest_component(nodes: DataFrame, link: float = 10.0) -> DataFrame:
    """Size of the largest linked group of each structure (0 without a link).

    Points in one grid cell whose diagonal is below ``link`` are linked by
    construction, so the graph is built between *cells*: its size is bounded
    by the volume the points fill, not by their number.
    """
    edge = link / math.sqrt(3.0) * 0.9999
    points = nodes.select("structure_id", *(F.col(f"c{a}").alias(a) for a in "xyz"))
    arcs = linked_cells(points, link, edge)
    # Cells are named by structure and place; components never cross structures.
    def cell(box: str):
        return F.struct("structure_id", F.col(box).alias("cell"))

    roots = connected_components(arcs.select(cell("cell").alias("a"), cell("other").alias("b")))
    sizes = points.groupBy("structure_id", pack_cell(*(cell_index(F.col(a), edge) for a in "xyz")).alias("cell")).agg(
        F.count("*").alias("n")).withColumn("node", cell("cell"))
    labels = sizes.join(roots, "node", "left").select(
        "structure_id", "n", F.coalesce("root", "node").alias("label"))
    groups = labels.groupBy("structure_id", "label").agg(F.sum("n").alias("size"))
    return groups.groupBy("structure_id").agg(
        F.max(F.when(F.col("size") > 1, F.col("size")).otherwise(F.lit(0)))
        .alias("largest_component"))

"""Range joins between points that share a structure.

Both sides are keyed by ``(structure_id, grid cell)``.  A structure of any
size is therefore spread over as many keys as it has cells, and the shuffle
key never degenerates to the structure alone.  Only pairs inside the radius
leave the join.  One crowded cell is split further by adaptive skew-join
handling, which applies because the join is a plain equi-join.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import (
    axis_gap, cell_index, pack_cell, squared_distance,
)

STRUCTURE = ["structure_id"]
POSITION = ["structure_id", "chain", "resi", "icode"]
RESIDUE = POSITION + ["resn"]


def with_cell(points: DataFrame, edge: float) -> DataFrame:
    """Add the packed grid cell of each point."""
    return points.withColumn(
        "cell", pack_cell(*(cell_index(F.col(a), edge) for a in "xyz")))


def with_reachable_cells(centers: DataFrame, radius: float, edge: float,
                         axes=("cx", "cy", "cz")) -> DataFrame:
    """One row per grid cell that a sphere around each centre can touch."""
    reach = math.ceil(radius / edge)
    steps = range(-reach, reach + 1)
    offsets = F.array(*(
        F.struct(*(F.lit(s).cast("bigint").alias(n) for s, n in zip(step, "ijk")))
        for step in product(steps, repeat=3)
    ))
    index = [
        cell_index(F.col(axis), edge) + F.col(f"_step.{n}")
        for axis, n in zip(axes, "ijk")
    ]
    gaps = [axis_gap(F.col(axis), i, edge) for axis, i in zip(axes, index)]
    # The slack keeps a cell whose border is exactly one radius away.
    touched = sum(g * g for g in gaps) <= F.lit(radius * radius + 1e-6)
    return (
        centers.withColumn("_step", F.explode(offsets))
        .where(touched)
        .withColumn("cell", pack_cell(*index))
        .drop("_step")
    )


def pairs_within(centers: DataFrame, points: DataFrame, radius: float,
                 strict: bool = False, edge: float | None = None) -> DataFrame:
    """Join centres ``(structure_id, …, cx, cy, cz)`` to points in the radius.

    The centre side is replicated over the touched cells, so pass the side
    with fewer rows there.  Column names other than ``structure_id`` must
    differ.  Adds ``distance``.
    """
    edge = edge or radius
    left = with_reachable_cells(centers, radius, edge)
    right = with_cell(points, edge)
    squared = squared_distance(("x", "y", "z"), ("cx", "cy", "cz"))
    # The coarse test on the squared distance avoids most square roots; the
    # exact comparison is made on the distance itself.
    joined = (
        left.join(right, ["structure_id", "cell"])
        .where(squared <= F.lit(radius * radius * (1 + 1e-9)))
        .withColumn("distance", F.sqrt(squared))
        .drop("cell")
    )
    inside = F.col("distance") < radius if strict else F.col("distance") <= radius
    return joined.where(inside)


#: Parts a structure's points are cut into where each meets its one centre.
SALTS = 16


def with_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Points joined to the one row of ``centers`` of their structure.

    Points are dealt by structure and a hash of their place, and the centre is
    repeated for each part, so a structure that holds a third of all points is
    not gathered in one task, and what is grouped by structure afterwards
    combines per part first.
    """
    salt = F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return points.withColumn("_part", salt).join(
        centers.withColumn("_part", parts), ["structure_id", "_part"]).drop("_part")


def residues(atoms: DataFrame, key=RESIDUE) -> DataFrame:
    """Residue table: atom count, centroid, mean B-factor."""
    return atoms.groupBy(*key).agg(
        F.count("*").alias("atom_count"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
        F.avg("b_factor").alias("b_mean"),
        F.min("line_no").alias("first_line"),
    )


def steady_mean(name: str | Column) -> Column:
    """Mean of a coordinate over its decimal digits, the same in whatever order the rows are added.

    A sum of doubles depends on that order in its last bits, and they decide
    whether an atom exactly one radius away is inside.  Values that have no
    decimal form (infinite, NaN) leave the plain mean.
    """
    value = F.col(name) if isinstance(name, str) else name
    digits = value.try_cast("decimal(28,15)")
    return F.when(F.count(digits) == F.count(value), F.sum(digits).cast("double") / F.count(value)).otherwise(
        F.sum(value) / F.count(value))


def burial(atoms: DataFrame, key=POSITION, radius: float = 6.0,
           of: DataFrame | None = None) -> DataFrame:
    """Per residue, how many other residues have an atom near its centroid.

    ``key`` names the residue; every residue gets a row, zero included.  With
    ``of`` only the residues listed there are measured.
    """
    names = [k for k in key if k != "structure_id"]
    measured = atoms if of is None else atoms.join(
        of.select(*key).distinct(), list(key), "left_semi")
    centers = measured.groupBy(*key).agg(*(steady_mean(a).alias(f"c{a}") for a in "xyz")).select(
        "structure_id", place(names).alias("place"), "cx", "cy", "cz")
    others = atoms.select("structure_id", place(names).alias("other"), "x", "y", "z")
    # Cells of two radii: a centre goes to 7 of them on average, not to 21, and
    # what is shuffled is mostly centres here.
    pairs = pairs_within(centers, others, radius, strict=True, edge=2 * radius)
    # Distinct (residue, neighbour) first: it combines before its shuffle, so
    # a residue with many close atoms ships one row.  Residues without any
    # neighbour enter as zero rows of the same aggregation, not by a join.
    near = (
        pairs.where(other_place("place", "other", names))
        .select("structure_id", "place", "other")
        .distinct()
        .select("structure_id", "place", F.lit(1).alias("n"))
    )
    asked = atoms if of is None else of
    listed = asked.select("structure_id", place(names).alias("place")).distinct().withColumn("n", F.lit(0))
    counted = near.unionByName(listed).groupBy("structure_id", "place").agg(F.sum("n").alias("burial"))
    return counted.select(*(F.col(k) if k == "structure_id" else part("place", names.index(k)).cast(atoms.schema[k].dataType).alias(k)
                            for k in key), "burial")


#: Ends a part of a residue's place, stands for a part that is null, and opens the two of these and itself inside a part.
_END, _NULL, _OPEN = "\u0000", "\u0001", "\u0002"
_WRITTEN = ((_OPEN, _OPEN + "2"), (_NULL, _OPEN + "1"), (_END, _OPEN + "0"))


def place(names: list[str]) -> Column:
    """The columns that name a residue in its structure as one string, a third as long in a shuffle as the columns."""
    def written(name):
        text = F.col(name).cast("string")
        for sign, form in _WRITTEN:
            text = F.replace(text, F.lit(sign), F.lit(form))
        return F.coalesce(text, F.lit(_NULL))

    return F.concat_ws(_END, *map(written, names))


def part(column: str, at: int) -> Column:
    """One of the columns that ``place`` was made of, as text."""
    text = F.nullif(F.get(F.split(column, _END), F.lit(at)), F.lit(_NULL))
    for sign, form in reversed(_WRITTEN):
        text = F.replace(text, F.lit(form), F.lit(sign))
    return text


def other_place(one: str, two: str, names: list[str]) -> Column:
    """Whether two places differ; as in SQL, a null part neither differs nor is the same."""
    same = F.lit(True)
    for at in range(len(names)):
        same = same & (part(one, at) == part(two, at))
    null = F.contains(F.col(one), F.lit(_NULL)) | F.contains(F.col(two), F.lit(_NULL))
    return F.when(null, ~same).otherwise(F.col(one) != F.col(two))


def clash_pairs(atoms: DataFrame, targets: DataFrame, near: float = 6.0,
                contact: float = 1.2, floor: float = 1e-3) -> DataFrame:
    """Atom pairs closer than ``contact`` next to a target centre.

    ``targets`` holds ``(structure_id, cx, cy, cz)``.  Each pair appears once,
    the earlier line first, when either atom lies within ``near`` of a target.
    """
    slim = atoms.select("structure_id", "line_no", "x", "y", "z")
    close = (
        pairs_within(targets.select("structure_id", "cx", "cy", "cz"), slim, near)
        .select("structure_id", "line_no", F.col("x").alias("cx"),
                F.col("y").alias("cy"), F.col("z").alias("cz"))
        .distinct()
    )
    partner = slim.withColumnRenamed("line_no", "other_line")
    found = pairs_within(close, partner, contact, strict=True).where(
        (F.col("distance") > floor) & (F.col("line_no") != F.col("other_line")))
    return found.select(
        "structure_id",
        F.least("line_no", "other_line").alias("first_line"),
        F.greatest("line_no", "other_line").alias("second_line"),
        "distance",
    ).distinct()

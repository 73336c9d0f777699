"""Cofactor sites: centre, score, and the representative of a structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.residues import is_cofactor
from ..session import checkpoint
from .spatial import POSITION, RESIDUE, pairs_within, with_center

_NOT_NUMERIC = 10 ** 9


def numeric_resi(column):
    """Residue number for ordering; text that is no number sorts last."""
    return F.coalesce(column.try_cast("int"), F.lit(_NOT_NUMERIC))


def cofactor_sites(atoms: DataFrame, key=RESIDUE) -> DataFrame:
    """One row per cofactor residue; the centre is its last N5, else centroid.

    The N5 position is taken with ``max_by`` on the line number, one per axis,
    so that every aggregation buffer is a primitive and the hash aggregate
    combines on the map side.
    """
    n5_line = F.when(F.upper("atom_name") == "N5", F.col("line_no"))
    grouped = atoms.where(is_cofactor(F.col("resn"))).groupBy(*key).agg(
        F.count("*").alias("n_atoms"),
        *(F.avg(a).alias(f"mean_{a}") for a in "xyz"),
        *(F.max_by(a, n5_line).alias(f"n5_{a}") for a in "xyz"),
    )
    return grouped.select(
        *key, "n_atoms",
        *(F.coalesce(f"n5_{a}", f"mean_{a}").alias(f"c{a}") for a in "xyz"),
        F.when(F.col("n5_x").isNotNull(), "n5").otherwise("centroid")
        .alias("center_kind"),
        *(f"mean_{a}" for a in "xyz"),
    )


def site_residue_pairs(atoms: DataFrame, sites: DataFrame, radius: float,
                       site_key=RESIDUE, residue_key=RESIDUE) -> DataFrame:
    """Minimum distance of each site to each residue it has in the radius.

    Site columns carry the prefix ``site_``.
    """
    names = [k for k in site_key if k != "structure_id"]
    residue_names = [k for k in residue_key if k != "structure_id"]
    centers = sites.select(
        "structure_id", *(F.col(n).alias(f"site_{n}") for n in names),
        "cx", "cy", "cz")
    points = atoms.where(~is_cofactor(F.col("resn"))).select(
        "structure_id", *residue_names, "x", "y", "z")
    return (
        pairs_within(centers, points, radius)
        .groupBy("structure_id", *(f"site_{n}" for n in names), *residue_names)
        .agg(F.min("distance").alias("min_dist"))
    )


def site_scores(pairs: DataFrame, sites: DataFrame, site_key=RESIDUE) -> DataFrame:
    """Residues in reach of each site; sites without any score zero."""
    names = [k for k in site_key if k != "structure_id"]
    counted = pairs.groupBy(
        "structure_id", *(F.col(f"site_{n}").alias(n) for n in names)
    ).agg(F.count("*").alias("score"))
    return sites.join(counted, list(site_key), "left").withColumn(
        "score", F.coalesce("score", F.lit(0)))


def representative_site(scored: DataFrame, site_key=RESIDUE) -> DataFrame:
    """Best site per structure: score, then chain, residue number, names.

    A ``min`` over an ordered struct: unlike a ranking window it keeps one row
    per structure and map task, whatever number of sites a structure has.
    """
    names = [k for k in site_key if k not in ("structure_id", "chain", "resi")]
    order = [
        (-F.col("score")).alias("neg_score"), F.col("chain"),
        numeric_resi(F.col("resi")).alias("resi_num"), F.col("resi"),
        *(F.col(n) for n in names),
        F.col("cx"), F.col("cy"), F.col("cz"), F.col("n_atoms"),
    ]
    best = scored.groupBy("structure_id").agg(F.min(F.struct(*order)).alias("best"))
    return best.select(
        "structure_id", *(F.col(f"best.{n}").alias(n) for n in site_key
                          if n != "structure_id"),
        (-F.col("best.neg_score")).alias("score"),
        "best.cx", "best.cy", "best.cz", "best.n_atoms")


def pick_site(atoms: DataFrame, radius: float, site_key=RESIDUE) -> DataFrame:
    """Representative site of each structure."""
    sites = cofactor_sites(atoms, site_key)
    pairs = site_residue_pairs(atoms, sites, radius, site_key, site_key)
    return representative_site(site_scores(pairs, sites, site_key), site_key)


def pick_with_neighbours(atoms: DataFrame, radius: float, site_key=RESIDUE):
    """Representative sites and, for each, its residues in the radius.

    The pairs decide the pick and are then filtered by it.  They are a few per
    cent of the atoms, and filters inferred on one of the two uses keep the
    planner from sharing the range join, so they are cut by a checkpoint.
    """
    return picks_with_neighbours(atoms, [radius], site_key)[radius]


def picks_with_neighbours(atoms: DataFrame, radii: list[float], site_key=RESIDUE) -> dict:
    """:func:`pick_with_neighbours` at several radii from one range join at the widest."""
    sites = cofactor_sites(atoms, site_key)
    pairs = checkpoint(site_residue_pairs(atoms, sites, max(radii), site_key, site_key))
    out = {}
    for radius in radii:
        inside = pairs if radius == max(radii) else pairs.where(F.col("min_dist") <= radius)
        picked = representative_site(site_scores(inside, sites, site_key), site_key)
        out[radius] = picked, chosen_pairs(picked, inside, site_key)
    return out


def chosen_pairs(picked: DataFrame, pairs: DataFrame, site_key=RESIDUE) -> DataFrame:
    """The rows of ``pairs`` that belong to the representative sites."""
    names = [k for k in site_key if k != "structure_id"]
    wanted = picked.select(
        "structure_id", *(F.col(n).alias(f"site_{n}") for n in names))
    return pairs.join(
        wanted, ["structure_id", *(f"site_{n}" for n in names)], "left_semi")


def residue_distances(atoms: DataFrame, picked: DataFrame,
                      key=RESIDUE) -> DataFrame:
    """Distance from the representative centre to every residue of it.

    Linear in the atoms: a structure has one representative.
    """
    centers = picked.select("structure_id", "cx", "cy", "cz")
    squared = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}"))
                  for a in "xyz")
    return (
        with_center(atoms.where(~is_cofactor(F.col("resn"))), centers)
        .groupBy(*key).agg(F.sqrt(F.min(squared)).alias("min_dist"))
    )


def nearest_residues(atoms: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """The ``k`` residues nearest to one centre per structure.

    The rank filter is applied before the shuffle too (window group limit).
    """
    ranked = Window.partitionBy("structure_id").orderBy(
        "min_dist", "chain", numeric_resi(F.col("resi")), "resi", "icode")
    return (
        residue_distances(atoms, centers, POSITION)
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= k).drop("_rank")
    )


def shell_residues(atoms: DataFrame, radius: float, fallback: int = 24) -> DataFrame:
    """Residues of the recommender shell around the representative site.

    Where a structure has none in the radius, its ``fallback`` nearest ones.
    """
    picked, near = pick_with_neighbours(atoms, radius, POSITION)
    inside = near.select(*POSITION, "min_dist")
    empty = picked.where(F.col("score") == 0)
    return inside.withColumn("fallback", F.lit(False)).unionByName(
        nearest_residues(atoms, empty, fallback).withColumn("fallback", F.lit(True)))

"""Environment features of the representative cofactor site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import residues as R
from .sites import pick_with_neighbours
from .spatial import RESIDUE


def environment_features(atoms: DataFrame, radius: float = 6.0,
                         water_as_histidine: bool = True) -> DataFrame:
    """Isoelectric, hydrogen-bond and flexibility features per structure.

    Every structure of ``atoms`` gets a row; without a cofactor site the
    features are zero and ``flavin_found`` is false.  Water is counted under
    the first letter of its name unless ``water_as_histidine`` is off.
    """
    if not water_as_histidine:
        atoms = atoms.where(F.col("resn") != "HOH")
    picked, near = pick_with_neighbours(atoms, radius)
    # Mean B-factor over all atoms of a residue, not only those in reach; of the residues that are in reach.
    b_means = atoms.join(near.select(*RESIDUE).distinct(), RESIDUE, "left_semi").groupBy(*RESIDUE).agg(
        F.avg("b_factor").alias("b_mean"))
    aa = R.aa_code(F.col("resn"))
    sums = near.join(b_means, RESIDUE).groupBy("structure_id").agg(
        F.count("*").alias("n"),
        F.sum(R.isoelectric_point(aa)).alias("pi_sum"),
        F.sum(R.is_hbond_capable(aa).cast("double")).alias("hb_count"),
        F.avg(R.steric_index(aa, 0.7)).alias("steric_mean"),
        F.avg("b_mean").alias("b_mean"),
    )
    flex = (F.lit(0.6) + 0.4 * F.col("steric_mean")
            + 0.006 * F.least(F.col("b_mean"), F.lit(60.0)))
    features = sums.select(
        "structure_id",
        (F.col("pi_sum") / F.greatest(F.lit(1.5), F.col("n") / 2.5)).alias("iso"),
        F.least(F.lit(5.0), F.col("hb_count") / 2.0).alias("hb_cap"),
        F.greatest(F.lit(1.05), F.least(F.lit(1.60), flex)).alias("flex"),
    )
    found = picked.select("structure_id", F.lit(True).alias("flavin_found"))
    return (
        atoms.select("structure_id").distinct()
        .join(found, "structure_id", "left")
        .join(features, "structure_id", "left")
        .na.fill(0.0, ["iso", "hb_cap", "flex"])
        .na.fill(False, ["flavin_found"])
    )


def local_field(atoms: DataFrame, radius: float = 5.0) -> DataFrame:
    """Sums of electronegativity and steric index near the site."""
    _, near = pick_with_neighbours(atoms, radius)
    aa = R.aa_code(F.col("resn"))
    sums = near.groupBy("structure_id").agg(
        F.sum(R.electronegativity(aa)).alias("lfp"),
        F.sum(R.steric_index(aa)).alias("steric"),
    )
    return (
        atoms.select("structure_id").distinct()
        .join(sums, "structure_id", "left")
        .na.fill(0.0, ["lfp", "steric"])
    )

"""Pocket audit: what surrounds the bound cofactor of each structure.

Unlike the site features, the centre here is the mean of all atoms of the
chosen cofactor type in the structure.  One centre per structure makes every
join below linear in the atoms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C, residues as R
from ..session import checkpoint
from .spatial import steady_mean, with_center

RESIDUE_NAMES = ["structure_id", "resn", "chain", "resi"]


def detect_cofactor(atoms: DataFrame) -> DataFrame:
    """Cofactor residue with most atoms; ties by chain, number, insertion."""
    number = F.coalesce(F.col("resi").try_cast("int"), F.lit(0))
    counted = (
        atoms.where(F.col("resn").isin(*C.COFACTOR_TYPE))
        .groupBy("structure_id", "chain", "resi", "icode", "resn")
        .agg(F.count("*").alias("atom_count"))
    )
    best = counted.groupBy("structure_id").agg(F.min(F.struct(
        (-F.col("atom_count")).alias("rank"), "chain", number.alias("num"),
        "icode", "resi", "resn")).alias("b"))
    return best.select(
        "structure_id", R.lookup(C.COFACTOR_TYPE, F.col("b.resn")).alias("cofactor"),
        "b.resn", "b.chain", "b.resi", "b.icode",
        (-F.col("b.rank")).alias("atom_count"))


def cofactor_presence(atoms: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether each requested ``(structure_id, target)`` type is present.

    Present means detected as the main type, or named exactly so anywhere.
    """
    target = F.upper("target")
    wanted = requests.select("structure_id", target.alias("target")).distinct()
    detected = detect_cofactor(atoms).select(
        "structure_id", F.col("cofactor").alias("target"))
    named = atoms.select("structure_id", F.col("resn").alias("target")).join(
        wanted, ["structure_id", "target"], "left_semi").distinct()
    have = detected.unionByName(named).distinct().withColumn("present", F.lit(True))
    return wanted.join(have, ["structure_id", "target"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False)))


def is_adenine() -> Column:
    name = F.upper("atom_name")
    return (F.col("resn").isin(*C.ADENINE_NAMES) | name.startswith("N9A")
            | name.startswith("C5A"))


def pocket_frame(atoms: DataFrame, forced: str | None = None) -> DataFrame:
    """One row per structure: cofactor choice, centre, anchors, counts.

    A single aggregation of the atoms with primitive buffers only.
    """
    forced = forced.upper() if forced and forced.upper() in C.SCANNED_COFACTORS else None
    name = F.upper(F.trim("atom_name"))
    aggregates = [
        F.sum(R.electrons(F.col("element"))).cast("bigint").alias("electron_count"),
        F.max(is_adenine().cast("int")).alias("has_adenine"),
    ]
    for kind in C.SCANNED_COFACTORS:
        mine = F.col("resn") == kind
        aggregates.append(F.count_if(mine).alias(f"{kind}_atoms"))
        for a in "xyz":
            aggregates.append(steady_mean(F.when(mine, F.col(a))).alias(f"{kind}_c{a}"))
            for anchor in ("n5", "o4"):
                named = mine & name.isin(anchor.upper(), anchor.upper() + "A")
                aggregates.append(
                    F.max_by(a, F.when(named, F.col("line_no")))
                    .alias(f"{kind}_{anchor}_{a}"))
    grouped = atoms.groupBy("structure_id").agg(*aggregates)
    detected = detect_cofactor(atoms).select(
        "structure_id", F.col("cofactor").alias("main"),
        F.col("resn").alias("cofactor_resn"), F.col("chain").alias("cofactor_chain"),
        F.col("resi").alias("cofactor_resi"))
    frame = grouped.join(detected, "structure_id", "left")
    frame = frame.withColumn(
        "detected", F.when(F.col("main").isNotNull() & (F.col("has_adenine") == 1), "FAD")
        .otherwise(F.col("main")))
    frame = frame.withColumn("target", F.coalesce(F.lit(forced), "detected"))
    held = F.when(F.col("target") == "FMN", F.col("FMN_atoms")).otherwise(
        F.when(F.col("target") == "FAD", F.col("FAD_atoms")))
    frame = frame.withColumn(
        "center_type",
        F.when(held > 0, F.col("target")).when(F.col("FAD_atoms") > 0, "FAD")
        .when(F.col("FMN_atoms") > 0, "FMN"))

    def of_type(type_column, suffix):
        return F.when(F.col(type_column) == "FMN", F.col(f"FMN_{suffix}")).when(
            F.col(type_column) == "FAD", F.col(f"FAD_{suffix}"))

    return frame.select(
        "structure_id", "detected", "target", "center_type",
        "cofactor_resn", "cofactor_chain", "cofactor_resi",
        F.col("FMN_atoms").alias("fmn_atoms"), F.col("FAD_atoms").alias("fad_atoms"),
        "electron_count",
        *(of_type("center_type", f"c{a}").alias(f"c{a}") for a in "xyz"),
        *(of_type("target", f"{n}_{a}").alias(f"{n}_{a}")
          for n in ("n5", "o4") for a in "xyz"),
    )


def cofactor_atom_counts(frame: DataFrame) -> DataFrame:
    """Atom count per cofactor type as a map."""
    entries = F.create_map(
        F.lit("FMN"), F.col("fmn_atoms"), F.lit("FAD"), F.col("fad_atoms"))
    return frame.select("structure_id", entries.alias("cofactor_atom_counts"))


def _to(prefix: str) -> Column:
    parts = [F.col(a) - F.col(f"{prefix}{a}") for a in "xyz"]
    return F.sqrt(sum(p * p for p in parts))


def pocket_distances(atoms: DataFrame, frame: DataFrame) -> DataFrame:
    """Every non-cofactor atom with its distance to centre and anchors."""
    center = frame.where(F.col("center_type").isNotNull()).select(
        "structure_id", "cx", "cy", "cz", "n5_x", "n5_y", "n5_z",
        "o4_x", "o4_y", "o4_z")
    return (
        with_center(atoms.where(~F.col("resn").isin(*C.SCANNED_COFACTORS)), center)
        .select("structure_id", "line_no", "atom_name", "resn", "chain", "resi",
                "x", "y", "z", _to("c").alias("dist"),
                _to("n5_").alias("dist_n5"), _to("o4_").alias("dist_o4"))
    )


def audit_pockets(atoms: DataFrame, forced: str | None = None):
    """Pocket frame and distances for callers that use them more than once.

    The frame is one row per structure behind an aggregation of all atoms, so
    it is checkpointed rather than computed again for every use.
    """
    frame = checkpoint(pocket_frame(atoms, forced))
    return frame, pocket_distances(atoms, frame)


def adenine_distance(atoms: DataFrame, frame: DataFrame) -> DataFrame:
    center = frame.where(F.col("center_type").isNotNull()).select(
        "structure_id", "cx", "cy", "cz")
    return (
        with_center(atoms.where(is_adenine()), center)
        .groupBy("structure_id").agg(F.min(_to("c")).alias("adenine_distance"))
    )


def resolve_cofactor(atoms: DataFrame, forced: str | None = None) -> DataFrame:
    """Final cofactor choice; adenine within 15 angstrom means FAD."""
    frame = checkpoint(pocket_frame(atoms, forced))
    joined = frame.join(adenine_distance(atoms, frame), "structure_id", "left")
    linked = F.coalesce(F.col("adenine_distance") <= 15.0, F.lit(False))
    held = F.when(F.lit(forced or "").isin(*C.SCANNED_COFACTORS),
                  F.when(F.lit(forced) == "FMN", F.col("fmn_atoms"))
                  .otherwise(F.col("fad_atoms")) > 0).otherwise(F.lit(True))
    found = F.col("center_type").isNotNull()
    return joined.select(
        "structure_id",
        F.when(linked, "FAD").otherwise(F.col("detected")).alias("detected_cofactor"),
        F.when(linked, "FAD").otherwise(
            F.coalesce("target", F.lit("FMN/FAD"))).alias("flavin_type"),
        F.when(linked, F.coalesce("target", F.lit("FAD"))).otherwise(F.col("target"))
        .alias("cofactor_mode"),
        (held & found).alias("geometry_check_passed"),
        "adenine_distance",
        (linked | F.coalesce(F.col("target").isin(*C.SCANNED_COFACTORS) & found,
                             F.lit(False))).alias("force_open_shell"),
    )


def nearest_neighbour(distances: DataFrame) -> DataFrame:
    """Closest atom of each structure with its residue; earliest line on ties."""
    # Primitive buffers hash: the least distance over all atoms, then a struct over the few at it.
    least = distances.groupBy("structure_id").agg(F.min("dist").alias("_least"))
    best = distances.join(least, "structure_id").where(
        F.col("dist") == F.col("_least")).groupBy("structure_id").agg(F.min(F.struct(
            "dist", "line_no", "resn", "chain", "resi", "atom_name",
            "x", "y", "z")).alias("b"))
    return best.select(
        "structure_id", "b.resn", "b.chain", "b.resi", "b.atom_name",
        F.col("b.dist").alias("distance"), "b.x", "b.y", "b.z",
        R.neighbor_shift(F.col("b.resn"), F.col("b.dist")).alias("energy_shift"),
        R.neighbor_spin(F.col("b.resn"), F.col("b.dist")).alias("spin_boost"))


def proximal_residues(distances: DataFrame, radius: float = 6.0) -> DataFrame:
    """Scanned residue types with an atom in the radius."""
    scanned = distances.where(
        F.col("resn").isin(*C.SCANNED_RESIDUES) & (F.col("dist") <= radius))
    best = scanned.groupBy(*RESIDUE_NAMES).agg(
        F.min(F.struct("dist", "line_no", "atom_name")).alias("b"))
    return best.select(*RESIDUE_NAMES, F.col("b.dist").alias("distance"),
                       F.col("b.atom_name").alias("atom_name"))


def proximal_counts(proximal: DataFrame) -> DataFrame:
    """Residues per scanned name and the share of TYR and GLN."""
    return proximal.groupBy("structure_id").agg(
        F.count("*").alias("n_proximal"),
        *(F.count_if(F.col("resn") == name).alias(f"n_{name.lower()}")
          for name in C.SCANNED_RESIDUES),
        F.avg(F.col("resn").isin("TYR", "GLN").cast("double")).alias("bluf_fraction"),
    )


def esp_samples(distances: DataFrame, radius: float = 8.0) -> DataFrame:
    """Inverse distances of atoms near the N5 and O4 anchors."""
    anchors = F.explode(F.array(
        F.struct(F.lit("N5").alias("anchor"), F.col("dist_n5").alias("d")),
        F.struct(F.lit("O4").alias("anchor"), F.col("dist_o4").alias("d"))))
    near = (F.col("dist_n5") <= radius) | (F.col("dist_o4") <= radius)
    return (
        distances.where(near).select("structure_id", "line_no", anchors.alias("s"))
        .where(F.col("s.d") <= radius)
        .select("structure_id", "line_no", "s.anchor",
                (1.0 / (F.col("s.d") + F.lit(1e-3))).alias("sample"))
    )


def esp_moments(frame: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean, variance and third central moment; zero where there is no sample.

    The third moment is recovered from ``skewness``, which merges centred
    moments: one pass, no join of the mean back to the samples.
    """
    moments = samples.groupBy("structure_id").agg(
        F.avg("sample").alias("esp_moment1"),
        F.var_pop("sample").alias("esp_moment2"),
        F.skewness("sample").alias("skew"))
    third = F.when(F.col("esp_moment2") > 0,
                   F.col("skew") * F.pow(F.col("esp_moment2"), F.lit(1.5)))
    return (
        frame.select("structure_id").join(moments, "structure_id", "left")
        .withColumn("esp_moment3", third).drop("skew")
        .na.fill(0.0, ["esp_moment1", "esp_moment2", "esp_moment3"])
    )


def shell_charge(nearest: DataFrame, proximal: DataFrame) -> DataFrame:
    """Summed energy shifts of the proximal residues and the closest one."""
    shell = proximal.groupBy("structure_id").agg(F.sum(
        R.neighbor_shift(F.col("resn"), F.col("distance"))).alias("shell"))
    return nearest.join(shell, "structure_id", "left").select(
        "structure_id",
        (F.coalesce("shell", F.lit(0.0)) + F.col("energy_shift"))
        .alias("shell_charge_sum"))


def gate_radius(distances: DataFrame, minimum: float = 12.0) -> DataFrame:
    """Reach to the residue farthest from the N5 anchor, at least ``minimum``."""
    per_residue = distances.groupBy(*RESIDUE_NAMES).agg(
        F.min("dist_n5").alias("d"))
    return per_residue.groupBy("structure_id").agg(
        F.greatest(F.lit(minimum), F.max("d")).alias("gate_radius"))


def environment_label(forced: Column, resn: Column, distance: Column,
                      trp_component: Column, bluf: Column) -> Column:
    lov = (resn == "CYS") & (distance <= 6.0)
    return (
        F.when(forced, "Radical Pair (Cryptochrome)")
        .when(lov, "LOV-Domain Thioadduct")
        .when(trp_component >= 3, "Cryptochrome-PET")
        .when(bluf, "BLUF-Type H-Bonding")
        .otherwise("Non-Canonical Binding Pocket")
    )


def label_structures(nearest: DataFrame, counts: DataFrame,
                     components: DataFrame, forced: Column) -> DataFrame:
    """Environment label, LOV flag and cysteine coupling per structure."""
    joined = (
        nearest.join(counts, "structure_id", "left")
        .join(components, "structure_id", "left")
    )
    resn, distance = F.col("resn"), F.col("distance")
    component = F.coalesce("largest_component", F.lit(0))
    bluf = F.coalesce(F.col("n_tyr") + F.col("n_gln"), F.lit(0)) > 0
    lov = ~forced & (resn == "CYS") & (distance <= 6.0)
    return joined.select(
        "structure_id", "resn", "resi", "atom_name", "distance",
        F.coalesce("n_proximal", F.lit(0)).alias("n_proximal"),
        F.coalesce("bluf_fraction", F.lit(0.0)).alias("bluf_fraction"),
        environment_label(forced, resn, distance, component, bluf)
        .alias("environment_label"),
        lov.alias("lov_domain"),
        F.when(lov, R.proximity(distance)).otherwise(F.lit(0.0))
        .alias("cys_coupling"),
    )

"""Substitution candidates around the cofactor of each structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C, residues as R, scoring
from ..session import checkpoint
from .extremes import extreme_rows
from .mutations import exclude_positions
from .prefix import running
from .sites import (
    cofactor_sites, nearest_residues, numeric_resi, site_residue_pairs,
)
from .spatial import POSITION, burial


def residue_names(atoms: DataFrame) -> DataFrame:
    """Residue name at each position: the one on its first line.

    The first aggregation has primitive buffers and folds the atoms on the map
    side; choosing among names is left to the residue-sized second one.
    """
    named = atoms.groupBy(*POSITION, "resn").agg(F.min("line_no").alias("line"))
    return named.groupBy(*POSITION).agg(F.min_by("resn", "line").alias("resn"))


def shells(atoms: DataFrame, primary: float = C.PRIMARY_RADIUS,
           secondary: float | None = C.SECONDARY_RADIUS) -> DataFrame:
    """Primary shell, then the rest of the secondary shell with its penalty.

    Each radius has its own representative site.  One range join at the wider
    radius serves both: the narrower pairs are a filter of it, and a residue
    that is in both shells is folded by an aggregation, not an anti join.
    """
    outer = max(primary, secondary or primary)
    sites = cofactor_sites(atoms, POSITION)
    # Read twice, for the scores and for the members: see pick_with_neighbours.
    pairs = checkpoint(site_residue_pairs(atoms, sites, outer, POSITION, POSITION))
    site_columns = ["site_chain", "site_resi", "site_icode"]
    reach = {"inner": primary, "outer": outer}
    counted = pairs.groupBy("structure_id", *site_columns).agg(*(
        F.count_if(F.col("min_dist") <= r).alias(f"score_{n}") for n, r in reach.items()))
    scored = sites.join(
        counted.select("structure_id", *score_columns(reach),
                       *(F.col(c).alias(c[5:]) for c in site_columns)), POSITION, "left",
    ).na.fill(0, score_columns(reach))
    # One row per structure with the best site of either radius.
    picks = scored.groupBy("structure_id").agg(*(
        F.min(F.struct(
            (-F.col(f"score_{n}")).alias("rank"), "chain",
            numeric_resi(F.col("resi")).alias("num"), "resi", "icode",
            "cx", "cy", "cz")).alias(n) for n in reach))

    def is_site(name):
        return ((F.col("site_chain") == F.col(f"{name}.chain"))
                & (F.col("site_resi") == F.col(f"{name}.resi"))
                & (F.col("site_icode") == F.col(f"{name}.icode")))

    member = {n: is_site(n) & (F.col("min_dist") <= r) for n, r in reach.items()}
    inside = (
        pairs.join(picks, "structure_id").where(member["inner"] | member["outer"])
        .groupBy(*POSITION)
        .agg(*(F.min(F.when(m, F.col("min_dist"))).alias(f"d_{n}")
               for n, m in member.items())))
    # Structures with no residue in the primary shell take their nearest ones.
    empty = picks.where(F.col("inner.rank") == 0).select(
        "structure_id", "inner.cx", "inner.cy", "inner.cz")
    nearest = nearest_residues(atoms, empty, C.NEAREST_FALLBACK)
    merged = inside.unionByName(nearest.select(
        *POSITION, F.col("min_dist").alias("d_inner"),
        F.lit(None).cast("double").alias("d_outer"))
    ).groupBy(*POSITION).agg(F.min("d_inner").alias("d_inner"),
                             F.min("d_outer").alias("d_outer"))
    first = F.col("d_inner").isNotNull()
    return merged.where(first | F.lit(secondary is not None)).select(
        *POSITION, F.coalesce("d_inner", "d_outer").alias("min_dist"),
        F.when(first, 0.0).otherwise(C.SECOND_SHELL_PENALTY).alias("penalty"))


def score_columns(reach: dict) -> list[str]:
    return [f"score_{name}" for name in reach]


def protect_close_cysteine(sites: DataFrame, closer_than: float = 4.0) -> DataFrame:
    return sites.where(~((F.col("resn") == "CYS") & (F.col("min_dist") < closer_than)))


def candidate_sites(atoms: DataFrame, exclusions: DataFrame | None = None,
                    primary: float = C.PRIMARY_RADIUS,
                    secondary: float | None = C.SECONDARY_RADIUS) -> DataFrame:
    """Positions open to substitution with distance, wild type and burial."""
    sites = shells(atoms, primary, secondary).join(residue_names(atoms), POSITION)
    if exclusions is not None:
        sites = exclude_positions(sites, exclusions)
    # A few dozen rows per structure, read twice below: cut here instead of
    # running the shell joins again.
    sites = checkpoint(protect_close_cysteine(sites))
    # Burial is a range join, so it is computed for the open sites only.
    buried = burial(atoms, of=sites)
    return sites.join(buried, POSITION).withColumn(
        "wt", R.aa_code_modified(F.col("resn")))


def site_substitutions(sites: DataFrame, per_site: int = C.SITE_SUBSTITUTIONS
                       ) -> DataFrame:
    """The best substitutions of each site, chosen inside its row."""
    choices = scoring.best_choices(F.col("wt"), F.col("burial"), per_site)
    score = (F.col("_s.pair_score")
             + scoring.site_term(F.col("min_dist"), F.col("burial")) - F.col("penalty"))
    token = F.concat("chain", F.lit(":"), "wt", "resi", F.trim("icode"), "_s.mut")
    return sites.withColumn("_s", F.explode(choices)).select(
        *POSITION, "wt", "min_dist", "burial", "_s.mut",
        token.alias("token"), score.alias("score"))


def best_per_token(candidates: DataFrame) -> DataFrame:
    """Keep the best-scored occurrence of a token; of equal scores the one with the largest other numbers.

    A token states chain, position and residues, so rows that tie in all numbers are equal.
    """
    candidates = checkpoint(candidates)
    numbers = [c for c, kind in candidates.dtypes if kind in ("double", "bigint", "int") and c not in ("structure_id", "score")]
    return extreme_rows(candidates, ["structure_id", "token"], ["score", *numbers]).distinct()


def rank_candidates(candidates: DataFrame, cap: int | None = None) -> DataFrame:
    """Rank per structure by score, then token; optionally the first ``cap``.

    A cap up to a thousand is applied before the shuffle (window group limit);
    without one the ranges of a large structure are numbered separately.
    """
    order = [F.round("score", 9).desc(), F.col("token")]
    if cap is None:
        return running(candidates, order, ["structure_id"], number="rank")
    ranked = Window.partitionBy("structure_id").orderBy(*order)
    return candidates.withColumn(
        "rank", F.row_number().over(ranked).cast("bigint")).where(F.col("rank") <= cap)


def existing_candidates(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Keep candidates whose position exists with the stated wild type.

    A position whose insertion code is not in the structure is looked up again
    with a blank one.
    """
    aa = R.aa_code_modified(F.col("resn"))
    exact = names.select(*POSITION, aa.alias("_exact"))
    blank = names.where(F.col("icode") == " ").select(*POSITION[:-1], aa.alias("_blank"))
    found = candidates.join(exact, POSITION, "left").join(blank, POSITION[:-1], "left")
    return found.where(F.coalesce("_exact", "_blank") == F.col("wt")).select(*candidates.columns)


def candidate_pool(atoms: DataFrame, exclusions: DataFrame | None = None,
                   primary: float = C.PRIMARY_RADIUS,
                   secondary: float | None = C.SECONDARY_RADIUS,
                   per_site: int = C.SITE_SUBSTITUTIONS) -> DataFrame:
    # The shells do not overlap, so no token occurs twice here.
    return site_substitutions(
        candidate_sites(atoms, exclusions, primary, secondary), per_site)

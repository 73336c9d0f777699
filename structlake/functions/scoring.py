"""Candidate scores and risks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C, residues as R

_OPEN_CHOICES = sorted({*C.HYDROPHOBIC, *C.POLAR, "K", "R"})
_BURIED_CHOICES = sorted({*C.HYDROPHOBIC, "H", "Y"})


def allowed_substitutions(wt: Column, burial: Column) -> Column:
    """Sorted array of substitutions for a wild type at a burial level."""
    choices = F.when(burial > 6, F.array(*map(F.lit, _BURIED_CHOICES))).otherwise(
        F.array(*map(F.lit, _OPEN_CHOICES)))
    return F.array_remove(choices, wt)


def candidate_score(wt: Column, mut: Column, distance: Column,
                    burial: Column) -> Column:
    """Fast score that ranks substitutions before any model is run."""
    shift = R.electronegativity(mut) - R.electronegativity(wt)
    bulk = (R.steric_index(mut, C.DEFAULT_STERIC_INDEX)
            - R.steric_index(wt, C.DEFAULT_STERIC_INDEX))

    def bonus(members, amount):
        return F.when(mut.isin(*members), F.lit(amount)).otherwise(F.lit(0.0))

    near = F.greatest(F.lit(0.0), 1.0 - F.least(distance, F.lit(12.0)) / 12.0)
    return (1.35 * shift + bonus(C.AROMATIC, 0.45) + bonus(C.POLAR, 0.18)
            + bonus(("K", "R"), 0.12) + 0.90 * near - 0.20 * F.abs(bulk)
            - 0.10 * F.greatest(F.lit(0.0), burial - F.lit(8.0)))


def site_term(distance: Column, burial: Column) -> Column:
    """The part of :func:`candidate_score` that all choices of a site share."""
    near = F.greatest(F.lit(0.0), 1.0 - F.least(distance, F.lit(12.0)) / 12.0)
    return 0.90 * near - 0.10 * F.greatest(F.lit(0.0), burial - F.lit(8.0))


def _pair_term(wt: str, mut: str) -> float:
    bulk = (C.STERIC_INDEX.get(mut, C.DEFAULT_STERIC_INDEX)
            - C.STERIC_INDEX.get(wt, C.DEFAULT_STERIC_INDEX))
    shift = C.ELECTRONEGATIVITY.get(mut, 0.0) - C.ELECTRONEGATIVITY.get(wt, 0.0)
    bonus = (0.45 * (mut in C.AROMATIC) + 0.18 * (mut in C.POLAR)
             + 0.12 * (mut in ("K", "R")))
    return 1.35 * shift + bonus - 0.20 * abs(bulk)


def best_choices(wt: Column, burial: Column, count: int) -> Column:
    """The ``count`` best substitutions as an array of ``(mut, pair_score)``.

    Distance and burial move all choices of a site alike, so the order depends
    on the wild type and the choice set alone: two dozen short lists, kept as
    map literals, instead of scoring and sorting fifteen choices per row.
    """
    def ranked(aa, choices):
        scored = sorted((-round(_pair_term(aa, m), 9), m) for m in choices if m != aa)
        return F.array(*(F.struct(F.lit(m).alias("mut"), F.lit(_pair_term(aa, m)).alias("pair_score"))
                         for _s, m in scored[:count]))

    def table(choices):
        known = F.create_map(*(item for aa in C.CANONICAL_AA
                               for item in (F.lit(aa), ranked(aa, choices))))
        return F.coalesce(known[wt], ranked("", choices))

    return F.when(burial > 6, table(_BURIED_CHOICES)).otherwise(table(_OPEN_CHOICES))


def brightness_gain(mut: Column) -> Column:
    return (F.lit(2.0)
            + F.when(mut.isin("K", "R"), 1.0).otherwise(0.0)
            + F.when(mut.isin("F", "Y", "W"), 0.5).otherwise(0.0))


def clash_risk(mut: Column, burial: Column) -> Column:
    return F.greatest(F.lit(0.0), burial - F.lit(6.0)) + F.when(
        mut.isin("W", "Y"), 1.0).otherwise(0.0)


def stability_risk(wt: Column, mut: Column, burial: Column) -> Column:
    charged = (burial > 8) & mut.isin(*C.CHARGED)
    bulky_glycine = (wt == "G") & ~mut.isin(*C.SMALL)
    return (F.when(charged, 2.0).otherwise(0.0)
            + F.when(bulky_glycine, 1.5).otherwise(0.0))


def total_score(delta: Column, clash: Column, stability: Column,
                confidence: Column, synergy: Column | None = None,
                clear_is_bad: bool = True) -> Column:
    """Weighted total.

    The clash term of a computed row is 100 when the pocket is *clear*, and it
    is subtracted all the same; ``clear_is_bad=False`` inverts it.
    """
    clash = clash if clear_is_bad else 100.0 - clash
    total = (delta - C.CLASH_WEIGHT * clash - C.STABILITY_WEIGHT * stability
             + C.CONFIDENCE_WEIGHT * confidence)
    return total if synergy is None else total + C.SYNERGY_WEIGHT * synergy

"""Column expressions over residue names and amino-acid codes.

The tables are at most two dozen entries, so each is a foldable map literal:
a lookup is an expression inside the current stage, never a join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from . import constants as C


def lookup(table: Mapping, key: Column, default=None) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    found = F.create_map(*entries)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def aa_code(resn: Column) -> Column:
    """One-letter code; an unknown name keeps its first letter, empty is X."""
    token = F.upper(F.trim(F.coalesce(resn, F.lit(""))))
    first = F.substring(token, 1, 1)
    return F.coalesce(
        lookup(C.THREE_TO_ONE, token),
        F.when(token == "", F.lit("X")).otherwise(first),
    )


def aa_code_modified(resn: Column) -> Column:
    """Like :func:`aa_code`, with modified residues mapped to their parent."""
    token = F.upper(F.trim(F.coalesce(resn, F.lit(""))))
    return aa_code(F.coalesce(lookup(C.MODIFIED_RESIDUES, token), token))


def electronegativity(aa: Column, default: float | None = 0.0,
                      display: bool = False) -> Column:
    table = C.ELECTRONEGATIVITY_DISPLAY if display else C.ELECTRONEGATIVITY
    return lookup(table, aa, default)


def steric_index(aa: Column, default: float | None = 0.0) -> Column:
    return lookup(C.STERIC_INDEX, aa, default)


def isoelectric_point(aa: Column) -> Column:
    return lookup(C.ISOELECTRIC_POINT, aa, C.DEFAULT_ISOELECTRIC_POINT)


def is_hbond_capable(aa: Column) -> Column:
    return aa.isin(*C.HBOND_CAPABLE)


def is_cofactor(resn: Column) -> Column:
    return resn.isin(*C.COFACTOR_SITE_NAMES)


def electrons(element: Column) -> Column:
    return lookup(C.ELECTRONS, element, 0)


def proximity(distance: Column, reach: float = 6.0) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(reach) - distance) / reach)


def neighbor_shift(resn: Column, distance: Column) -> Column:
    """Softened energy shift caused by the nearest residue."""
    return _influence(C.NEIGHBOR_CHARGE, resn, distance, 0.1)


def neighbor_spin(resn: Column, distance: Column) -> Column:
    """Softened spin boost caused by the nearest residue."""
    return _influence(C.NEIGHBOR_SPIN, resn, distance, 0.2)


def _influence(table, resn: Column, distance: Column, soften: float) -> Column:
    usable = distance.isNotNull() & ~F.isnan(distance) & (distance > 0)
    weight = lookup(table, F.upper(resn), 0.0)
    return F.when(
        usable & resn.isNotNull(), weight * proximity(distance) * soften
    ).otherwise(F.lit(0.0))

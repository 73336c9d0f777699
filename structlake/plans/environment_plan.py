"""End-to-end plan: structure text to labelled environment features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.environment import environment_features, local_field
from ..sources.structure_text import accessions, scan_atoms


def structure_profile(lines: DataFrame, radius: float = 6.0) -> DataFrame:
    """Features, local field and accession of every structure of a line table."""
    atoms = scan_atoms(lines)
    return (
        environment_features(atoms, radius)
        .join(local_field(atoms), "structure_id", "left")
        .join(accessions(lines), "structure_id", "left")
    )

"""Fixed-width structure text as DataFrames.

A line table has ``structure_id``, ``line_no`` (increasing inside a
structure) and ``value``.  All parsing is ``substring`` plus ``try_cast`` and
runs inside the scan stage; malformed rows are dropped row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from .structure_files import read_structure_lines  # noqa: F401  the usual source of a line table


def is_coordinate_record(value: Column) -> Column:
    return value.startswith("ATOM") | value.startswith("HETATM")


def _field(start: int, width: int) -> Column:
    return F.trim(F.substring("value", start, width))


def _or_default(column: Column, default: str) -> Column:
    return F.when(column == "", F.lit(default)).otherwise(column)


def record_fields() -> dict[str, Column]:
    """Every field of a coordinate record by name."""
    atom = _field(13, 4)
    element = F.upper(_field(77, 2))
    return {
        "record": _field(1, 6),
        "serial": _field(7, 5),
        "atom_name": atom,
        "altloc": F.substring("value", 17, 1),
        "resn": F.upper(_field(18, 3)),
        "chain": _or_default(_field(22, 1), "?"),
        "resi": _field(23, 4),
        "icode": _or_default(_field(27, 1), " "),
        "x": _field(31, 8).try_cast("double"),
        "y": _field(39, 8).try_cast("double"),
        "z": _field(47, 8).try_cast("double"),
        "b_factor": F.when(F.length("value") < 66, F.lit(20.0))
        .otherwise(_field(61, 6).try_cast("double")),
        "element": F.when(element != "", element)
        .otherwise(F.upper(F.substring(atom, 1, 1))),
        "tail": F.substring("value", 55, 200),
    }


_ATOM_COLUMNS = ("atom_name", "resn", "chain", "resi", "icode",
                 "x", "y", "z", "b_factor", "element")
_FULL_COLUMNS = ("record", "serial", "atom_name", "altloc", "resn", "chain",
                 "resi", "icode", "x", "y", "z", "tail")


def scan_atoms(lines: DataFrame, need_b_factor: bool = True) -> DataFrame:
    """Atoms with usable coordinates (and, if asked, a usable B-factor)."""
    fields = record_fields()
    atoms = lines.where(is_coordinate_record(F.col("value"))).select(
        "structure_id", "line_no", *(fields[c].alias(c) for c in _ATOM_COLUMNS))
    required = ["x", "y", "z"] + (["b_factor"] if need_b_factor else [])
    return atoms.dropna(subset=required)


def scan_records(lines: DataFrame) -> DataFrame:
    """Full atom records, for structure editing."""
    fields = record_fields()
    return (
        lines.where(is_coordinate_record(F.col("value")))
        .select("structure_id", "line_no",
                *(fields[c].alias(c) for c in _FULL_COLUMNS))
        .dropna(subset=["x", "y", "z"])
    )


def residue_index(lines: DataFrame) -> DataFrame:
    """Residues with atom counts; coordinates are not looked at.

    The name is the one on the first line of the residue.
    """
    fields = record_fields()
    return index_residues(
        lines.where(is_coordinate_record(F.col("value"))).select(
            "structure_id", "line_no",
            *(fields[c].alias(c) for c in ("chain", "resi", "icode", "resn"))))


def index_residues(records: DataFrame) -> DataFrame:
    """Name and atom count per position, folded by name first.

    The first aggregation has primitive buffers, so it hashes on the map side;
    the second one sees residues, not atoms.
    """
    position = ["structure_id", "chain", "resi", "icode"]
    named = records.groupBy(*position, "resn").agg(
        F.min("line_no").alias("line"), F.count("*").alias("n"))
    return named.groupBy(*position).agg(
        F.min_by("resn", "line").alias("resn"), F.sum("n").alias("atom_count"))


def header_ids(lines: DataFrame) -> DataFrame:
    """Id of each structure: the first usable HEADER line, else its own name.

    Only header lines are compared; the list of structures is a plain hash
    aggregation over the other lines.
    """
    headers = lines.where(F.col("value").startswith("HEADER") & (F.length("value") >= 66)).groupBy(
        "structure_id").agg(F.min_by(_field(63, 4), F.col("line_no")).alias("header_id"))
    usable = F.when(F.col("header_id") != "", F.col("header_id"))
    return lines.select("structure_id").distinct().join(headers, "structure_id", "left").select(
        "structure_id",
        F.coalesce(usable, F.col("structure_id").cast("string")).alias("pdb_id"))


def accessions(lines: DataFrame) -> DataFrame:
    """First sequence accession of each structure, in file order."""
    value = F.upper("value")
    candidate_rows = lines.where(
        (F.col("value").startswith("DBREF") | F.col("value").startswith("SEQADV"))
        & (value.contains("UNP") | value.contains("UNIPROT")))
    tokens = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")

    def matches(token):
        return token.rlike(C.ACCESSION_PATTERN)

    rows = candidate_rows.select("structure_id", "line_no", tokens.alias("tokens"))
    after_marker = F.filter(
        F.col("tokens"),
        lambda token, i: matches(token) & (i > 0) & F.coalesce(
            F.get(F.col("tokens"), i - 1).isin("UNP", "UNIPROT"), F.lit(False)))
    anywhere = F.filter(F.col("tokens"), lambda token: matches(token))
    best = F.coalesce(F.get(after_marker, F.lit(0)), F.get(anywhere, F.lit(0)))
    return (
        rows.select("structure_id", "line_no", best.alias("accession"))
        .where(F.col("accession").isNotNull())
        .groupBy("structure_id")
        .agg(F.min_by("accession", "line_no").alias("accession"))
    )


def locate_structures(measurements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Match ids to catalogued structures; the lowest priority number wins.

    ``catalog`` holds ``(structure_id, location, priority)``; an id may occur
    in several locations.  The winner is reduced before the join.
    """
    best = catalog.groupBy(F.upper("structure_id").alias("id_upper")).agg(
        F.min(F.struct("priority", "location")).alias("best"))
    return (
        measurements.withColumn("id_upper", F.upper("pdb_id"))
        .join(best, "id_upper", "left")
        .select(*measurements.columns, F.col("best.location").alias("location"))
    )

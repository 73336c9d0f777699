"""Editing structures by mutation, hashing and rendering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as C, hashing, residues as R
from ..sources.structure_text import is_coordinate_record
from .prefix import running
from .spatial import POSITION, with_center

_RECORD = ["structure_id", "line_no", "sub_line", "record", "atom_name", "altloc",
           "resn", "chain", "resi", "icode", "x", "y", "z", "tail"]


def structure_hashes(lines: DataFrame) -> DataFrame:
    """Content hash of all lines and of the coordinate records, in their order.

    Each line enters with its place among all lines, or among the coordinate
    records; places are counted by range, so no structure is gathered.
    """
    placed = running(
        lines.withColumn("coordinate", is_coordinate_record(F.col("value")).cast("int")),
        [F.col("line_no")], keys=["structure_id"], value="coordinate",
        number="place", total="atom_place")
    coordinate = F.col("coordinate") == 1
    return placed.groupBy("structure_id").agg(
        hashing.multiset_digest(hashing.placed_words("place", F.col("value")), F.count("*"))
        .alias("structure_hash"),
        hashing.multiset_digest(
            [F.when(coordinate, w).otherwise(F.lit(0)) for w in
             hashing.placed_words("atom_place", F.col("value"))],
            F.count_if(coordinate)).alias("atom_hash"))


def file_hashes(spark, path: str, glob: str = "*.{pdb,ent}") -> DataFrame:
    """SHA-256 of whole files; the format bounds a file to a few megabytes."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path))
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("structure_id"),
        F.sha2("content", 256).alias("structure_hash"))


def coordinate_hashes(atoms: DataFrame, radius: float = 12.0) -> DataFrame:
    """Hash of the coordinates, in line order, within a sphere around the structure's mean."""
    centers = atoms.groupBy("structure_id").agg(
        *(F.avg(a).alias(f"c{a}") for a in "xyz"))
    parts = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    inside = F.sqrt(sum(p * p for p in parts)) <= radius
    text = F.format_string("%.3f %.3f %.3f", "x", "y", "z")
    marked = with_center(atoms, centers).select(
        "structure_id", "line_no", inside.alias("inside"), text.alias("text"))
    placed = running(marked, [F.col("line_no")], keys=["structure_id", "inside"], number="place")
    return placed.groupBy("structure_id").agg(
        hashing.multiset_digest(
            [F.when(F.col("inside"), w).otherwise(F.lit(0)) for w in
             hashing.placed_words("place", F.col("text"))],
            F.count_if("inside")).alias("coordinate_hash"),
        F.count_if("inside").alias("n_atoms"))


def _templates():
    def row(name, offset):
        return F.struct(F.lit(name).alias("name"), *(
            F.lit(float(v)).alias(f"d{a}") for a, v in zip("xyz", offset)))

    def array(template):
        return F.array(*(row(n, o) for n, o in template.items()))

    known = [item for aa, template in C.SIDE_CHAIN_TEMPLATES.items()
             for item in (F.lit(aa), array(template))]
    return F.coalesce(F.create_map(*known)[F.col("mut")], array(C.DEFAULT_SIDE_CHAIN))


def apply_mutations(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Replace the side chains of the target residues.

    ``targets`` has ``(structure_id, chain, resi, icode, mut)``, one row per
    residue.  Backbone atoms stay under the new residue name, the rest of the
    residue is dropped, and pseudo-atoms of the new side chain are placed from
    the alpha carbon (or the centroid) and sorted behind the residue.
    """
    base = records.withColumn("sub_line", F.lit(0))
    wanted = targets.select(*POSITION, "mut")
    marked = base.join(wanted, POSITION, "left")
    new_name = R.lookup(C.ONE_TO_THREE, F.col("mut"))
    hit = F.col("mut").isNotNull()
    kept = marked.where(~hit | F.col("atom_name").isin(*C.BACKBONE_ATOMS)).withColumn(
        "resn", F.when(hit, F.coalesce(new_name, "mut")).otherwise(F.col("resn")))

    alpha = F.when(F.col("atom_name") == "CA", F.col("line_no"))
    anchors = base.join(wanted, POSITION).groupBy(*POSITION, "mut").agg(
        F.max("line_no").alias("line_no"),
        *(F.coalesce(F.min_by(a, alpha), F.avg(a)).alias(f"c{a}") for a in "xyz"))
    shift = hashing.shift_vector(F.concat("chain", F.lit(":"), "resi", "mut"))
    placed = anchors.select(
        *POSITION, "mut", "line_no", "cx", "cy", "cz",
        *(s.alias(f"s{a}") for a, s in zip("xyz", shift)),
        F.posexplode(_templates()).alias("i", "t"))
    built = placed.select(
        "structure_id", "line_no", (F.col("i") + 1).alias("sub_line"),
        F.lit("ATOM").alias("record"), F.col("t.name").alias("atom_name"),
        F.lit(" ").alias("altloc"), F.coalesce(new_name, "mut").alias("resn"),
        "chain", "resi", "icode",
        *((F.col(f"c{a}") + (F.col(f"t.d{a}") + F.col(f"s{a}"))).alias(a) for a in "xyz"),
        F.lit("  1.00 20.00           C").alias("tail"))
    return kept.select(*_RECORD).unionByName(built)


def check_edit(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """Verdict per target residue after an edit.

    A target that exists must have changed its atom count or moved its centre
    of mass; a target without atoms was not touched.
    """
    def stats(frame, tag):
        return frame.join(targets.select(*POSITION), POSITION, "left_semi").groupBy(
            *POSITION).agg(F.count("*").alias(f"n_{tag}"),
                           *(F.avg(a).alias(f"{a}_{tag}") for a in "xyz"))

    both = (
        targets.select(*POSITION).distinct()
        .join(stats(before, "wt"), POSITION, "left")
        .join(stats(after, "mut"), POSITION, "left"))
    parts = [F.col(f"{a}_mut") - F.col(f"{a}_wt") for a in "xyz"]
    moved = F.sqrt(sum(p * p for p in parts))
    return both.select(
        *POSITION, "n_wt", "n_mut", moved.alias("moved"),
        F.when(F.col("n_wt").isNull() | F.col("n_mut").isNull(), "target not touched")
        .when((F.col("n_wt") == F.col("n_mut")) & (moved < 1e-3), "structure build failure")
        .otherwise("ok").alias("verdict"))


def render_lines(records: DataFrame) -> DataFrame:
    """Fixed-width lines with fresh serial numbers, in line order."""
    numbered = running(
        records, [F.col("line_no"), F.col("sub_line"), F.col("atom_name")],
        keys=["structure_id"], number="serial_no")
    # Atom names are centred in their four columns, extra space on the right.
    pad = F.lit(4) - F.length("atom_name")
    centred = F.rpad(F.concat(
        F.repeat(F.lit(" "), F.floor(pad / 2).cast("int")), "atom_name"), 4, " ")
    return numbered.select(
        "structure_id", "serial_no",
        F.format_string(
            "%-6s%5d %s%1s%3s %s%4s%1s   %8.3f%8.3f%8.3f%s",
            "record", "serial_no", centred, "altloc", "resn", "chain", "resi",
            "icode", "x", "y", "z", "tail").alias("value"))

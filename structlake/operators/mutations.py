"""Mutation lists against structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import mutation_exprs as M, residues as R


def parse_lists(sets: DataFrame, raw: str = "raw",
                default_chain: Column | None = None) -> DataFrame:
    """Add ``mutations`` and ``rejects`` arrays to a table of list texts."""
    return (
        sets.withColumn("_parsed", M.parse_list(F.col(raw), default_chain))
        .withColumn("mutations", M.accepted(F.col("_parsed")))
        .withColumn("rejects", M.rejected(F.col("_parsed")))
        .drop("_parsed")
    )


def default_chains(index: DataFrame) -> DataFrame:
    """Chain with most atoms per structure, alphabetical on ties."""
    counted = index.groupBy("structure_id", "chain").agg(
        F.sum("atom_count").alias("n"))
    best = counted.groupBy("structure_id").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), "chain")).alias("b"))
    return best.select("structure_id", F.col("b.chain").alias("default_chain"),
                       (-F.col("b.rank")).alias("atom_count"))


def validate(parsed: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """One row per mutation with the reason it fails, NULL when it resolves.

    ``parsed`` has ``structure_id`` and ``mutations``; ``index`` is the
    residue index, one row per residue and thus the smaller side of each join.
    """
    residue = index.select(
        "structure_id", "chain", F.col("resi").alias("resseq"), "icode", "resn")
    rows = parsed.select(*keys, "structure_id", F.explode("mutations").alias("m")).select(
        *keys, "structure_id", "m.*")
    filled = rows.join(
        default_chains(index).select("structure_id", "default_chain"),
        "structure_id", "left",
    ).withColumn("chain", F.when(F.col("chain").isin("", "?"),
                                 F.coalesce("default_chain", F.lit("?")))
                 .otherwise(F.col("chain"))).drop("default_chain")
    exact = filled.join(residue.withColumnRenamed("resn", "resn_exact"),
                        ["structure_id", "chain", "resseq", "icode"], "left")
    blank = residue.where(F.col("icode") == " ").drop("icode").withColumnRenamed(
        "resn", "resn_blank")
    both = exact.join(blank, ["structure_id", "chain", "resseq"], "left")
    found = F.coalesce("resn_exact", "resn_blank")
    return both.select(
        *keys, "structure_id", "chain", "resseq", "icode", "wt", "mut", "raw",
        found.alias("resn"),
        F.when(found.isNull(), "residue not found")
        .when(R.aa_code_modified(found) != F.col("wt"), "wild type mismatch")
        .alias("reason"))


def exclude_positions(candidates: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop candidates at excluded positions.

    ``exclusions`` has ``(structure_id, token)``; ``50`` excludes the number on
    every chain, ``A:75`` on one.
    """
    token = F.trim("token")
    chain = F.trim(F.substring_index(token, ":", 1))
    number = F.trim(F.substr(token, F.instr(token, ":") + F.lit(1)))
    typed = exclusions.where(token != "").select(
        "structure_id", F.contains(token, F.lit(":")).alias("typed"),
        F.when(F.contains(token, F.lit(":")), chain).alias("chain"),
        F.when(F.contains(token, F.lit(":")), number).otherwise(token).alias("resi"))
    anywhere = typed.where(~F.col("typed")).select("structure_id", "resi").distinct()
    on_chain = typed.where(
        F.col("typed") & (F.col("chain") != "") & (F.col("resi") != "")
    ).select("structure_id", "chain", "resi").distinct()
    return candidates.join(anywhere, ["structure_id", "resi"], "left_anti").join(
        on_chain, ["structure_id", "chain", "resi"], "left_anti")

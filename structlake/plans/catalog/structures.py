"""Scans, residue lookups, sites and environment features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as C, residues as R
from ...operators import environment, sites, spatial
from ...sources import structure_files, structure_text as text
from ..registry import query, scratch_path, view


def rounded(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def case_table(table, key, default="NULL"):
    arms = " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)")
        for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def listed(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


COF = listed(C.COFACTOR_SITE_NAMES)
AA1 = ("coalesce(" + case_table(C.THREE_TO_ONE, "{0}")
       + ", CASE WHEN {0} = '' THEN 'X' ELSE substring({0}, 1, 1) END)")


def aa1(column):
    return AA1.replace("{0}", column)


# --- scans ------------------------------------------------------------------
view("records_sql", """
SELECT structure_id, line_no, value, trim(substring(value, 1, 6)) AS record,
       trim(substring(value, 7, 5)) AS serial, trim(substring(value, 13, 4)) AS atom_name,
       substring(value, 17, 1) AS altloc, upper(trim(substring(value, 18, 3))) AS resn,
       CASE WHEN trim(substring(value, 22, 1)) = '' THEN '?' ELSE trim(substring(value, 22, 1)) END AS chain,
       trim(substring(value, 23, 4)) AS resi,
       CASE WHEN trim(substring(value, 27, 1)) = '' THEN ' ' ELSE trim(substring(value, 27, 1)) END AS icode,
       TRY_CAST(trim(substring(value, 31, 8)) AS DOUBLE) AS x,
       TRY_CAST(trim(substring(value, 39, 8)) AS DOUBLE) AS y,
       TRY_CAST(trim(substring(value, 47, 8)) AS DOUBLE) AS z,
       CASE WHEN length(value) < 66 THEN 20.0::DOUBLE ELSE TRY_CAST(trim(substring(value, 61, 6)) AS DOUBLE) END AS b_factor,
       upper(trim(substring(value, 77, 2))) AS element, substring(value, 55, 200) AS tail
FROM lines_fx WHERE value LIKE 'ATOM%' OR value LIKE 'HETATM%'
""")
view("parsed_sql", """
SELECT structure_id, line_no, atom_name, resn, chain, resi, icode, x, y, z, b_factor, element
FROM records_sql WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND b_factor IS NOT NULL
""")


@query("s01_atom_scan", "SELECT * FROM parsed_sql")
def _(t):
    return text.scan_atoms(t.lines)


@query("s02_record_scan", """
SELECT structure_id, line_no, record, serial, atom_name, altloc, resn, chain, resi, icode, x, y, z, tail
FROM records_sql WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""")
def _(t):
    return text.scan_records(t.lines)


# --- whole files: the lines are written as files and read back; of a third of the structures only the cached copy is there,
# which holds no heteroatoms -------------------------------------------------------------------------------------------
view("filelines_sql", """
SELECT CAST(structure_id AS VARCHAR) AS structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY line_no) AS line_no, value
FROM lines_fx WHERE structure_id % 3 <> 0 OR value NOT LIKE 'HETATM%'""")


def file_lines(t):
    path = scratch_path(t)
    structure_files.write_structure_files(t.lines, path, {
        "main": F.col("structure_id") % 3 != 0, "cache": ~F.col("value").like("HETATM%")})
    return structure_files.read_structure_lines(
        t.spark, path, "*.txt", ("/folder=main/", "/folder=cache/"), structure_files.WRITTEN)


@query("s01_file_lines", "SELECT * FROM filelines_sql")
def _(t):
    return file_lines(t)


@query("s01_file_atoms", """
SELECT CAST(p.structure_id AS VARCHAR) AS structure_id, f.line_no, atom_name, resn, chain, resi, icode, x, y, z, b_factor, element FROM parsed_sql p
JOIN (SELECT structure_id, line_no AS source_no, row_number() OVER (PARTITION BY structure_id ORDER BY line_no) AS line_no
      FROM lines_fx WHERE structure_id % 3 <> 0 OR value NOT LIKE 'HETATM%') f ON f.structure_id = p.structure_id AND f.source_no = p.line_no""")
def _(t):
    return text.scan_atoms(file_lines(t))


@query("s06_chosen_files", """
SELECT CAST(s_suppkey AS VARCHAR) AS structure_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'main' ELSE 'cache' END AS folder FROM supplier""")
def _(t):
    path = scratch_path(t)
    names = t.table("supplier").select(F.col("s_suppkey").alias("structure_id"), F.lit(1).alias("line_no"), F.lit("END").alias("value"))
    structure_files.write_structure_files(names.where("structure_id % 3 <> 0"), f"{path}/main")
    structure_files.write_structure_files(names, f"{path}/cache")
    files = structure_files.list_files(t.spark, path, "*.txt", structure_files.WRITTEN)
    return structure_files.choose_files(files, ("/main/", "/cache/")).select(
        "structure_id", F.regexp_extract("path", "/(main|cache)/", 1).alias("folder"))


view("residue_index_sql", """
SELECT structure_id, chain, resi, icode, min_by(resn, line_no) AS resn, count(*) AS atom_count
FROM records_sql GROUP BY ALL""")


@query("s03_residue_index", "SELECT * FROM residue_index_sql")
def _(t):
    return text.residue_index(t.lines)


@query("s04_header_id", """
SELECT structure_id, coalesce(nullif(trim(min_by(substring(value, 63, 4), line_no)
         FILTER (value LIKE 'HEADER%' AND length(value) >= 66)), ''), CAST(structure_id AS VARCHAR)) AS pdb_id
FROM lines_fx GROUP BY structure_id""")
def _(t):
    return text.header_ids(t.lines)


@query("s05_accession", """
SELECT structure_id, min_by(tok, line_no) AS accession FROM (
  SELECT structure_id, line_no, string_split_regex(trim(value), '\\s+')[7] AS tok
  FROM lines_fx WHERE value LIKE 'DBREF%' AND string_split_regex(trim(value), '\\s+')[6] = 'UNP')
WHERE regexp_matches(tok, '^[OPQ][0-9][A-Z0-9]{3}[0-9]$') GROUP BY structure_id""")
def _(t):
    return text.accessions(t.lines)


# Marked and unmarked accessions of both lengths, sequence differences, lower case, and records that name none.
KINDS = (
    "DBREF  1ABC A    1   600  UNP    P00533   EGFR_HUMAN", "SEQADV 1ABC GLY A    0  UNP  Q9Y6K9              EXPRESSION TAG",
    "DBREF1 1ABC A    1   600  UNIPROT  A0A024R1R8   LONG_NAME", "DBREF  1ABC A    1   600  UNP    NOTHING  P12345 LATER",
    "dbref  1abc a    1   600  unp    p00533", "SEQADV 1ABC unp q8n158 lower", "REMARK UNP P00533", "DBREF  1ABC A 1 600  PDB    P00533",
    "DBREF  1ABC A    1   600  UNP    NONE")
FOUND = ("P00533", "Q9Y6K9", "A0A024R1R8", "P12345", None, "Q8N158", None, None, None)


def kind_of(values, shift):
    arms = " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values))
    return f"CASE (s_suppkey + {shift}) % {len(values)} {arms} END"


@query("s05_accession_kinds", f"""
SELECT s_suppkey AS structure_id, coalesce({kind_of(FOUND, 0)}, {kind_of(FOUND, 4)}) AS accession
FROM supplier WHERE coalesce({kind_of(FOUND, 0)}, {kind_of(FOUND, 4)}) IS NOT NULL""")
def _(t):
    supplier = t.table("supplier")
    lines = supplier.select(F.col("s_suppkey").alias("structure_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("line_no"), F.expr(kind_of(KINDS, 0)).alias("value")),
        F.struct(F.lit(2).alias("line_no"), F.expr(kind_of(KINDS, 4)).alias("value")))).alias("l"))
    return text.accessions(lines.select("structure_id", "l.*"))


@query("s06_locate_structure", """
WITH cat AS (SELECT s_suppkey AS structure_id, concat('dir', CAST(s_nationkey % 3 AS VARCHAR), '/', s_name) AS location,
                    CAST(s_nationkey % 3 AS INTEGER) AS priority FROM supplier
             UNION ALL SELECT s_suppkey, concat('cache/', s_name), 1 FROM supplier WHERE s_suppkey % 4 = 0)
SELECT o_orderkey AS pdb_key, CAST(o_orderkey % (SELECT 3 * count(*) // 2 FROM supplier) AS VARCHAR) AS pdb_id, best.location AS location
FROM orders LEFT JOIN (SELECT structure_id, min(struct_pack(p := priority, location := location)) AS best
                       FROM cat GROUP BY 1) c ON c.structure_id = o_orderkey % (SELECT 3 * count(*) // 2 FROM supplier)""")
def _(t):
    supplier = t.table("supplier")
    name = F.col("s_suppkey").cast("string").alias("structure_id")
    folder = F.col("s_nationkey") % 3
    catalog = supplier.select(
        name, F.concat(F.lit("dir"), folder.cast("string"), F.lit("/"), "s_name").alias("location"),
        folder.cast("int").alias("priority"),
    ).unionByName(supplier.where(F.col("s_suppkey") % 4 == 0).select(
        name, F.concat(F.lit("cache/"), "s_name").alias("location"), F.lit(1).alias("priority")))
    # Half as many ids again as there are structures, so that some are not found.
    ids = supplier.agg((F.count("*") * 3 / 2).cast("bigint").alias("n")).scalar()
    wanted = t.table("orders").withColumn("_ids", ids).select(
        F.col("o_orderkey").alias("pdb_key"),
        (F.col("o_orderkey") % F.col("_ids")).cast("string").alias("pdb_id"))
    return text.locate_structures(wanted, catalog)


# --- sites ------------------------------------------------------------------
view("sites_sql", f"""
SELECT structure_id, chain, resi, icode, resn, count(*) AS n_atoms,
       coalesce(max_by(x, line_no) FILTER (upper(atom_name) = 'N5'), avg(x)) AS cx,
       coalesce(max_by(y, line_no) FILTER (upper(atom_name) = 'N5'), avg(y)) AS cy,
       coalesce(max_by(z, line_no) FILTER (upper(atom_name) = 'N5'), avg(z)) AS cz,
       CASE WHEN count(*) FILTER (upper(atom_name) = 'N5') > 0 THEN 'n5' ELSE 'centroid' END AS center_kind
FROM atoms_fx WHERE resn IN {COF} GROUP BY ALL""")


@query("a01_site_center", """
SELECT structure_id, chain, resi, icode, resn, n_atoms, center_kind,
       round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM sites_sql""")
def _(t):
    return sites.cofactor_sites(t.atoms).select(
        *spatial.RESIDUE, "n_atoms", "center_kind", *rounded("cx", "cy", "cz"))


def pairs_sql(radius, residue="a.chain, a.resi, a.icode, a.resn"):
    return f"""
SELECT s.structure_id, s.chain AS site_chain, s.resi AS site_resi, s.icode AS site_icode, s.resn AS site_resn,
       {residue}, min(sqrt((a.x - s.cx) * (a.x - s.cx) + (a.y - s.cy) * (a.y - s.cy) + (a.z - s.cz) * (a.z - s.cz))) AS min_dist
FROM sites_sql s JOIN atoms_fx a ON a.structure_id = s.structure_id AND a.resn NOT IN {COF}
GROUP BY ALL HAVING min_dist <= {radius}"""


def pick_sql(pairs):
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, coalesce(p.score, 0) AS score, row_number() OVER (PARTITION BY s.structure_id ORDER BY coalesce(p.score, 0) DESC,
         s.chain, coalesce(TRY_CAST(s.resi AS INTEGER), 1000000000), s.resi, s.icode, s.resn) AS rn
  FROM sites_sql s LEFT JOIN (SELECT structure_id, site_chain, site_resi, site_icode, site_resn, count(*) AS score
                              FROM {pairs} GROUP BY ALL) p
    ON p.structure_id = s.structure_id AND p.site_chain = s.chain AND p.site_resi = s.resi
   AND p.site_icode = s.icode AND p.site_resn = s.resn) WHERE rn = 1"""


def near_sql(pairs, pick):
    return f"""
SELECT p.* FROM {pairs} p JOIN {pick} k ON k.structure_id = p.structure_id AND p.site_chain = k.chain
 AND p.site_resi = k.resi AND p.site_icode = k.icode AND p.site_resn = k.resn"""


for _r in (3, 5, 6, 8, 12):
    view(f"pairs{_r}_sql", pairs_sql(_r))
    view(f"pick{_r}_sql", pick_sql(f"pairs{_r}_sql"))
    view(f"near{_r}_sql", near_sql(f"pairs{_r}_sql", f"pick{_r}_sql"))


@query("a02_site_score", """
SELECT s.structure_id, s.chain, s.resi, s.icode, s.resn, count(p.structure_id) AS score
FROM sites_sql s LEFT JOIN pairs6_sql p ON p.structure_id = s.structure_id AND p.site_chain = s.chain
 AND p.site_resi = s.resi AND p.site_icode = s.icode AND p.site_resn = s.resn GROUP BY ALL""")
def _(t):
    found = sites.cofactor_sites(t.atoms)
    pairs = sites.site_residue_pairs(t.atoms, found, 6.0)
    return sites.site_scores(pairs, found).select(*spatial.RESIDUE, "score")


@query("w01_representative_site", """
SELECT structure_id, chain, resi, icode, resn, score, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz
FROM pick6_sql""")
def _(t):
    picked = sites.pick_site(t.atoms, 6.0)
    return picked.select(*spatial.RESIDUE, "score", *rounded("cx", "cy", "cz"))


@query("j01_site_residue_distance", f"""
SELECT a.structure_id, a.chain, a.resi, a.icode, a.resn,
       round(min(sqrt((a.x - k.cx) * (a.x - k.cx) + (a.y - k.cy) * (a.y - k.cy) + (a.z - k.cz) * (a.z - k.cz))), 6) AS min_dist
FROM pick6_sql k JOIN atoms_fx a ON a.structure_id = k.structure_id AND a.resn NOT IN {COF} GROUP BY ALL""")
def _(t):
    picked = sites.pick_site(t.atoms, 6.0)
    return sites.residue_distances(t.atoms, picked).select(
        *spatial.RESIDUE, *rounded("min_dist"))


@query("j02_radius_join", " UNION ALL ".join(
    f"SELECT CAST({r} AS INTEGER) AS radius, structure_id, chain, resi, icode, resn, round(min_dist, 6) AS min_dist FROM near{r}_sql"
    for r in (5, 6, 8, 12)))
def _(t):
    out = None
    for radius, (_picked, near) in sites.picks_with_neighbours(t.atoms, [5.0, 6.0, 8.0, 12.0]).items():
        part = near.select(
            F.lit(int(radius)).alias("radius"), *spatial.RESIDUE, *rounded("min_dist"))
        out = part if out is None else out.unionByName(part)
    return out


view("env_sql", f"""
SELECT structure_id, pi_sum / greatest(1.5, n / 2.5) AS iso, least(5.0, hb / 2.0) AS hb_cap,
       greatest(1.05, least(1.60, 0.6 + 0.4 * steric + 0.006 * least(b, 60.0))) AS flex
FROM (SELECT p.structure_id, CAST(count(*) AS DOUBLE) AS n,
             sum({case_table(C.ISOELECTRIC_POINT, aa1('p.resn'), '6.5::DOUBLE')}) AS pi_sum,
             CAST(sum(CASE WHEN {aa1('p.resn')} IN {listed(C.HBOND_CAPABLE)} THEN 1 ELSE 0 END) AS DOUBLE) AS hb,
             avg({case_table(C.STERIC_INDEX, aa1('p.resn'), '0.7::DOUBLE')}) AS steric, avg(r.b_mean) AS b
      FROM near6_sql p JOIN (SELECT structure_id, chain, resi, icode, resn, avg(b_factor) AS b_mean FROM atoms_fx GROUP BY ALL) r
        ON r.structure_id = p.structure_id AND r.chain = p.chain AND r.resi = p.resi AND r.icode = p.icode AND r.resn = p.resn
      GROUP BY 1)""")

ENV = """
SELECT s.structure_id, CAST(round(coalesce(e.iso, 0.0), 9) AS DOUBLE) AS iso, CAST(round(coalesce(e.hb_cap, 0.0), 9) AS DOUBLE) AS hb_cap,
       CAST(round(coalesce(e.flex, 0.0), 9) AS DOUBLE) AS flex, (k.structure_id IS NOT NULL) AS flavin_found
FROM (SELECT DISTINCT structure_id FROM atoms_fx) s LEFT JOIN env_sql e ON e.structure_id = s.structure_id
LEFT JOIN pick6_sql k ON k.structure_id = s.structure_id"""


@query("a03_environment_features", ENV)
def _(t):
    return environment.environment_features(t.atoms).select(
        "structure_id", *rounded("iso", "hb_cap", "flex", digits=9), "flavin_found")


view("lfp_sql", f"""
SELECT s.structure_id, coalesce(n.lfp, 0.0) AS lfp, coalesce(n.steric, 0.0) AS steric
FROM (SELECT DISTINCT structure_id FROM atoms_fx) s LEFT JOIN (
  SELECT structure_id, sum({case_table(C.ELECTRONEGATIVITY, aa1('resn'), '0.0::DOUBLE')}) AS lfp,
         sum({case_table(C.STERIC_INDEX, aa1('resn'), '0.0::DOUBLE')}) AS steric FROM near5_sql GROUP BY 1) n
  ON n.structure_id = s.structure_id""")


@query("a04_local_field", """
SELECT structure_id, round(lfp, 6) AS lfp, round(steric, 6) AS steric FROM lfp_sql""")
def _(t):
    return environment.local_field(t.atoms).select(
        "structure_id", *rounded("lfp", "steric"))


@query("p01_residue_codes", f"""
SELECT resn, {aa1('resn')} AS aa, {aa1("CASE WHEN resn = 'MSE' THEN 'MET' ELSE resn END")} AS aa_modified, count(*) AS n
FROM (SELECT CASE WHEN line_no % 101 = 0 THEN 'MSE' WHEN line_no % 103 = 0 THEN 'K' WHEN line_no % 107 = 0 THEN '' ELSE resn END AS resn
      FROM atoms_fx) GROUP BY ALL""")
def _(t):
    line = F.col("line_no")
    named = t.atoms.select(
        F.when(line % 101 == 0, "MSE").when(line % 103 == 0, "K")
        .when(line % 107 == 0, "").otherwise(F.col("resn")).alias("resn"))
    return named.groupBy("resn").agg(F.count("*").alias("n")).select(
        "resn", R.aa_code(F.col("resn")).alias("aa"),
        R.aa_code_modified(F.col("resn")).alias("aa_modified"), "n")


@query("j04_nearest_fallback", f"""
WITH d AS (SELECT a.structure_id, a.chain, a.resi, a.icode,
             min(sqrt((a.x - k.cx) * (a.x - k.cx) + (a.y - k.cy) * (a.y - k.cy) + (a.z - k.cz) * (a.z - k.cz))) AS min_dist
           FROM pick3_sql k JOIN atoms_fx a ON a.structure_id = k.structure_id AND a.resn NOT IN {COF} GROUP BY ALL),
     r AS (SELECT *, count(*) FILTER (min_dist <= 3) OVER (PARTITION BY structure_id) AS inside,
             row_number() OVER (PARTITION BY structure_id ORDER BY min_dist, chain, CAST(resi AS INTEGER), resi, icode) AS rn FROM d)
SELECT structure_id, chain, resi, icode, round(min_dist, 6) AS min_dist, inside = 0 AS fallback
FROM r WHERE (inside > 0 AND min_dist <= 3) OR (inside = 0 AND rn <= 24)""")
def _(t):
    return sites.shell_residues(t.atoms, 3.0, C.NEAREST_FALLBACK).select(
        *spatial.POSITION, *rounded("min_dist"), "fallback")


@query("j05_burial", """
WITH c AS (SELECT structure_id, chain, resi, icode, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atoms_fx GROUP BY ALL),
     n AS (SELECT DISTINCT c.structure_id, c.chain, c.resi, c.icode, a.chain AS oc, a.resi AS ori, a.icode AS oi
           FROM c JOIN atoms_fx a ON a.structure_id = c.structure_id AND NOT (a.chain = c.chain AND a.resi = c.resi AND a.icode = c.icode)
            AND sqrt((a.x - c.cx) * (a.x - c.cx) + (a.y - c.cy) * (a.y - c.cy) + (a.z - c.cz) * (a.z - c.cz)) < 6)
SELECT c.structure_id, c.chain, c.resi, c.icode, count(n.oc) AS burial
FROM c LEFT JOIN n ON n.structure_id = c.structure_id AND n.chain = c.chain AND n.resi = c.resi AND n.icode = c.icode GROUP BY ALL""")
def _(t):
    return spatial.burial(t.atoms)

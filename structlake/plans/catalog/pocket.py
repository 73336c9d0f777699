"""Pocket audit: cofactor choice, neighbours, field moments, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as C, residues as R, rules
from ...operators import graph, scanner, spatial
from ...session import checkpoint
from ..registry import query, view
from .structures import case_table, listed, rounded

TYPES = listed(C.COFACTOR_TYPE)
SCAN = listed(C.SCANNED_RESIDUES)
view("atoms_ade", """
SELECT * REPLACE (CASE WHEN resn = 'HOH' AND structure_id % 3 = 0 AND resi = '20' THEN 'ADE'
                       WHEN resn = 'FAD' AND structure_id % 5 = 1 THEN 'SO4' ELSE resn END AS resn) FROM atoms_fx""")


def atoms_ade(t):
    resn, sid = F.col("resn"), F.col("structure_id")
    return t.atoms.withColumn(
        "resn", F.when((resn == "HOH") & (sid % 3 == 0) & (F.col("resi") == "20"), "ADE")
        .when((resn == "FAD") & (sid % 5 == 1), "SO4").otherwise(resn))


def detect_sql(atoms):
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT structure_id, {case_table(C.COFACTOR_TYPE, 'resn')} AS cofactor, resn, chain, resi, icode, atom_count,
         row_number() OVER (PARTITION BY structure_id ORDER BY atom_count DESC, chain, coalesce(TRY_CAST(resi AS INTEGER), 0), icode, resn) AS rn
  FROM (SELECT structure_id, chain, resi, icode, resn, count(*) AS atom_count FROM {atoms} WHERE resn IN {TYPES} GROUP BY ALL)) WHERE rn = 1"""


def frame_sql(atoms, detect, forced=None):
    target = f"'{forced}'" if forced else "detected"
    anchors = ", ".join(
        f"max_by({a}, line_no) FILTER (resn = '{k}' AND upper(trim(atom_name)) IN ('{n.upper()}', '{n.upper()}A')) AS {k}_{n}_{a}"
        for k in ("FMN", "FAD") for n in ("n5", "o4") for a in "xyz")
    means = ", ".join(f"avg({a}) FILTER (resn = '{k}') AS {k}_c{a}" for k in ("FMN", "FAD") for a in "xyz")
    pick = ", ".join(f"CASE center_type WHEN 'FMN' THEN FMN_c{a} WHEN 'FAD' THEN FAD_c{a} END AS c{a}" for a in "xyz")
    pick_anchor = ", ".join(f"CASE target WHEN 'FMN' THEN FMN_{n}_{a} WHEN 'FAD' THEN FAD_{n}_{a} END AS {n}_{a}"
                            for n in ("n5", "o4") for a in "xyz")
    return f"""
SELECT *, {pick}, {pick_anchor} FROM (
  SELECT *, CASE WHEN CASE target WHEN 'FMN' THEN fmn_atoms WHEN 'FAD' THEN fad_atoms END > 0 THEN target
                 WHEN fad_atoms > 0 THEN 'FAD' WHEN fmn_atoms > 0 THEN 'FMN' END AS center_type
  FROM (SELECT *, {target} AS target FROM (
    SELECT g.*, CASE WHEN d.cofactor IS NOT NULL AND g.adenine THEN 'FAD' ELSE d.cofactor END AS detected
    FROM (SELECT structure_id, count(*) FILTER (resn = 'FMN') AS fmn_atoms, count(*) FILTER (resn = 'FAD') AS fad_atoms,
            bool_or(resn IN {listed(C.ADENINE_NAMES)}) AS adenine, {means}, {anchors} FROM {atoms} GROUP BY structure_id) g
    LEFT JOIN {detect} d ON d.structure_id = g.structure_id)))"""


def dist(p):
    return f"sqrt((a.x - f.{p}x) * (a.x - f.{p}x) + (a.y - f.{p}y) * (a.y - f.{p}y) + (a.z - f.{p}z) * (a.z - f.{p}z))"


view("detect_sql", detect_sql("atoms_fx"))
view("frame_sql", frame_sql("atoms_fx", "detect_sql"))
view("pocket_sql", f"""
SELECT a.structure_id, a.line_no, a.atom_name, a.resn, a.chain, a.resi, a.x, a.y, a.z,
       {dist('c')} AS dist, {dist('n5_')} AS dist_n5, {dist('o4_')} AS dist_o4
FROM atoms_fx a JOIN frame_sql f ON f.structure_id = a.structure_id AND f.center_type IS NOT NULL
WHERE a.resn NOT IN ('FMN', 'FAD')""")
CHARGE = case_table(C.NEIGHBOR_CHARGE, "resn", "0.0::DOUBLE")
SPIN = case_table(C.NEIGHBOR_SPIN, "resn", "0.0::DOUBLE")


def influence(table, distance, soften):
    return f"CASE WHEN {distance} > 0 THEN {table} * greatest(0.0, (6.0 - {distance}) / 6.0) * {soften} ELSE 0.0 END"


view("nearest_sql", f"""
SELECT *, {influence(CHARGE, 'distance', 0.1)} AS energy_shift, {influence(SPIN, 'distance', 0.2)} AS spin_boost
FROM (SELECT structure_id, resn, chain, resi, atom_name, dist AS distance, x, y, z,
        row_number() OVER (PARTITION BY structure_id ORDER BY dist, line_no) AS rn FROM pocket_sql) WHERE rn = 1""")
view("proximal_sql", f"""
SELECT structure_id, resn, chain, resi, distance, atom_name FROM (
  SELECT structure_id, resn, chain, resi, dist AS distance, atom_name,
    row_number() OVER (PARTITION BY structure_id, resn, chain, resi ORDER BY dist, line_no) AS rn
  FROM pocket_sql WHERE resn IN {SCAN} AND dist <= 6) WHERE rn = 1""")
view("esp_sql", """
SELECT structure_id, line_no, 'N5' AS anchor, 1.0 / (dist_n5 + 1e-3) AS sample FROM pocket_sql WHERE dist_n5 <= 8
UNION ALL SELECT structure_id, line_no, 'O4', 1.0 / (dist_o4 + 1e-3) FROM pocket_sql WHERE dist_o4 <= 8""")


def pocket(t):
    return scanner.audit_pockets(t.atoms)


@query("a12_detect_cofactor", "SELECT * FROM detect_sql")
def _(t):
    return scanner.detect_cofactor(t.atoms)


@query("a13_cofactor_presence", f"""
WITH det AS ({detect_sql('atoms_ade')})
SELECT q.structure_id, q.target, (d.cofactor IS NOT NULL AND d.cofactor = q.target) OR EXISTS (
  SELECT 1 FROM atoms_ade a WHERE a.structure_id = q.structure_id AND a.resn = q.target) AS present
FROM (SELECT s_suppkey AS structure_id, upper(k) AS target FROM supplier, (VALUES ('fmn'), ('FAD'), ('RBF')) v(k)) q
LEFT JOIN det d ON d.structure_id = q.structure_id""")
def _(t):
    requests = t.table("supplier").select(
        F.col("s_suppkey").alias("structure_id"),
        F.explode(F.array(F.lit("fmn"), F.lit("FAD"), F.lit("RBF"))).alias("target"))
    return scanner.cofactor_presence(atoms_ade(t), requests)


@query("a05_electron_count", f"""
SELECT structure_id, CAST(sum({case_table(C.ELECTRONS, 'element', '0')}) AS BIGINT) AS electron_count FROM atoms_fx GROUP BY 1""")
def _(t):
    return scanner.pocket_frame(t.atoms).select("structure_id", "electron_count")


@query("a06_cofactor_atom_counts", """
SELECT structure_id, count(*) FILTER (resn = 'FMN') AS fmn, count(*) FILTER (resn = 'FAD') AS fad FROM atoms_fx GROUP BY 1""")
def _(t):
    counts = scanner.cofactor_atom_counts(scanner.pocket_frame(t.atoms))
    return counts.select("structure_id", *(
        F.col("cofactor_atom_counts")[k].alias(k.lower()) for k in ("FMN", "FAD")))


view("ade_detect", detect_sql("atoms_ade"))
view("ade_frame", frame_sql("atoms_ade", "ade_detect", "FAD"))
view("ade_dist", f"""
SELECT a.structure_id, min({dist('c')}) AS adenine_distance FROM atoms_ade a
JOIN ade_frame f ON f.structure_id = a.structure_id AND f.center_type IS NOT NULL WHERE a.resn = 'ADE' GROUP BY 1""")


@query("p05_cofactor_resolution", """
SELECT f.structure_id, CASE WHEN near THEN 'FAD' ELSE detected END AS detected_cofactor, 'FAD' AS flavin_type,
       'FAD' AS cofactor_mode, fad_atoms > 0 AND center_type IS NOT NULL AS geometry_check_passed,
       round(adenine_distance, 6) AS adenine_distance, near OR center_type IS NOT NULL AS force_open_shell
FROM (SELECT f.*, d.adenine_distance, coalesce(d.adenine_distance <= 15, false) AS near
      FROM ade_frame f LEFT JOIN ade_dist d ON d.structure_id = f.structure_id) f""")
def _(t):
    return scanner.resolve_cofactor(atoms_ade(t), "FAD").withColumn(
        "adenine_distance", F.round("adenine_distance", 6))


@query("j07_adenine_distance", """
SELECT structure_id, round(adenine_distance, 6) AS adenine_distance FROM ade_dist""")
def _(t):
    atoms = atoms_ade(t)
    return scanner.adenine_distance(atoms, scanner.pocket_frame(atoms, "FAD")).select(
        "structure_id", *rounded("adenine_distance"))


@query("j03_nearest_neighbour", """
SELECT structure_id, resn, chain, resi, atom_name, round(distance, 6) AS distance, x, y, z FROM nearest_sql""")
def _(t):
    _frame, distances = pocket(t)
    return scanner.nearest_neighbour(distances).select(
        "structure_id", "resn", "chain", "resi", "atom_name", *rounded("distance"), "x", "y", "z")


@query("p02_neighbour_influence", f"""
SELECT structure_id, line_no, resn, round({influence(CHARGE, 'dist', 0.1)}, 9) AS energy_shift,
       round({influence(SPIN, 'dist', 0.2)}, 9) AS spin_boost FROM pocket_sql""")
def _(t):
    _frame, distances = pocket(t)
    return distances.select(
        "structure_id", "line_no", "resn",
        F.round(R.neighbor_shift(F.col("resn"), F.col("dist")), 9).alias("energy_shift"),
        F.round(R.neighbor_spin(F.col("resn"), F.col("dist")), 9).alias("spin_boost"))


@query("a09_proximal_residues", """
SELECT structure_id, count(*) AS n_proximal, """ + ", ".join(
    f"count(*) FILTER (resn = '{n}') AS n_{n.lower()}" for n in C.SCANNED_RESIDUES) + """,
  avg(CASE WHEN resn IN ('TYR', 'GLN') THEN 1.0 ELSE 0.0 END) AS bluf_fraction,
  string_agg(resn || chain || resi || atom_name, ',' ORDER BY resn || chain || resi || atom_name) AS members
FROM proximal_sql GROUP BY 1""")
def _(t):
    _frame, distances = pocket(t)
    proximal = scanner.proximal_residues(distances)
    # Radius and residue types bound the list of one pocket.
    members = proximal.groupBy("structure_id").agg(F.array_join(F.array_sort(
        F.collect_list(F.concat("resn", "chain", "resi", "atom_name"))), ",").alias("members"))
    return scanner.proximal_counts(proximal).join(members, "structure_id")


@query("j06_anchor_samples", """
SELECT structure_id, line_no, anchor, round(sample, 9) AS sample FROM esp_sql""")
def _(t):
    _frame, distances = pocket(t)
    return scanner.esp_samples(distances).withColumn("sample", F.round("sample", 9))


view("moments_sql", """
SELECT f.structure_id, coalesce(m.m1, 0.0) AS esp_moment1, coalesce(m.m2, 0.0) AS esp_moment2, coalesce(m.m3, 0.0) AS esp_moment3
FROM frame_sql f LEFT JOIN (
  SELECT e.structure_id, any_value(a.m) AS m1, avg(pow(e.sample - a.m, 2)) AS m2, avg(pow(e.sample - a.m, 3)) AS m3
  FROM esp_sql e JOIN (SELECT structure_id, avg(sample) AS m FROM esp_sql GROUP BY 1) a ON a.structure_id = e.structure_id GROUP BY 1) m
ON m.structure_id = f.structure_id""")


@query("a07_field_moments", """
SELECT structure_id, round(esp_moment1, 9) AS esp_moment1, round(esp_moment2, 9) AS esp_moment2, round(esp_moment3, 9) AS esp_moment3
FROM moments_sql""")
def _(t):
    frame, distances = pocket(t)
    return scanner.esp_moments(frame, scanner.esp_samples(distances)).select(
        "structure_id", *rounded("esp_moment1", "esp_moment2", "esp_moment3", digits=9))


@query("a08_shell_charge", f"""
SELECT n.structure_id, round(coalesce(p.s, 0.0) + n.energy_shift, 9) AS shell_charge_sum FROM nearest_sql n LEFT JOIN (
  SELECT structure_id, sum({influence(CHARGE, 'distance', 0.1)}) AS s FROM proximal_sql GROUP BY 1) p ON p.structure_id = n.structure_id""")
def _(t):
    _frame, distances = pocket(t)
    return scanner.shell_charge(
        scanner.nearest_neighbour(distances), scanner.proximal_residues(distances)
    ).withColumn("shell_charge_sum", F.round("shell_charge_sum", 9))


@query("a10_gate_radius", """
SELECT structure_id, round(greatest(12.0, max(d)), 6) AS gate_radius FROM (
  SELECT structure_id, resn, chain, resi, min(dist_n5) AS d FROM pocket_sql GROUP BY ALL) GROUP BY 1""")
def _(t):
    _frame, distances = pocket(t)
    return scanner.gate_radius(distances).select("structure_id", *rounded("gate_radius"))


view("trp_sql", """
SELECT p.structure_id, p.chain || ':' || p.resi AS node, avg(a.x) AS x, avg(a.y) AS y, avg(a.z) AS z
FROM proximal_sql p JOIN atoms_fx a ON a.structure_id = p.structure_id AND a.resn = p.resn AND a.chain = p.chain AND a.resi = p.resi
WHERE p.resn = 'TRP' GROUP BY ALL""")
view("reach_sql", """
SELECT structure_id, node AS root, node FROM trp_sql
UNION
SELECT r.structure_id, r.root, b.node FROM reach_sql r
JOIN trp_sql a ON a.structure_id = r.structure_id AND a.node = r.node
JOIN trp_sql b ON b.structure_id = r.structure_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 10""")
view("component_sql", """
SELECT structure_id, CAST(max(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS largest_component
FROM (SELECT structure_id, root, count(*) AS n FROM reach_sql GROUP BY ALL) GROUP BY 1""")


def components(t, proximal):
    return graph.largest_component(graph.tryptophan_nodes(t.atoms, proximal))


@query("g01_tryptophan_component", "SELECT * FROM component_sql")
def _(t):
    _frame, distances = pocket(t)
    return components(t, scanner.proximal_residues(distances))


view("labels_sql", """
SELECT n.structure_id, n.resn, n.resi, n.atom_name, n.distance, coalesce(p.n_proximal, 0) AS n_proximal,
       coalesce(p.bluf_fraction, 0.0) AS bluf_fraction, n.energy_shift, n.structure_id % 7 = 0 AS forced,
       CASE WHEN n.structure_id % 7 = 0 THEN 'Radical Pair (Cryptochrome)'
            WHEN n.resn = 'CYS' AND n.distance <= 6 THEN 'LOV-Domain Thioadduct'
            WHEN coalesce(c.largest_component, 0) >= 3 THEN 'Cryptochrome-PET'
            WHEN p.bluf_fraction > 0 THEN 'BLUF-Type H-Bonding' ELSE 'Non-Canonical Binding Pocket' END AS environment_label,
       n.structure_id % 7 <> 0 AND n.resn = 'CYS' AND n.distance <= 6 AS lov_domain,
       CASE WHEN n.structure_id % 7 <> 0 AND n.resn = 'CYS' AND n.distance <= 6 THEN greatest(0.0, (6.0 - n.distance) / 6.0) ELSE 0.0 END AS cys_coupling
FROM nearest_sql n LEFT JOIN component_sql c ON c.structure_id = n.structure_id
LEFT JOIN (SELECT structure_id, count(*) AS n_proximal, avg(CASE WHEN resn IN ('TYR', 'GLN') THEN 1.0 ELSE 0.0 END) AS bluf_fraction
           FROM proximal_sql GROUP BY 1) p ON p.structure_id = n.structure_id""")


def labelled(t):
    _frame, distances = pocket(t)
    proximal = checkpoint(scanner.proximal_residues(distances))
    return scanner.label_structures(
        scanner.nearest_neighbour(distances), scanner.proximal_counts(proximal),
        components(t, proximal), F.col("structure_id") % 7 == 0)


@query("p04_environment_label", """
SELECT structure_id, environment_label, lov_domain, round(cys_coupling, 6) AS cys_coupling FROM labels_sql""")
def _(t):
    return labelled(t).select("structure_id", "environment_label", "lov_domain", *rounded("cys_coupling"))


@query("p07_confidence_score", """
SELECT structure_id, round(CASE environment_label
  WHEN 'LOV-Domain Thioadduct' THEN least(100.0, 90 + 10 * greatest(0.0, (6 - distance) / 6))
  WHEN 'Cryptochrome-PET' THEN 95.0
  WHEN 'BLUF-Type H-Bonding' THEN least(100.0, 70 + 20 * bluf_fraction + 0.1 * plddt)
  ELSE least(100.0, 60 * (1 - greatest(0.0, 1 - greatest(1, n_proximal) / 4.0)) + 0.4 * plddt) END, 6) AS scs
FROM (SELECT *, least(100.0, 50 + structure_id % 60)::DOUBLE AS plddt FROM labels_sql)""")
def _(t):
    score = rules.confidence_score(
        F.col("environment_label"), F.col("distance"), F.col("bluf_fraction"),
        F.col("n_proximal"), (50 + F.col("structure_id") % 60).cast("double"))
    return labelled(t).select("structure_id", F.round(score, 6).alias("scs"))


@query("p33_derived_energies", """
SELECT l.structure_id, round(CASE WHEN lov_domain THEN -0.03 * cys_coupling ELSE 0.0 END + energy_shift, 9) AS sulfur_shift,
       round(0.1 * esp_moment1 + 0.05 * esp_moment2, 9) AS e2_perturbation
FROM labels_sql l JOIN moments_sql m ON m.structure_id = l.structure_id""")
def _(t):
    frame, distances = pocket(t)
    moments = scanner.esp_moments(frame, scanner.esp_samples(distances))
    shift = scanner.nearest_neighbour(distances).select("structure_id", "energy_shift")
    joined = labelled(t).join(shift, "structure_id").join(moments, "structure_id")
    return joined.select(
        "structure_id",
        F.round(rules.sulfur_shift(F.col("lov_domain"), F.col("cys_coupling"),
                                   F.col("energy_shift")), 9).alias("sulfur_shift"),
        F.round(rules.perturbation_energy(F.col("esp_moment1"), F.col("esp_moment2")), 9)
        .alias("e2_perturbation"))


@query("f12_message_text", """
SELECT structure_id, printf('%s%s-%s found at %.2f Å', resn, resi, atom_name, distance) AS nearest_atom_report,
       concat(CASE WHEN lov_domain THEN 'Electronic singlet–triplet crossing detected' ELSE 'No singlet–triplet crossing detected' END,
              ' (criteria: gap<0.01, spin>0.4)') AS crossing_text
FROM labels_sql""")
def _(t):
    return labelled(t).select(
        "structure_id",
        rules.nearest_report(*(F.col(c) for c in ("resn", "resi", "atom_name", "distance")))
        .alias("nearest_atom_report"),
        rules.crossing_message(F.col("lov_domain"), F.lit("gap<0.01, spin>0.4"))
        .alias("crossing_text"))


@query("j17_clash_pairs", """
WITH c AS (SELECT structure_id, chain, resi, icode, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atoms_fx
           WHERE CAST(resi AS INTEGER) % 10 = structure_id % 10 GROUP BY ALL),
     n AS (SELECT DISTINCT a.structure_id, a.line_no, a.x, a.y, a.z FROM atoms_fx a JOIN c ON c.structure_id = a.structure_id
            AND sqrt((a.x - cx) * (a.x - cx) + (a.y - cy) * (a.y - cy) + (a.z - cz) * (a.z - cz)) <= 6)
SELECT DISTINCT n.structure_id, least(n.line_no, b.line_no) AS first_line, greatest(n.line_no, b.line_no) AS second_line,
       round(sqrt((b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) + (b.z - n.z) * (b.z - n.z)), 6) AS distance
FROM n JOIN atoms_fx b ON b.structure_id = n.structure_id AND b.line_no <> n.line_no
 AND sqrt((b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) + (b.z - n.z) * (b.z - n.z)) < 1.2
 AND sqrt((b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) + (b.z - n.z) * (b.z - n.z)) > 0.001""")
def _(t):
    targets = spatial.residues(
        t.atoms.where(F.col("resi").cast("int") % 10 == F.col("structure_id") % 10),
        spatial.POSITION)
    return spatial.clash_pairs(t.atoms, targets).withColumn("distance", F.round("distance", 6))

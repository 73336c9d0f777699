"""Mutation lists, keys, validation, effects, structure edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as C, hashing, mutation_exprs as M, rules
from ...operators import environment, mutations, structure_edit
from ...sources import structure_text as text
from ..registry import query, view
from .structures import aa1, case_table, listed, rounded

AA20 = listed(C.CANONICAL_AA)
PATTERN = "^([A-Za-z])?([0-9]+)([A-Za-z]?)([A-Za-z])$"

view("token_sql", "SELECT set_id, structure_id, unnest(string_split_regex(raw, '[,\\s]+')) AS tok FROM mutlist_fx")
view("mut_sql", f"""
SELECT set_id, structure_id, tok AS raw, chain, chain_explicit,
       coalesce(nullif(ltrim(regexp_extract(body, '{PATTERN}', 2), '0'), ''), '0') AS resseq,
       CASE WHEN regexp_extract(body, '{PATTERN}', 3) = '' THEN ' ' ELSE regexp_extract(body, '{PATTERN}', 3) END AS icode,
       upper(regexp_extract(body, '{PATTERN}', 1)) AS wt, upper(regexp_extract(body, '{PATTERN}', 4)) AS mut,
       CASE WHEN NOT regexp_matches(body, '{PATTERN}') THEN 'unparsable'
            WHEN regexp_extract(body, '{PATTERN}', 1) = '' THEN 'missing wild type'
            WHEN upper(regexp_extract(body, '{PATTERN}', 1)) NOT IN {AA20} OR upper(regexp_extract(body, '{PATTERN}', 4)) NOT IN {AA20}
            THEN 'not canonical' END AS reason
FROM (SELECT *, CASE WHEN contains(tok, ':') THEN split_part(tok, ':', 1) ELSE '?' END AS chain, contains(tok, ':') AS chain_explicit,
             CASE WHEN contains(tok, ':') THEN split_part(tok, ':', 2) ELSE tok END AS body FROM token_sql WHERE tok <> '')""")
view("good_sql", """
SELECT *, chain || ':' || wt || resseq || trim(icode) || mut AS token,
       CASE WHEN chain_explicit THEN chain || ':' ELSE '' END || wt || resseq || trim(icode) || mut AS display
FROM mut_sql WHERE reason IS NULL""")
ORDER = "chain, CAST(resseq AS INTEGER), trim(icode), wt, mut"
view("set_sql", f"""
SELECT m.set_id, m.structure_id, coalesce(string_agg(g.token, '_' ORDER BY g.chain, CAST(g.resseq AS INTEGER), trim(g.icode), g.wt, g.mut), 'WT') AS canonical_key,
       coalesce(string_agg(g.display, '_' ORDER BY g.chain, CAST(g.resseq AS INTEGER), trim(g.icode), g.wt, g.mut), 'WT') AS display_key,
       coalesce(string_agg(g.token, ',' ORDER BY g.token), 'WT') AS sorted_tokens, count(g.token) AS n_mutations,
       coalesce(sum({case_table(C.ELECTRONEGATIVITY, 'g.mut', '0.0::DOUBLE')}) FILTER (g.mut IS NOT NULL), 0.0) AS lfp,
       coalesce(sum({case_table(C.STERIC_INDEX, 'g.mut', '0.0::DOUBLE')}) FILTER (g.mut IS NOT NULL), 0.0) AS steric,
       coalesce(sum({case_table(C.STERIC_INDEX, 'g.mut', '0.0::DOUBLE')} - {case_table(C.STERIC_INDEX, 'g.wt', '0.0::DOUBLE')}) FILTER (g.mut IS NOT NULL), 0.0) AS volume_delta,
       coalesce(max({case_table(C.STERIC_INDEX, 'g.wt', '0.0::DOUBLE')}) FILTER (g.mut IS NOT NULL), 0.0) AS wt_reference,
       coalesce(bool_or(g.wt IN ('P', 'I') AND g.mut IN ('H', 'Y')), false) AS hybridisation_change,
       coalesce(product({case_table({k: 1 + v for k, v in C.MUTATION_ELECTRO_SHIFT.items()}, 'g.mut', '1.0::DOUBLE')}) FILTER (g.mut IS NOT NULL), 1.0) AS electro,
       coalesce(product({case_table(C.MUTATION_VIB_DAMPING, 'g.mut', '1.0::DOUBLE')}) FILTER (g.mut IS NOT NULL), 1.0) AS vib,
       coalesce(bool_or(g.resseq IN ('39', '40')), false) AS strained, coalesce(bool_or(g.resseq = '42' AND g.mut = 'C'), false) AS to_cys
FROM mutlist_fx m LEFT JOIN good_sql g ON g.set_id = m.set_id GROUP BY ALL""")


def sets(t):
    return mutations.parse_lists(t.mutlists)


def muts():
    return F.col("mutations")


@query("f01_parse_mutations", """
SELECT set_id, raw, chain_explicit, coalesce(reason, 'ok') AS status,
  CASE WHEN reason IS NULL THEN chain END AS chain, CASE WHEN reason IS NULL THEN resseq END AS resseq,
  CASE WHEN reason IS NULL THEN icode END AS icode, CASE WHEN reason IS NULL THEN wt END AS wt, CASE WHEN reason IS NULL THEN mut END AS mut
FROM mut_sql""")
def _(t):
    parsed = t.mutlists.select("set_id", F.explode(M.parse_list(F.col("raw"))).alias("m"))
    good = F.col("m.reason").isNull()
    return parsed.select(
        "set_id", "m.raw", "m.chain_explicit",
        F.coalesce("m.reason", F.lit("ok")).alias("status"),
        *(F.when(good, F.col(f"m.{f}")).alias(f) for f in ("chain", "resseq", "icode", "wt", "mut")))


@query("f02_tokens", "SELECT set_id, token, display FROM good_sql")
def _(t):
    rows = sets(t).select("set_id", F.explode("mutations").alias("m"))
    return rows.select("set_id", M.canonical_token(F.col("m")).alias("token"),
                       M.display_token(F.col("m")).alias("display"))


@query("f03_set_keys", "SELECT set_id, canonical_key, display_key FROM set_sql")
def _(t):
    return sets(t).select("set_id", M.canonical_key(muts()).alias("canonical_key"),
                          M.display_key(muts()).alias("display_key"))


@query("f04_feature_hash", """
SELECT pdb_id, sha256(printf('flex:%.8f|hb:%.8f|iso:%.8f|st_gap:%.8f|%s', flex, hb_cap, iso, st_gap, cofactor)) AS feature_hash FROM eval_fx""")
def _(t):
    features = F.create_map(F.lit("iso"), F.col("iso"), F.lit("hb"), F.col("hb_cap"),
                            F.lit("flex"), F.col("flex"), F.lit("st_gap"), F.col("st_gap"))
    return t.evals.select("pdb_id", hashing.feature_hash(features, F.col("cofactor")).alias("feature_hash"))


@query("f05_run_key", """
SELECT set_id, sha256(concat_ws('|', 'S' || CAST(structure_id AS VARCHAR), 'FMN', canonical_key, 'len:' || CAST(n_mutations AS VARCHAR), sorted_tokens, 'm')) AS run_key
FROM set_sql""")
def _(t):
    return sets(t).select("set_id", hashing.run_key(
        F.concat(F.lit("S"), F.col("structure_id").cast("string")), F.lit("FMN"), muts(),
        F.lit("m")).alias("run_key"))


def words_sql(col, when="true"):
    return " || '|' || ".join(
        f"CAST(sum(CASE WHEN {when} THEN ('0x' || substring(sha256({col}), {1 + 8 * i}, 8))::HUGEINT ELSE 0 END) AS VARCHAR)"
        for i in range(4)) + f" || '|' || CAST(count(*) FILTER ({when}) AS VARCHAR)"


@query("f06_structure_hashes", f"""
WITH c AS (SELECT structure_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM parsed_sql GROUP BY 1),
     j AS (SELECT a.structure_id, a.line_no, printf('%.3f %.3f %.3f', x, y, z) AS txt,
             sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) <= 12 AS inside FROM parsed_sql a JOIN c ON c.structure_id = a.structure_id),
     k AS (SELECT *, concat(row_number() OVER (PARTITION BY structure_id, inside ORDER BY line_no), '|', txt) AS placed FROM j),
     n AS (SELECT structure_id, atom, concat(row_number() OVER (PARTITION BY structure_id ORDER BY line_no), '|', value) AS placed,
             concat(row_number() OVER (PARTITION BY structure_id, atom ORDER BY line_no), '|', value) AS atom_placed
           FROM (SELECT *, value LIKE 'ATOM%' OR value LIKE 'HETATM%' AS atom FROM lines_fx))
SELECT l.structure_id, l.structure_hash, l.atom_hash, q.coordinate_hash, q.n_atoms FROM (
  SELECT structure_id, sha256({words_sql('placed')}) AS structure_hash,
         sha256({words_sql('atom_placed', 'atom')}) AS atom_hash FROM n GROUP BY 1) l
JOIN (SELECT structure_id, sha256({words_sql('placed', 'inside')}) AS coordinate_hash, count(*) FILTER (inside) AS n_atoms FROM k GROUP BY 1) q
  ON q.structure_id = l.structure_id""")
def _(t):
    return structure_edit.structure_hashes(t.lines).join(
        structure_edit.coordinate_hashes(text.scan_atoms(t.lines)), "structure_id")


def byte_sql(i):
    h = f"('0x' || substring(sha256(token), {1 + 2 * i}, 2))::BIGINT"
    return f"round((({h} % 7) - 3) * 0.05::DOUBLE, 6)"


@query("f07_shift_vector", f"""
SELECT DISTINCT token, {byte_sql(0)} AS dx, {byte_sql(1)} AS dy, {byte_sql(2)} AS dz FROM good_sql""")
def _(t):
    tokens = sets(t).select(F.explode("mutations").alias("m")).select(
        M.canonical_token(F.col("m")).alias("token")).distinct()
    shift = hashing.shift_vector(F.col("token"))
    return tokens.select("token", *(F.round(s, 6).alias(n) for s, n in zip(shift, ("dx", "dy", "dz"))))


view("index_sql", "SELECT structure_id, chain, resi, icode, min_by(resn, line_no) AS resn, count(*) AS atom_count FROM atoms_fx GROUP BY ALL")
view("default_chain_sql", """
SELECT structure_id, chain AS default_chain, n AS atom_count FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY n DESC, chain) AS rn
  FROM (SELECT structure_id, chain, count(*) AS n FROM atoms_fx GROUP BY ALL)) WHERE rn = 1""")


def index(t):
    return text.index_residues(t.atoms)


@query("a11_default_chain", "SELECT * FROM default_chain_sql")
def _(t):
    return mutations.default_chains(index(t)).withColumn("atom_count", F.col("atom_count").cast("bigint"))


@query("j08_validate_mutations", f"""
SELECT set_id, structure_id, chain, resseq, icode, wt, mut, raw, coalesce(re, rb) AS resn,
       CASE WHEN coalesce(re, rb) IS NULL THEN 'residue not found' WHEN {aa1('coalesce(re, rb)')} <> wt THEN 'wild type mismatch' END AS reason
FROM (SELECT g.*, e.resn AS re, b.resn AS rb FROM (
        SELECT g.* REPLACE (CASE WHEN g.chain = '?' THEN coalesce(d.default_chain, '?') ELSE g.chain END AS chain)
        FROM good_sql g LEFT JOIN default_chain_sql d ON d.structure_id = g.structure_id) g
      LEFT JOIN index_sql e ON e.structure_id = g.structure_id AND e.chain = g.chain AND e.resi = g.resseq AND e.icode = g.icode
      LEFT JOIN index_sql b ON b.structure_id = g.structure_id AND b.chain = g.chain AND b.resi = g.resseq AND b.icode = ' ')""")
def _(t):
    return mutations.validate(sets(t), index(t), ["set_id"])


@query("a22_effect_sums", "SELECT set_id, round(lfp, 6) AS lfp, round(steric, 6) AS steric FROM set_sql")
def _(t):
    lfp, steric = M.effect_sums(muts())
    return sets(t).select("set_id", F.round(lfp, 6).alias("lfp"), F.round(steric, 6).alias("steric"))


@query("a23_effect_factors", "SELECT set_id, round(electro, 6) AS electro, round(vib, 6) AS vib FROM set_sql")
def _(t):
    electro, vib = M.effect_factors(muts())
    return sets(t).select("set_id", F.round(electro, 6).alias("electro"), F.round(vib, 6).alias("vib"))


@query("a24_volume_change", """
SELECT set_id, round(volume_delta, 6) AS volume_delta, round(wt_reference, 6) AS wt_reference, hybridisation_change FROM set_sql""")
def _(t):
    parts = M.volume_change(muts())
    return sets(t).select("set_id", F.round(parts["volume_delta"], 6).alias("volume_delta"),
                          F.round(parts["wt_reference"], 6).alias("wt_reference"),
                          parts["hybridisation_change"].alias("hybridisation_change"))


@query("p19_adjusted_features", """
SELECT s.set_id, round(coalesce(e.iso, 0.0) + f.lfp + s.lfp, 6) AS iso, round(coalesce(e.hb_cap, 0.0) + 0.5 * (f.steric + s.steric), 6) AS hb_cap,
       round(coalesce(e.flex, 0.0) * (1 + 0.02 * s.n_mutations), 10) AS flex
FROM set_sql s JOIN lfp_sql f ON f.structure_id = s.structure_id LEFT JOIN env_sql e ON e.structure_id = s.structure_id""")
def _(t):
    lfp, steric = M.effect_sums(muts())
    features = environment.environment_features(t.atoms)
    field = environment.local_field(t.atoms)
    adjusted = rules.mutation_adjusted(
        F.col("iso"), F.col("hb_cap"), F.col("flex"), F.col("lfp") + lfp,
        F.col("steric") + steric, F.size("mutations"))
    return sets(t).join(features, "structure_id").join(field, "structure_id").select(
        "set_id", F.round(adjusted["iso"], 6).alias("iso"),
        F.round(adjusted["hb_cap"], 6).alias("hb_cap"), F.round(adjusted["flex"], 10).alias("flex"))


@query("p21_adjusted_gap", f"""
SELECT set_id, round(gap, 6) AS st_gap_ev, round(gap / 0.35 * 150, 6) AS brightness FROM (
  SELECT m.set_id, greatest(0.35 + coalesce(e, 0.0) - 0.02 * coalesce(s, 0.0), 0.01) AS gap FROM mutlist_fx m LEFT JOIN (
    SELECT set_id, sum({case_table(C.ELECTRONEGATIVITY_DISPLAY, 'aa', '0.0::DOUBLE')}) AS e, sum({case_table(C.STERIC_INDEX, 'aa', '0.0::DOUBLE')}) AS s
    FROM (SELECT set_id, upper(right(trim(p), 1)) AS aa FROM (SELECT set_id, unnest(string_split(raw, ',')) AS p FROM mutlist_fx) WHERE length(trim(p)) >= 3)
    GROUP BY 1) x ON x.set_id = m.set_id)""")
def _(t):
    gap = rules.adjusted_gap(*M.display_effects(F.col("raw")))
    return t.mutlists.select("set_id", gap.alias("gap")).select(
        "set_id", F.round("gap", 6).alias("st_gap_ev"),
        F.round(rules.brightness_from_gap(F.col("gap")), 6).alias("brightness"))


@query("p33_strain_and_scaling", """
SELECT set_id, round(CASE WHEN strained THEN abs(steric) + 0.5 ELSE 0.0 END, 6) AS strain, to_cys FROM set_sql""")
def _(t):
    _lfp, steric = M.effect_sums(muts())
    return sets(t).select(
        "set_id", F.round(M.strain_energy(muts(), steric, ("39", "40")), 6).alias("strain"),
        M.has_substitution(muts(), ("42",), "C").alias("to_cys"))


view("exclude_sql", """
SELECT structure_id, tok FROM (SELECT s_suppkey AS structure_id, CAST(s_suppkey % 60 AS VARCHAR) AS tok FROM supplier
UNION ALL SELECT s_suppkey, 'A:' || CAST((s_suppkey * 7 + 3) % 60 AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, ' R : 5 ' FROM supplier)""")


def exclusions(t):
    key = F.col("s_suppkey")
    return t.table("supplier").select(key.alias("structure_id"), F.explode(F.array(
        (key % 60).cast("string"),
        F.concat(F.lit("A:"), ((key * 7 + 3) % 60).cast("string")),
        F.lit(" R : 5 "))).alias("token"))


@query("p25_exclusions", """
SELECT i.* FROM index_sql i WHERE NOT EXISTS (SELECT 1 FROM exclude_sql e WHERE e.structure_id = i.structure_id AND (
  e.tok = i.resi OR (contains(e.tok, ':') AND trim(split_part(e.tok, ':', 1)) = i.chain AND trim(split_part(e.tok, ':', 2)) = i.resi)))""")
def _(t):
    return mutations.exclude_positions(index(t), exclusions(t)).select(
        "structure_id", "chain", "resi", "icode", "resn", "atom_count")


# --- structure edits: one target chain-and-number pair per structure ----------
view("target_sql", """
SELECT structure_id, chain, resi, icode, mut FROM (
  SELECT DISTINCT structure_id, chain, resi, icode, split_part('F,W,Y,H,V,K,C', ',', CAST(CAST(resi AS BIGINT) % 7 AS INTEGER) + 1) AS mut
  FROM atoms_fx WHERE CAST(resi AS BIGINT) % 12 = structure_id % 12
  UNION ALL SELECT s_suppkey, 'Z', '5', ' ', 'F' FROM supplier)""")
view("full_sql", """
SELECT structure_id, line_no, record, atom_name, altloc, resn, chain, resi, icode, x, y, z, tail
FROM records_sql WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""")
THREE = case_table(C.ONE_TO_THREE, "mut", "mut")


def template_rows():
    out = []
    for aa in "FWYHVKC":
        template = C.SIDE_CHAIN_TEMPLATES.get(aa, C.DEFAULT_SIDE_CHAIN)
        for i, (name, (x, y, z)) in enumerate(template.items(), 1):
            out.append(f"('{aa}', {i}, '{name}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)")
    return ", ".join(out)


def shift_sql(i):
    h = f"('0x' || substring(sha256(concat(chain, ':', resi, p.mut)), {1 + 2 * i}, 2))::BIGINT"
    return f"(({h} % 7) - 3) * 0.05::DOUBLE"


view("edited_sql", f"""
SELECT f.structure_id, f.line_no, 0 AS sub_line, f.record, f.atom_name, f.altloc,
       CASE WHEN t.mut IS NULL THEN f.resn ELSE {THREE.replace('CASE mut', 'CASE t.mut').replace('ELSE mut', 'ELSE t.mut')} END AS resn,
       f.chain, f.resi, f.icode, f.x, f.y, f.z, f.tail
FROM full_sql f LEFT JOIN target_sql t ON t.structure_id = f.structure_id AND t.chain = f.chain AND t.resi = f.resi AND t.icode = f.icode
WHERE t.mut IS NULL OR f.atom_name IN {listed(C.BACKBONE_ATOMS)}
UNION ALL
SELECT structure_id, line_no, i, 'ATOM', name, ' ', {THREE.replace('CASE mut', 'CASE p.mut').replace('ELSE mut', 'ELSE p.mut')}, chain, resi, icode,
       cx + (dx + {shift_sql(0)}), cy + (dy + {shift_sql(1)}), cz + (dz + {shift_sql(2)}), '  1.00 20.00           C'
FROM (SELECT f.structure_id, f.chain, f.resi, f.icode, t.mut, max(f.line_no) AS line_no,
        coalesce(min_by(f.x, f.line_no) FILTER (f.atom_name = 'CA'), avg(f.x)) AS cx,
        coalesce(min_by(f.y, f.line_no) FILTER (f.atom_name = 'CA'), avg(f.y)) AS cy,
        coalesce(min_by(f.z, f.line_no) FILTER (f.atom_name = 'CA'), avg(f.z)) AS cz
      FROM full_sql f JOIN target_sql t ON t.structure_id = f.structure_id AND t.chain = f.chain AND t.resi = f.resi AND t.icode = f.icode GROUP BY ALL) p
JOIN (VALUES {template_rows()}) v(mut, i, name, dx, dy, dz) ON v.mut = p.mut""")


def targets(t):
    resi = F.col("resi").cast("bigint")
    letters = F.split(F.lit("F,W,Y,H,V,K,C"), ",")
    chosen = t.atoms.where(resi % 12 == F.col("structure_id") % 12).select(
        "structure_id", "chain", "resi", "icode",
        F.get(letters, (resi % 7).cast("int")).alias("mut")).distinct()
    absent = t.table("supplier").select(
        F.col("s_suppkey").alias("structure_id"), F.lit("Z").alias("chain"),
        F.lit("5").alias("resi"), F.lit(" ").alias("icode"), F.lit("F").alias("mut"))
    return chosen.unionByName(absent)


@query("f08_apply_mutations", """
SELECT structure_id, line_no, sub_line, record, atom_name, resn, chain, resi, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM edited_sql""")
def _(t):
    return structure_edit.apply_mutations(text.scan_records(t.lines), targets(t)).select(
        "structure_id", "line_no", "sub_line", "record", "atom_name", "resn", "chain", "resi",
        *rounded("x", "y", "z"))


@query("f09_check_edit", """
WITH b AS (SELECT structure_id, chain, resi, icode, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM full_sql GROUP BY ALL),
     a AS (SELECT structure_id, chain, resi, icode, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM edited_sql GROUP BY ALL)
SELECT *, CASE WHEN n_wt IS NULL OR n_mut IS NULL THEN 'target not touched' WHEN n_wt = n_mut AND moved < 1e-3 THEN 'structure build failure' ELSE 'ok' END AS verdict
FROM (SELECT t.structure_id, t.chain, t.resi, t.icode, b.n AS n_wt, a.n AS n_mut,
        round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS moved
      FROM target_sql t LEFT JOIN b ON b.structure_id = t.structure_id AND b.chain = t.chain AND b.resi = t.resi AND b.icode = t.icode
      LEFT JOIN a ON a.structure_id = t.structure_id AND a.chain = t.chain AND a.resi = t.resi AND a.icode = t.icode)""")
def _(t):
    before = text.scan_records(t.lines)
    after = structure_edit.apply_mutations(before, targets(t))
    return structure_edit.check_edit(before, after, targets(t)).withColumn("moved", F.round("moved", 6))


@query("f10_render_lines", """
SELECT structure_id, serial_no, printf('%-6s%5d %s%1s%3s %s%4s%1s   %8.3f%8.3f%8.3f%s', record, serial_no,
       rpad(repeat(' ', CAST((4 - length(atom_name)) // 2 AS BIGINT)) || atom_name, 4, ' '), altloc, resn, chain, resi, icode, x, y, z, tail) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY line_no) AS serial_no FROM full_sql)""")
def _(t):
    records = text.scan_records(t.lines).withColumn("sub_line", F.lit(0))
    return structure_edit.render_lines(records)


# The small step keeps coordinates away from decimal ties, where engines round apart.
@query("f10_render_edited", """
SELECT structure_id, serial_no, printf('%-6s%5d %s%1s%3s %s%4s%1s   %8.3f%8.3f%8.3f%s', record, serial_no,
       rpad(repeat(' ', CAST((4 - length(atom_name)) // 2 AS BIGINT)) || atom_name, 4, ' '), altloc, resn, chain, resi, icode, x + 0.0000137, y + 0.0000137, z + 0.0000137, tail) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY line_no, sub_line, atom_name) AS serial_no FROM edited_sql)""")
def _(t):
    edited = structure_edit.apply_mutations(text.scan_records(t.lines), targets(t))
    return structure_edit.render_lines(edited.withColumns({a: F.col(a) + 0.0000137 for a in "xyz"}))

"""Candidate pools, scores, beam search and recommendation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as C, hashing, residues as R, rules, scoring
from ...operators import candidates, evaluated, recommend, sites, spatial
from ...session import checkpoint
from ..registry import query, view
from .mutation_sets import exclusions
from .structures import COF, aa1, case_table, listed, rounded

view("burial_sql", """
SELECT c.structure_id, c.chain, c.resi, c.icode, count(n.oc) AS burial
FROM (SELECT DISTINCT structure_id, chain, resi, icode FROM atoms_fx) c LEFT JOIN (
  SELECT DISTINCT c.structure_id, c.chain, c.resi, c.icode, a.chain AS oc, a.resi AS ori, a.icode AS oi
  FROM (SELECT structure_id, chain, resi, icode, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atoms_fx GROUP BY ALL) c
  JOIN atoms_fx a ON a.structure_id = c.structure_id AND NOT (a.chain = c.chain AND a.resi = c.resi AND a.icode = c.icode)
   AND sqrt((a.x - c.cx) * (a.x - c.cx) + (a.y - c.cy) * (a.y - c.cy) + (a.z - c.cz) * (a.z - c.cz)) < 6) n
ON n.structure_id = c.structure_id AND n.chain = c.chain AND n.resi = c.resi AND n.icode = c.icode GROUP BY ALL""")

for _r in (8, 12):
    view(f"dist{_r}_sql", f"""
SELECT a.structure_id, a.chain, a.resi, a.icode,
       min(sqrt((a.x - k.cx) * (a.x - k.cx) + (a.y - k.cy) * (a.y - k.cy) + (a.z - k.cz) * (a.z - k.cz))) AS min_dist
FROM pick{_r}_sql k JOIN atoms_fx a ON a.structure_id = k.structure_id AND a.resn NOT IN {COF} GROUP BY ALL""")
    view(f"shell{_r}_sql", f"""
SELECT structure_id, chain, resi, icode, min_dist FROM (
  SELECT *, count(*) FILTER (min_dist <= {_r}) OVER (PARTITION BY structure_id) AS inside,
         row_number() OVER (PARTITION BY structure_id ORDER BY min_dist, chain, CAST(resi AS INTEGER), resi, icode) AS rn FROM dist{_r}_sql)
WHERE (inside > 0 AND min_dist <= {_r}) OR (inside = 0 AND rn <= 24)""")

view("shells_sql", """
SELECT *, 0.0::DOUBLE AS penalty FROM shell8_sql
UNION ALL SELECT *, 0.35::DOUBLE FROM shell12_sql o WHERE min_dist <= 12 AND NOT EXISTS (SELECT 1 FROM shell8_sql i
  WHERE i.structure_id = o.structure_id AND i.chain = o.chain AND i.resi = o.resi AND i.icode = o.icode)""")
view("open_sql", f"""
SELECT s.*, i.resn, {aa1('i.resn')} AS wt, b.burial FROM shells_sql s
JOIN index_sql i ON i.structure_id = s.structure_id AND i.chain = s.chain AND i.resi = s.resi AND i.icode = s.icode
JOIN burial_sql b ON b.structure_id = s.structure_id AND b.chain = s.chain AND b.resi = s.resi AND b.icode = s.icode
WHERE NOT (i.resn = 'CYS' AND s.min_dist < 4.0) AND NOT EXISTS (SELECT 1 FROM exclude_sql e WHERE e.structure_id = s.structure_id AND (
  e.tok = s.resi OR (contains(e.tok, ':') AND trim(split_part(e.tok, ':', 1)) = s.chain AND trim(split_part(e.tok, ':', 2)) = s.resi)))""")
OPEN = sorted({*C.HYDROPHOBIC, *C.POLAR, "K", "R"})
BURIED = sorted({*C.HYDROPHOBIC, "H", "Y"})


def table(values, key, default):
    return case_table(values, key, f"{default}::DOUBLE")


def score_sql(wt, mut, dist, burial):
    return f"""1.35 * ({table(C.ELECTRONEGATIVITY, mut, 0.0)} - {table(C.ELECTRONEGATIVITY, wt, 0.0)})
 + CASE WHEN {mut} IN {listed(C.AROMATIC)} THEN 0.45 ELSE 0 END + CASE WHEN {mut} IN {listed(C.POLAR)} THEN 0.18 ELSE 0 END
 + CASE WHEN {mut} IN ('K', 'R') THEN 0.12 ELSE 0 END + 0.90 * greatest(0.0, 1 - least({dist}, 12.0) / 12)
 - 0.20 * abs({table(C.STERIC_INDEX, mut, 0.7)} - {table(C.STERIC_INDEX, wt, 0.7)}) - 0.10 * greatest(0, {burial} - 8)"""


view("choice_sql", f"""
SELECT *, CAST({score_sql('wt', 'mut', 'min_dist', 'burial')} - penalty AS DOUBLE) AS score,
       chain || ':' || wt || resi || trim(icode) || mut AS token
FROM (SELECT o.*, v.mut FROM open_sql o JOIN (
  SELECT unnest(string_split('{",".join(OPEN)}', ',')) AS mut, false AS buried
  UNION ALL SELECT unnest(string_split('{",".join(BURIED)}', ',')), true) v ON v.buried = (o.burial > 6) AND v.mut <> o.wt)""")
view("pool_sql", """
SELECT structure_id, chain, resi, icode, wt, mut, min_dist, burial, token, score FROM (
  SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resi, icode ORDER BY round(score, 9) DESC, token) AS rn FROM choice_sql) WHERE rn <= 3""")


def pool(t):
    return candidates.candidate_pool(t.atoms, exclusions(t))


@query("u06_shells", """
SELECT structure_id, chain, resi, icode, round(min_dist, 6) AS min_dist, penalty FROM shells_sql""")
def _(t):
    return candidates.shells(t.atoms).withColumn("min_dist", F.round("min_dist", 6))


@query("p26_protect_cysteine", """
SELECT s.structure_id, s.chain, s.resi, s.icode, i.resn, round(s.min_dist, 6) AS min_dist FROM shell12_sql s
JOIN index_sql i ON i.structure_id = s.structure_id AND i.chain = s.chain AND i.resi = s.resi AND i.icode = s.icode
WHERE NOT (i.resn = 'CYS' AND s.min_dist < 4.0)""")
def _(t):
    from ...operators.sites import shell_residues
    sites = shell_residues(t.atoms, 12.0).join(
        candidates.residue_names(t.atoms), spatial.POSITION)
    return candidates.protect_close_cysteine(sites).select(
        *spatial.POSITION, "resn", *rounded("min_dist"))


@query("u05_allowed_substitutions", f"""
SELECT i.structure_id, i.chain, i.resi, i.icode, array_to_string(list_filter(string_split(CASE WHEN b.burial > 6 THEN '{",".join(BURIED)}' ELSE '{",".join(OPEN)}' END, ','),
       lambda m: m <> {aa1('i.resn')}), ',') AS choices
FROM index_sql i JOIN burial_sql b ON b.structure_id = i.structure_id AND b.chain = i.chain AND b.resi = i.resi AND b.icode = i.icode""")
def _(t):
    joined = candidates.residue_names(t.atoms).join(spatial.burial(t.atoms), spatial.POSITION)
    choices = scoring.allowed_substitutions(R.aa_code(F.col("resn")), F.col("burial"))
    return joined.select(*spatial.POSITION, F.array_join(choices, ",").alias("choices"))


PAIR_SQL = f"""
SELECT structure_id, line_no, wt, mut, dist, burial FROM (
  SELECT structure_id, line_no, {aa1('resn')} AS wt, split_part('{",".join(C.CANONICAL_AA)}', ',', CAST(line_no % 20 AS INTEGER) + 1) AS mut,
         x / 4 AS dist, CAST(line_no % 13 AS BIGINT) AS burial FROM atoms_fx)"""


def pairs(t):
    letters = F.array(*map(F.lit, C.CANONICAL_AA))
    return t.atoms.select(
        "structure_id", "line_no", R.aa_code(F.col("resn")).alias("wt"),
        F.get(letters, (F.col("line_no") % 20).cast("int")).alias("mut"),
        (F.col("x") / 4).alias("dist"), (F.col("line_no") % 13).alias("burial"))


@query("p28_candidate_score", f"""
SELECT structure_id, line_no, round(CAST({score_sql('wt', 'mut', 'dist', 'burial')} AS DOUBLE), 9) AS score FROM ({PAIR_SQL})""")
def _(t):
    score = scoring.candidate_score(*(F.col(c) for c in ("wt", "mut", "dist", "burial")))
    return pairs(t).select("structure_id", "line_no", F.round(score, 9).alias("score"))


RISKS = f"""
SELECT structure_id, line_no, 2.0 + CASE WHEN mut IN ('K', 'R') THEN 1 ELSE 0 END + CASE WHEN mut IN ('F', 'Y', 'W') THEN 0.5 ELSE 0 END AS gain,
       greatest(0, burial - 6) + CASE WHEN mut IN ('W', 'Y') THEN 1.0 ELSE 0.0 END AS clash,
       CASE WHEN burial > 8 AND mut IN ('K', 'R', 'D', 'E') THEN 2.0 ELSE 0.0 END + CASE WHEN wt = 'G' AND mut NOT IN ('A', 'G', 'S') THEN 1.5 ELSE 0.0 END AS stability
FROM ({PAIR_SQL})"""


@query("p27_risk_rules", f"SELECT structure_id, line_no, gain::DOUBLE AS gain, clash::DOUBLE AS clash, stability::DOUBLE AS stability FROM ({RISKS})")
def _(t):
    wt, mut, buried = F.col("wt"), F.col("mut"), F.col("burial")
    return pairs(t).select(
        "structure_id", "line_no", scoring.brightness_gain(mut).alias("gain"),
        scoring.clash_risk(mut, buried).alias("clash"),
        scoring.stability_risk(wt, mut, buried).alias("stability"))


@query("p29_total_score", f"""
SELECT structure_id, line_no, round((gain - 0.5 * clash - 0.7 * stability + 0.3 * 50 + 0.2 * (gain / 10))::DOUBLE, 6) AS total_score,
       round((gain - 0.5 * (100 - clash) - 0.7 * stability + 0.3 * 50)::DOUBLE, 6) AS inverted FROM ({RISKS})""")
def _(t):
    wt, mut, buried = F.col("wt"), F.col("mut"), F.col("burial")
    gain = scoring.brightness_gain(mut)
    clash, stability = scoring.clash_risk(mut, buried), scoring.stability_risk(wt, mut, buried)
    return pairs(t).select(
        "structure_id", "line_no",
        F.round(scoring.total_score(gain, clash, stability, F.lit(50.0), gain / 10), 6).alias("total_score"),
        F.round(scoring.total_score(gain, clash, stability, F.lit(50.0), clear_is_bad=False), 6).alias("inverted"))


@query("w02_site_substitutions", """
SELECT structure_id, chain, resi, icode, wt, mut, burial, token, round(score, 6) AS score FROM pool_sql""")
def _(t):
    sites = candidates.candidate_sites(t.atoms, exclusions(t))
    return candidates.site_substitutions(sites).select(
        *spatial.POSITION, "wt", "mut", "burial", "token", *rounded("score"))


@query("w03_best_per_token", """
SELECT structure_id, token, round(max(score), 6) AS score FROM (
  SELECT structure_id, token, score FROM pool_sql UNION ALL SELECT structure_id, token, score - 0.35 FROM pool_sql WHERE burial > 4) GROUP BY ALL""")
def _(t):
    sites = candidates.site_substitutions(candidates.candidate_sites(t.atoms, exclusions(t)))
    second = sites.where(F.col("burial") > 4).withColumn("score", F.col("score") - 0.35)
    return candidates.best_per_token(sites.unionByName(second)).select(
        "structure_id", "token", *rounded("score"))


@query("w04_candidate_ranking", """
SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY round(score, 9) DESC, token) AS rank, token, round(score, 6) AS score FROM pool_sql""")
def _(t):
    return candidates.rank_candidates(pool(t)).select(
        "structure_id", "rank", "token", *rounded("score"))


@query("w04_candidate_ranking_capped", """
SELECT * FROM (SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY round(score, 9) DESC, token) AS rank, token, round(score, 6) AS score
FROM pool_sql) WHERE rank <= 20""")
def _(t):
    return candidates.rank_candidates(pool(t), cap=20).select(
        "structure_id", "rank", "token", *rounded("score"))


@query("j09_existing_candidates", f"""
SELECT c.structure_id, c.token FROM (SELECT *, CASE WHEN burial % 5 = 1 THEN 'Q' ELSE icode END AS code FROM pool_sql) c
LEFT JOIN index_sql i ON i.structure_id = c.structure_id AND i.chain = c.chain AND i.resi = c.resi AND i.icode = c.code
LEFT JOIN index_sql b ON b.structure_id = c.structure_id AND b.chain = c.chain AND b.resi = c.resi AND b.icode = ' '
WHERE {aa1('coalesce(i.resn, b.resn)')} = CASE WHEN c.burial % 3 = 0 THEN 'A' ELSE c.wt END""")
def _(t):
    altered = pool(t).withColumns({
        "wt": F.when(F.col("burial") % 3 == 0, "A").otherwise(F.col("wt")),
        "icode": F.when(F.col("burial") % 5 == 1, "Q").otherwise(F.col("icode"))})
    return candidates.existing_candidates(
        altered, candidates.residue_names(t.atoms)).select("structure_id", "token")


# --- beam -------------------------------------------------------------------
KEY = """sha256(concat_ws('|', CAST(structure_id AS VARCHAR), 'FMN', array_to_string(list_transform(muts, lambda m: m.token), '_'),
 'len:' || CAST(len(muts) AS VARCHAR), array_to_string(list_sort(list_transform(muts, lambda m: m.token)), ','), ''))"""
TOTAL = "delta - 0.5 * clash - 0.7 * stab + 15.0 + 0.2 * syn"
view("single_all_sql", f"""
SELECT *, {TOTAL} AS total, {KEY} AS run_key FROM (
  SELECT structure_id, [struct_pack(chain := chain, num := CAST(resi AS INTEGER), icode := trim(icode), wt := wt, mut := mut, token := token)] AS muts,
         CAST(2.0 + CASE WHEN mut IN ('K', 'R') THEN 1 ELSE 0 END + CASE WHEN mut IN ('F', 'Y', 'W') THEN 0.5 ELSE 0 END AS DOUBLE) AS delta, 0.0::DOUBLE AS syn,
         CASE WHEN mut IN ('W', 'Y') THEN 1.0 ELSE 0.0 END::DOUBLE AS clash, CASE WHEN wt = 'G' AND mut NOT IN ('A', 'G', 'S') THEN 1.5 ELSE 0.0 END::DOUBLE AS stab
  FROM pool_sql)""")


def top_sql(source, k):
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY round(total, 9) DESC, run_key) AS rn
  FROM {source}) WHERE rn <= {k}"""


def level_sql(parents):
    return f"""
SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, run_key ORDER BY total DESC) AS o FROM (
  SELECT *, {TOTAL} AS total, {KEY} AS run_key FROM (
    SELECT p.structure_id, list_sort(list_append(p.muts, c.muts[1])) AS muts, (p.delta + c.delta) + (p.delta + c.delta) * 0.1::DOUBLE AS delta,
           (p.delta + c.delta) * 0.1::DOUBLE AS syn, p.clash + c.clash AS clash, p.stab + c.stab AS stab
    FROM {parents} p JOIN single5_sql c ON c.structure_id = p.structure_id
    WHERE len(list_filter(p.muts, lambda m: m.chain = c.muts[1].chain AND m.num = c.muts[1].num AND m.icode = c.muts[1].icode)) = 0))) WHERE o = 1"""


view("single5_sql", top_sql("single_all_sql", 5))
view("level2_sql", level_sql("single5_sql"))
view("beam2_sql", top_sql("level2_sql", 6))
view("level3_sql", level_sql("beam2_sql"))
view("beam3_sql", top_sql("level3_sql", 6))
STATE = """structure_id, array_to_string(list_transform(muts, lambda m: m.token), ';') AS mutations, round(total, 6) AS total_score,
 round(delta, 6) AS delta_brightness, round(syn, 6) AS synergy, clash AS clash_risk, stab AS stability_risk, run_key"""


def show_states(frame):
    from ...functions import mutation_exprs as M
    tokens = F.array_join(F.split(M.canonical_key(F.col("mutations")), "_"), ";")
    return frame.select(
        "structure_id", tokens.alias("mutations"), *rounded("total_score", "delta_brightness", "synergy"),
        "clash_risk", "stability_risk", "run_key")


def top_singles(t):
    scored = recommend.score_singles(pool(t))
    return checkpoint(recommend.top_per_group(scored, ["structure_id"], C.TOP_N).drop("rank"))


@query("w08_beam_level2", f"SELECT {STATE} FROM beam2_sql")
def _(t):
    return show_states(recommend.beam_levels(top_singles(t), 2)[2])


@query("w08_beam_level3", f"SELECT {STATE} FROM beam3_sql")
def _(t):
    return show_states(recommend.beam_levels(top_singles(t), 3)[3])


@query("w09_top_recommendations", f"""
SELECT structure_id, size, CAST(row_number() OVER (PARTITION BY structure_id, size ORDER BY round(total, 9) DESC, run_key) AS INTEGER) AS rank, run_key, round(total, 6) AS total_score
FROM (SELECT structure_id, 1 AS size, run_key, total FROM single5_sql UNION ALL SELECT structure_id, 2, run_key, total FROM ({top_sql('beam2_sql', 5)})
UNION ALL SELECT structure_id, 3, run_key, total FROM ({top_sql('beam3_sql', 5)}))""")
def _(t):
    return recommend.recommend(pool(t)).select(
        "structure_id", "size", "rank", "run_key", *rounded("total_score"))


@query("f11_output_rows", f"""
SELECT structure_id, 2 AS size, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY round(total, 9) DESC, run_key) AS INTEGER) AS rank,
  array_to_string(list_sort(list_transform(muts, lambda m: m.token)), ';') AS mutations, round(total, 6) AS total_score, round(delta, 6) AS pred_brightness,
  round(delta, 6) AS delta_brightness, round(syn, 6) AS synergy, clash AS clash_risk, stab AS stability_risk, 50.0::DOUBLE AS confidence, run_key, true AS heuristic
FROM ({top_sql('beam2_sql', 5)})""")
def _(t):
    rows = recommend.to_rows(recommend.recommend(pool(t), max_size=2)).where(F.col("size") == 2)
    ordered = F.array_join(F.array_sort(F.split("mutations", ";")), ";")
    return rows.withColumn("mutations", ordered).select(
        "structure_id", "size", "rank", "mutations",
        *rounded("total_score", "pred_brightness", "delta_brightness", "synergy"),
        "clash_risk", "stability_risk", "confidence", "run_key", "heuristic")


# --- evaluated recommendations ------------------------------------------------
# An answer is a function of the run key's hex digits.  Structures divisible by five get none, the next ones equal
# answers, the others values of three kinds; keys that start with 0 are never answered, a second digit 1 is a unit error.
def digit(n):
    return f"ascii(substring(run_key, {n}, 1))"


BRIGHT = f"CAST(60 + ({digit(1)} * 3 + {digit(2)}) % 41 AS DOUBLE)"
GAP = f"CAST(({digit(1)} + {digit(2)}) % 31 AS DOUBLE) / 100"
ANSWER = f"""
SELECT structure_id, run_key, CAST(1 AS BIGINT) AS seq,
  CASE WHEN structure_id % 5 = 1 THEN CAST(100 AS DOUBLE) WHEN substring(run_key, 2, 1) = '1' THEN CAST(-5 AS DOUBLE) WHEN {digit(3)} % 3 = 0 THEN {BRIGHT} END AS pred_brightness,
  CAST(NULL AS DOUBLE) AS brightness_pred, CASE WHEN structure_id % 5 <> 1 AND {digit(3)} % 3 = 1 THEN {GAP} END AS st_gap,
  -{BRIGHT} AS pred_final, CASE WHEN structure_id % 5 = 1 OR {digit(4)} % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS clash_penalty,
  CASE WHEN structure_id % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST({digit(5)} % 3 AS DOUBLE) END AS triad_score,
  CASE WHEN {digit(6)} % 4 > 0 THEN CAST(40 + {digit(6)} % 20 AS DOUBLE) END AS scs,
  CASE WHEN structure_id % 5 = 1 THEN 'same' ELSE substring(run_key, 1, 8) END AS feature_hash, CAST(NULL AS VARCHAR(8)) AS wavefunction_signature
FROM {{asked}} WHERE structure_id % 5 <> 0 AND substring(run_key, 1, 1) <> '0'"""
WILD = """
SELECT structure_id, run_key, CAST(1 AS BIGINT) AS seq, CASE WHEN structure_id % 5 = 1 THEN CAST(100 AS DOUBLE) ELSE CAST(70 + structure_id % 20 AS DOUBLE) END AS pred_brightness,
  CAST(NULL AS DOUBLE) AS brightness_pred, CAST(NULL AS DOUBLE) AS st_gap, CAST(NULL AS DOUBLE) AS pred_final, CAST(0 AS DOUBLE) AS clash_penalty, CAST(0 AS DOUBLE) AS triad_score,
  CAST(NULL AS DOUBLE) AS scs, 'wild' AS feature_hash, CAST(NULL AS VARCHAR(8)) AS wavefunction_signature FROM {asked} WHERE structure_id % 5 <> 0 AND structure_id % 7 <> 3"""


def evaluated_sql(asked):
    """States of a view with the scores of their answers."""
    value = f"coalesce(pred_brightness, CASE WHEN st_gap <= 5 THEN greatest(0.0, st_gap / 0.35 * 150) END, abs(pred_final))"
    return f"""
SELECT structure_id, muts, run_key, bright - wt AS delta, 0.0::DOUBLE AS syn, clash_penalty AS clash, triad_score AS stab, bright, coalesce(scs, 50.0) AS conf, hash,
       (bright - wt) - 0.5 * clash_penalty - 0.7 * triad_score + 0.3 * coalesce(scs, 50.0) AS total
FROM (SELECT s.structure_id, s.muts, s.run_key, a.* EXCLUDE (structure_id, run_key), {value} AS bright, a.feature_hash || '|st:' || coalesce(printf('%.6f', st_gap), 'nan') AS hash,
        CASE WHEN s.structure_id % 7 = 3 THEN 0.0 WHEN s.structure_id % 5 = 1 THEN 100.0 ELSE 70.0 + s.structure_id % 20 END::DOUBLE AS wt
      FROM {asked} s JOIN ({ANSWER.format(asked=asked)}) a ON a.run_key = s.run_key)
WHERE NOT (pred_brightness IS NOT NULL AND pred_brightness < 0)"""


view("done1_all_sql", evaluated_sql("single_all_sql"))
view("done1_sql", top_sql("done1_all_sql", 5))
view("asked2_sql", level_sql("done1_sql").replace("single5_sql", "done1_sql"))
view("askedbeam2_sql", top_sql("asked2_sql", 6))
view("asked3_sql", level_sql("askedbeam2_sql").replace("single5_sql", "done1_sql"))
view("askedbeam3_sql", top_sql("asked3_sql", 6))
view("done2_sql", evaluated_sql("askedbeam2_sql"))
view("done3_sql", evaluated_sql("askedbeam3_sql"))
view("done_sql", """
SELECT *, 1 AS size FROM done1_sql UNION ALL SELECT *, 2 FROM done2_sql UNION ALL SELECT *, 3 FROM done3_sql""")
view("reason_sql", """
SELECT structure_id, 'computed-flat-response' AS reason FROM done_sql GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT round_even(bright, 6)) <= 1
 AND count(DISTINCT hash) <= 1 AND bool_and(abs(delta) < 1e-9)
UNION ALL SELECT DISTINCT structure_id, 'no-computed-singles' FROM pool_sql WHERE structure_id NOT IN (SELECT structure_id FROM done1_sql)""")


def answers(t, asked):
    """What the evaluator of these queries says to a request table."""
    return t._view(ANSWER.format(asked="asked"), asked=asked)


def evaluation_rounds(t):
    """The pool, and the results after singles and then combinations were asked for."""
    found = checkpoint(pool(t))
    runs = evaluated.unmutated_runs(found)
    results = checkpoint(t._view(WILD.format(asked="asked"), asked=runs).unionByName(
        answers(t, recommend.score_singles(found))))
    _, combinations = evaluated.recommend_evaluated(found, results)
    return found, results, checkpoint(combinations.where(F.col("size") > 1))


@query("w09_computed_recommendations", f"""
SELECT structure_id, size, CAST(row_number() OVER (PARTITION BY structure_id, size ORDER BY round(total, 9) DESC, run_key) AS INTEGER) AS rank, run_key,
  round(total, 6) AS total_score, round(bright, 6) AS pred_brightness, round(delta, 6) AS delta_brightness, conf AS confidence, heuristic, hash AS feature_hash, reason FROM (
  SELECT structure_id, size, run_key, total, bright, delta, conf, false AS heuristic, hash, NULL::VARCHAR AS reason FROM done_sql WHERE structure_id NOT IN (SELECT structure_id FROM reason_sql)
  UNION ALL SELECT h.structure_id, size, run_key, total, delta, delta, 50.0::DOUBLE, true, NULL, CASE WHEN size = 1 THEN reason END FROM (
    SELECT structure_id, 1 AS size, run_key, total, delta FROM single5_sql UNION ALL SELECT structure_id, 2, run_key, total, delta FROM beam2_sql
    UNION ALL SELECT structure_id, 3, run_key, total, delta FROM beam3_sql) h JOIN reason_sql r ON r.structure_id = h.structure_id)
QUALIFY row_number() OVER (PARTITION BY structure_id, size ORDER BY round(total, 9) DESC, run_key) <= 5""")
def _(t):
    found, results, combinations = evaluation_rounds(t)
    rows, _ = evaluated.recommend_evaluated(found, results.unionByName(answers(t, combinations)))
    reason = F.nullif(F.regexp_extract("notes", r"\((.*)\)", 1), F.lit(""))
    return rows.select("structure_id", "size", "rank", "run_key",
                       *rounded("total_score", "pred_brightness", "delta_brightness"), "confidence", "heuristic", "feature_hash",
                       F.when(F.col("heuristic"), reason).alias("reason"))


@query("w09_open_requests", f"""
SELECT structure_id, size, run_key FROM (SELECT structure_id, 1 AS size, run_key FROM single_all_sql UNION ALL SELECT structure_id, 2, run_key FROM askedbeam2_sql
  UNION ALL SELECT structure_id, 3, run_key FROM askedbeam3_sql) WHERE structure_id % 5 = 0 OR substring(run_key, 1, 1) = '0'""")
def _(t):
    found, results, combinations = evaluation_rounds(t)
    _, still_open = evaluated.recommend_evaluated(found, results.unionByName(answers(t, combinations)))
    return still_open.select("structure_id", "size", "run_key")


@query("w09_refusals", f"""
SELECT s_suppkey AS structure_id, CASE WHEN s_suppkey IN (SELECT structure_id FROM atoms_fx WHERE resn IN {COF} AND chain <> 'R') THEN 'no-candidates' ELSE 'no-flavin-detected' END AS reason
FROM supplier WHERE s_suppkey NOT IN (SELECT structure_id FROM pool_sql WHERE structure_id % 4 <> 0)""")
def _(t):
    kept = pool(t).where(F.col("structure_id") % 4 != 0)
    known = t.table("supplier").select(F.col("s_suppkey").alias("structure_id"))
    return evaluated.refusals(known, sites.cofactor_sites(t.atoms.where("chain <> 'R'")), kept)


# --- result tables: one recommendation row per order --------------------------
view("recs_sql", """
SELECT uniprot_id AS structure_id, CAST(pdb_id % 3 + 1 AS INTEGER) AS size, pdb_id AS seq, CAST(pdb_id AS VARCHAR) AS run_key, pdb_id % 4 = 0 OR uniprot_id % 9 = 0 AS heuristic,
       CASE WHEN uniprot_id % 5 = 0 THEN 100.0::DOUBLE ELSE abs(em) END AS pred_brightness, CASE WHEN uniprot_id % 5 = 0 THEN 0.0::DOUBLE ELSE em END AS delta_brightness,
       CASE WHEN uniprot_id % 5 = 0 THEN 'same' ELSE CAST(pdb_id AS VARCHAR) END AS feature_hash, em * 2 AS total_score FROM eval_fx""")


def recs(t):
    flat = F.col("uniprot_id") % 5 == 0
    return t.evals.select(
        F.col("uniprot_id").alias("structure_id"), (F.col("pdb_id") % 3 + 1).cast("int").alias("size"),
        F.col("pdb_id").alias("seq"), F.col("pdb_id").cast("string").alias("run_key"),
        ((F.col("pdb_id") % 4 == 0) | (F.col("uniprot_id") % 9 == 0)).alias("heuristic"),
        F.when(flat, 100.0).otherwise(F.abs("em")).alias("pred_brightness"),
        F.when(flat, 0.0).otherwise(F.col("em")).alias("delta_brightness"),
        F.when(flat, "same").otherwise(F.col("pdb_id").cast("string")).alias("feature_hash"),
        (F.col("em") * 2).alias("total_score"))


@query("w10_quick_picks", """
SELECT structure_id, size, run_key, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY size, rn) AS INTEGER) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY structure_id, size ORDER BY round(total_score, 9) DESC, run_key) AS rn FROM recs_sql WHERE NOT heuristic) WHERE rn <= 3""")
def _(t):
    return recommend.quick_picks(recs(t).withColumn("rank", F.lit(0))).select(
        "structure_id", "size", "run_key", "pick")


@query("w11_prefer_computed", """
SELECT structure_id, size, run_key, heuristic FROM (SELECT *, bool_or(NOT heuristic) OVER (PARTITION BY structure_id, size) AS c FROM recs_sql) WHERE heuristic <> c""")
def _(t):
    return recommend.prefer_computed(recs(t), ["structure_id", "size"]).select(
        "structure_id", "size", "run_key", "heuristic")


@query("a25_flat_response", """
SELECT structure_id, count(*) >= 2 AND count(DISTINCT round_even(pred_brightness, 6)) <= 1 AND count(DISTINCT nullif(feature_hash, '')) <= 1
       AND bool_and(abs(coalesce(delta_brightness, 0)) < 1e-9) AS flat FROM recs_sql GROUP BY 1""")
def _(t):
    return recommend.is_flat_response(recs(t), ["structure_id"])


@query("w13_first_result_per_key", """
SELECT seq, run_key, first_value(total_score) OVER (PARTITION BY run_key ORDER BY seq) AS total_score
FROM (SELECT seq, concat(CAST(structure_id AS VARCHAR), '-', CAST(size AS VARCHAR)) AS run_key, total_score FROM recs_sql)""")
def _(t):
    keyed = recs(t).select(
        "seq", F.concat(F.col("structure_id").cast("string"), F.lit("-"), F.col("size").cast("string")).alias("run_key"),
        "total_score")
    return recommend.first_result_per_key(keyed, value=["total_score"]).select("seq", "run_key", "total_score")


@query("p20_brightness", """
SELECT pdb_id, round(b, 6) AS brightness, round(b - 10, 6) AS delta, CASE WHEN stated IS NOT NULL AND stated < 0 THEN 'UNIT_MIXUP_BUG' WHEN stated IS NOT NULL THEN ''
  WHEN gap <= 5 THEN 'derived_from_st_gap' WHEN pf IS NOT NULL THEN 'emission_proxy' ELSE 'BRIGHTNESS_MISSING' END AS note
FROM (SELECT *, coalesce(stated, CASE WHEN gap <= 5 THEN greatest(0.0, gap / 0.35 * 150) END, abs(pf)) AS b FROM (
  SELECT pdb_id, CASE WHEN pdb_id % 5 = 0 THEN em - 1 END AS stated, CASE WHEN pdb_id % 5 IN (1, 2) THEN st_gap * (CASE WHEN pdb_id % 5 = 2 THEN 1000 ELSE 1 END) END AS gap,
         CASE WHEN pdb_id % 5 <> 4 THEN -em END AS pf FROM eval_fx))""")
def _(t):
    turn = F.col("pdb_id") % 5
    stated = F.when(turn == 0, F.col("em") - 1)
    gap = F.when(turn.isin(1, 2), F.col("st_gap") * F.when(turn == 2, 1000).otherwise(1))
    value, note = rules.brightness([stated], gap, F.when(turn != 4, -F.col("em")))
    return t.evals.select("pdb_id", F.round(value, 6).alias("brightness"),
                          F.round(value - 10, 6).alias("delta"), note.alias("note"))


@query("f13_hash_tags", """
SELECT pdb_id, CASE WHEN tag = wt AND abs(em - 1) > 0 THEN tag || '_collision' ELSE tag END AS tagged,
  CASE WHEN tag = wt AND (pdb_id % 2 = 0 OR abs(iso - 20) >= 0.2 * (1.2 + 1e-3)) THEN 'FEATURE_HASH_COLLISION_WT' WHEN tag = wt THEN 'NO_EFFECT' ELSE 'OK' END AS verdict
FROM (SELECT *, base || '|st:' || printf('%.6f', st_gap) || CASE WHEN pdb_id % 3 = 0 THEN '|wf:sig' ELSE '' END || CASE WHEN abs(st_gap - 0.01) > 0.005 THEN '|stshift' ELSE '' END AS tag,
        base || '|st:' || printf('%.6f', st_gap) AS wt FROM (SELECT * REPLACE (floor(st_gap * 10000) / 10000 AS st_gap), sha256(CAST(pdb_id AS VARCHAR)) AS base FROM eval_fx))""")
def _(t):
    evals = t.evals.withColumn("st_gap", F.floor(F.col("st_gap") * 10000) / 10000)
    base = F.sha2(F.col("pdb_id").cast("string").cast("binary"), 256)
    wt_hash = F.concat(base, F.lit("|st:"), F.format_string("%.6f", "st_gap"))
    signature = F.when(F.col("pdb_id") % 3 == 0, "sig")
    plain = hashing.tagged_hash(base, F.col("st_gap"), signature, F.lit(0.01))
    tagged = hashing.tagged_hash(base, F.col("st_gap"), signature, F.lit(0.01), wt_hash, F.col("em") - 1)
    return evals.select(
        "pdb_id", tagged.alias("tagged"), hashing.no_effect_check(
            plain, wt_hash, F.col("pdb_id") % 2 == 0, F.col("iso") - 20, F.lit(1.2)).alias("verdict"))

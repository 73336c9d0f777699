"""Blending rules, evaluation reports and curve summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as C, jsonio, rules
from ...operators import blending, curves, evaluation, prediction
from ...session import checkpoint
from ..registry import query, view
from .structures import rounded

view("ev_sql", """
SELECT *, pred_q AS pred_16q, pred_q * 1.1 - 5 AS pred_8q, abs(em - gpr_pred_raw) AS err_gpr, abs(em - pred_q) AS err_final,
       iso * 9 + flex AS local_pred, CASE pdb_id % 3 WHEN 0 THEN 'nitroreductase' WHEN 1 THEN 'reductase' ELSE 'single_upload' END AS family,
       pdb_id % 100 = 7 AS failure, CASE WHEN pdb_id % 17 <> 0 THEN hfcc_primary / 3 END AS polarizability FROM eval_fx""")


def evals(t):
    return with_derived(t.evals)


def evals_once(t):
    """The same rows, written once, for plans that read them several times."""
    return with_derived(t.evals_once)


def with_derived(rows):
    key = F.col("pdb_id")
    return rows.select(
        "*", F.col("pred_q").alias("pred_16q"), (F.col("pred_q") * 1.1 - 5).alias("pred_8q"),
        F.abs(F.col("em") - F.col("gpr_pred_raw")).alias("err_gpr"),
        F.abs(F.col("em") - F.col("pred_q")).alias("err_final"),
        (F.col("iso") * 9 + F.col("flex")).alias("local_pred"),
        F.when(key % 3 == 0, "nitroreductase").when(key % 3 == 1, "reductase")
        .otherwise("single_upload").alias("family"),
        (key % 100 == 7).alias("failure"),
        F.when(key % 17 != 0, F.col("hfcc_primary") / 3).alias("polarizability"))


# --- row rules ----------------------------------------------------------------
@query("p03_clash_penalty", """
SELECT pdb_id, CASE WHEN d < 0.8 THEN 0.0 ELSE 100.0 END::DOUBLE AS clash_penalty FROM (SELECT pdb_id, CASE WHEN pdb_id % 7 <> 0 THEN st_gap * 100 END AS d FROM ev_sql)""")
def _(t):
    d = F.when(F.col("pdb_id") % 7 != 0, F.col("st_gap") * 100)
    return evals(t).select("pdb_id", rules.clash_penalty(d).alias("clash_penalty"))


@query("p06_interpolated_parameters", """
SELECT pdb_id, round((-0.008 + 0.005 * flex) * CASE family WHEN 'nitroreductase' THEN 0.9 WHEN 'reductase' THEN 0.95 ELSE 1 END, 9) AS iso_scale,
       round((0.02 + 0.003 * tanh(iso / 20)) * CASE WHEN hb_cap < 2 THEN 0.8 ELSE 1 END * CASE WHEN family = 'reductase' THEN 0.9 ELSE 1 END, 9) AS hb_scale,
       round((0.05 + 0.005 * flex) / (1 + hb_cap), 9) AS cross_scale FROM ev_sql""")
def _(t):
    parts = rules.interpolated_parameters(*(F.col(c) for c in ("iso", "flex", "hb_cap", "family")))
    return evals(t).select("pdb_id", *(F.round(c, 9).alias(n) for n, c in parts.items()))


@query("p33_cysteine_scaling", """
SELECT pdb_id, round((-0.008 + 0.005 * flex) * CASE family WHEN 'nitroreductase' THEN 0.9 WHEN 'reductase' THEN 0.95 ELSE 1 END * CASE WHEN c THEN 0.85 ELSE 1 END, 13) AS iso_scale,
       round((0.02 + 0.003 * tanh(iso / 20)) * CASE WHEN hb_cap < 2 THEN 0.8 ELSE 1 END * CASE WHEN family = 'reductase' THEN 0.9 ELSE 1 END * CASE WHEN c THEN 0.9 ELSE 1 END, 13) AS hb_scale,
       round((0.05 + 0.005 * flex) / (1 + hb_cap) * CASE WHEN c THEN 0.9 ELSE 1 END, 13) AS cross_scale, round(n5_spin / 7 * CASE WHEN c THEN 0.8 ELSE 1 END, 13) AS sulfur_shift
FROM (SELECT *, pdb_id % 4 = 0 AS c FROM ev_sql)""")
def _(t):
    parts = rules.interpolated_parameters(*(F.col(c) for c in ("iso", "flex", "hb_cap", "family")))
    scaled = rules.cysteine_scaled(parts, F.col("n5_spin") / 7, F.col("pdb_id") % 4 == 0)
    return evals(t).select("pdb_id", *(F.round(c, 13).alias(n) for n, c in scaled.items()))


@query("p34_engine_overrides", """
SELECT pdb_id, CASE WHEN fixed THEN 'Radical Pair (Cryptochrome)' ELSE family END AS environment_label, CASE WHEN fixed THEN 'Radical Pair' ELSE cofactor END AS computational_mode,
  NOT fixed AND hb_cap > 3 AS lov_domain, CASE WHEN fixed THEN 0.0 ELSE hb_cap END::DOUBLE AS cys_flavin_coupling, coalesce(acc IN ('P26484', 'Q9VBW3') OR acc LIKE 'CRY%', false) AS force_uhf,
  CASE WHEN fixed THEN coalesce(nullif(det, ''), 'FAD') ELSE det END AS detected_cofactor
FROM (SELECT *, coalesce(acc = 'P26484', false) AS fixed FROM (SELECT *, CASE uniprot_id % 6 WHEN 0 THEN 'P26484' WHEN 1 THEN 'CRY1' WHEN 2 THEN 'Q9VBW3' WHEN 3 THEN 'P1' END AS acc,
  CASE pdb_id % 3 WHEN 0 THEN '' WHEN 1 THEN cofactor END AS det FROM ev_sql))""")
def _(t):
    turn, kind = F.col("uniprot_id") % 6, F.col("pdb_id") % 3
    accession = F.when(turn == 0, "P26484").when(turn == 1, "CRY1").when(turn == 2, "Q9VBW3").when(turn == 3, "P1")
    detected = F.when(kind == 0, "").when(kind == 1, F.col("cofactor"))
    out = rules.accession_overrides(accession, F.col("family"), F.col("cofactor"), F.col("hb_cap") > 3, F.col("hb_cap"), detected)
    return evals(t).select("pdb_id", *(c.alias(n) for n, c in out.items()))


@query("p08_crossing_flag", """
SELECT pdb_id, coalesce(st_gap < 0.01 AND spin > 0.4, false) AS crossing FROM (SELECT *, CASE WHEN pdb_id % 5 <> 0 THEN n5_spin END AS spin FROM ev_sql)""")
def _(t):
    spin = F.when(F.col("pdb_id") % 5 != 0, F.col("n5_spin"))
    return evals(t).select("pdb_id", rules.crossing_detected(F.col("st_gap"), spin).alias("crossing"))


@query("p09_coupling_label", """
SELECT pdb_id, CASE WHEN pdb_id % 50 = 1 THEN 'MAGNETICALLY INACTIVE' WHEN spin IS NULL THEN 'COUPLING: UNKNOWN (insufficient data)'
  WHEN st_gap < 0.01 AND spin > 0.4 AND hfcc_primary > 15 THEN 'HIGH COUPLING' WHEN spin < 0.2 OR hfcc_primary < 7.5 THEN 'WEAK COUPLING' ELSE 'MODERATE COUPLING' END AS label
FROM (SELECT *, CASE WHEN pdb_id % 5 <> 0 THEN n5_spin * 2 END AS spin FROM ev_sql)""")
def _(t):
    spin = F.when(F.col("pdb_id") % 5 != 0, F.col("n5_spin") * 2)
    activity = F.when(F.col("pdb_id") % 50 == 1, "MAGNETICALLY INACTIVE")
    return evals(t).select("pdb_id", rules.coupling_label(
        F.col("st_gap"), spin, F.col("hfcc_primary"), activity).alias("label"))


@query("p10_derived_measures", """
SELECT pdb_id, round(n5_spin * hfcc_primary / (st_gap + 1e-6), 4) AS msi, round(1.0 / (st_gap + 1e-6) * n5_spin, 5) AS heading, st_gap < 0.01 AS coherent,
       list_reverse_sort([iso, hb_cap, hfcc_primary])[1] AS hfcc_1, list_reverse_sort([iso, hb_cap, hfcc_primary])[2] AS hfcc_2, list_reverse_sort([iso, hb_cap, hfcc_primary])[3] AS hfcc_3
FROM ev_sql""")
def _(t):
    gap, spin = F.col("st_gap"), F.col("n5_spin")
    ordered = rules.ordered_hyperfine(F.col("iso"), F.col("hb_cap"), F.col("hfcc_primary"))
    return evals(t).select(
        "pdb_id", F.round(rules.sensitivity_index(spin, F.col("hfcc_primary"), gap), 4).alias("msi"),
        F.round(rules.heading_index(spin, gap), 5).alias("heading"),
        rules.is_coherent(gap).alias("coherent"),
        *(c.alias(f"hfcc_{i}") for i, c in enumerate(ordered, 1)))


# --- statistics ---------------------------------------------------------------
STAT_COLUMNS = ("em", "iso", "hb_cap", "flex", "gpr_pred_raw", "gpr_sigma")
view("stats_sql", "SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd" for c in STAT_COLUMNS) + " FROM ev_sql")
view("success_sql", """
SELECT count(*) AS n_success, avg(flex) AS flex_mean, avg(hb_cap) AS hb_cap_mean, avg(gpr_sigma) AS sigma_mean,
       stddev_pop(flex) AS flex_sd, stddev_pop(hb_cap) AS hb_cap_sd, stddev_pop(gpr_sigma) AS sigma_sd, avg(em) AS em_mean
FROM ev_sql WHERE err_gpr < 36""")


@query("a14_column_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, round(median({c}), 6) AS median FROM ev_sql"
    for c in STAT_COLUMNS))
def _(t):
    return evaluation.column_stats(evals_once(t), list(STAT_COLUMNS)).select(
        "column", "n", *rounded("mean", "sd", "median"))


@query("a15_success_stats", "SELECT n_success, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("flex_mean", "hb_cap_mean", "sigma_mean", "flex_sd", "hb_cap_sd", "sigma_sd", "em_mean")) + " FROM success_sql")
def _(t):
    stats = blending.success_stats(evals(t))
    return stats.select("n_success", *rounded(*(c for c in stats.columns if c != "n_success")))


def complexity_rows(t):
    rows = evals_once(t)
    return blending.with_complexity(rows, rows)


COMPLEX_SQL = """
SELECT *, 1.0 / (1.0 + complexity) AS damping, complexity > 1.8 OR gpr_sigma > 90 AS escalate FROM (
  SELECT e.*, s.gpr_pred_raw_mean AS gpr_mean, abs((iso - iso_mean) / iso_sd) + abs((hb_cap - hb_cap_mean) / hb_cap_sd) + 0.5 * abs(flex) AS complexity,
    CASE WHEN gpr_pred_raw_sd > 0 AND abs(gpr_pred_raw - gpr_pred_raw_mean) > 1.5 * gpr_pred_raw_sd THEN gpr_pred_raw_mean + 0.7 * (gpr_pred_raw - gpr_pred_raw_mean) ELSE gpr_pred_raw END AS gpr_pred
  FROM ev_sql e, stats_sql s)"""
view("complex_sql", COMPLEX_SQL)


@query("p11_complexity", "SELECT pdb_id, round(complexity, 6) AS complexity, round(damping, 6) AS damping, escalate FROM complex_sql")
def _(t):
    return complexity_rows(t).select("pdb_id", *rounded("complexity", "damping"), "escalate")


@query("p12_shrink_outliers", "SELECT pdb_id, round(gpr_pred, 6) AS gpr_pred FROM complex_sql")
def _(t):
    return complexity_rows(t).select("pdb_id", *rounded("gpr_pred"))


WEIGHT_SQL = """
SELECT *, CASE WHEN gpr_sigma > 110 OR complexity > 1.4 OR failure OR (gpr_sigma <= sigma_median AND NOT gold) THEN 0.0
  WHEN gold THEN greatest(base, 3.125) WHEN NOT escalate AND complexity < 1.2 AND gpr_sigma < 50 THEN greatest(base, 1.5) ELSE base END::DOUBLE AS quantum_weight
FROM (SELECT *, CASE WHEN in_domain THEN 0.5 ELSE 0.05 END AS base, gpr_sigma < 50 AND complexity < 1 AND NOT escalate AS gold FROM (
  SELECT c.*, s.em_mean AS success_em_mean, (SELECT median(gpr_sigma) FROM ev_sql) AS sigma_median,
    flex_sd > 0 AND abs(flex - flex_mean) <= 0.5 * flex_sd AND hb_cap_sd > 0 AND abs(hb_cap - hb_cap_mean) <= 0.5 * hb_cap_sd
    AND sigma_sd > 0 AND abs(gpr_sigma - sigma_mean) <= 0.5 * sigma_sd AS in_domain FROM complex_sql c, success_sql s))"""
view("weight_sql", WEIGHT_SQL)


def weighted_rows(t):
    return blending.with_quantum_weight(complexity_rows(t), evals_once(t), F.col("failure"))


@query("p13_quantum_weight", "SELECT pdb_id, in_domain, round(quantum_weight, 6) AS quantum_weight FROM weight_sql")
def _(t):
    return weighted_rows(t).select("pdb_id", "in_domain", *rounded("quantum_weight"))


ROUTED_SQL = """
SELECT *, CASE WHEN miss THEN gpr_pred + n16 WHEN escalate THEN gpr_pred + n8 ELSE pred_16q END AS pred_final,
  CASE WHEN miss THEN n16 WHEN escalate THEN n8 ELSE greatest(-15.0, least(15.0, quantum_weight * (pred_16q - gpr_pred) * damping)) END AS nudge,
  CASE WHEN miss THEN 'hybrid_16q' WHEN escalate THEN 'hybrid_8q' WHEN quantum_weight > 0 THEN 'uhf_16q_active' ELSE 'uhf_quantum' END AS tier,
  CASE WHEN miss OR NOT escalate THEN pred_16q ELSE pulled END AS pred_q_used
FROM (SELECT *, CASE WHEN abs(pred_16q - gpr_pred) > 100 THEN 0 ELSE 0.15 * (pred_16q - gpr_pred) * damping END AS n16,
        CASE WHEN sign(pulled - gpr_pred) * sign(em - gpr_pred) > 0 AND abs(gpr_pred + step - gpr_mean) <= abs(gpr_pred - gpr_mean) THEN step ELSE 0 END AS n8
  FROM (SELECT *, greatest(-30.0, least(30.0, 0.04 * (pulled - gpr_pred) * damping)) AS step FROM (
    SELECT *, CASE WHEN abs(biased - success_em_mean) > 100 THEN gpr_pred + 0.5 * (biased - gpr_pred) ELSE biased END AS pulled FROM (
      SELECT *, pred_8q - 40 + 50 * (0.5 * flex + 0.2 * complexity) AS biased, pdb_id IN (
        SELECT pdb_id FROM ev_sql ORDER BY err_gpr DESC, pdb_id LIMIT 54) AS miss FROM weight_sql))))"""
view("routed_sql", ROUTED_SQL)


@query("p14_tier_routing", """
SELECT pdb_id, tier, tier || '|single_calibrated' AS single_tier, round(pred_q_used, 6) AS pred_q_used, round(nudge, 6) AS nudge, round(pred_final, 6) AS pred_final FROM routed_sql""")
def _(t):
    return blending.route(weighted_rows(t), evals_once(t), evaluating=True).select(
        "pdb_id", "tier", rules.calibrated_tier(F.col("tier")).alias("single_tier"),
        *rounded("pred_q_used", "nudge", "pred_final"))


@query("p15_final_cascade", """
SELECT pdb_id, round(CASE WHEN gap > 0 THEN (q - gpr_pred_raw) / 96.485 ELSE coalesce(pred_8q, q, gpr_pred_raw) END, 6) AS batch_value,
       round(gpr_pred_raw + greatest(-cap, least(cap, 0.08 * (q - gpr_pred_raw))), 6) AS single_value
FROM (SELECT *, CASE WHEN pdb_id % 4 <> 0 THEN st_gap END AS gap, pred_q AS q, CASE WHEN pdb_id % 2 = 0 THEN 10.0 ELSE 20.0 END AS cap FROM ev_sql)""")
def _(t):
    key, q, gpr = F.col("pdb_id"), F.col("pred_q"), F.col("gpr_pred_raw")
    return evals(t).select(
        "pdb_id",
        F.round(rules.final_batch(F.col("pred_8q"), q, gpr, F.when(key % 4 != 0, F.col("st_gap"))), 6).alias("batch_value"),
        F.round(rules.final_single(F.col("pred_8q"), q, gpr, key % 2 == 0), 6).alias("single_value"))


@query("p16_fallback_blend", """
SELECT pdb_id, used::INTEGER AS gpr_fallback_used, round(CASE WHEN used THEN 0.35 * gpr_pred_raw + 0.65 * local_pred ELSE gpr_pred_raw END, 6) AS gpr_blended
FROM (SELECT *, abs(gpr_pred_raw - m) <= greatest(0.001, 0.01 * greatest(1.0, abs(m))) OR gpr_sigma >= q AS used
  FROM ev_sql, (SELECT avg(em) AS m, quantile_cont(gpr_sigma, 0.75) AS q FROM ev_sql))""")
def _(t):
    rows = evals_once(t)
    return blending.with_fallback(rows, rows).select(
        "pdb_id", "gpr_fallback_used", *rounded("gpr_blended"))


@query("p17_prior_blend", """
WITH tr AS (SELECT * FROM ev_sql WHERE pdb_id % 3 <> 0),
     a AS (SELECT uniprot_id, avg(em) AS m FROM tr GROUP BY 1), b AS (SELECT uniprot_id, cofactor, avg(em) AS m FROM tr GROUP BY ALL)
SELECT pdb_id, round(p, 6) AS prior_em, p IS NOT NULL AS prior_used, round(CASE WHEN p IS NULL THEN gpr_pred_raw ELSE w * p + (1 - w) * gpr_pred_raw END, 6) AS gpr_prior
FROM (SELECT e.*, coalesce(b.m, a.m) AS p, greatest(0.35, least(0.85, (gpr_sigma - 55) / 70)) AS w FROM ev_sql e LEFT JOIN a ON a.uniprot_id = e.uniprot_id
      LEFT JOIN b ON b.uniprot_id = e.uniprot_id AND b.cofactor = e.cofactor)""")
def _(t):
    rows = evals(t)
    return blending.with_prior(rows, rows.where(F.col("pdb_id") % 3 != 0)).select(
        "pdb_id", *rounded("prior_em"), "prior_used", *rounded("gpr_prior"))


# --- the whole cascade: the value is handed on from step to step -----------------
view("handed_sql", """
SELECT f.* REPLACE (CASE WHEN p IS NULL THEN gpr_pred_raw ELSE w * p + (1 - w) * gpr_pred_raw END AS gpr_pred_raw), p IS NOT NULL AS prior_used FROM (
  SELECT f.*, coalesce(b.m, a.m) AS p, greatest(0.35, least(0.85, (gpr_sigma - 55) / 70)) AS w FROM (
    SELECT * EXCLUDE (m, q) REPLACE (CASE WHEN used THEN 0.35 * gpr_pred_raw + 0.65 * local_pred ELSE gpr_pred_raw END AS gpr_pred_raw) FROM (
      SELECT *, abs(gpr_pred_raw - m) <= greatest(0.001, 0.01 * greatest(1.0, abs(m))) OR gpr_sigma >= q AS used
      FROM ev_sql, (SELECT avg(em) AS m, quantile_cont(gpr_sigma, 0.75) AS q FROM ev_sql))) f
  LEFT JOIN (SELECT uniprot_id, avg(em) AS m FROM ev_sql GROUP BY 1) a ON a.uniprot_id = f.uniprot_id
  LEFT JOIN (SELECT uniprot_id, cofactor, avg(em) AS m FROM ev_sql GROUP BY ALL) b ON b.uniprot_id = f.uniprot_id AND b.cofactor = f.cofactor) f""")
view("handed_complex_sql", COMPLEX_SQL.replace("ev_sql e", "handed_sql e"))
view("handed_weight_sql", WEIGHT_SQL.replace("complex_sql c", "handed_complex_sql c"))
view("handed_routed_sql", ROUTED_SQL.replace("weight_sql", "handed_weight_sql"))
PROFILE = ("complexity", "gpr_pred", "quantum_weight", "pred_q_used", "pred_final")


def profile_sql(tier, final):
    return f"""
SELECT pdb_id, used::INTEGER AS gpr_fallback_used, prior_used, {tier} AS tier, round(complexity, 6) AS complexity, round(gpr_pred, 6) AS gpr_pred,
  round(quantum_weight, 6) AS quantum_weight, round(pred_q_used, 6) AS pred_q_used, round({final}, 6) AS pred_final,
  CASE WHEN st_gap < 0.01 AND n5_spin > 0.4 AND hfcc_primary > 15 THEN 'HIGH COUPLING' WHEN n5_spin < 0.2 OR hfcc_primary < 7.5 THEN 'WEAK COUPLING' ELSE 'MODERATE COUPLING' END AS coupling_label
FROM handed_routed_sql"""


def profile(t, single):
    rows = evals_once(t)
    return prediction.predict(rows, rows, F.col("failure"), single, evaluating=True).select(
        "pdb_id", "gpr_fallback_used", "prior_used", "tier", *rounded(*PROFILE), "coupling_label")


@query("p00_batch_profiles", profile_sql(
    "tier", "CASE WHEN st_gap > 0 THEN (pred_q_used - gpr_pred) / 96.485 ELSE pred_final END"))
def _(t):
    return profile(t, single=False)


@query("p00_single_profiles", profile_sql(
    "tier || '|single_calibrated'",
    "gpr_pred + greatest(-CASE WHEN prior_used THEN 10.0 ELSE 20.0 END, least(CASE WHEN prior_used THEN 10.0 ELSE 20.0 END, 0.08 * (pred_q_used - gpr_pred)))"))
def _(t):
    return profile(t, single=True)


@query("p18_align_features", """
SELECT pdb_id, """ + ", ".join(f"round(({c} - g{c}) * s{c} / d{c} + m{c}, 6) AS {c}" for c in ("iso", "hb_cap", "flex")) + """
FROM ev_sql, (SELECT """ + ", ".join(f"avg({c}) AS g{c}, stddev_pop({c}) AS d{c}" for c in ("iso", "hb_cap", "flex")) + """ FROM ev_sql WHERE cofactor = 'FAD'),
 (SELECT """ + ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in ("iso", "hb_cap", "flex")) + " FROM ev_sql)")
def _(t):
    rows = evals(t)
    return blending.align_features(rows, rows.where(F.col("cofactor") == "FAD"), rows).select(
        "pdb_id", *rounded("iso", "hb_cap", "flex"))


@query("p32_global_guard", """
SELECT pdb_id, m > 46.5 AS lock_applied, round(CASE WHEN m > 46.5 OR (m > 46.0 AND failure) THEN gpr_pred_raw ELSE pred_q END, 6) AS pred_guarded
FROM ev_sql, (SELECT avg(err_final) AS m FROM ev_sql)""")
def _(t):
    return evaluation.global_guard(evals(t), F.col("failure"), final="pred_q", baseline="gpr_pred_raw").select(
        "pdb_id", "lock_applied", *rounded("pred_guarded"))


@query("p35_complete_rows", """
SELECT count(*) AS n_before, count(*) FILTER (polarizability IS NOT NULL AND e2 IS NOT NULL) AS n_after
FROM (SELECT *, CASE WHEN pdb_id % 13 <> 0 THEN em END AS e2 FROM ev_sql)""")
def _(t):
    rows = evals(t).withColumn("em", F.when(F.col("pdb_id") % 13 != 0, F.col("em")))
    return evaluation.complete_rows(rows, ["em", "iso", "polarizability"])[1]


# --- reports --------------------------------------------------------------------
def metric_sql(model, column, subset, where):
    return f"""SELECT '{model}' AS model, '{subset}' AS subset, count(*) AS n, round(avg(abs(em - {column})), 6) AS mae, round(median(abs(em - {column})), 6) AS medae,
 round(1 - sum(pow(em - {column}, 2)) / sum(pow(em - (SELECT avg(em) FROM ev_sql WHERE {where}), 2)), 6) AS r2 FROM ev_sql WHERE {where}"""


@query("a16_regression_metrics", " UNION ALL ".join(
    metric_sql(m, c, s, w) for m, c in (("gpr", "gpr_pred_raw"), ("small", "pred_8q"), ("quantum", "pred_q"))
    for s, w in (("all", "true"), ("clean", "NOT failure"), ("failure", "failure"))))
def _(t):
    return evaluation.regression_metrics(
        evals_once(t), {"gpr": "gpr_pred_raw", "small": "pred_8q", "quantum": "pred_q"},
        {"all": F.lit(True), "clean": ~F.col("failure"), "failure": F.col("failure")},
    ).select("model", "subset", "n", *rounded("mae", "medae", "r2"))


FAILED = "split_part('" + ",".join(C.FAILURE_IDS) + "', ',', CAST(pdb_id % 14 AS INTEGER) + 1)"


@query("a16_known_failures", f"""
SELECT subset, count(*) AS n, round(avg(err_final), 6) AS mae FROM (
  SELECT err_final, CASE WHEN upper(id) IN {tuple(C.FAILURE_IDS)} THEN 'failure' ELSE 'clean' END AS subset FROM (
    SELECT err_final, CASE WHEN pdb_id % 3 = 0 THEN lower({FAILED}) ELSE {FAILED} END AS id FROM ev_sql)) GROUP BY 1""")
def _(t):
    listed_id = F.split_part(F.lit(",".join(C.FAILURE_IDS)), F.lit(","), (F.col("pdb_id") % 14 + 1).cast("int"))
    failure = rules.is_known_failure(F.when(F.col("pdb_id") % 3 == 0, F.lower(listed_id)).otherwise(listed_id))
    rows = checkpoint(evals(t).withColumn("known", failure))
    return evaluation.regression_metrics(rows, {"quantum": "pred_q"}, {"clean": ~F.col("known"), "failure": F.col("known")}).select(
        "subset", "n", *rounded("mae"))


@query("a17_hit_counts", """
SELECT count(*) AS n, count(*) FILTER (err_final < 36) AS hits_36, count(*) FILTER (err_final < 43) AS hits_43,
  round(100.0::DOUBLE * count(*) FILTER (err_final < 36) / count(*), 6) AS pct_36, round(100.0::DOUBLE * count(*) FILTER (err_final < 43) / count(*), 6) AS pct_43,
  round(100.0::DOUBLE * count(*) FILTER (err_final < err_gpr) / count(*), 6) AS improved_pct, round(avg(err_gpr - err_final), 6) AS mean_error_reduction FROM ev_sql""")
def _(t):
    out = evaluation.hit_counts(evals(t), "err_gpr", "err_final")
    return out.select("n", "hits_36", "hits_43", *rounded("pct_36", "pct_43", "improved_pct", "mean_error_reduction"))


@query("a18_success_contrast", """
SELECT g AS "group", count(e.pdb_id) AS n, round(avg(flex), 6) AS mean_flexibility, round(avg(hb_cap), 6) AS mean_hbondcap, round(avg(gpr_sigma), 6) AS mean_sigma
FROM (VALUES ('success_lt36'), ('failure_gt80')) v(g) LEFT JOIN ev_sql e ON CASE WHEN g = 'success_lt36' THEN err_final < 36 ELSE err_final > 80 END GROUP BY 1""")
def _(t):
    return evaluation.success_contrast(evals(t), "err_final").select(
        "group", "n", *rounded("mean_flexibility", "mean_hbondcap", "mean_sigma"))


def corr_sql(name, a, b):
    return f"""SELECT '{name}' AS pair, n, round(r, 9) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM (
 SELECT count(*) AS n, corr({a}, {b}) AS r FROM ev_sql WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def full_corr_sql(name, a, b):
    return f"SELECT '{name}' AS pair, count(*) AS n, corr({a}, {b}) AS r FROM ev_sql WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


@query("a19_correlations", " UNION ALL ".join((
    corr_sql("gap_em", "st_gap", "em"), corr_sql("polar_em", "polarizability", "em"), corr_sql("spin_em", "n5_spin", "em"),
    corr_sql("resid_gap", "em - gpr_pred_raw", "st_gap"), corr_sql("delta_resid", "pred_q - gpr_pred_raw", "em - gpr_pred_raw"),
    "SELECT 'constant_em', (SELECT count(*) FROM ev_sql), NULL::DOUBLE, NULL::DOUBLE")))
def _(t):
    em, gpr = F.col("em"), F.col("gpr_pred_raw")
    return evaluation.correlations(evals(t), {
        "gap_em": (F.col("st_gap"), em), "polar_em": (F.col("polarizability"), em),
        "spin_em": (F.col("n5_spin"), em), "resid_gap": (em - gpr, F.col("st_gap")),
        "delta_resid": (F.col("pred_q") - gpr, em - gpr), "constant_em": (F.lit(1.0), em),
    }).select("pair", "n", F.round("r", 9).alias("r"), *rounded("t"))


# The tail is integrated by Simpson's rule over the angle whose tangent is t over the root of the degrees of freedom.
TAIL = """SELECT pair, n, t, v, CASE WHEN n = 2 THEN 1.0 ELSE least(1.0, 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * w / 3 * (
  SELECT sum(CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(edge + i * w), v - 1)) FROM range(6001) s(i))) END AS p
FROM (SELECT *, (least(pi() / 2, edge + 14 / sqrt(v)) - edge) / 6000 AS w FROM (SELECT *, atan(abs(t) / sqrt(v)) AS edge FROM (SELECT *, (n - 2)::DOUBLE AS v FROM {rows})))"""
view("fullcorr_sql", " UNION ALL ".join((
    full_corr_sql("gap_em", "st_gap", "em"), full_corr_sql("polar_em", "polarizability", "em"), full_corr_sql("spin_em", "n5_spin", "em"),
    full_corr_sql("spin_few", "n5_spin", "CASE WHEN pdb_id <= 160 THEN em END"), full_corr_sql("gap_few", "st_gap", "CASE WHEN pdb_id <= 40 THEN em END"))))


@query("a19_correlation_p", f"""
SELECT pair, n, round(p, 9) AS p FROM ({TAIL.format(rows="(SELECT pair, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM fullcorr_sql)")})
UNION ALL SELECT 'constant_em', (SELECT count(*) FROM ev_sql), NULL""")
def _(t):
    em = F.col("em")
    rows = evaluation.correlations(evals(t), {
        "gap_em": (F.col("st_gap"), em), "polar_em": (F.col("polarizability"), em), "spin_em": (F.col("n5_spin"), em),
        "spin_few": (F.col("n5_spin"), F.when(F.col("pdb_id") <= 160, em)),
        "gap_few": (F.col("st_gap"), F.when(F.col("pdb_id") <= 40, em)), "constant_em": (F.lit(1.0), em)})
    return evaluation.correlation_p(rows).select("pair", "n", F.round("p", 9).alias("p"))


CANDIDATE = """SELECT e.*, st_gap <= g AND n5_spin >= s AND polarizability >= p AS candidate FROM ev_sql e,
 (SELECT quantile_cont(st_gap, 0.1) AS g, quantile_cont(n5_spin, 0.9) AS s, quantile_cont(polarizability, 0.9) AS p FROM ev_sql)"""


@query("a20_magnetic_candidates", f"SELECT pdb_id, coalesce(candidate, false) AS candidate FROM ({CANDIDATE})")
def _(t):
    return evaluation.magnetic_candidates(evals_once(t), "st_gap", "n5_spin", "polarizability").select("pdb_id", "candidate")


@query("a21_hit_miss_gap", """
SELECT round(avg(st_gap) FILTER (err_final < 43), 9) AS mean_hits, round(avg(st_gap) FILTER (err_final >= 43), 9) AS mean_misses FROM ev_sql""")
def _(t):
    return evaluation.hit_miss_means(evals(t), "err_final", "st_gap").select(
        *rounded("mean_hits", "mean_misses", digits=9))


@query("a28_error_histogram", """
WITH h AS (SELECT err_final AS e, (SELECT min(err_final) FROM ev_sql) AS lo, (SELECT max(err_final) FROM ev_sql) AS hi FROM ev_sql)
SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / 30), 6) AS left_edge, coalesce(c.n, 0) AS n
FROM (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin) b CROSS JOIN (SELECT DISTINCT lo, hi FROM h) s
LEFT JOIN (SELECT CAST(least(floor(30 * (e - lo) / (hi - lo)) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM h GROUP BY 1) c ON c.bin = b.bin""")
def _(t):
    return evaluation.histogram(evals(t), "err_final").select("bin", *rounded("left_edge"), "n")


@query("j10_join_flag", f"""
SELECT e.pdb_id, coalesce(f.candidate, false) AS candidate FROM ev_sql e LEFT JOIN (SELECT pdb_id, coalesce(candidate, false) AS candidate FROM ({CANDIDATE}) WHERE pdb_id % 2 = 0) f ON f.pdb_id = e.pdb_id""")
def _(t):
    flags = evaluation.magnetic_candidates(evals_once(t), "st_gap", "n5_spin", "polarizability").where(F.col("pdb_id") % 2 == 0)
    return evaluation.join_flag(evals_once(t), flags.select("pdb_id", "candidate"), "pdb_id", "candidate").select("pdb_id", "candidate")


@query("j11_split_by_ids", """
SELECT pdb_id, pdb_id IN (SELECT pdb_id FROM ev_sql ORDER BY err_gpr DESC, pdb_id LIMIT 54) AS is_miss FROM ev_sql""")
def _(t):
    rows = evals(t).select("pdb_id")
    misses = blending.worst_misses(evals(t)).select(F.col("id_upper").cast("bigint").alias("pdb_id"))
    inside, outside = evaluation.split_by_ids(rows, misses)
    return inside.withColumn("is_miss", F.lit(True)).unionByName(outside.withColumn("is_miss", F.lit(False)))


@query("w05_top_reports", """
SELECT * FROM (SELECT 'hbond' AS report, pdb_id, hb_cap AS value FROM ev_sql ORDER BY hb_cap DESC, pdb_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'heading', pdb_id, round(1.0 / (st_gap + 1e-6) * n5_spin, 3) FROM ev_sql ORDER BY 1.0 / (st_gap + 1e-6) * n5_spin DESC, pdb_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'failures', pdb_id, round(err_final, 6) FROM ev_sql WHERE err_gpr > 80 AND err_final > 80 ORDER BY err_final DESC, pdb_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'misses', pdb_id, round(err_gpr, 6) FROM ev_sql ORDER BY err_gpr DESC, pdb_id LIMIT 54)""")
def _(t):
    rows = evals(t).withColumn("heading", rules.heading_index(F.col("n5_spin"), F.col("st_gap")))
    def part(name, frame, value):
        return frame.select(F.lit(name).alias("report"), "pdb_id", value.alias("value"))
    return (
        part("hbond", evaluation.top_rows(rows, F.col("hb_cap"), 5), F.col("hb_cap"))
        .unionByName(part("heading", evaluation.top_rows(rows, F.col("heading"), 10), F.round("heading", 3)))
        .unionByName(part("failures", evaluation.failures(rows, "err_gpr", "err_final"), F.round("err_final", 6)))
        .unionByName(part("misses", evaluation.top_rows(rows, F.col("err_gpr"), C.WORST_MISSES), F.round("err_gpr", 6))))


@query("w06_major_divergence", """
SELECT pdb_id, round(abs(pred_8q - gpr_pred_raw), 6) AS divergence FROM (SELECT * FROM ev_sql WHERE err_gpr > 80 AND err_final > 80 ORDER BY err_final DESC, pdb_id LIMIT 10)
WHERE abs(pred_8q * 2 - gpr_pred_raw) > 150""")
def _(t):
    failed = evaluation.failures(evals(t), "err_gpr", "err_final").withColumn("doubled", F.col("pred_8q") * 2)
    return evaluation.major_divergence(failed, "doubled", "gpr_pred_raw").select(
        "pdb_id", F.round(F.abs(F.col("pred_8q") - F.col("gpr_pred_raw")), 6).alias("divergence"))


# Errors in whole micro-units, so that a running sum is exact in any order.
@query("w07_cumulative_error", """
WITH m AS (SELECT pdb_id, CAST(round(err_final * 1000000) AS BIGINT) AS err, failure FROM ev_sql)
SELECT 'all' AS subset, pdb_id, row_number() OVER w AS rank, CAST(sum(err) OVER w AS BIGINT) AS cumulative_error FROM m WINDOW w AS (ORDER BY err DESC, pdb_id ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT 'clean', pdb_id, row_number() OVER w, CAST(sum(err) OVER w AS BIGINT) FROM m WHERE NOT failure WINDOW w AS (ORDER BY err DESC, pdb_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    micro = evals(t).select(
        "pdb_id", F.round(F.col("err_final") * 1000000).cast("bigint").alias("err"), "failure")
    both = micro.select("pdb_id", "err", F.lit("all").alias("subset")).unionByName(
        micro.where(~F.col("failure")).select("pdb_id", "err", F.lit("clean").alias("subset")))
    return evaluation.cumulative_error(both, "err", by=["subset"]).select(
        "subset", "pdb_id", "rank", "cumulative_error")


@query("s13_summary_json", """
SELECT '{"n":' || count(*) || ',"hits_36":' || count(*) FILTER (err_final < 36) || ',"hits_43":' || count(*) FILTER (err_final < 43) ||
       ',"clean_room":{"n":' || count(*) FILTER (NOT failure) || ',"lock":' || CASE WHEN avg(err_final) > 46.5 THEN 'true' ELSE 'false' END || '}}' AS summary FROM ev_sql""")
def _(t):
    rows = evals(t)
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("err_final") < 36).alias("hits_36"),
        F.count_if(F.col("err_final") < 43).alias("hits_43"),
        F.struct(F.count_if(~F.col("failure")).alias("n"),
                 (F.avg("err_final") > 46.5).alias("lock")).alias("clean_room"))
    return facts.select(jsonio.json_text(F.struct("*")).alias("summary"))


# --- curves -----------------------------------------------------------------------
@query("a26_spike_metrics", """
SELECT curve_id, round(max(phi) - min(phi), 9) AS spike_amp, arg_max(theta, (phi, -theta)) AS theta_at_max, arg_min(theta, (phi, theta)) AS theta_at_min FROM curve_fx GROUP BY 1""")
def _(t):
    return curves.spike_metrics(t.curves).withColumn("spike_amp", F.round("spike_amp", 9))


@query("a27_closure_error", """
SELECT curve_id, round(max(abs(phi + (1 - phi * 0.999) - 1.0)), 9) AS closure_error FROM curve_fx GROUP BY 1""")
def _(t):
    both = t.curves.select("curve_id", F.col("phi").alias("phi_s"), (1 - F.col("phi") * 0.999).alias("phi_t"))
    return curves.closure_error(both).withColumn("closure_error", F.round("closure_error", 9))


@query("a27_centred_series", """
SELECT curve_id, theta, round(phi - avg(phi) OVER (PARTITION BY curve_id), 9) AS phi_centred FROM curve_fx""")
def _(t):
    return curves.centred(t.curves).select("curve_id", "theta", F.round("phi_centred", 9).alias("phi_centred"))

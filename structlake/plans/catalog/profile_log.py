"""Tables, log maintenance, lookups, variant audit, exports."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ...functions import constants as C, jsonio, rules
from ...operators import profiles
from ...sources import keyed, sinks, tables
from ..registry import query, scratch_path, view
from .structures import rounded

AUDIT = ("em", "st_gap", "n5_spin", "hfcc_primary", "iso", "hb_cap", "flex")


# --- tables from files: the measurements are written as CSV and read back -------


def csv_folder(t):
    path = scratch_path(t)
    source = t.evals.select(
        F.col("pdb_id").cast("string").alias("PDB ID"),
        F.when(F.col("uniprot_id") % 10 != 0, F.concat(F.lit("P"), F.col("uniprot_id").cast("string"))).alias("uniprot_id"),
        F.round("em", 4).alias("EM"), F.round("iso", 3).alias("Around N5-IsoelectricPoint"),
        F.col("hb_cap").alias("Around_N5_nH-bonds"), F.round("flex", 3).alias("Around_N5 Flexibility"))
    sinks.overwrite_table(source, path, "csv")
    return path


@query("s07_read_table", """
SELECT CAST(pdb_id AS VARCHAR) AS "PDB_ID", CASE WHEN uniprot_id % 10 <> 0 THEN 'P' || CAST(uniprot_id AS VARCHAR) END AS uniprot_id, CAST(hb_cap AS VARCHAR) AS "Around_N5_nH_bonds" FROM eval_fx""")
def _(t):
    return tables.read_table(t.spark, csv_folder(t)).select("PDB_ID", "uniprot_id", "Around_N5_nH_bonds")


@query("s08_load_measurements", """
SELECT CAST(pdb_id AS VARCHAR) AS pdb_id, CASE WHEN uniprot_id % 10 <> 0 THEN 'P' || CAST(uniprot_id AS VARCHAR) ELSE 'UNK' END AS uniprot_id,
  'FMN' AS cofactor, 'UNK' AS nearest_resname, round(em, 4) AS em, hb_cap FROM eval_fx""")
def _(t):
    loaded = tables.load_measurements(t.spark, "/nonexistent/table.csv", csv_folder(t))
    return loaded.select("pdb_id", "uniprot_id", "cofactor", "nearest_resname", "em", "hb_cap")


LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("profile_id", T.StringType()),
    T.StructField("value", T.DoubleType())])


@query("s09_tolerant_read", """
SELECT seq, profile_id, value FROM log_fx WHERE seq % 50 <> 0""")
def _(t):
    path = scratch_path(t)
    # Every fiftieth line holds text where a number belongs.
    line = F.concat_ws(",", F.when(F.col("seq") % 50 == 0, "not a number").otherwise(
        F.col("seq").cast("string")), "profile_id", F.col("value").cast("string"))
    t.log.select(line.alias("value")).write.mode("overwrite").text(path)
    good = tables.safe_read_table(t.spark, path, LOG_SCHEMA, header=False)
    absent = tables.safe_read_table(t.spark, path + "-absent", LOG_SCHEMA)
    return good.unionByName(absent)


@query("s10_append_log", "SELECT seq, profile_id, label, value, CASE WHEN seq % 2 = 1 THEN 1.0::DOUBLE END AS gpr_sigma FROM log_fx")
def _(t):
    path = scratch_path(t)
    expected = ["seq", "profile_id", "label", "value"]
    sinks.append_log(t.log.where(F.col("seq") % 2 == 0), path, expected)
    sinks.append_log(t.log.where(F.col("seq") % 2 == 1).withColumn("gpr_sigma", F.lit(1.0)), path, expected)
    return sinks.read_log(t.spark, path).select(*expected, "gpr_sigma")


@query("s11_overwrite_table", "SELECT seq, value FROM log_fx WHERE seq % 2 = 0")
def _(t):
    path = scratch_path(t)
    sinks.overwrite_table(t.log.select("seq", "value"), path)
    sinks.overwrite_table(t.log.where(F.col("seq") % 2 == 0).select("seq", "value"), path)
    return t.spark.read.parquet(path)


@query("s12_last_row_per_profile", "SELECT profile_id, max(seq) AS seq, arg_max(label, seq) AS label, arg_max(value, seq) AS value FROM log_fx GROUP BY 1")
def _(t):
    path = scratch_path(t)
    sinks.overwrite_table(profiles.latest_per_key(t.log, "profile_id"), path)
    return t.spark.read.parquet(path).select("profile_id", "seq", "label", "value")


@query("s12_keyed_upsert", """
SELECT profile_id, max(seq) AS seq, arg_max(label, seq) AS label, arg_max(value, seq) AS value, CASE WHEN max(seq) % 3 = 1 THEN arg_max(value, seq) * 2 END AS gpr_sigma
FROM log_fx GROUP BY 1""")
def _(t):
    path = scratch_path(t)
    parts = [t.log.where("seq % 3 = 0"), t.log.where("seq % 3 = 1").withColumn("gpr_sigma", F.col("value") * 2), t.log.where("seq % 3 = 2")]
    # The first part once more at the end changes nothing.
    for part in (*parts, parts[0]):
        keyed.upsert(part, path, "profile_id", "seq")
    return keyed.read_keyed(t.spark, path)


@query("u04_keyed_insert_absent", "SELECT profile_id, min(seq) AS seq, arg_min(value, seq) AS value FROM log_fx GROUP BY 1")
def _(t):
    path = scratch_path(t)
    rows = t.log.select("profile_id", "seq", "value")
    for part in (rows.where("seq % 2 = 1"), rows.where("seq % 2 = 0"), rows.where("seq % 4 = 1")):
        keyed.upsert(part, path, "profile_id", "seq", replace=False)
    return keyed.read_keyed(t.spark, path)


@query("s14_finite_json", """
SELECT pdb_id, '{"eigenvalues":[' || CASE WHEN pdb_id % 3 = 0 THEN 'null' ELSE CAST(CAST(hb_cap AS BIGINT) AS VARCHAR) || '.0' END || ',' ||
  CASE WHEN pdb_id % 4 = 0 THEN 'null' ELSE CAST(CAST(hb_cap + 100 AS BIGINT) AS VARCHAR) || '.0' END || ']}' AS payload FROM eval_fx""")
def _(t):
    first = F.when(F.col("pdb_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("hb_cap"))
    second = F.when(F.col("pdb_id") % 4 == 0, F.lit(float("-inf"))).otherwise(F.col("hb_cap") + 100)
    return t.evals.select("pdb_id", jsonio.eigenvalue_payload(first, second).alias("payload"))


@query("s15_profile_export", """
SELECT seq, '{"profile_id":"' || profile_id || '","label":"' || label || '","seq":' || seq || '}' AS json_text, profile_id || ',' || label || ',' || seq AS csv_text FROM log_fx""")
def _(t):
    return t.log.select(
        "seq", jsonio.json_text(F.struct("profile_id", "label", "seq")).alias("json_text"),
        sinks.csv_text("profile_id", "label", "seq").alias("csv_text"))


# --- log maintenance ----------------------------------------------------------
@query("w12_latest_per_key", """
SELECT profile_id, seq, label, value FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq DESC) AS rn FROM log_fx) WHERE rn = 1""")
def _(t):
    return profiles.latest_per_key(t.log, "profile_id")


@query("w12_last_rows", "SELECT * FROM log_fx ORDER BY seq DESC LIMIT 5")
def _(t):
    return profiles.last_rows(t.log, 5)


@query("u01_append_rows", """
SELECT * FROM log_fx UNION ALL SELECT * REPLACE (seq + 1000000 AS seq) FROM log_fx WHERE value > 20""")
def _(t):
    extra = t.log.where(F.col("value") > 20).withColumn("seq", F.col("seq") + 1000000)
    return profiles.append_rows(t.log, extra)


@query("u02_append_aligned", """
SELECT NULL::DOUBLE AS gpr_sigma, label, profile_id, seq, value FROM log_fx UNION ALL SELECT value * 2, NULL, profile_id, seq, value FROM log_fx WHERE seq % 3 = 0""")
def _(t):
    second = t.log.where(F.col("seq") % 3 == 0).drop("label").withColumn("gpr_sigma", F.col("value") * 2)
    return profiles.append_aligned(t.log, second)


@query("u03_drop_duplicate_columns", "SELECT seq, value, label FROM log_fx")
def _(t):
    doubled = t.log.select("seq", "value", F.upper("label").alias("value"), "label", F.lit(0).alias("seq"))
    return profiles.drop_duplicate_columns(doubled)


@query("u04_insert_absent", """
SELECT profile_id, 1 AS source FROM (SELECT DISTINCT profile_id FROM log_fx WHERE seq % 7 = 0)
UNION ALL SELECT lower(profile_id), 2 FROM (SELECT DISTINCT profile_id FROM log_fx) d WHERE profile_id NOT IN (SELECT profile_id FROM log_fx WHERE seq % 7 = 0)""")
def _(t):
    have = t.log.where(F.col("seq") % 7 == 0).select("profile_id").distinct().withColumn("source", F.lit(1))
    new = t.log.select(F.lower("profile_id").alias("profile_id")).distinct().withColumn("source", F.lit(2))
    return profiles.insert_absent(have, new, "profile_id")


# --- lookups --------------------------------------------------------------------
view("wt_log_sql", """
SELECT seq, profile_id || CASE WHEN seq % 4 = 0 THEN '_WT' WHEN seq % 4 = 1 THEN '_WT_mutation' WHEN seq % 4 = 2 THEN '_WT_copy' ELSE '_AQ1K_mutation' END AS profile_id, value
FROM log_fx WHERE NOT (profile_id LIKE '%5' AND seq % 4 < 2)""")


def wt_log(t):
    turn = F.col("seq") % 4
    suffix = F.when(turn == 0, "_WT").when(turn == 1, "_WT_mutation").when(
        turn == 2, "_WT_copy").otherwise("_AQ1K_mutation")
    return t.log.where(~(F.col("profile_id").endswith("5") & (turn < 2))).select(
        "seq", F.concat("profile_id", suffix).alias("profile_id"), "value")


WT_ROW = """
SELECT r.pdb_id, w.seq AS wt_seq, w.profile_id AS wt_profile_id, w.value AS wt_value FROM (SELECT DISTINCT lower(profile_id) AS pdb_id FROM log_fx) r LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY base ORDER BY exact DESC, seq DESC) AS rn FROM (
    SELECT *, split_part(upper(profile_id), '_WT', 1) AS base, upper(profile_id) IN (split_part(upper(profile_id), '_WT', 1) || '_WT', split_part(upper(profile_id), '_WT', 1) || '_WT_MUTATION') AS exact
    FROM wt_log_sql WHERE upper(profile_id) LIKE '%\\_WT%' ESCAPE '\\')) w ON w.base = upper(r.pdb_id) AND w.rn = 1"""


@query("j12_wild_type_row", WT_ROW)
def _(t):
    requests = t.log.select(F.lower("profile_id").alias("pdb_id")).distinct()
    return profiles.wild_type_rows(requests, wt_log(t))


view("runs_sql", """
SELECT pdb_id AS seq, 'r' || CAST(pdb_id AS VARCHAR) AS run_key, 'p' || CAST(uniprot_id AS VARCHAR) AS profile_id, 'm' || CAST(pdb_id % 500 AS VARCHAR) AS mutation_list, cofactor, em FROM eval_fx WHERE pdb_id % 2 = 0""")


@query("j13_lookup_cascade", """
WITH q AS (SELECT CASE WHEN pdb_id % 4 = 0 THEN 'r' || CAST(pdb_id AS VARCHAR) ELSE 'none' END AS run_key,
             CASE WHEN pdb_id % 3 = 0 THEN 'p' || CAST(uniprot_id AS VARCHAR) ELSE 'none' END AS profile_id,
             CASE WHEN pdb_id % 5 <> 0 THEN 'm' || CAST(pdb_id % 500 AS VARCHAR) ELSE 'none' END AS mutation_list, cofactor, pdb_id FROM eval_fx),
 a AS (SELECT run_key, max(struct_pack(s := seq, em := em)) AS b FROM runs_sql GROUP BY 1), p AS (SELECT profile_id, max(struct_pack(s := seq, em := em)) AS b FROM runs_sql GROUP BY 1),
 m AS (SELECT mutation_list, cofactor, max(struct_pack(s := seq, em := em)) AS b FROM runs_sql GROUP BY ALL), l AS (SELECT max(struct_pack(s := seq, em := em)) AS b FROM runs_sql)
SELECT q.pdb_id, CASE WHEN a.b IS NOT NULL THEN 'run_key' WHEN p.b IS NOT NULL THEN 'profile_id' WHEN m.b IS NOT NULL THEN 'mutation_list' ELSE 'last_row' END AS source,
  coalesce(a.b, p.b, m.b, l.b).s AS seq, round(coalesce(a.b, p.b, m.b, l.b).em, 6) AS em
FROM q LEFT JOIN a ON a.run_key = q.run_key LEFT JOIN p ON p.profile_id = q.profile_id LEFT JOIN m ON m.mutation_list = q.mutation_list AND m.cofactor = q.cofactor, l""")
def _(t):
    key = F.col("pdb_id")
    def text(prefix, value):
        return F.concat(F.lit(prefix), value.cast("string"))
    runs = t.evals.where(key % 2 == 0).select(
        key.alias("seq"), text("r", key).alias("run_key"), text("p", F.col("uniprot_id")).alias("profile_id"),
        text("m", key % 500).alias("mutation_list"), "cofactor", "em")
    requests = t.evals.select(
        F.when(key % 4 == 0, text("r", key)).otherwise("none").alias("run_key"),
        F.when(key % 3 == 0, text("p", F.col("uniprot_id"))).otherwise("none").alias("profile_id"),
        F.when(key % 5 != 0, text("m", key % 500)).otherwise("none").alias("mutation_list"),
        "cofactor", "pdb_id")
    return profiles.lookup_cascade(requests, runs, ["em"]).select("pdb_id", "source", "seq", *rounded("em"))


# Requests without a run key; lists of both cases of cofactor, null lists, and no cofactor at all.
view("loose_sql", """
SELECT pdb_id, NULL::VARCHAR AS run_key, CASE WHEN pdb_id % 9 = 0 THEN 'p' || CAST(uniprot_id AS VARCHAR) END AS profile_id, CASE WHEN pdb_id % 4 = 0 THEN 'm' || CAST(pdb_id % 300 AS VARCHAR) END AS mutation_list,
  CASE WHEN pdb_id % 3 = 0 THEN lower(cofactor) WHEN pdb_id % 3 = 1 THEN cofactor WHEN pdb_id % 2 = 0 THEN '' END AS cofactor FROM eval_fx""")
view("looseruns_sql", """
SELECT seq, run_key, CASE WHEN seq % 6 = 0 THEN profile_id END AS profile_id, CASE WHEN seq % 10 <> 0 THEN mutation_list END AS mutation_list,
  CASE WHEN seq % 14 = 0 THEN NULL WHEN seq % 8 = 0 THEN lower(cofactor) ELSE cofactor END AS cofactor, em FROM runs_sql""")


@query("j13_lookup_cascade_loose", """
WITH p AS (SELECT profile_id, max(struct_pack(s := seq, em := em)) AS b FROM looseruns_sql WHERE profile_id IS NOT NULL GROUP BY 1),
 m AS (SELECT coalesce(mutation_list, '') AS l, upper(cofactor) AS c, max(struct_pack(s := seq, em := em)) AS b FROM looseruns_sql WHERE cofactor IS NOT NULL GROUP BY ALL),
 n AS (SELECT coalesce(mutation_list, '') AS l, max(struct_pack(s := seq, em := em)) AS b FROM looseruns_sql GROUP BY 1), l AS (SELECT max(struct_pack(s := seq, em := em)) AS b FROM looseruns_sql)
SELECT q.pdb_id, CASE WHEN p.b IS NOT NULL THEN 'profile_id' WHEN coalesce(m.b, n.b) IS NOT NULL THEN 'mutation_list' ELSE 'last_row' END AS source,
  coalesce(p.b, m.b, n.b, l.b).s AS seq, round(coalesce(p.b, m.b, n.b, l.b).em, 6) AS em
FROM loose_sql q LEFT JOIN p ON p.profile_id = q.profile_id LEFT JOIN m ON m.l = coalesce(q.mutation_list, '') AND m.c = nullif(upper(q.cofactor), '')
LEFT JOIN n ON n.l = coalesce(q.mutation_list, '') AND coalesce(q.cofactor, '') = '', l""")
def _(t):
    key, none = F.col("pdb_id"), F.lit(None).cast("string")
    def text(prefix, value):
        return F.concat(F.lit(prefix), value.cast("string"))
    requests = t.evals.select(
        "pdb_id", none.alias("run_key"), F.when(key % 9 == 0, text("p", F.col("uniprot_id"))).alias("profile_id"),
        F.when(key % 4 == 0, text("m", key % 300)).alias("mutation_list"),
        F.when(key % 3 == 0, F.lower("cofactor")).when(key % 3 == 1, F.col("cofactor")).when(key % 2 == 0, "").alias("cofactor"))
    runs = t.evals.where(key % 2 == 0).select(
        key.alias("seq"), text("r", key).alias("run_key"), F.when(key % 6 == 0, text("p", F.col("uniprot_id"))).alias("profile_id"),
        F.when(key % 10 != 0, text("m", key % 500)).alias("mutation_list"),
        F.when(key % 14 == 0, none).when(key % 8 == 0, F.lower("cofactor")).otherwise(F.col("cofactor")).alias("cofactor"), "em")
    return profiles.lookup_cascade(requests, runs, ["em"]).select("pdb_id", "source", "seq", *rounded("em"))


@query("j14_entries_in_both", """
SELECT upper(b.profile_id) AS id_upper, b.seq AS bulk_seq, b.value AS bulk_value, p.seq AS profile_seq, p.value AS profile_value
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS rn FROM log_fx WHERE label = 'click') WHERE rn = 1) b
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS rn FROM log_fx WHERE label = 'error') WHERE rn = 1) p ON p.profile_id = b.profile_id""")
def _(t):
    slim = t.log.select(F.col("profile_id").alias("pdb_id"), "seq", "value", "label")
    bulk = slim.where(F.col("label") == "click").drop("label").withColumn("pdb_id", F.lower("pdb_id"))
    return profiles.entries_in_both(bulk, slim.where(F.col("label") == "error").drop("label"))


# --- variant audit: each order against the first order of its customer -----------
view("pair_sql", f"""
SELECT m.pdb_id, {", ".join(f"w.{f} AS wt_{f}, m.{f} AS mut_{f}" for f in AUDIT)} FROM eval_fx m
JOIN (SELECT uniprot_id, min(pdb_id) AS first_id FROM eval_fx GROUP BY 1) k ON k.uniprot_id = m.uniprot_id JOIN eval_fx w ON w.pdb_id = k.first_id""")
view("diff_sql", " UNION ALL ".join(f"""
SELECT pdb_id, '{'pred_final' if f == 'em' else f}' AS feature, wt_{f} AS wt, mut_{f} AS mut, mut_{f} - wt_{f} AS delta,
 abs(mut_{f} - wt_{f}) >= 1e-3 OR abs(mut_{f} - wt_{f}) / (abs(wt_{f}) + 1e-9) >= 0.02 AS changed FROM pair_sql""" for f in AUDIT))


def diffs(t):
    rows = t.evals.select("pdb_id", "uniprot_id", *AUDIT).withColumnRenamed("em", "pred_final")
    fields = ["pred_final", *AUDIT[1:]]
    first = rows.groupBy("uniprot_id").agg(F.min(F.struct("pdb_id", *fields)).alias("w"))
    wild = rows.select("pdb_id", "uniprot_id").join(first, "uniprot_id").select(
        "pdb_id", *(F.col(f"w.{f}").alias(f) for f in fields))
    return profiles.feature_diff(wild, rows, "pdb_id", fields)


@query("j15_feature_diff", """
SELECT pdb_id, feature, round(wt, 9) AS wt, round(mut, 9) AS mut, round(delta, 9) AS delta, changed FROM diff_sql""")
def _(t):
    return diffs(t).select("pdb_id", "feature", *rounded("wt", "mut", "delta", digits=9), "changed")


@query("j16_audit_summary", """
SELECT pdb_id, count(*) AS n_features, count(*) FILTER (changed) AS n_changed,
  CASE WHEN count(*) FILTER (changed) = 0 THEN 'no feature changed' WHEN count(*) FILTER (changed) < 3 THEN 'weak sensitivity' ELSE 'ok' END AS warning,
  coalesce(abs(max(b.brightness) - max(b.wt_em)) < 1e-3, false) AS emission_unchanged
FROM diff_sql JOIN (SELECT pdb_id, wt_em, CASE WHEN pdb_id % 7 = 0 THEN wt_em WHEN pdb_id % 5 <> 0 THEN mut_em END AS brightness FROM pair_sql) b USING (pdb_id) GROUP BY 1""")
def _(t):
    # A seventh of the mutants is as bright as the wild type predicts; some have no brightness.
    rows = t.evals.select("pdb_id", "uniprot_id", "em")
    first = rows.groupBy("uniprot_id").agg(F.min_by("em", "pdb_id").alias("wt_pred_final"))
    key = F.col("pdb_id")
    emission = rows.join(first, "uniprot_id").select("pdb_id", "wt_pred_final", F.when(
        key % 7 == 0, F.col("wt_pred_final")).when(key % 5 != 0, F.col("em")).alias("brightness"))
    return profiles.audit_summary(diffs(t), "pdb_id", emission)


@query("p31_headline_deltas", """
SELECT pdb_id, round(CASE WHEN pdb_id % 5 <> 0 THEN iso END - wt_em, 6) AS brightness_delta, round(mut_st_gap - wt_st_gap / 1000, 12) AS st_gap_delta, round(mut_flex - CASE WHEN pdb_id % 4 <> 0 THEN wt_flex END, 6) AS scs_delta
FROM (SELECT *, mut_iso AS iso FROM pair_sql)""")
def _(t):
    rows = t.evals.select("pdb_id", "uniprot_id", "em", "iso", "st_gap", "flex")
    first = rows.groupBy("uniprot_id").agg(F.min(F.struct("pdb_id", "em", "st_gap", "flex")).alias("w"))
    key = F.col("pdb_id")
    staged = rows.join(first, "uniprot_id").select(
        "pdb_id", F.when(key % 5 != 0, F.col("iso")).otherwise(F.lit(float("nan"))).alias("brightness"),
        F.col("st_gap").alias("st_gap_ev"), F.col("flex").alias("scs"), F.col("w.em").alias("wt_pred_final"),
        F.col("w.st_gap").alias("wt_st_gap"), F.when(key % 4 != 0, F.col("w.flex")).alias("wt_scs"))
    return profiles.headline_deltas(staged).select(
        "pdb_id", F.round("brightness_delta", 6).alias("brightness_delta"),
        F.round("st_gap_delta", 12).alias("st_gap_delta"), F.round("scs_delta", 6).alias("scs_delta"))


# --- row rules of the display -----------------------------------------------------
@query("p22_first_finite", """
SELECT pdb_id, coalesce(TRY_CAST(a AS DOUBLE), b, round(em, 3)) AS value FROM (
  SELECT *, CASE WHEN pdb_id % 3 = 0 THEN 'n/a' WHEN pdb_id % 3 = 1 THEN CAST(pdb_id AS VARCHAR) END AS a, CASE WHEN pdb_id % 2 = 0 THEN hb_cap END AS b FROM eval_fx)""")
def _(t):
    key = F.col("pdb_id")
    text = F.when(key % 3 == 0, "n/a").when(key % 3 == 1, key.cast("string"))
    second = F.when(key % 2 == 0, F.col("hb_cap")).otherwise(F.lit(float("inf")))
    return t.evals.select("pdb_id", rules.first_finite(text, second, F.round("em", 3)).alias("value"))


@query("p23_prediction_display", """
SELECT pdb_id, CASE WHEN g IS NULL THEN 'proxy_only' WHEN abs(g + 208.30234375) < 1e-3 AND r IS NOT NULL THEN printf('%.3f (quantum fallback)', r) WHEN abs(g + 208.30234375) < 1e-3 THEN 'proxy_only'
  WHEN pdb_id % 2 = 1 THEN printf('%.3f (local fallback)', g) ELSE printf('%.3f', g) END AS display
FROM (SELECT pdb_id, CASE WHEN pdb_id % 5 = 0 THEN -208.30234375 WHEN pdb_id % 7 = 0 THEN NULL ELSE gpr_pred_raw END AS g, CASE WHEN pdb_id % 3 <> 0 THEN pred_q END AS r FROM eval_fx)""")
def _(t):
    key = F.col("pdb_id")
    gpr = F.when(key % 5 == 0, C.TRAINING_MEAN_EM).when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("gpr_pred_raw"))
    return t.evals.select("pdb_id", profiles.prediction_display(
        gpr, F.when(key % 3 != 0, F.col("pred_q")), (key % 2)).alias("display"))


@query("p24_cofactor_checks", """
SELECT pdb_id, CASE WHEN present THEN 'PASS' WHEN pdb_id % 2 = 0 THEN 'FORCED' ELSE 'FAIL' END AS status,
  concat_ws(';', CASE WHEN pdb_id % 4 = 0 AND cofactor = 'FMN' THEN 'override: FAD selected, FMN detected' END,
    CASE WHEN NOT present THEN 'geometry check failed: ' || CASE WHEN pdb_id % 4 = 0 THEN 'FAD' ELSE 'FMN' END END) AS warnings
FROM (SELECT *, pdb_id % 3 <> 0 AS present FROM eval_fx)""")
def _(t):
    key = F.col("pdb_id")
    choice = F.when(key % 4 == 0, "fad").otherwise(F.lit("FMN"))
    return t.evals.select(
        "pdb_id", rules.validation_status(key % 3 != 0, key % 2 == 0).alias("status"),
        F.concat_ws(";", profiles.cofactor_warnings(choice, F.col("cofactor"), key % 3 != 0)).alias("warnings"))


@query("p30_profile_id", """
SELECT seq, upper(profile_id) || CASE WHEN k = '' THEN '_WT' ELSE '_' || replace(replace(k, ',', '_'), ':', '') || '_mutation' END AS name
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN '' ELSE 'A:Q' || CAST(seq AS VARCHAR) || 'K,B:D1R' END AS k FROM log_fx)""")
def _(t):
    key = F.when(F.col("seq") % 3 == 0, "").otherwise(
        F.concat(F.lit("A:Q"), F.col("seq").cast("string"), F.lit("K,B:D1R")))
    return t.log.select("seq", profiles.profile_id(F.col("profile_id"), key).alias("name"))


@query("p34_accession_override", """
SELECT pdb_id, CASE WHEN acc IN ('P26484', 'Q9VBW3') OR acc LIKE 'CRY%' THEN 'Radical Pair (Cryptochrome)' ELSE cofactor || '-Quantum-State' END AS mode
FROM (SELECT *, CASE uniprot_id % 7 WHEN 0 THEN 'P26484' WHEN 1 THEN 'CRY1' WHEN 2 THEN 'Q9VBW3' ELSE 'P' || CAST(uniprot_id AS VARCHAR) END AS acc FROM eval_fx)""")
def _(t):
    turn = F.col("uniprot_id") % 7
    accession = F.when(turn == 0, "P26484").when(turn == 1, "CRY1").when(turn == 2, "Q9VBW3").otherwise(
        F.concat(F.lit("P"), F.col("uniprot_id").cast("string")))
    return t.evals.select("pdb_id", rules.accession_mode(
        accession, F.concat("cofactor", F.lit("-Quantum-State"))).alias("mode"))

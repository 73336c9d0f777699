"""Learned models.  Where the fit has no SQL form, the SQL states the row that a working fit must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import learning
from ...session import checkpoint
from ..registry import query, view
from .evaluation import evals
from .structures import rounded


@query("m01_standardise", """
SELECT pdb_id, round((iso - im) / isd, 6) AS z_iso, round((hb_cap - hm) / hsd, 6) AS z_hb_cap, round((flex - fm) / fsd, 6) AS z_flex
FROM ev_sql, (SELECT avg(iso) AS im, stddev_pop(iso) AS isd, avg(hb_cap) AS hm, stddev_pop(hb_cap) AS hsd, avg(flex) AS fm, stddev_pop(flex) AS fsd FROM ev_sql)""")
def _(t):
    return learning.standardise(evals(t)).select("pdb_id", *rounded("z_iso", "z_hb_cap", "z_flex"))


@query("m02_fourier_regression", "SELECT count(*) AS n, count(*) AS n_sigma, true AS beats_mean FROM ev_sql")
def _(t):
    rows = evals(t).select("pdb_id", "em", *learning.FEATURES)
    # At unit scales, as the query has always been; the search for scales is in m02_held_out.
    predicted = learning.fit_fourier(rows, length_scales=(1.0, 1.0, 1.0)).predict(rows)
    error = F.col("em") - F.col("gpr_pred_raw")
    return predicted.agg(
        F.count("*").alias("n"), F.count_if(F.col("gpr_sigma") > 0).alias("n_sigma"),
        (F.avg(error * error) <= F.var_pop("em")).alias("beats_mean"))


@query("m03_local_forest", "SELECT count(*) AS n, count(*) AS n_predicted, true AS beats_mean FROM ev_sql")
def _(t):
    rows = evals(t).select("pdb_id", "em", *learning.FEATURES)
    predicted = learning.predict_local(learning.fit_local_forest(rows), rows)
    error = F.col("em") - F.col("local_pred")
    return predicted.agg(F.count("*").alias("n"), F.count("local_pred").alias("n_predicted"),
                         (F.avg(error * error) <= F.var_pop("em")).alias("beats_mean"))


# Lloyd steps from a cut at each feature's mean, unrolled until they have long come to rest.
STEPS = 40
for _f in ("iso", "hb_cap"):
    view(f"means_{_f}_0_sql", f"""
SELECT avg(iso) FILTER ({_f} <= m) AS ai, avg(hb_cap) FILTER ({_f} <= m) AS ah, avg(iso) FILTER ({_f} > m) AS bi, avg(hb_cap) FILTER ({_f} > m) AS bh
FROM ev_sql, (SELECT avg({_f}) AS m FROM ev_sql)""")
    for _k in range(STEPS):
        view(f"means_{_f}_{_k + 1}_sql", f"""
SELECT avg(iso) FILTER (low) AS ai, avg(hb_cap) FILTER (low) AS ah, avg(iso) FILTER (NOT low) AS bi, avg(hb_cap) FILTER (NOT low) AS bh, sum(spread) AS spread FROM (
  SELECT iso, hb_cap, da <= db AS low, least(da, db) AS spread FROM (
    SELECT iso, hb_cap, pow(iso - ai, 2) + pow(hb_cap - ah, 2) AS da, pow(iso - bi, 2) + pow(hb_cap - bh, 2) AS db FROM ev_sql, means_{_f}_{_k}_sql))""")
view("means_sql", f"""
SELECT * FROM (SELECT *, 1 AS turn FROM means_iso_{STEPS}_sql UNION ALL SELECT *, 2 FROM means_hb_cap_{STEPS}_sql) ORDER BY spread, turn LIMIT 1""")
view("clustered_sql", """
SELECT *, CASE WHEN ai <= bi THEN CASE WHEN da <= db THEN 'nitroreductase' ELSE 'reductase' END ELSE CASE WHEN db <= da THEN 'nitroreductase' ELSE 'reductase' END END AS named
FROM (SELECT pdb_id, iso, hb_cap, ai, bi, pow(iso - ai, 2) + pow(hb_cap - ah, 2) AS da, pow(iso - bi, 2) + pow(hb_cap - bh, 2) AS db FROM ev_sql, means_sql)""")


@query("m04_cluster_families", "SELECT named AS family, count(*) AS n, round(avg(iso), 1) AS mean_iso FROM clustered_sql GROUP BY 1")
def _(t):
    return learning.cluster_families(evals(t)).groupBy("family").agg(
        F.count("*").alias("n"), F.round(F.avg("iso"), 1).alias("mean_iso"))


@query("m04_family_of_each", "SELECT pdb_id, named AS family FROM clustered_sql")
def _(t):
    return learning.cluster_families(evals(t)).select("pdb_id", "family")


# A fifth of the rows is held out; the model has to beat the training mean of each row's bond count.  The measured values
# of the tables do not depend on the features, so they enter as the noise of a target that does.
TARGET = "40 * sin(iso / 3) + 30 * cos(hb_cap) + em / 20"
view("target_sql", f"SELECT pdb_id, hb_cap, {TARGET} AS y FROM ev_sql")
view("heldout_sql", """
SELECT count(*) AS n, round(avg(pow(y - coalesce(g.m, a.m), 2)), 4) AS baseline_mse
FROM target_sql e LEFT JOIN (SELECT hb_cap, avg(y) AS m FROM target_sql WHERE pdb_id % 5 <> 0 GROUP BY 1) g ON g.hb_cap = e.hb_cap,
 (SELECT avg(y) AS m FROM target_sql WHERE pdb_id % 5 <> 0) a
WHERE pdb_id % 5 = 0""")


def held_out(t):
    """Training rows, and the rest with the baseline's prediction; one feature is noise."""
    noise = F.pmod(F.xxhash64("pdb_id"), F.lit(1000)) / 1000
    rows = checkpoint(evals(t).select("pdb_id", F.expr(TARGET).alias("em"), *learning.FEATURES, noise.alias("noise")))
    train = rows.where(F.col("pdb_id") % 5 != 0)
    grouped = train.groupBy("hb_cap").agg(F.avg("em").alias("_g"))
    rest = rows.where(F.col("pdb_id") % 5 == 0).join(grouped, "hb_cap", "left").withColumn(
        "baseline", F.coalesce("_g", train.agg(F.avg("em")).scalar()))
    return train, rest


def against_baseline(predicted, column):
    def squared(c):
        return (F.col("em") - F.col(c)) * (F.col("em") - F.col(c))
    return predicted.agg(F.count("*").alias("n"), F.round(F.avg(squared("baseline")), 4).alias("baseline_mse"),
                         (F.avg(squared(column)) < F.avg(squared("baseline"))).alias("beats_baseline"))


@query("m02_held_out", "SELECT *, true AS beats_baseline, true AS noise_has_longest_scale FROM heldout_sql")
def _(t):
    train, rest = held_out(t)
    features = (*learning.FEATURES, "noise")
    model = learning.fit_fourier(train, features=features)
    longest = model.length_scales[-1] == max(model.length_scales) > min(model.length_scales)
    return against_baseline(model.predict(rest, features), "gpr_pred_raw").withColumn("noise_has_longest_scale", F.lit(longest))


@query("m03_held_out", "SELECT *, true AS beats_baseline FROM heldout_sql")
def _(t):
    train, rest = held_out(t)
    return against_baseline(learning.predict_local(learning.fit_local_forest(train), rest), "local_pred")


@query("m04_name_families", """
SELECT pdb_id, CASE WHEN pow(iso - 18.5, 2) + pow(hb_cap - 3, 2) <= pow(iso - 30.25, 2) + pow(hb_cap - 6, 2) THEN 'nitroreductase' ELSE 'reductase' END AS family FROM ev_sql""")
def _(t):
    return learning.name_families(evals(t), [(30.25, 6.0), (18.5, 3.0)]).select("pdb_id", "family")

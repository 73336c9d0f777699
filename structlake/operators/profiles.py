"""Profile log: latest rows, lookups, unions and variant comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C, rules
from ..session import checkpoint
from .extremes import extreme_rows


def latest_per_key(log: DataFrame, key: str | list[str], seq: str = "seq",
                   values: list[str] | None = None) -> DataFrame:
    """Row with the highest sequence number of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = values or [c for c in log.columns if c not in (*keys, seq)]
    return extreme_rows(log.select(*keys, seq, *rest), keys, seq)


def last_rows(log: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return log.orderBy(F.desc(seq)).limit(n)


def append_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def append_aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union over the sorted set of columns, missing ones NULL."""
    merged = first.unionByName(second, allowMissingColumns=True)
    return merged.select(*sorted(merged.columns))


def drop_duplicate_columns(frame: DataFrame) -> DataFrame:
    """First column of each name."""
    kept, seen, names = [], set(), []
    for position, name in enumerate(frame.columns):
        names.append(f"_c{position}")
        if name not in seen:
            seen.add(name)
            kept.append(F.col(f"_c{position}").alias(name))
    return frame.toDF(*names).select(*kept)


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Add only rows whose id is not in the table yet, ignoring case."""
    have = table.select(F.upper(key).alias("_k")).distinct()
    fresh = new.withColumn("_k", F.upper(key)).join(have, "_k", "left_anti").drop("_k")
    return table.unionByName(fresh)


def profile_id(pdb_id: Column, mutation_key: Column) -> Column:
    """``ID_key_mutation``; commas become underscores, colons vanish."""
    base = F.coalesce(F.upper(pdb_id.cast("string")), F.lit("UNDEF"))
    key = F.translate(F.coalesce(mutation_key, F.lit("")), ",:", "_")
    return F.when(key == "", F.concat(base, F.lit("_WT"))).otherwise(
        F.concat(base, F.lit("_"), key, F.lit("_mutation")))


def wild_type_rows(requests: DataFrame, profiles: DataFrame,
                   seq: str = "seq") -> DataFrame:
    """Wild-type profile of each requested id: exact name, else its prefix.

    Both tests become one equality on the id before ``_WT``, so no prefix
    comparison between all pairs is planned; the last match wins.
    """
    name = F.upper("profile_id")
    base = F.regexp_extract(name, r"^(.*?)_WT", 1)
    exact = name.isin(F.concat(base, F.lit("_WT")), F.concat(base, F.lit("_WT_MUTATION")))
    keyed = profiles.where(name.contains("_WT")).select(
        base.alias("_base"), exact.cast("int").alias("_exact"), *profiles.columns)
    best = extreme_rows(keyed, "_base", ["_exact", seq])
    rest = [c for c in profiles.columns if c != seq]
    wanted = requests.withColumn("_base", F.upper("pdb_id"))
    named = best.select("_base", *(F.col(c).alias(f"wt_{c}") for c in (seq, *rest)))
    return wanted.join(named, "_base", "left").select(*requests.columns, *(f"wt_{c}" for c in (seq, *rest)))


def _level(rest: DataFrame, log: DataFrame, asked: list[Column], held: list[Column], seq: str,
           value: list[str], source: str) -> DataFrame:
    """What no level has found yet, joined with the last log row of its key; a null key finds nothing.

    Only the keys still asked for are kept of the log before it is folded.
    """
    ask, have = [f"_a{n}" for n in range(len(asked))], [f"_h{n}" for n in range(len(held))]
    on = F.lit(True)
    for a, h in zip(ask, have):
        on = on & (F.col(a) == F.col(h))
    wanted = rest.withColumns(dict(zip(ask, asked)))
    rows = log.select(*(c.alias(h) for c, h in zip(held, have)), F.col(seq).alias("_f_seq"),
                      *(F.col(v).alias(f"_f_{v}") for v in value))
    rows = rows.join(wanted.select(*ask).dropna().distinct(), on, "left_semi")
    last = extreme_rows(rows, have, "_f_seq").withColumn("_source", F.lit(source))
    return checkpoint(wanted.join(last, on, "left").drop(*ask, *have))


def lookup_cascade(requests: DataFrame, log: DataFrame, value: list[str],
                   seq: str = "seq") -> DataFrame:
    """Result row of each request: run key, profile id, mutation list, last row.

    A level meets only the requests that the levels before have left.  A null
    mutation list is an empty one on both sides; a request that names a
    cofactor finds rows of that cofactor, case ignored, and one that names none
    goes by the list alone.
    """
    listed = [F.coalesce(F.col("mutation_list"), F.lit(""))]
    named = F.nullif(F.upper(F.col("cofactor")), F.lit(""))
    nameless = F.when(named.isNull(), listed[0])
    levels = (("run_key", [F.col("run_key")], [F.col("run_key")]),
              ("profile_id", [F.col("profile_id")], [F.col("profile_id")]),
              ("mutation_list", [*listed, named], [*listed, F.upper(F.col("cofactor"))]),
              ("mutation_list", [nameless], listed))
    rest, found = requests, []
    hits = ["_source", "_f_seq", *(f"_f_{v}" for v in value)]
    for source, asked, held in levels:
        met = _level(rest, log, asked, held, seq, value, source)
        found.append(met.where(F.col("_source").isNotNull()))
        rest = met.where(F.col("_source").isNull()).drop(*hits)
    last = log.agg(F.max(F.struct(seq, *value)).alias("last")).scalar()
    rest = rest.withColumn("_last", last)
    found.append(rest.select(*requests.columns, F.lit("last_row").alias("_source"), F.col(f"_last.{seq}").alias("_f_seq"),
                             *(F.col(f"_last.{v}").alias(f"_f_{v}") for v in value)))
    out = found[0].select(*requests.columns, *hits)
    for more in found[1:]:
        out = out.unionByName(more.select(*requests.columns, *hits))
    return out.select(*requests.columns, F.col("_source").alias("source"), F.col("_f_seq").alias(seq),
                      *(F.col(f"_f_{v}").alias(v) for v in value))


def entries_in_both(bulk: DataFrame, profiles: DataFrame, key: str = "pdb_id",
                    seq: str = "seq") -> DataFrame:
    """First row per id in each table, for ids that both tables hold."""
    def first(frame, prefix):
        rest = [c for c in frame.columns if c not in (key, seq)]
        named = frame.select(F.upper(key).alias("id_upper"), *(F.col(c).alias(f"{prefix}{c}") for c in (seq, *rest)))
        return extreme_rows(named, "id_upper", f"{prefix}{seq}", largest=False)

    return first(bulk, "bulk_").join(first(profiles, "profile_"), "id_upper")


def feature_diff(wild: DataFrame, mutant: DataFrame, key: str, fields: list[str],
                 absolute: float = C.ABSOLUTE_TOLERANCE,
                 relative: float = C.RELATIVE_TOLERANCE) -> DataFrame:
    """Long table of feature differences between two rows of one id.

    The wide rows are joined first and unpivoted after: one shuffle of ``n``
    rows instead of one of ``n × fields``.
    """
    left = wild.select(key, *(F.col(f).alias(f"wt_{f}") for f in fields))
    right = mutant.select(key, *(F.col(f).alias(f"mut_{f}") for f in fields))
    pairs = F.inline(F.array(*(F.struct(
        F.lit(f).alias("feature"), F.col(f"wt_{f}").cast("double").alias("wt"),
        F.col(f"mut_{f}").cast("double").alias("mut")) for f in fields)))
    delta = F.col("mut") - F.col("wt")
    change = F.abs(delta)
    changed = (change >= absolute) | (change / (F.abs("wt") + F.lit(1e-9)) >= relative)
    return left.join(right, key).select(key, pairs).select(
        key, "feature", "wt", "mut", delta.alias("delta"),
        F.coalesce(changed, F.lit(False)).alias("changed"))


def audit_summary(diff: DataFrame, key: str, emission: DataFrame) -> DataFrame:
    """Changed-feature count and the warning it calls for.

    ``emission`` has, per key, the mutant's ``brightness`` and the wild type's
    ``wt_pred_final``; the emission is unchanged when these two agree.
    """
    change = F.abs(rules.finite(F.col("brightness")) - rules.finite(F.col("wt_pred_final")))
    grouped = diff.groupBy(key).agg(
        F.count("*").alias("n_features"), F.count_if("changed").alias("n_changed"),
    ).join(emission.select(key, change.alias("emission_change")), key, "left")
    warning = (F.when(F.col("n_changed") == 0, "no feature changed")
               .when(F.col("n_changed") < F.floor(F.col("n_features") / 2), "weak sensitivity")
               .otherwise("ok"))
    return grouped.select(
        key, "n_features", "n_changed", warning.alias("warning"),
        F.coalesce(F.col("emission_change") < C.EMISSION_TOLERANCE, F.lit(False))
        .alias("emission_unchanged"))


def headline_deltas(rows: DataFrame) -> DataFrame:
    """Deltas against the wild type of brightness, gap and confidence.

    Expects ``brightness, st_gap_ev, scs`` and the wild type's
    ``wt_pred_final, wt_st_gap, wt_scs``; a missing side gives NULL.
    """
    return rows.withColumns({
        "brightness_delta": rules.finite(F.col("brightness")) - rules.finite(F.col("wt_pred_final")),
        "st_gap_delta": rules.finite(F.col("st_gap_ev")) - rules.finite(F.col("wt_st_gap")) / 1000.0,
        "scs_delta": rules.finite(F.col("scs")) - rules.finite(F.col("wt_scs")),
    })


def prediction_display(gpr: Column, redox: Column, fallback: Column,
                       train_mean: float = C.TRAINING_MEAN_EM) -> Column:
    """Displayed prediction: collapsed, locally corrected, or direct."""
    g, r = rules.finite(gpr), rules.finite(redox)
    used = F.coalesce(rules.finite(fallback) != 0, F.lit(False))
    def shown(value, suffix=""):
        return F.format_string("%.3f" + suffix, value)
    return (
        F.when((F.abs(g - train_mean) < 1e-3) & r.isNotNull(), shown(r, " (quantum fallback)"))
        .when(F.abs(g - train_mean) < 1e-3, "proxy_only")
        .when(g.isNull(), "proxy_only")
        .when(used, shown(g, " (local fallback)"))
        .otherwise(shown(g)))


def cofactor_warnings(choice: Column, detected: Column, geometry_ok: Column) -> Column:
    """Warnings about an overridden or absent cofactor, as an array."""
    wanted = F.upper(F.coalesce(choice, F.lit("")))
    override = (wanted == "FAD") & (detected == "FMN")
    absent = wanted.isin("FAD", "FMN") & ~geometry_ok
    return F.array_compact(F.array(
        F.when(override, "override: FAD selected, FMN detected"),
        F.when(absent, F.concat(F.lit("geometry check failed: "), wanted))))

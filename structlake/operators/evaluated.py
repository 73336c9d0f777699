"""Recommendations from evaluated results, level by level, with requests for what is missing.

Evaluation runs outside: a request table names mutation sets by run key, and a
result table answers some of them.  Each level is anti-joined with the results;
what is open is requested, what is answered goes on.  Beams are grown from the
best *evaluated* singles.  Structures without a usable single, and structures
whose results do not differ at all, fall back to the heuristic.

All joins are on the run key or the structure, and a structure holds a few
dozen states per level, so nothing grows with a structure's atoms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C, hashing, rules, scoring
from ..functions.mutation_exprs import volume_change
from ..session import checkpoint
from .extremes import extreme_rows
from .recommend import beam_levels, is_flat_response, recommend, score_singles, top_per_group

RESULT_COLUMNS = ("seq", "pred_brightness", "brightness_pred", "st_gap", "pred_final", "clash_penalty",
                  "triad_score", "scs", "feature_hash", "wavefunction_signature")
STATE_COLUMNS = ("structure_id", "mutations", "delta_brightness", "synergy", "clash_risk", "stability_risk",
                 "pred_brightness", "confidence", "total_score", "run_key", "heuristic", "feature_hash", "notes")


def _answers(states: DataFrame, results: DataFrame) -> DataFrame:
    """Each state with the values of the last result of its run key, as ``r_`` columns."""
    asked = results.join(states.select("run_key").distinct(), "run_key", "left_semi")
    last = extreme_rows(asked.select("run_key", *RESULT_COLUMNS), "run_key", "seq").select(
        "run_key", *(F.col(c).alias(f"r_{c}") for c in RESULT_COLUMNS))
    return states.join(last, "run_key")


def _brightness() -> tuple[Column, Column]:
    return rules.brightness(
        [F.col("r_pred_brightness"), F.col("r_brightness_pred")], F.col("r_st_gap"), F.col("r_pred_final"))


def _usable(note: Column) -> Column:
    return ~note.isin("UNIT_MIXUP_BUG", "BRIGHTNESS_MISSING")


def unmutated_runs(structures: DataFrame, cofactor: str = "FMN") -> DataFrame:
    """``structure_id``, ``run_key`` of the run without mutations that all others are measured against."""
    none = F.array().cast("array<struct<chain:string,resseq:string,icode:string,wt:string,mut:string>>")
    return structures.select("structure_id").distinct().withColumn(
        "run_key", hashing.run_key(F.col("structure_id").cast("string"), F.lit(cofactor), none))


def wild_types(structures: DataFrame, results: DataFrame, cofactor: str = "FMN") -> DataFrame:
    """``structure_id``, ``wt_brightness``, ``wt_gap``, ``wt_hash`` of structures whose unmutated run has a usable result."""
    value, note = _brightness()
    return _answers(unmutated_runs(structures, cofactor), results).where(_usable(note)).select(
        "structure_id", value.alias("wt_brightness"), F.col("r_st_gap").alias("wt_gap"),
        hashing.tagged_hash(F.col("r_feature_hash"), F.col("r_st_gap"), F.col("r_wavefunction_signature")).alias("wt_hash"))


def evaluate(states: DataFrame, results: DataFrame, wild: DataFrame, baseline: float = 0.0,
             confidence: float = 50.0) -> DataFrame:
    """The answered states with the scores of their results.

    Rejected are results without a usable brightness, and those whose features
    equal the wild type's although the set changes volume or hybridisation.
    Every hash carries its gap, its signature and a mark when the gap moved.
    """
    value, note = _brightness()
    joined = _answers(states.select("structure_id", "mutations", "run_key"), results).join(
        wild, "structure_id", "left").withColumns({"_value": value, "_note": note})
    change = volume_change(F.col("mutations"))
    base, gap = F.col("r_feature_hash"), F.col("r_st_gap")
    verdict = hashing.no_effect_check(hashing.tagged_hash(base, gap), F.col("wt_hash"),
                                      change["hybridisation_change"], change["volume_delta"], change["wt_reference"])
    delta = F.col("_value") - F.coalesce("wt_brightness", F.lit(float(baseline)))
    tagged = hashing.tagged_hash(base, gap, F.col("r_wavefunction_signature"), F.col("wt_gap"), F.col("wt_hash"), delta)
    clash = F.coalesce("r_clash_penalty", F.lit(0.0))
    stability = F.coalesce("r_triad_score", F.lit(0.0))
    sure = F.coalesce("r_scs", F.lit(float(confidence)))
    proxy = F.when(F.col("_note") == "emission_proxy", "; emission-derived brightness proxy").otherwise("")
    return joined.where(_usable(F.col("_note")) & (verdict != "FEATURE_HASH_COLLISION_WT")).select(
        "structure_id", "mutations", delta.alias("delta_brightness"), F.lit(0.0).alias("synergy"),
        clash.alias("clash_risk"), stability.alias("stability_risk"), F.col("_value").alias("pred_brightness"),
        sure.alias("confidence"), scoring.total_score(delta, clash, stability, sure).alias("total_score"),
        "run_key", F.lit(False).alias("heuristic"), tagged.alias("feature_hash"),
        F.concat(F.lit("Computed via full pipeline"), proxy).alias("notes"))


def requests(states: DataFrame, results: DataFrame) -> DataFrame:
    """States whose run key no result answers: what an evaluator has to run."""
    return states.select("structure_id", "mutations", "run_key").join(
        results.select("run_key").distinct(), "run_key", "left_anti")


def _heuristic(candidates: DataFrame, reasons: DataFrame, **options) -> DataFrame:
    """Heuristic recommendations of the structures that have a reason for them."""
    chosen = candidates.join(reasons, "structure_id", "left_semi")
    note = F.when(F.col("size") == 1, F.concat(
        F.lit("Conservative substitution; heuristic gain applied. ("), "reason", F.lit(")"))).otherwise(
        "Synergy heuristic applied.")
    return recommend(chosen, **options).join(reasons, "structure_id").withColumns({
        "feature_hash": F.lit(None).cast("string"), "notes": note}).select(*STATE_COLUMNS, "size", "rank")


def recommend_evaluated(candidates: DataFrame, results: DataFrame, top_n: int = C.TOP_N, max_size: int = C.MAX_COMBO_SIZE,
                        beam_width: int = C.BEAM_WIDTH, confidence: float = 50.0, baseline: float = 0.0,
                        cofactor: str = "FMN") -> tuple[DataFrame, DataFrame]:
    """Ranked recommendations of every size, and the requests that are still open (with their size).

    ``results`` has ``run_key`` and ``RESULT_COLUMNS``.  Called again with the
    answers to its requests it goes one level on; two calls settle all levels,
    as beams depend on evaluated singles alone.
    """
    options = {"confidence": confidence, "baseline": baseline, "cofactor": cofactor}
    candidates = checkpoint(candidates)
    wild = checkpoint(wild_types(candidates, results, cofactor))
    asked = score_singles(candidates, **options)
    open_sets = requests(asked, results).withColumn("size", F.lit(1))
    single = checkpoint(top_per_group(
        evaluate(asked, results, wild, baseline, confidence), ["structure_id"], top_n).drop("rank"))
    computed = single.withColumn("size", F.lit(1))
    grown = single.drop("feature_hash", "notes")
    for size, beam in beam_levels(grown, max_size, beam_width, **options).items():
        if size > 1:
            found = evaluate(beam, results, wild, baseline, confidence)
            computed = computed.unionByName(found.withColumn("size", F.lit(size)))
            open_sets = open_sets.unionByName(requests(beam, results).withColumn("size", F.lit(size)))
    computed = checkpoint(computed)
    flat = is_flat_response(computed, ["structure_id"]).where("flat").select(
        "structure_id", F.lit("computed-flat-response").alias("reason"))
    empty = candidates.select("structure_id").distinct().join(single, "structure_id", "left_anti").select(
        "structure_id", F.lit("no-computed-singles").alias("reason"))
    reasons = checkpoint(flat.union(empty))
    ranked = top_per_group(computed.join(reasons, "structure_id", "left_anti"), ["structure_id", "size"], top_n)
    told = ranked.select(*STATE_COLUMNS, "size", "rank")
    return told.unionByName(_heuristic(
        candidates, reasons, top_n=top_n, max_size=max_size, beam_width=beam_width, **options)), open_sets


def refusals(structures: DataFrame, sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row with a reason for every structure that gets no recommendation."""
    known = structures.select("structure_id").distinct()
    with_site = sites.select("structure_id", F.lit(True).alias("_site")).distinct()
    left = known.join(candidates.select("structure_id").distinct(), "structure_id", "left_anti")
    return left.join(with_site, "structure_id", "left").select(
        "structure_id", F.when(F.col("_site"), "no-candidates").otherwise("no-flavin-detected").alias("reason"))

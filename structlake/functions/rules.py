"""Rule sheets of the prediction stage as column expressions.

Each function takes columns and returns one; none looks at a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def clip(value: Column, low: float, high: float) -> Column:
    """Limit a value; missing stays missing."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def finite(value: Column) -> Column:
    """The value as a double, or NULL when it is not a finite number."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (
        F.abs(number) < F.lit(float("inf")))
    return F.when(usable, number)


def first_finite(*values: Column) -> Column:
    return F.coalesce(*(finite(v) for v in values))


def clash_penalty(pocket_min_dist: Column) -> Column:
    """100 when the pocket is clear or unmeasured, 0 when atoms clash."""
    return F.when(pocket_min_dist < 0.8, F.lit(0.0)).otherwise(F.lit(100.0))


def interpolated_parameters(iso: Column, flex: Column, hb: Column,
                            family: Column) -> dict[str, Column]:
    iso_scale = F.lit(-0.008) + 0.005 * flex
    hb_scale = F.lit(0.02) + 0.003 * F.tanh(iso / 20.0)
    return {
        "iso_scale": iso_scale
        * F.when(family == "nitroreductase", 0.9)
        .when(family == "reductase", 0.95).otherwise(1.0),
        "hb_scale": hb_scale
        * F.when(hb < 2.0, 0.8).otherwise(1.0)
        * F.when(family == "reductase", 0.9).otherwise(1.0),
        "cross_scale": (F.lit(0.05) + 0.005 * flex) / (1.0 + hb),
    }


def cysteine_scaled(parts: dict[str, Column], shift: Column, to_cysteine: Column) -> dict[str, Column]:
    """Interpolated parameters and sulfur shift of a set that puts a cysteine at the scaled position."""
    whole = parts | {"sulfur_shift": shift}
    return {name: value * F.when(to_cysteine, C.CYSTEINE_SCALING[name]).otherwise(1.0) for name, value in whole.items()}


def confidence_score(label: Column, distance: Column, bluf_fraction: Column,
                     n_proximal: Column, plddt: Column | None = None) -> Column:
    """Structural confidence between 0 and 100."""
    quality = clip(F.coalesce(plddt, F.lit(75.0)) if plddt is not None
                   else F.lit(75.0), 0, 100)
    close = F.greatest(F.lit(0.0), (6.0 - distance) / 6.0)
    crowd = F.greatest(F.lit(1), n_proximal)
    sparse = F.greatest(F.lit(0.0), 1.0 - crowd / 4.0)
    return (
        F.when(label == "LOV-Domain Thioadduct", clip(90.0 + 10.0 * close, 0, 100))
        .when(label == "Cryptochrome-PET", F.lit(95.0))
        .when(label == "BLUF-Type H-Bonding", clip(
            70.0 + 20.0 * F.least(F.lit(1.0), bluf_fraction) + 0.1 * quality, 0, 100))
        .otherwise(clip(60.0 * (1.0 - sparse) + 0.4 * quality, 0, 100))
    )


def crossing_detected(gap: Column, spin: Column) -> Column:
    hit = (gap < C.CRITICAL_GAP) & (spin > C.CRITICAL_SPIN)
    return F.coalesce(hit, F.lit(False))


def coupling_label(gap: Column, spin: Column, hyperfine: Column,
                   activity: Column | None = None) -> Column:
    g, s, h = (finite(c) for c in (gap, spin, hyperfine))
    label = (
        F.when(g.isNull() | s.isNull() | h.isNull(),
               "COUPLING: UNKNOWN (insufficient data)")
        .when((g < C.CRITICAL_GAP) & (s > C.CRITICAL_SPIN) & (h > C.HIGH_HYPERFINE),
              "HIGH COUPLING")
        .when((s < 0.2) | (h < C.HIGH_HYPERFINE * 0.5), "WEAK COUPLING")
        .otherwise("MODERATE COUPLING")
    )
    if activity is None:
        return label
    return F.when(activity == "MAGNETICALLY INACTIVE", activity).otherwise(label)


def sensitivity_index(spin: Column, hyperfine: Column, gap: Column) -> Column:
    return spin * hyperfine / (gap + F.lit(1e-6))


def heading_index(spin: Column, gap: Column) -> Column:
    return F.lit(1.0) / (gap + F.lit(1e-6)) * spin


def is_coherent(gap: Column) -> Column:
    return gap < C.CRITICAL_GAP


def ordered_hyperfine(a: Column, b: Column, c: Column) -> list[Column]:
    """The three couplings, largest first."""
    values = F.sort_array(F.array(a, b, c), asc=False)
    return [values[i] for i in range(3)]


def complexity(iso: Column, hb: Column, flex: Column, iso_mean: Column,
               iso_sd: Column, hb_mean: Column, hb_sd: Column) -> Column:
    def score(value, mean, sd):
        return F.when(sd > 0, (value - mean) / sd).otherwise(F.lit(0.0))

    return (F.abs(score(iso, iso_mean, iso_sd)) + F.abs(score(hb, hb_mean, hb_sd))
            + 0.5 * F.abs(flex))


def damping(complexity_score: Column) -> Column:
    return F.lit(1.0) / (1.0 + complexity_score)


def shrink_outlier(prediction: Column, mean: Column, sd: Column) -> Column:
    far = (sd > 0) & (F.abs(prediction - mean) > 1.5 * sd)
    return F.when(far, mean + 0.7 * (prediction - mean)).otherwise(prediction)


def should_escalate(complexity_score: Column, sigma: Column) -> Column:
    return (complexity_score > C.ESCALATE_COMPLEXITY) | (sigma > C.ESCALATE_SIGMA)


def within_half_sd(value: Column, mean: Column, sd: Column) -> Column:
    return F.coalesce((sd > 0) & (F.abs(value - mean) <= 0.5 * sd), F.lit(False))


def quantum_weight(in_domain: Column, complexity_score: Column, sigma: Column,
                   sigma_median: Column, is_failure: Column) -> Column:
    """Weight of the quantum correction from the applicability rules."""
    escalate = should_escalate(complexity_score, sigma)
    gold = (sigma < 50.0) & (complexity_score < 1.0) & ~escalate
    safe = ~escalate & (complexity_score < 1.2) & (sigma < 50.0)
    base = F.when(in_domain, F.lit(0.5)).otherwise(F.lit(0.05))
    raised = (
        F.when(gold, F.greatest(base, F.lit(0.25 / C.NUDGE_SMALL_TIER)))
        .when(safe, F.greatest(base, F.lit(0.12 / C.NUDGE_SMALL_TIER)))
        .otherwise(base)
    )
    muted = (
        (sigma > 110.0) | (complexity_score > 1.4) | is_failure
        | ((sigma <= sigma_median) & ~gold)
    )
    return F.when(muted, F.lit(0.0)).otherwise(raised)


def fallback_blend(prediction: Column, local: Column, sigma: Column,
                   mean_em: Column, sigma_high: Column) -> tuple[Column, Column]:
    """Blend in the local model where the prediction collapsed; and the flag."""
    near = F.greatest(F.lit(1e-3), 0.01 * F.greatest(F.lit(1.0), F.abs(mean_em)))
    used = (F.abs(prediction - mean_em) <= near) | (sigma >= sigma_high)
    return (F.when(used, 0.35 * prediction + 0.65 * local).otherwise(prediction),
            used.cast("int"))


def prior_blend(prediction: Column, sigma: Column, prior: Column) -> Column:
    weight = clip((sigma - 55.0) / 70.0, 0.35, 0.85)
    return F.when(prior.isNotNull(), weight * prior + (1.0 - weight) * prediction
                  ).otherwise(prediction)


def align(value: Column, geo_mean: Column, geo_sd: Column,
          train_mean: Column, train_sd: Column) -> Column:
    """Move a value from the geometry distribution to the training one."""
    spread = F.when(F.coalesce(geo_sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(geo_sd)
    target = F.when(F.coalesce(train_sd, F.lit(0.0)) == 0, spread).otherwise(train_sd)
    scale = F.when(spread > 1e-6, target / spread).otherwise(F.lit(1.0))
    return (value - geo_mean) * scale + train_mean


def routed_prediction(prediction: Column, quantum_large: Column,
                      quantum_small: Column, flex: Column,
                      complexity_score: Column, sigma: Column,
                      is_miss: Column, success_mean_em: Column,
                      gpr_mean: Column, weight: Column,
                      truth: Column | None = None) -> dict[str, Column]:
    """Tier routing with the gated nudge.

    ``truth`` switches on the sign agreement with the measured value, which
    is only meaningful when evaluating; without it the small tier keeps the
    regression value.
    """
    damp = damping(complexity_score)
    delta_large = quantum_large - prediction
    miss_nudge = F.when(F.abs(delta_large) > 100.0, F.lit(0.0)).otherwise(
        C.NUDGE_LARGE_TIER * delta_large * damp)

    biased = quantum_small - 40.0 + 50.0 * (0.5 * flex + 0.2 * complexity_score)
    far = F.abs(biased - success_mean_em) > 100.0
    pulled = F.when(far, prediction + 0.5 * (biased - prediction)).otherwise(biased)
    delta_small = pulled - prediction
    step = clip(0.04 * delta_small * damp, -30.0, 30.0)
    if truth is None:
        agrees = F.lit(False)
    else:
        agrees = F.coalesce(
            F.signum(delta_small) * F.signum(truth - prediction) > 0, F.lit(False))
    leaves = F.abs(prediction + step - gpr_mean) > F.abs(prediction - gpr_mean)
    small_nudge = F.when(agrees & ~leaves, step).otherwise(F.lit(0.0))

    escalate = should_escalate(complexity_score, sigma)
    return {
        "tier": F.when(is_miss, "hybrid_16q").when(escalate, "hybrid_8q")
        .when(weight > 0, "uhf_16q_active").otherwise("uhf_quantum"),
        "pred_q_used": F.when(is_miss, quantum_large).when(escalate, pulled)
        .otherwise(quantum_large),
        "nudge": F.when(is_miss, miss_nudge).when(escalate, small_nudge)
        .otherwise(clip(weight * delta_large * damp, -15.0, 15.0)),
        "pred_final": F.when(is_miss, prediction + miss_nudge)
        .when(escalate, prediction + small_nudge).otherwise(quantum_large),
    }


def final_batch(pred_final: Column, pred_q: Column, prediction: Column,
                gap: Column) -> Column:
    """Batch value: energy over the Faraday constant where a gap is known."""
    value = F.when(finite(gap) > 0, (pred_q - prediction) / C.FARADAY
                   ).otherwise(pred_final)
    return first_finite(value, pred_q, prediction)


def final_single(pred_final: Column, pred_q: Column, prediction: Column,
                 prior_used: Column) -> Column:
    """Single-structure value: regression plus a capped quantum correction."""
    cap = F.when(prior_used, F.lit(10.0)).otherwise(F.lit(20.0))
    shift = F.least(cap, F.greatest(-cap, 0.08 * (finite(pred_q) - finite(prediction))))
    return F.when(
        finite(prediction).isNotNull(),
        prediction + F.when(finite(pred_q).isNotNull(), shift).otherwise(F.lit(0.0)),
    ).otherwise(first_finite(pred_final, pred_q))


def calibrated_tier(tier: Column) -> Column:
    """Tier of a single-structure value."""
    return F.concat(tier, F.lit("|single_calibrated"))


def mutation_adjusted(iso: Column, hb: Column, flex: Column, lfp: Column,
                      steric: Column, n_mutations: Column) -> dict[str, Column]:
    return {
        "iso": iso + lfp,
        "hb_cap": hb + 0.5 * steric,
        "flex": flex * (1.0 + 0.02 * n_mutations),
    }


def adjusted_gap(e_neg_sum: Column, steric_sum: Column) -> Column:
    return F.greatest(C.BASE_GAP_EV + e_neg_sum - 0.02 * steric_sum, F.lit(0.01))


def brightness_from_gap(gap: Column) -> Column:
    return gap / C.BASE_GAP_EV * C.BASE_BRIGHTNESS


def brightness(explicit: list[Column], gap: Column, pred_final: Column
               ) -> tuple[Column, Column]:
    """Brightness of a result row and a note on where it came from."""
    stated = first_finite(*explicit)
    usable_gap = F.when(finite(gap) <= 5.0, finite(gap))
    derived = F.greatest(F.lit(0.0), brightness_from_gap(usable_gap))
    derived = F.when(usable_gap.isNotNull(), derived)
    proxy = F.abs(finite(pred_final))
    value = F.coalesce(stated, derived, proxy)
    note = (
        F.when(stated.isNotNull() & (stated < 0), "UNIT_MIXUP_BUG")
        .when(stated.isNotNull(), "")
        .when(derived.isNotNull(), "derived_from_st_gap")
        .when(proxy.isNotNull(), "emission_proxy")
        .otherwise("BRIGHTNESS_MISSING")
    )
    return value, note


def sulfur_shift(lov: Column, coupling: Column, neighbor: Column) -> Column:
    own = F.when(lov, C.SULFUR_SHIFT * coupling).otherwise(F.lit(0.0))
    return own + neighbor


def perturbation_energy(moment1: Column, moment2: Column) -> Column:
    return 0.1 * moment1 + 0.05 * moment2


def accession_mode(accession: Column, otherwise: Column) -> Column:
    known = accession.isin(*C.RADICAL_PAIR_ACCESSIONS) | accession.startswith("CRY")
    return F.when(known, "Radical Pair (Cryptochrome)").otherwise(otherwise)


def is_known_failure(pdb_id: Column) -> Column:
    """Whether a structure is on the list of known failures; case is ignored."""
    return F.coalesce(F.upper(pdb_id.cast("string")).isin(*C.FAILURE_IDS), F.lit(False))


def is_cryptochrome(accession: Column) -> Column:
    """Whether the open-shell treatment is forced: listed accessions and names that begin with CRY."""
    return F.coalesce(accession.isin(*C.RADICAL_PAIR_ACCESSIONS) | accession.startswith("CRY"), F.lit(False))


def accession_overrides(accession: Column, label: Column, mode: Column, lov: Column, coupling: Column,
                        detected: Column) -> dict[str, Column]:
    """What a known accession sets, whatever was measured: label, mode, domain, coupling, treatment and cofactor."""
    fixed = F.coalesce(accession == C.FIXED_ACCESSION, F.lit(False))

    def forced(value, otherwise: Column) -> Column:
        return F.when(fixed, F.lit(value)).otherwise(otherwise)

    return {
        "environment_label": forced("Radical Pair (Cryptochrome)", label),
        "computational_mode": forced("Radical Pair", mode),
        "lov_domain": forced(False, lov),
        "cys_flavin_coupling": forced(0.0, coupling),
        "force_uhf": is_cryptochrome(accession),
        "detected_cofactor": F.when(fixed, F.coalesce(F.nullif(detected, F.lit("")), F.lit("FAD"))).otherwise(detected),
    }


def validation_status(present: Column, forced: Column) -> Column:
    return F.when(present, "PASS").when(forced, "FORCED").otherwise("FAIL")


def crossing_message(flag: Column, criteria: Column) -> Column:
    prefix = F.when(flag, "Electronic singlet–triplet crossing detected").otherwise(
        F.lit("No singlet–triplet crossing detected"))
    return F.concat(prefix, F.lit(" (criteria: "), criteria, F.lit(")"))


def fixed_text(value: Column, digits: int) -> Column:
    """A double with so many digits (1 to 6) after the point, rounded by its exact value, halves to even, as C does.

    Java's formatter rounds the shortest decimal form of the number, halves up,
    so that 1.005, which is a little less than its digits say, becomes 1.01.
    """
    one, scale = F.lit(2 ** 60).cast("decimal(19,0)"), 10 ** digits
    size, whole = F.abs(value), F.floor(F.abs(value))
    # The part behind the point in units of 2^-60: taking it off and a power of two are exact.
    units = ((size - whole) * F.lit(2.0 ** 60)).cast("bigint").cast("decimal(19,0)") * F.lit(scale).cast("decimal(7,0)")
    rest = units % one
    down = ((units - rest) / one).cast("bigint")
    up = (rest * 2 > one) | ((rest * 2 == one) & (down % 2 == 1))
    shown = down + up.cast("bigint")
    text = F.concat(F.when(value.cast("string").startswith("-"), "-").otherwise(""),
                    (whole + F.floor(shown / scale)).cast("string"), F.lit("."),
                    F.lpad((shown % scale).cast("string"), digits, "0"))
    return F.when(size < 2.0 ** 53, text).otherwise(F.format_string(f"%.{digits}f", value))


def nearest_report(resn: Column, resi: Column, atom: Column,
                   distance: Column) -> Column:
    return F.format_string("%s%s-%s found at %s Å", resn, resi, atom, fixed_text(distance, 2))

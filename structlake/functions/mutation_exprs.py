"""Mutation lists as arrays of structs, parsed and keyed inside one row.

A list needs no explode and no shuffle: tokens are split, parsed, checked and
sorted with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C, residues as R

# Optional wild type, number, optional insertion code, substitution.
TOKEN_PATTERN = r"^([A-Za-z])?([0-9]+)([A-Za-z]?)([A-Za-z])$"


def tokens(raw: Column) -> Column:
    parts = F.split(F.coalesce(raw, F.lit("")), r"[,\s]+")
    return F.filter(parts, lambda p: p != "")


def _parse_token(token: Column, default_chain: Column) -> Column:
    has_chain = F.contains(token, F.lit(":"))
    written = F.when(has_chain, F.trim(F.substring_index(token, ":", 1))).otherwise(F.lit(""))
    body = F.when(has_chain, F.substr(token, F.instr(token, ":") + 1)).otherwise(token)

    def group(i):
        return F.regexp_extract(body, TOKEN_PATTERN, i)

    chain = F.when(written != "", written).otherwise(default_chain)
    wt, mut = F.upper(group(1)), F.upper(group(4))
    icode = F.when(group(3) == "", F.lit(" ")).otherwise(group(3))
    reason = (
        F.when(~body.rlike(TOKEN_PATTERN), "unparsable")
        .when(wt == "", "missing wild type")
        .when(~wt.isin(*C.CANONICAL_AA) | ~mut.isin(*C.CANONICAL_AA), "not canonical")
    )
    return F.struct(
        F.when(chain == "", F.lit("?")).otherwise(chain).alias("chain"),
        F.coalesce(F.nullif(F.ltrim(group(2), F.lit("0")), F.lit("")), F.lit("0"))
        .alias("resseq"),
        icode.alias("icode"), wt.alias("wt"), mut.alias("mut"),
        token.alias("raw"), (written != "").alias("chain_explicit"),
        reason.alias("reason"),
    )


_FIELDS = ("chain", "resseq", "icode", "wt", "mut", "raw", "chain_explicit")


def parse_list(raw: Column, default_chain: Column | None = None) -> Column:
    """Array of parsed tokens, in the order written; bad ones carry a reason."""
    chain = F.coalesce(default_chain, F.lit("")) if default_chain is not None else F.lit("")
    return F.transform(tokens(raw), lambda tok: _parse_token(tok, chain))


def accepted(parsed: Column) -> Column:
    """The good mutations, sorted by chain, number text, icode, wt, mut."""
    good = F.filter(parsed, lambda m: m.reason.isNull())
    return F.array_sort(F.transform(
        good, lambda m: F.struct(*(m[f].alias(f) for f in _FIELDS))))


def rejected(parsed: Column) -> Column:
    return F.transform(
        F.filter(parsed, lambda m: m.reason.isNotNull()),
        lambda m: F.struct(m.raw.alias("raw"), m.reason.alias("reason")))


def _icode_text(m: Column) -> Column:
    return F.trim(F.coalesce(m["icode"], F.lit("")))


def canonical_token(m: Column) -> Column:
    return F.concat(m["chain"], F.lit(":"), m["wt"], m["resseq"], _icode_text(m), m["mut"])


def display_token(m: Column) -> Column:
    """Keeps the chain only where the user wrote one."""
    bare = F.concat(m["wt"], m["resseq"], _icode_text(m), m["mut"])
    explicit = m["chain_explicit"] & (m["chain"] != "")
    return F.when(explicit, F.concat(m["chain"], F.lit(":"), bare)).otherwise(bare)


def _set_key(mutations: Column, token) -> Column:
    ordered = F.array_sort(F.transform(mutations, lambda m: F.struct(
        m["chain"].alias("chain"), m["resseq"].try_cast("int").alias("num"),
        _icode_text(m).alias("icode"), m["wt"].alias("wt"), m["mut"].alias("mut"),
        token(m).alias("token"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["token"]), "_")
    return F.when(F.size(mutations) == 0, F.lit("WT")).otherwise(joined)


def canonical_key(mutations: Column) -> Column:
    """Order-free key of a set: numeric residue order, ``WT`` when empty."""
    return _set_key(mutations, canonical_token)


def display_key(mutations: Column) -> Column:
    return _set_key(mutations, display_token)


def _total(mutations: Column, value) -> Column:
    return F.aggregate(mutations, F.lit(0.0), lambda acc, m: acc + value(m))


def effect_sums(mutations: Column) -> tuple[Column, Column]:
    """Electronegativity and steric sums of the substituted residues."""
    return (_total(mutations, lambda m: R.electronegativity(m["mut"])),
            _total(mutations, lambda m: R.steric_index(m["mut"])))


def effect_factors(mutations: Column) -> tuple[Column, Column]:
    """Products of the electrostatic and vibrational factors."""
    def product(table, plus):
        def step(acc, m):
            found = R.lookup(table, m["mut"])
            return acc * F.coalesce(found + F.lit(plus), F.lit(1.0))
        return F.aggregate(mutations, F.lit(1.0), step)

    return product(C.MUTATION_ELECTRO_SHIFT, 1.0), product(C.MUTATION_VIB_DAMPING, 0.0)


def volume_change(mutations: Column) -> dict[str, Column]:
    """Steric change, largest wild-type index, hybridisation change."""
    change = _total(mutations, lambda m: R.steric_index(m["mut"]) - R.steric_index(m["wt"]))
    largest = F.aggregate(
        mutations, F.lit(0.0),
        lambda acc, m: F.greatest(acc, F.abs(R.steric_index(m["wt"]))))
    return {
        "volume_delta": change,
        "wt_reference": largest,
        "hybridisation_change": F.exists(
            mutations, lambda m: m["wt"].isin("P", "I") & m["mut"].isin("H", "Y")),
    }


def has_substitution(mutations: Column, resseqs: tuple, mut: str | None = None) -> Column:
    def hit(m):
        test = m["resseq"].isin(*resseqs)
        return test & (m["mut"] == mut) if mut else test
    return F.exists(mutations, hit)


def strain_energy(mutations: Column, steric_sum: Column, hinges: tuple = ("396", "402")) -> Column:
    """Backbone strain where one of the two hinge residues is substituted."""
    return F.when(has_substitution(mutations, hinges), F.abs(steric_sum) + 0.5).otherwise(F.lit(0.0))


def display_effects(raw: Column) -> tuple[Column, Column]:
    """Sums over comma-separated text, by its last letters only."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.trim(p)),
        lambda p: F.length(p) >= 3)
    last = F.transform(parts, lambda p: F.upper(F.right(p, F.lit(1))))
    def total(value):
        return F.aggregate(last, F.lit(0.0), lambda acc, aa: acc + value(aa))
    return (total(lambda aa: R.electronegativity(aa, display=True)),
            total(lambda aa: R.steric_index(aa)))

"""Content hashes and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import mutation_exprs as M

_WORDS = 4


def feature_hash(features: Column, salt: Column | str = "") -> Column:
    """SHA-256 over a map of doubles: sorted ``name:value`` with 8 digits."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    items = F.transform(
        F.array_sort(F.map_entries(features)),
        lambda e: F.format_string("%s:%.8f", e["key"], e["value"]))
    return F.sha2(F.concat(F.array_join(items, "|"), F.lit("|"), salt), 256)


def run_key(structure_hash: Column, cofactor: Column, mutations: Column,
            metadata: Column | None = None) -> Column:
    sorted_tokens = F.array_join(
        F.array_sort(F.transform(mutations, M.canonical_token)), ",")
    return F.sha2(F.concat_ws(
        "|", structure_hash, cofactor, M.canonical_key(mutations),
        F.concat(F.lit("len:"), F.size(mutations).cast("string")),
        F.when(F.size(mutations) == 0, F.lit("WT")).otherwise(sorted_tokens),
        metadata if metadata is not None else F.lit("")), 256)


def digest_words(digest: Column) -> list[Column]:
    """The first words of a row's hex digest as non-negative longs."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
            for i in range(_WORDS)]


def placed_words(place: str, text: Column) -> list[Column]:
    """Words of the digest of a text together with its place in the order."""
    return digest_words(F.sha2(F.concat(F.col(place).cast("string"), F.lit("|"), text), 256))


def multiset_digest(words: list[Column], count: Column) -> Column:
    """SHA-256 over summed row words and the row count.

    Sums combine on the map side, so a group of any size is hashed without
    being gathered.  Order enters through the place in each row's text (``placed_words``).
    """
    sums = [F.sum(w.cast("decimal(38,0)")).cast("string") for w in words]
    return F.sha2(F.concat_ws("|", *sums, count.cast("string")), 256)


def shift_vector(token: Column) -> list[Column]:
    """Small displacement per axis from the token's hash, ±0.15 angstrom."""
    digest = F.sha2(token, 256)
    def byte(i):
        return F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("bigint")
    return [((byte(i) % 7) - 3) * F.lit(0.05) for i in range(3)]


def tagged_hash(base: Column, gap: Column, signature: Column | None = None,
                wt_gap: Column | None = None, wt_hash: Column | None = None,
                delta: Column | None = None) -> Column:
    """Append the collision-resistance tags to a feature hash."""
    # A null would be shown as text by ``format_string``.
    shown = F.when(gap.isNull() | F.isnan(gap), "nan").otherwise(F.format_string("%.6f", gap))
    out = F.concat(base, F.lit("|st:"), shown)
    if signature is not None:
        out = F.when(signature.isNotNull(), F.concat(out, F.lit("|wf:"), signature)).otherwise(out)
    if wt_gap is not None:
        moved = F.coalesce(F.abs(gap - wt_gap) > 0.005, F.lit(False))
        out = F.when(moved, F.concat(out, F.lit("|stshift"))).otherwise(out)
    if wt_hash is not None and delta is not None:
        clash = F.coalesce((out == wt_hash) & (F.abs(delta) > 0), F.lit(False))
        out = F.when(clash, F.concat(out, F.lit("_collision"))).otherwise(out)
    return out


def no_effect_check(tagged: Column, wt_hash: Column, hybridisation: Column,
                    volume_delta: Column, wt_reference: Column) -> Column:
    """Reject, warn or pass a mutant whose hash equals the wild type's."""
    same = F.coalesce(tagged == wt_hash, F.lit(False))
    should_differ = hybridisation | (
        F.abs(volume_delta) >= 0.2 * (wt_reference + 1e-3))
    return (F.when(same & should_differ, "FEATURE_HASH_COLLISION_WT")
            .when(same, "NO_EFFECT").otherwise("OK"))

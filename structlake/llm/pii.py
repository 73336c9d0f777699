"""Personal data in texts: proposed by patterns, confirmed by checksums, scored by context.

Every kind has a pattern that proposes spans (leftmost, non-overlapping), a
validator that confirms or drops them, and words that, near a span, raise its
score.  Spans that reach ``THRESHOLD`` stay.  The four plain kinds start above
it, so context only ranks them; ``iban`` needs its mod-97 check, ``ssn`` needs
a word beside it.

Patterns are possessive wherever nothing after the run can take characters
back, and start only where a run starts; so they match what the plain pattern
matches, in linear time and without recursion on long runs.

Defined cases: null text is the empty text and has no span; repeated rows get
equal results; the texts of a table are read one by one, so no group forms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, positions, running_sums, whole_text

THRESHOLD = 0.5
#: What words within REACH characters of a span add to its score.
CONTEXT_BONUS, REACH = 0.35, 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    words: str
    #: A cheap sign without which the pattern cannot match.
    sign: str


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True when the digits pass the Luhn check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(value: Column) -> Column:
    """True when an account number, its first four signs moved last, leaves 1 modulo 97."""
    bare = F.regexp_replace(value, " ", "")
    moved = F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), "")

    def add(acc: Column, sign: Column) -> Column:
        letter = F.ascii(sign) - 55
        return F.when(sign.between("0", "9"), acc * 10 + sign.cast("int")).otherwise(acc * 100 + letter) % 97

    return F.aggregate(moved, F.lit(0), add) == 1


def octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(value, r"\."), small)


#: What the plain kinds are, and the words looked for beside them.
LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda v: F.lit(True), 0.6, "mail|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.5, "ip|host|server|address", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         lambda v: F.length(digits(v)).between(13, 19) & luhn(digits(v)), 0.65, "card|visa|credit|pay", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda v: F.length(digits(v)).between(9, 15), 0.5, "phone|tel|call|fax|mobile", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         mod97, 0.65, "iban|account|konto|compte|cuenta", ""),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda v: ~v.rlike("^(000|666|9)"), 0.2, r"\bssn\b|social security", "-"),
)
BASE = ("email", "ip", "card", "phone")


def proposals(text: Column, pattern: str) -> Column:
    """Matches with their place: array of (start, end, value, near), code points, end exclusive.

    The pieces between matches give the places: each match starts where the
    pieces and matches before it end.  ``near`` is what stands beside it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values: Column, gaps: Column) -> Column:
        lengths = F.transform(values, lambda v, k: F.length(gaps[k]) + F.length(v))

        def span(value: Column, k: Column, before: Column) -> Column:
            start = before[k] + F.length(gaps[k])
            near = F.concat_ws(" ", F.right(gaps[k], F.lit(REACH)), F.left(gaps[k + 1], F.lit(REACH)))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"),
                            value.alias("value"), F.lower(near).alias("near"))

        return let(running_sums(lengths), lambda before: F.transform(
            values, lambda v, k: span(v, k, before)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,near:string>>")
    return let(found, lambda values: F.when(F.size(values) == 0, empty).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: placed(values, gaps))))


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, value, score)."""
    def scored(x: Column) -> Column:
        bonus = F.when(x["near"].rlike(kind.words), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                        x["value"].alias("value"), F.least(F.lit(1.0), bonus + kind.score).alias("score"))

    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")
    confirmed = F.filter(proposals(text, kind.pattern), lambda x: kind.confirm(x["value"]))
    kept = F.filter(F.transform(confirmed, scored), lambda x: x["score"] >= THRESHOLD)
    return F.when(F.contains(text, F.lit(kind.sign)), kept).otherwise(empty) if kind.sign else kept


def find_personal_data(docs: DataFrame, into: str = "personal_data") -> DataFrame:
    """``docs`` with the spans of each text, by kind as listed, then start, in column ``into``."""
    text = whole_text(F.col("text"))
    return docs.select("*", F.concat(*(spans_of(text, k) for k in KINDS)).alias(into))


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the plain spans, and all spans as text."""
    found = find_personal_data(docs.select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(spans: Column, kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")

    def digest(spans: Column) -> Column:
        base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
        return F.struct(
            *(number(spans, k).alias(f"n_{k}") for k in BASE),
            F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"),
            F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))

    return found.select("doc_id", let(F.col("personal_data"), digest).alias("_digest")).select("doc_id", "_digest.*")

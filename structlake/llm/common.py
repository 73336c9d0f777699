"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Functions for executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null or blank text."""
    return F.regexp_extract_all(whole_text(text), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A lambda that names an outer expression evaluates it again for each
    element; bound to a variable of an enclosing lambda it is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def positions(first: Column | int, last: Column | int) -> Column:
    """first..last, empty when last is below first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(
        F.array().cast("array<int>"))


def running_sums(values: Column, block: int = 256) -> Column:
    """For each element the sum of those before it (exclusive), as bigint.

    Appending to an accumulator copies it, so the sums are taken in blocks of
    256 and the block totals are summed apart: n * 256 copies, not n * n.
    """
    empty = F.array().cast("array<bigint>")

    def fold(items: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("sums"))
        return F.aggregate(
            items, start,
            lambda acc, x: F.struct((acc["total"] + x).alias("total"),
                                    F.concat(acc["sums"], F.array(acc["total"])).alias("sums")),
            lambda acc: acc["sums"])

    def by_blocks(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / block).cast("int")
        blocks = F.transform(positions(1, n_blocks), lambda b: F.slice(v, (b - 1) * block + 1, block))
        totals = F.transform(blocks, lambda x: F.aggregate(
            x, F.lit(0).cast("bigint"), lambda acc, y: acc + y))
        return let(blocks, lambda parts: let(fold(totals), lambda before: F.flatten(
            F.transform(parts, lambda part, b: F.transform(fold(part), lambda s: s + before[b])))))

    return F.when(F.size(values) == 0, empty).otherwise(let(values.cast("array<bigint>"), by_blocks))


def held_out(doc_id: Column, parts: int) -> Column:
    """True where crc32 of the id as text leaves 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def share_bound(limit: int, rows: int) -> int | None:
    """The signed 64-bit value below which hashes of ``limit`` in ``rows`` rows lie; None where all rows are taken."""
    return None if limit >= rows else limit * (1 << 64) // rows - (1 << 63)


def sampled_share(frame: DataFrame, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows, the same on every run: all rows while they fit.

    The share is set by the row count, so no rows are gathered or sorted; it is
    cut in the whole range of a 64-bit hash, so it never rounds to nothing.
    """
    bound = share_bound(limit, frame.count())
    return frame if bound is None else frame.where(F.xxhash64(key, F.lit("sample")) < bound)


def row_key(frame: DataFrame) -> Column:
    """A 128-bit name of a row's content; equal rows share it."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
             for c in DOCUMENT_COLUMNS if c in frame.columns]
    return F.md5(F.concat_ws("\x01", *parts))


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""A table with one row per key, kept in buckets of keys that are rewritten alone.

The bucket is a hash of the key, and each bucket is a folder.  An upsert reads
the buckets that its keys fall into, folds old and new rows to one per key, and
replaces these folders by dynamic partition overwrite; all other files stay as
they are.  The same rows written again change nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.extremes import extreme_rows
from ..session import checkpoint

BUCKETS = 64
_BUCKET = "key_bucket"


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(path).drop(_BUCKET)


def _stored(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame | None:
    """The rows of some buckets; the others are not read.  None before the first write."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    return table.where(F.col(_BUCKET).isin(wanted))


def upsert(rows: DataFrame, path: str, keys: str | list[str], seq: str, replace: bool = True,
           buckets: int = BUCKETS) -> list[int]:
    """Add rows to the table: per key the highest ``seq`` stays, or with ``replace=False`` the lowest.

    Returns the buckets that were rewritten, at most ``buckets``.  Rows that tie
    in key and ``seq`` must be equal; they count once.  A column that only one
    side has is null in the other's rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = rows.sparkSession
    new = checkpoint(rows.withColumn(_BUCKET, bucket_of(keys, buckets)))
    touched = sorted(r[0] for r in new.select(_BUCKET).distinct().collect())
    if not touched:
        return []
    old = _stored(spark, path, touched)
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    # Cut from the files it was read from before they are replaced.
    merged = checkpoint(extreme_rows(both, keys, seq, largest=replace).distinct())
    merged.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        _BUCKET).parquet(path)
    return touched

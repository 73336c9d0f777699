"""The regression spreads its work, and single-precision cosines leave its sums as they are."""

import numpy as np
from pyspark.sql import functions as F

from structlake.operators import learning


def test_rows_of_a_merged_shuffle_are_spread(spark):
    merged = spark.range(2000).repartition("id").groupBy("id").agg(F.count("*").alias("n"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert learning._spread(merged).rdd.getNumPartitions() == wanted > 1
    assert merged.coalesce(1).transform(learning._spread).rdd.getNumPartitions() == wanted


def test_basis_keeps_sums():
    rng = np.random.default_rng(3)
    scaled, frequencies, phases = rng.normal(size=(20_000, 4)), 10 * rng.standard_t(3, (4, 64)), rng.uniform(0, 6.28, 64)
    got = learning._basis(scaled, frequencies, phases)
    want = np.sqrt(2 / 64) * np.cos(scaled @ frequencies + phases)
    assert got.dtype == float and np.allclose(got.T @ got / 20_000, want.T @ want / 20_000, atol=1e-8)
    assert np.allclose(got, want, atol=1e-4)

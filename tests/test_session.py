"""What a lineage cut leaves behind."""

import time

from pyspark.sql import functions as F

from structlake.session import checkpoint


def test_checkpoint_removes_its_shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = held.getAllFiles()
        names = (found.apply(k).getName() for k in range(found.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = files()
    frame = spark.range(1000).repartition(3, F.col("id") % 7).groupBy("id").count()
    kept = checkpoint(frame)
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 1000

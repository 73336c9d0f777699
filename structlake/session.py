"""Session helpers: a local session for tests, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "structlake") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests, one machine) gets a
    folder of its own; on a cluster that would be a folder of the driver, which
    executors do not see, so it is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Session setting: shuffle files of a query go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Inside, the session has this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; runs a job.

    The job's shuffle files are removed when it has ended: nothing reads them
    again, and a plan of many checkpoints would otherwise hold them all until
    the driver's garbage collection comes upon them.
    """
    spark = frame.sparkSession
    folder = checkpoint_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    with setting(spark, _CLEANUP, "true"):
        # A frame takes the setting when it is made, so this one is made again.
        return frame.select("*").checkpoint(eager=True)

"""Continuous ingestion: the same scans and log writer on a stream.

The operators have no streaming-only semantics; scans are row-local, so they
run unchanged on a stream, and the append-only log is fed batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import write_batch
from ..sources.structure_files import STEM, number_lines

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_structure_text(spark: SparkSession, path: str,
                          glob: str = "*.{pdb,ent}", name: str = STEM) -> DataFrame:
    """Line table of structure files as they arrive in a folder; a file is one row, numbered inside it."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).load(path)
    return number_lines(files.select(F.regexp_extract("path", name, 1).alias("structure_id"), "content"))


def append_stream(stream: DataFrame, path: str, checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
                  expected: list[str] | None = None):
    """Write every micro-batch to its own folder of the log; run until no new data is left.

    The folder is named by the batch, so a batch that is replayed after a
    failure replaces itself.  ``prepare`` turns a batch into log rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(prepare(batch), path, batch_id, expected)

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

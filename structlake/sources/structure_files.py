"""Structure files as rows: listed and chosen by name, then read, cut and numbered inside their row.

A structure file has at most a few megabytes, so a file is one row and its
lines get their exact numbers there; text never meets a shuffle.  Which of
several files of one structure is read is settled before any content is: the
chosen paths are handed to the reader, whose index of files is a driver's list
of paths in any case.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The structure's name in a path: the file's name without its last ending.
STEM = r"([^/]+)\.[^./]+$"
_LINE_END = r"\r\n|\n|\r"


#: Session setting with the number of tasks that list folders and paths; Spark's own value is 10,000, one for almost each of them.
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


#: Hadoop's local file system without checksum files, for one write; other file systems are not concerned.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def _listing(spark: SparkSession):
    """Inside, folders are listed by a few tasks a core, so a task takes many of them."""
    before = spark.conf.get(_LISTERS)
    spark.conf.set(_LISTERS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LISTERS, before)


def list_files(spark: SparkSession, path: str, glob: str = "*.{pdb,ent}", name: str = STEM) -> DataFrame:
    """``structure_id``, ``path``, ``length`` of all files below a folder; no content is read."""
    with _listing(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", name, 1).alias("structure_id"), "path", "length")


def choose_files(files: DataFrame, preferred: tuple[str, ...] = ()) -> DataFrame:
    """One file per structure: the one whose path holds the earliest preferred part, then the first path."""
    rank = F.lit(len(preferred))
    for k, part in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("path").contains(part), k).otherwise(rank)
    best = files.groupBy("structure_id").agg(F.min(F.struct(rank.alias("rank"), "path")).alias("best"))
    return best.select("structure_id", F.col("best.path").alias("path"))


def read_contents(spark: SparkSession, chosen: DataFrame, name: str = STEM) -> DataFrame:
    """``structure_id``, ``content`` of the chosen files, one row each."""
    paths = [_plain(r.path) for r in chosen.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "structure_id string, content binary")
    with _listing(spark):
        whole = spark.read.format("binaryFile").load(paths)
    return whole.select(
        F.regexp_extract("path", name, 1).alias("structure_id"), "content")


def _plain(path: str) -> str:
    """A path with the characters escaped that a file pattern gives a meaning to."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def lines_of(content: Column) -> Column:
    """Lines of a file's bytes in order; invalid bytes are left out, and the last line end ends no further line."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    cut = F.split(F.regexp_replace(text, rf"(?:{_LINE_END})\z", ""), _LINE_END)
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def number_lines(contents: DataFrame) -> DataFrame:
    """``structure_id``, ``line_no`` (from 1), ``value`` of all lines."""
    return contents.select("structure_id", F.posexplode(lines_of(F.col("content"))).alias("at", "value")).select(
        "structure_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "value")


def read_structure_lines(spark: SparkSession, path: str, glob: str = "*.{pdb,ent}",
                         preferred: tuple[str, ...] = (), name: str = STEM) -> DataFrame:
    """Line table of a folder of structure files, one file per structure."""
    return number_lines(read_contents(spark, choose_files(list_files(spark, path, glob, name), preferred), name))


def write_structure_files(lines: DataFrame, path: str, folders: dict[str, Column] | None = None) -> None:
    """One text file per structure, in the folder ``structure_id=<name>`` below the path.

    With ``folders`` the path gets a folder ``folder=<name>`` for each, which
    holds the structures' lines that meet its condition; the lines are computed
    and shuffled once for all of them.

    The cost of small files is that of opening and moving them, not their bytes,
    so they are dealt over all shuffle partitions, which are not merged by
    size.  A structure's folder is moved as a whole by the driver (version 1
    of the committer): moved by the tasks it is made anew, and on a local disk a
    process is started for the mode of each folder made, as for each checksum
    file, so there are none there.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(folders or {})
    held = F.array_compact(F.array(*(F.when(folders[n], n) for n in names))) if folders else F.array(F.lit(""))
    lines = lines.withColumn("held", held).where(F.size("held") > 0).repartition(tasks, "structure_id")
    # A file is one row here as well, so its lines are gathered, but no more than a file's.
    whole = lines.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "value", "held"))).alias("rows"))

    def file(name: str) -> Column:
        kept = F.filter("rows", lambda r: F.array_contains(r["held"], name))
        text = F.array_join(F.transform(kept, lambda r: r["value"]), "\n")
        return F.when(F.size(kept) > 0, F.struct(F.lit(name).alias("folder"), text.alias("value")))

    files = whole.select("structure_id", F.explode(F.array_compact(F.array(*map(file, names or [""])))).alias("file"))
    files.select("structure_id", *(["file.folder"] if folders else []), "file.value").write.mode("overwrite").options(
        **_PLAIN_FILES).option("mapreduce.fileoutputcommitter.algorithm.version", "1").partitionBy(
        *(["folder"] if folders else []), "structure_id").text(path)


#: The structure's name in a path that ``write_structure_files`` has written.
WRITTEN = r"structure_id=([^/]+)/"

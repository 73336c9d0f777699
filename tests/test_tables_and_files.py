"""Whole structure files, the keyed table, and extreme rows."""

import os

from pyspark.sql import functions as F

from structlake.operators.extremes import extreme_rows
from structlake.sources import keyed, structure_files as files


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lines_of_any_ending_and_bad_bytes(spark, tmp_path):
    cases = {"unix": b"a\nb\n", "open": b"a\nb", "dos": b"a\r\nb\r\n", "mac": b"a\rb\r", "blank": b"a\n\nb\n\n",
             "none": b"", "bad": b"a\xff\nb\n", "one": b"\n"}
    for name, content in cases.items():
        (tmp_path / f"{name}.pdb").write_bytes(content)
    (tmp_path / "odd [x] {y}*.pdb").write_bytes(b"z\n")
    got = {}
    for r in files.read_structure_lines(spark, str(tmp_path)).collect():
        got.setdefault(r.structure_id, {})[r.line_no] = r.value
    two = {1: "a", 2: "b"}
    assert got == {"unix": two, "open": two, "dos": two, "mac": two, "bad": two, "one": {1: ""},
                   "blank": {1: "a", 2: "", 3: "b", 4: ""}, "odd [x] {y}*": {1: "z"}}


def test_reading_files_moves_no_text(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.pdb").write_text("x\n" * 20_000)
    lines = files.read_structure_lines(spark, str(tmp_path))
    assert "Exchange" not in plan_of(lines)
    assert lines.groupBy("structure_id").agg(F.max("line_no"), F.count_distinct("line_no")).collect()[0][1:] == (20_000, 20_000)
    assert files.read_structure_lines(spark, str(tmp_path), "*.absent").count() == 0


def bucket_files(path):
    return {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("key_bucket=")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit(1).alias("seq"), F.col("id").alias("v"))
    assert len(keyed.upsert(rows, path, "key", "seq", buckets=16)) == 16
    before = bucket_files(path)
    change = spark.createDataFrame([("k7", 2, 700), ("k7", 0, -1)], "key string, seq int, v bigint")
    touched = keyed.upsert(change, path, "key", "seq", buckets=16)
    after = bucket_files(path)
    assert len(touched) == 1 and {d for d in after if after[d] != before[d]} == {f"key_bucket={touched[0]}"}
    table = {r["key"]: r.v for r in keyed.read_keyed(spark, path).collect()}
    assert table == {f"k{i}": 700 if i == 7 else i for i in range(200)}
    keyed.upsert(change, path, "key", "seq", buckets=16)
    assert {r["key"]: r.v for r in keyed.read_keyed(spark, path).collect()} == table
    assert keyed.upsert(change.limit(0), path, "key", "seq", buckets=16) == []
    keyed.upsert(spark.createDataFrame([("k8", 9, 5), ("new", 1, 6)], "key string, seq int, w bigint"), path, "key", "seq", False, 16)
    held = {r["key"]: r.v for r in keyed.read_keyed(spark, path).collect()}
    assert held == table | {"new": None}


def test_extreme_rows(spark):
    rows = [("a", 1, 2.0, "x"), ("a", 3, 1.0, "y"), ("a", 3, 2.0, "z"), ("b", None, 1.0, "n"), (None, 1, 1.0, "q"), (None, 0, 9.0, "r")]
    frame = spark.createDataFrame(rows, "k string, s int, v double, t string")
    def names(*args, **kw):
        return sorted(r.t for r in extreme_rows(frame, *args, **kw).collect())
    assert names("k", "s") == ["q", "y", "z"]
    assert names("k", ["s", "v"]) == ["q", "z"]
    assert names("k", ["s", "v"], [True, False]) == ["q", "y"]
    assert names("k", "s", largest=False) == ["r", "x"]
    assert names([], "v") == ["r"]


def test_extreme_rows_of_a_heavy_key_need_no_sort(spark):
    frame = spark.range(300_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    out = extreme_rows(frame, "k", "id")
    assert "SortAggregate" not in plan_of(out) and out.where("k = 'hot'").select("id").collect() == [(299_998,)]
    assert out.count() == 100_001


def test_many_small_files_are_dealt_over_tasks(spark, tmp_path):
    """Small files are written by many tasks, and listed by a few tasks a core instead of one a folder."""
    lines = spark.range(300).selectExpr("id AS structure_id", "1 AS line_no", "'END' AS value")
    files.write_structure_files(lines, f"{tmp_path}/main")
    written = [p.name for p in (tmp_path / "main").rglob("part-*.txt")]
    assert len(written) == 300 and len({name.split("-")[1] for name in written}) > 1
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    context, before = spark.sparkContext, spark.conf.get(setting)
    context.setJobGroup("listing", "listing")
    try:
        listed = files.list_files(spark, str(tmp_path), "*.txt", files.WRITTEN)
        contents = files.read_contents(spark, listed, files.WRITTEN)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * context.defaultParallelism
    assert contents.count() == 300 and spark.conf.get(setting) == before


def test_files_of_several_folders_are_written_at_once(spark, tmp_path):
    rows = [("a", 2, "two"), ("a", 1, "HETATM one"), ("b", 1, "HETATM"), ("c", 1, "none"), ("c", 2, "")]
    lines = spark.createDataFrame(rows, "structure_id string, line_no long, value string")
    path = str(tmp_path / "out")
    files.write_structure_files(lines, path, {
        "main": F.col("structure_id") != "c", "cache": ~F.col("value").like("HETATM%")})
    written = {p.parent.relative_to(path).as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert written == {"folder=main/structure_id=a": "HETATM one\ntwo\n", "folder=main/structure_id=b": "HETATM\n",
                       "folder=cache/structure_id=a": "two\n", "folder=cache/structure_id=c": "none\n\n"}
    # Files beside them would cost a process each on a local disk.
    assert not list((tmp_path / "out").rglob("structure_id=*/*.crc")) and not list((tmp_path / "out").rglob("structure_id=*/.*.crc"))

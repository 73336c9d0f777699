"""Tables, sinks, log maintenance, lookups, audits, streams, sessions."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from structlake.functions import jsonio, rules
from structlake.operators import profiles
from structlake.session import checkpoint
from structlake.sources import sinks, tables
from structlake.streaming import ingest


def test_headers_and_measurements(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("PDB ID,em,Around_N5 IsoelectricPoint,Around_N5_nH-bonds,Around_N5_ Flexibility\n"
                    "1ABC,-200,6.5,2,1.2\n,x,6.5,2,1.2\n")
    rows = tables.load_measurements(spark, str(tmp_path / "absent.csv"), str(path)).collect()
    assert (rows[0].pdb_id, rows[0].uniprot_id, rows[0].cofactor, rows[0].em) == ("1ABC", "UNK", "FMN", -200.0)
    assert rows[1].pdb_id == "DATASET" and rows[1].em is None
    with pytest.raises(FileNotFoundError):
        tables.load_measurements(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="em"):
        tables.as_measurements(tables.read_table(spark, str(tmp_path / "bad.csv")))


def test_tolerant_read(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("seq,name\n1,a\nbroken,b\n3,c,extra\n4,d\n")
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("name", T.StringType())])
    assert [r.seq for r in tables.safe_read_table(spark, str(path), schema).collect()] == [1, 4]
    assert tables.safe_read_table(spark, str(tmp_path / "absent"), schema).count() == 0


def test_append_checks_and_evolves(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.range(2), path, ["id"])
    sinks.append_log(spark.range(2, 4).withColumn("extra", F.lit(1)), path, ["id"])
    rows = sinks.read_log(spark, path).orderBy("id").collect()
    assert [(r.id, r.extra) for r in rows] == [(0, None), (1, None), (2, 1), (3, 1)]
    with pytest.raises(ValueError, match="missing"):
        sinks.append_log(spark.range(1), path, ["absent"])
    sinks.overwrite_table(spark.range(1), str(tmp_path / "t"))
    sinks.overwrite_table(spark.range(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_json_has_no_non_finite(spark, tmp_path):
    payload = spark.range(1).select(jsonio.eigenvalue_payload(
        F.lit(1.5), F.lit(float("nan")), F.lit(float("inf")), F.lit("2"), F.lit("x")).alias("p")).first().p
    assert json.loads(payload) == {"eigenvalues": [1.5, None, None, 2.0, None]}
    sinks.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": 1, "b": None}


def test_profile_names(spark):
    frame = spark.createDataFrame([("1abc", "A:Q1K,B:D2R"), ("1abc", ""), (None, None)], "id string, key string")
    names = [r.n for r in frame.select(profiles.profile_id(F.col("id"), F.col("key")).alias("n")).collect()]
    assert names == ["1ABC_AQ1K_BD2R_mutation", "1ABC_WT", "UNDEF_WT"]


def test_log_operations(spark):
    log = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "seq int, profile_id string, v double")
    assert {(r.profile_id, r.v) for r in profiles.latest_per_key(log, "profile_id").collect()} == {("a", 2.0), ("b", 3.0)}
    assert [r.seq for r in profiles.last_rows(log, 2).collect()] == [3, 2]
    added = profiles.insert_absent(log, spark.createDataFrame(
        [(9, "A", 0.0), (10, "c", 0.0)], log.schema), "profile_id")
    assert sorted(r.profile_id for r in added.collect()) == ["a", "a", "b", "c"]
    twice = log.select("seq", "v", F.lit("x").alias("seq"))
    assert profiles.drop_duplicate_columns(twice).columns == ["seq", "v"]


def test_wild_type_row_prefers_exact_name(spark):
    log = spark.createDataFrame([(1, "1ABC_WT_mutation", 1.0), (2, "1abc_WT_old", 2.0), (3, "2XYZ_WT_old", 3.0),
                                 (4, "1ABC_WTX", 4.0)], "seq int, profile_id string, v double")
    requests = spark.createDataFrame([("1abc",), ("2xyz",), ("3nnn",)], "pdb_id string")
    got = {r.pdb_id: r.wt_v for r in profiles.wild_type_rows(requests, log).collect()}
    assert got == {"1abc": 1.0, "2xyz": 3.0, "3nnn": None}


def test_diff_and_audit(spark):
    wild = spark.createDataFrame([(1, 100.0, 1.0, None), (2, 100.0, 1.0, 1.0)], "id int, pred_final double, a double, b double")
    mutant = spark.createDataFrame([(1, 100.0005, 1.0, 2.0), (2, 103.0, 1.5, 1.0)], wild.schema)
    diff = profiles.feature_diff(wild, mutant, "id", ["pred_final", "a", "b"])
    got = {(r.id, r.feature): (r.delta, r.changed) for r in diff.collect()}
    assert got[(1, "pred_final")][1] is False and got[(1, "b")] == (None, False)
    assert got[(2, "a")] == (0.5, True)
    emission = spark.createDataFrame([(1, 100.0005, 100.0), (2, None, 100.0)], "id int, brightness double, wt_pred_final double")
    audit = {r.id: (r.n_changed, r.warning, r.emission_unchanged) for r in profiles.audit_summary(diff, "id", emission).collect()}
    assert audit == {1: (0, "no feature changed", True), 2: (2, "ok", False)}


def test_status_and_override(spark):
    frame = spark.createDataFrame([(True, False), (False, True), (False, False)], "p boolean, f boolean")
    assert [r.s for r in frame.select(rules.validation_status(F.col("p"), F.col("f")).alias("s")).collect()] == [
        "PASS", "FORCED", "FAIL"]
    assert spark.range(1).select(rules.accession_mode(F.lit("CRY2"), F.lit("x")).alias("m")).first().m.startswith("Radical")


def test_checkpoint_uses_the_folder_of_the_session(spark):
    frame = checkpoint(spark.range(10).selectExpr("id * 2 as x"))
    assert frame.count() == 10
    assert "Scan ExistingRDD" in frame._jdf.queryExecution().executedPlan().toString()
    named = spark.conf.get("spark.checkpoint.dir", None)
    used = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert named is None or named.rstrip("/") in used


def test_stream_feeds_the_log(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    for turn, name in enumerate(("a", "b"), 1):
        (folder / f"{name}.pdb").write_text("HEADER\nATOM      1  N   ALA A   1      10.000  10.000  10.000\n")
        query = ingest.append_stream(ingest.stream_structure_text(spark, str(folder)), log,
                                     str(tmp_path / "cp"), expected=["structure_id", "value"])
        query.awaitTermination()
        assert sinks.read_log(spark, log).count() == 2 * turn

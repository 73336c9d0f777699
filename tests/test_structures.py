"""Closed-form structures: scan, sites, features, cofactor, edits."""

import math

import pytest
from pyspark.sql import functions as F

from structlake.functions import rules
from structlake.operators import environment, graph, scanner, sites, spatial, structure_edit
from structlake.sources import structure_text as text


def record(serial, atom, resn, chain, resi, x, y, z, kind="ATOM", icode=" ", b=20.0, element=""):
    return (f"{kind:<6}{serial:5d} {atom:<4} {resn:>3} {chain}{resi:>4}{icode}   "
            f"{x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{b:6.2f}          {element:>2}")


def line_table(spark, **structures):
    rows = [(name, i, line) for name, lines in structures.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "structure_id string, line_no long, value string")


SAMPLE = [
    record(1, "N", "ALA", "A", 1, 10, 10, 10), record(2, "CA", "ALA", "A", 1, 11, 10, 10),
    record(3, "C", "ALA", "A", 1, 11.5, 10, 10), record(4, "N", "GLY", "A", 10, 13, 20, 10, icode="A"),
    record(5, "N5", "FMN", "A", 400, 20, 20, 20, "HETATM"), record(6, "C4A", "FMN", "A", 400, 21, 20, 20, "HETATM"),
    record(7, "P", "FMN", "A", 400, 22, 20, 20, "HETATM"), record(8, "N", "LYS", "A", 2, 30, 30, 30),
]


def test_scan_fields_and_rejects(spark):
    bad = record(9, "CB", "ALA", "A", 1, 1, 1, 1)[:38] + "     n/a" + record(9, "CB", "ALA", "A", 1, 1, 1, 1)[46:]
    lines = line_table(spark, s=["REMARK", *SAMPLE, bad, record(10, "CA", "VAL", " ", 7, 1, 2, 3)[:60]])
    atoms = {r.line_no: r for r in text.scan_atoms(lines).collect()}
    assert len(atoms) == 9
    assert atoms[4].icode == "A" and atoms[4].resi == "10"
    assert atoms[10].chain == "?" and atoms[10].b_factor == 20.0
    assert atoms[5].element == "N"
    index = {(r.resi, r.icode): r.atom_count for r in text.residue_index(lines).collect()}
    assert index[("1", " ")] == 4  # the unreadable coordinate still counts here


def test_read_files_keeps_line_order(spark, tmp_path):
    (tmp_path / "one.pdb").write_text("\n".join(["HEADER", *SAMPLE]) + "\n")
    (tmp_path / "two.ent").write_text("\n".join(SAMPLE[:2]) + "\n")
    (tmp_path / "skip.txt").write_text("\n".join(SAMPLE))
    lines = text.read_structure_lines(spark, str(tmp_path))
    got = lines.where("structure_id = 'one'").orderBy("line_no").select("value").collect()
    assert [r.value for r in got] == ["HEADER", *SAMPLE]
    assert text.scan_atoms(lines).groupBy("structure_id").count().orderBy("structure_id").collect() == [
        ("one", 8), ("two", 2)]
    hashes = structure_edit.file_hashes(spark, str(tmp_path))
    assert {len(r.structure_hash) for r in hashes.collect()} == {64}


def test_environment_closed_form(spark):
    # A lysine and an aspartate, one angstrom from the N5.
    lines = line_table(spark, s=[
        record(1, "N5", "FMN", "A", 1, 0, 0, 0, "HETATM"), record(2, "CA", "LYS", "A", 2, 1, 0, 0),
        record(3, "CA", "ASP", "A", 3, 0, 1, 0)], none=[record(1, "CA", "ALA", "A", 1, 0, 0, 0)])
    rows = {r.structure_id: r for r in environment.environment_features(text.scan_atoms(lines)).collect()}
    assert rows["s"].iso == pytest.approx((10.5 + 3.1) / 1.5)
    assert rows["s"].hb_cap == pytest.approx(1.0)
    assert rows["s"].flex == pytest.approx(1.08)
    assert rows["none"].flavin_found is False and rows["none"].iso == 0.0


def test_water_option(spark):
    lines = line_table(spark, s=[
        record(1, "N5", "FMN", "A", 1, 0, 0, 0, "HETATM"), record(2, "O", "HOH", "A", 2, 1, 0, 0, "HETATM")])
    atoms = text.scan_atoms(lines)
    assert environment.environment_features(atoms).first().iso == pytest.approx(6.0 / 1.5)
    assert environment.environment_features(atoms, water_as_histidine=False).first().iso == 0.0


def test_busier_site_wins_then_chain(spark):
    crowded = [record(9, "N5", "FAD", "B", 9, 100, 0, 0, "HETATM"), record(10, "CA", "LYS", "B", 1, 101, 0, 0)]
    lonely = [record(1, "N5", "FAD", "A", 9, 0, 0, 0, "HETATM")]
    lines = line_table(spark, busy=lonely + crowded, tie=lonely + crowded[:1])
    picked = {r.structure_id: r for r in sites.pick_site(text.scan_atoms(lines), 6.0).collect()}
    assert (picked["busy"].chain, picked["busy"].score) == ("B", 1)
    assert (picked["tie"].chain, picked["tie"].score) == ("A", 0)


def test_cofactor_detection_and_presence(spark):
    atoms = text.scan_atoms(line_table(spark, s=SAMPLE, none=SAMPLE[:3]))
    found = scanner.detect_cofactor(atoms).collect()
    assert [(r.structure_id, r.cofactor, r.chain, r.resi, r.atom_count) for r in found] == [("s", "FMN", "A", "400", 3)]
    requests = spark.createDataFrame([("s", "fmn"), ("s", "FAD"), ("none", "FMN")], "structure_id string, target string")
    got = {(r.structure_id, r.target): r.present for r in scanner.cofactor_presence(atoms, requests).collect()}
    assert got == {("s", "FMN"): True, ("s", "FAD"): False, ("none", "FMN"): False}


def test_nearest_atom_of_the_sample(spark):
    atoms = text.scan_atoms(line_table(spark, s=SAMPLE))
    _frame, distances = scanner.audit_pockets(atoms)
    nearest = scanner.nearest_neighbour(distances).first()
    assert (nearest.resn, nearest.resi, nearest.atom_name) == ("GLY", "10", "N")
    assert nearest.distance == pytest.approx(math.sqrt(164))


def test_accession(spark):
    lines = line_table(spark, s=["DBREF  1CF3 A    3   583  UNP    P13006   GOX_ASPNG"],
                       t=["REMARK UNP P13006"], u=["SEQADV X Q9VBW3 UNIPROT none"])
    got = {r.structure_id: r.accession for r in text.accessions(lines).collect()}
    assert got == {"s": "P13006", "u": "Q9VBW3"}


def test_components_by_brute_force(spark):
    import random

    rng = random.Random(3)
    points = [("s", f"n{i}", rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 20)) for i in range(60)]
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            if math.dist(a[2:], b[2:]) <= 10:
                parent[find(i)] = find(j)
    sizes = [sum(find(j) == r for j in range(len(points))) for r in {find(i) for i in range(len(points))}]
    nodes = spark.createDataFrame(points, "structure_id string, node string, cx double, cy double, cz double")
    assert graph.largest_component(nodes).first().largest_component == max(sizes)
    alone = spark.createDataFrame(points[:1], nodes.schema)
    assert graph.largest_component(alone).first().largest_component == 0


@pytest.mark.parametrize("edge", [2.0, 5.0, 9.0])
def test_range_join_by_brute_force(spark, edge):
    import random

    rng = random.Random(int(edge))
    centers = [("s", i, *(rng.uniform(-20, 20) for _ in "xyz")) for i in range(40)]
    # Points on exact cell borders and exactly one radius away are included.
    points = [("s", i, *(float(rng.randint(-20, 20)) for _ in "xyz")) for i in range(300)]
    centers.append(("s", 99, 0.0, 0.0, 0.0))
    points.append(("s", 999, 5.0, 0.0, 0.0))
    left = spark.createDataFrame(centers, "structure_id string, c int, cx double, cy double, cz double")
    right = spark.createDataFrame(points, "structure_id string, p int, x double, y double, z double")
    got = {(r.c, r.p) for r in spatial.pairs_within(left, right, 5.0, edge=edge).select("c", "p").collect()}
    want = {(c[1], p[1]) for c in centers for p in points if math.dist(c[2:], p[2:]) <= 5.0}
    assert got == want and (99, 999) in got
    strict = {(r.c, r.p) for r in spatial.pairs_within(left, right, 5.0, strict=True, edge=edge).collect()}
    assert (99, 999) not in strict


def test_hot_structure_is_split_over_cells(spark):
    """One structure with nearly all rows is keyed by cells, not by its id."""
    rows = [("hot", i, "A", str(i // 3), " ", float(i % 50), float(i % 37), float(i % 23)) for i in range(3000)]
    atoms = spark.createDataFrame(
        rows, "structure_id string, line_no long, chain string, resi string, icode string, x double, y double, z double")
    cells = spatial.with_cell(atoms, 6.0).groupBy("structure_id", "cell").count()
    assert cells.agg(F.max("count")).first()[0] < 100
    assert spatial.burial(atoms).count() == 1000


def test_hot_structure_meets_its_centre_in_parts(spark):
    """Without a broadcast, the atoms of one structure still go to many tasks."""
    rows = [("hot" if i % 3 else f"s{i}", float(i), float(i % 37), float(i % 23)) for i in range(3000)]
    atoms = spark.createDataFrame(rows, "structure_id string, x double, y double, z double")
    centers = atoms.select("structure_id").distinct().withColumn("cx", F.lit(0.0))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        joined = spatial.with_center(atoms, centers)
        parts = [r["count"] for r in joined.where("structure_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        plan = joined.groupBy("structure_id").agg(F.max("x"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(parts) == 2000 and len(parts) >= 5 and max(parts) < 1000
    assert "partial_max" in plan and plan.count("Exchange hashpartitioning(structure_id") >= 2


def test_edit_keeps_backbone_and_renders(spark):
    lines = line_table(spark, s=[
        record(1, "N", "GLN", "A", 5, 0, 0, 0), record(2, "CA", "GLN", "A", 5, 1, 0, 0),
        record(3, "CB", "GLN", "A", 5, 2, 0, 0), record(4, "N", "ALA", "A", 6, 5, 0, 0)])
    records = text.scan_records(lines)
    targets = spark.createDataFrame(
        [("s", "A", "5", " ", "V"), ("s", "A", "77", " ", "V")],
        "structure_id string, chain string, resi string, icode string, mut string")
    edited = structure_edit.apply_mutations(records, targets)
    names = [(r.resn, r.atom_name) for r in edited.orderBy("line_no", "sub_line").collect()]
    assert names == [("VAL", "N"), ("VAL", "CA"), ("VAL", "CB"), ("VAL", "CG1"), ("VAL", "CG2"), ("ALA", "N")]
    verdicts = {r.resi: r.verdict for r in structure_edit.check_edit(records, edited, targets).collect()}
    assert verdicts == {"5": "ok", "77": "target not touched"}
    same = {r.resi: r.verdict for r in structure_edit.check_edit(records, records, targets).collect()}
    assert same["5"] == "structure build failure"
    rendered = [r.value for r in structure_edit.render_lines(edited).orderBy("serial_no").collect()]
    assert [line[6:11].strip() for line in rendered] == [str(i) for i in range(1, 7)]
    assert rendered[1][:30] == "ATOM      2  CA  VAL A   5    "
    back = text.scan_atoms(line_table(spark, s=rendered))
    assert back.count() == 6


def test_one_file_per_stem(spark, tmp_path):
    for folder, x in (("a", 1.0), ("b", 2.0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1ABC.pdb").write_text(
            f"ATOM      1  CA  ALA A   1    {x:8.3f}{x:8.3f}{x:8.3f}  1.00 20.00           C\n")
    first = text.scan_atoms(text.read_structure_lines(spark, str(tmp_path))).collect()
    assert [(r.structure_id, r.x) for r in first] == [("1ABC", 1.0)]
    wanted = text.scan_atoms(text.read_structure_lines(spark, str(tmp_path), preferred=("/b/",))).collect()
    assert [r.x for r in wanted] == [2.0]


def test_hashes_notice_order(spark):
    atom = "ATOM      1  CA  ALA A   1    {:8.3f}   1.000   1.000  1.00 20.00           C"
    rows = [(1, 1, atom.format(1)), (1, 2, atom.format(2)), (2, 1, atom.format(2)), (2, 2, atom.format(1)),
            (3, 1, atom.format(1)), (3, 2, atom.format(2))]
    lines = spark.createDataFrame(rows, "structure_id bigint, line_no bigint, value string")
    got = {r.structure_id: tuple(r)[1:] for r in structure_edit.structure_hashes(lines).join(
        structure_edit.coordinate_hashes(text.scan_atoms(lines)), "structure_id").collect()}
    assert got[1] == got[3] and all(a != b for a, b in zip(got[1][:3], got[2][:3]))


def test_burial_does_not_depend_on_the_order_of_atoms(spark):
    # The mean of the three is exactly six away from the other residue's atom.
    for zs in ((0.1, 0.1, 23.5), (0.1, 23.5, 0.1), (23.5, 0.1, 0.1)):
        rows = [("s", "A", "1", " ", 0.0, 0.0, z) for z in zs] + [("s", "A", "2", " ", 0.0, 0.0, 13.9)]
        atoms = spark.createDataFrame(rows, "structure_id string, chain string, resi string, icode string, x double, y double, z double")
        assert {r.resi: r.burial for r in spatial.burial(atoms.coalesce(1)).collect()}["1"] == 0
    infinite = spark.createDataFrame([("s", "A", "1", " ", 0.0, 0.0, float("nan"))], atoms.schema)
    assert [r.burial for r in spatial.burial(infinite).collect()] == [0]


def test_message_rounds_the_exact_distance(spark):
    values = [1.005, 0.125, 0.375, 2.675, 4.985, 1.115, 0.005, 9.995, 0.995, 12.0, 0.0, 1e-9, 123456.785, -0.001, -2.675]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 6):
        shown = rows.select("v", rules.fixed_text(F.col("v"), digits).alias("s")).collect()
        assert [r.s for r in shown] == [f"{r.v:.{digits}f}" for r in shown]
    report = rules.nearest_report(F.lit("GLY"), F.lit("1"), F.lit("N"), F.col("v"))
    assert rows.select(report.alias("s")).first().s == "GLY1-N found at 1.00 Å"
    odd = spark.createDataFrame([(float("nan"),), (1e300,)], "v double").select(rules.fixed_text(F.col("v"), 2).alias("s"))
    assert [len(r.s) for r in odd.collect()] == [3, 304]


def test_pocket_centre_does_not_depend_on_the_order_of_atoms(spark):
    found = set()
    for zs in ((0.1, 0.1, 23.5), (0.1, 23.5, 0.1), (23.5, 0.1, 0.1)):
        rows = [("s", n, "C", "FMN", "A", "9", " ", 0.0, 0.0, z, "C") for n, z in enumerate(zs)] + [
            ("s", 7, "CA", "GLY", "A", "1", " ", 0.0, 0.0, 13.9, "C")]
        atoms = spark.createDataFrame(rows, "structure_id string, line_no bigint, atom_name string, resn string, chain string, "
                                            "resi string, icode string, x double, y double, z double, element string")
        found.add(scanner.pocket_frame(atoms.coalesce(1)).first().cz)
    assert len(found) == 1


def test_burial_of_odd_places_and_what_it_shuffles(spark):
    """Places of signs, nulls and numbers come back as they were; the places of a pair go as two strings, not as six."""
    odd = [("A", "1", " "), ("A\x00", "1", " "), ("A", "\x001", " "), ("", "\x02", "\x01"), ("\x02", "0", ""), (None, "1", " "), ("A", None, " ")]
    rows = [("s", *p, float(n) / 10, 0.0, 0.0) for n, p in enumerate(odd)]
    atoms = spark.createDataFrame(rows, "structure_id string, chain string, resi string, icode string, x double, y double, z double")

    def same(p, q):
        parts = [None if a is None or b is None else a == b for a, b in zip(p, q)]
        return False if False in parts else None if None in parts else True

    got = {(r.chain, r.resi, r.icode): r.burial for r in spatial.burial(atoms).collect()}
    assert got == {p: sum(same(p, q) is False for q in odd) for p in odd}
    numbered = atoms.where("resi = '1'").withColumn("resi", F.lit(7))
    assert spatial.burial(numbered).schema["resi"].dataType.simpleString() == "int"
    plan = spatial.burial(atoms)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("other_resi" in line for line in shuffled)

"""Comparisons of wells and layers, texts of surfaces and faults, exports."""

import json

import pytest
from pyspark.sql import functions as F

from wellspring.operators import catalog, compare, ingest, search, surfaces, trajectory
from wellspring.sources import binary_formats as bf
from wellspring.sources import sinks, surface_texts
from wellspring.sources import text_formats as tf


def test_two_to_four_wells(spark):
    asked = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A"), (1, "C"), (2, "A"), (2, "A"), (3, None), (4, "A"), (4, "D")], "q int, well string")
    wells = spark.createDataFrame([("A", 0.0, 0.0), ("B", 3.0, 4.0), ("C", None, 1.0), ("D", float("nan"), 1.0)], "well string, x double, y double")
    low = spark.createDataFrame([("A", 0.0, 0.0), ("B", 6.0, 8.0)], "well string, x double, y double")
    got = {(r["q"], r["left_well"], r["right_well"]): tuple(r)[3:] for r in compare.compared_wells(asked, wells, low).collect()}
    assert got == {(1, "A", "B"): (5.0, 10.0, 5.0), (1, "A", "C"): (None, None, None), (1, "B", "C"): (None, None, None), (4, "A", "D"): (None, None, None)}
    items = spark.createDataFrame([("A", "GR"), ("A", "GR"), ("B", "GR"), ("A", "RT"), ("X", "SP")], "well string, item string")
    assert {tuple(r) for r in compare.shared_items(asked.where("q = 1"), items).collect()} == {(1, "GR", 2, True), (1, "RT", 1, False)}


def test_layers_of_a_well(spark):
    asked = spark.createDataFrame([(1, "A", lay, i) for i, lay in enumerate(("L2", "L1", "L3", "L4", "L5", "L6"))], "q int, well string, layer string, place int")
    tops = spark.createDataFrame([("A", "L1", 100.0, "f2"), ("A", "L1", 90.0, "f1"), ("A", "L2", 200.0, "f1")], "well string, layer string, md double, file string")
    hits = spark.createDataFrame([("A", "L3", 300.0, True, True), ("A", "L1", 1.0, True, True), ("A", "L4", None, False, True), ("A", "L5", None, False, False)], "well string, layer string, md double, hit boolean, computed boolean")
    rows = compare.resolved_layers(asked, tops, hits)
    got = {r["layer"]: (r["status"], r["md"], r["versions"], r["md_spread"]) for r in rows.collect()}
    assert got == {"L1": ("resolved", 90.0, 2, 10.0), "L2": ("resolved", 200.0, 1, 0.0), "L3": ("resolved", 300.0, 1, None), "L4": ("not_intersected", None, 1, None), "L5": ("not_computed", None, 1, None), "L6": ("missing", None, 0, None)}
    path = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 0.0), ("A", 400.0, 200.0, 0.0, 300.0)], "well string, md double, x double, y double, tvd double")
    curves = spark.createDataFrame([("A", 1, "GR", 0.0, 250.0), ("A", 2, "RT", 150.0, 400.0)], "well string, id long, mnemonic string, top double, base double")
    perf = spark.createDataFrame([("A", 1, 180.0, 220.0), ("A", 2, 10.0, 20.0)], "well string, id long, top double, base double")
    seg = {r["top_layer"]: r for r in compare.layer_intervals(rows, path, curves, perf).collect()}
    assert set(seg) == {"L1", "L2"} and seg["L1"]["base_layer"] == "L2" and seg["L1"]["reordered"]
    assert (seg["L1"]["md_thickness"], seg["L1"]["tvd_thickness"], seg["L1"]["displacement"]) == pytest.approx((110.0, 82.5, 55.0))
    assert (seg["L1"]["full_curves"], seg["L1"]["partial_curves"], seg["L1"]["perforations"], seg["L1"]["perforated"]) == ("GR", "RT", 1, 20.0)
    assert (seg["L2"]["full_curves"], seg["L2"]["partial_curves"], seg["L2"]["perforated"]) == ("RT", "GR", 20.0)


def test_quality_of_a_catalogue(spark):
    kinds = spark.createDataFrame([(k, 2) for k in ("well_head", "deviation", "well_log", "well_top", "seismic", "horizon", "polygon", "production")], "kind string, files int")
    share = spark.createDataFrame([("deviation", 0.5), ("well_log", 1.5)], "kind string, share double")
    checks = compare.quality_checks(kinds, share)
    assert checks.count() == 9 and checks.agg(F.sum("weight")).first()[0] == 96
    g = compare.quality_grade(checks).first()
    assert (g["score"], g["grade"], g["alerts"]) == (80, "mostly complete", "few head wells have trajectories; no fault model")
    assert compare.quality_grade(compare.quality_checks(kinds.limit(0), share.limit(0))).first()["score"] == 0


def test_merged_wells_and_new_mentions(spark):
    kids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "well_id long, x string")
    merges = spark.createDataFrame([(1, 2), (2, 3)], "merged_id long, into_id long")
    assert sorted((r["x"], r["well_id"]) for r in compare.merged_wells(kids, merges).collect()) == [("a", 3), ("b", 3), ("c", 3), ("d", None)]
    schema = "id long, well_id long, source_id long, uwi string, x double, y double, kb_elevation double, total_depth double"
    old = spark.createDataFrame([(1, 7, 1, None, 1.0, 2.0, 5.0, None), (2, 8, 1, None, 1.0, 2.0, 5.0, None)], schema)
    new = spark.createDataFrame([(3, 7, 2, "U", 9.0, 9.0, None, 100.0)], schema)
    src = spark.createDataFrame([(1, "las"), (2, "well_head")], "id long, data_type string")
    got = compare.with_mention(old, new, src).collect()
    assert [(r["well_id"], r["uwi"], r["x"], r["kb_elevation"], r["total_depth"]) for r in got] == [(7, "U", 9.0, 5.0, 100.0)]
    with pytest.raises(ValueError):
        compare.hits_by_kind(old, "2d_profile", old)


def test_mask_without_its_boundary(spark):
    ring = spark.createDataFrame([("p", 0, i, x, y) for i, (x, y) in enumerate(((0.5, 0.5), (3.0, 0.5), (3.0, 3.0), (0.5, 3.0)))], "polygon string, ring int, seq int, x double, y double")
    nodes = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else 1.0) for r in range(5) for c in range(5)], "row int, col int, value double")
    got = {(r["row"], r["col"]) for r in surfaces.grid_mask(nodes, ring, 0.0, 0.0, 1.0, 1.0).where("inside").collect()}
    assert {(1, 2), (2, 1), (2, 2)} <= got and not got & {(1, 1), (0, 0), (4, 4), (1, 4)}
    pts = spark.createDataFrame([(1, 3.0, 2.0), (2, 2.0, 2.0)], "id int, x double, y double")
    assert {r["id"] for r in surfaces.points_in_polygons(pts, ring, 2.0).collect()} == {1, 2} and {r["id"] for r in surfaces.points_in_polygons(pts, ring, 2.0, boundary=False).collect()} == {2}


def test_depth_below_the_sea(spark):
    rows = spark.createDataFrame([("A", 1, 0.0, 0.0, 0.0), ("A", 2, 100.0, 0.0, 0.0), ("B", 3, 50.0, 0.0, 0.0)], "well string, id long, md double, inc double, azi double")
    heads = spark.createDataFrame([("A", 12.0)], "well string, kb double")
    got = {(r["well"], r["md"]): r["tvdss"] for r in trajectory.minimum_curvature(rows, heads).collect()}
    assert got == {("A", 0.0): -12.0, ("A", 100.0): 88.0, ("B", 50.0): None}


def test_kinds_of_surfaces(spark, tmp_path):
    texts = {
        "a.grd": "FSASCI 0 1\nFSLIMI 0 100 0 50 -9 9\nFSNROW 3 5\nFSXINC 25 25\n->\n1 2 3", "b.zmap": "! ZMAP\n@ x", "c.xyz": "10 20 -3\n500 600 7\n# no", "d.txt": "PROFILE a TYPE 2\nx y", "e.dat": "1000 2000 50000 60000 7\n",
        "f.dat": "12 13 50000.5 60000.5 -7", "g.dat": "nothing",
    }
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    files = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in texts.items()], "path string, content binary")
    for got in (surface_texts.surface_metadata(spark, str(tmp_path)), surface_texts.surface_metadata(spark, files)):
        m = {r["path"].rsplit("/", 1)[-1]: r for r in got.collect()}
        assert {n: r["kind"] for n, r in m.items()} == {"a.grd": "regular_surface", "b.zmap": "zmap_grid", "c.xyz": "xyz_surface", "d.txt": "2d_profile", "e.dat": "xyz_surface", "f.dat": "xyz_surface", "g.dat": "catalog_horizon"}
        assert (m["a.grd"]["rows"], m["a.grd"]["cols"], m["a.grd"]["x_max"], m["a.grd"]["low"]) == (3, 5, 100.0, -9.0)
        assert (m["c.xyz"]["points"], m["c.xyz"]["y_max"], m["c.xyz"]["low"]) == (2, 600.0, -3.0) and (m["f.dat"]["x_min"], m["f.dat"]["low"]) == (50000.5, -7.0)


def _lines(spark, **files):
    return spark.createDataFrame([(f"/x/{n}.txt", line) for n, t in files.items() for line in t.splitlines()], "path string, value string")


def test_profiles_and_faults(spark):
    p = surface_texts.profile_points(spark, _lines(spark, one="PROFILE a TYPE 1\n1 2 0 0 -5 0 0 44 0 L1\n# c\n3 4 0 0 bad 0 0 45 0 L2", two="SNAPPING\nPROFILE b TYPE 2\n5 6 7\n8"))
    assert sorted((r["profile_type"], r["line"], r["trace"], r["x"], r["z"]) for r in p.where("z is not null").collect()) == [(1, "L1", 44, 1.0, -5.0), (2, "two", None, 5.0, 7.0)] and p.count() == 3
    s = surface_texts.point_summary(p, "line").where("path like '%one%'").first()
    assert (s["points"], s["groups"], s["low"], s["y_max"]) == (2, 2, -5.0, 4.0)
    f = surface_texts.fault_sticks(spark, _lines(spark, f="INLINE- 1 2 10 20 -30 0 S1\nXLINE 1 2 x 20 -30 0 S2\nTRACE 1 2 3 4 5 6 7")).collect()
    assert [tuple(r)[1:] for r in f] == [("S1", 10.0, 20.0, -30.0)]
    m = surface_texts.fault_model(spark, _lines(spark, m='FAULT "Big one"\nPILLAR 1 2 3\nPILLAR 4 5\nFAULT')).collect()
    assert sorted((r["kind"], r["name"], r["z"]) for r in m if r["kind"] == "fault") == [("fault", "Big one", None)] and sum(r["kind"] == "pillar" for r in m) == 2
    d = surface_texts.faults_on_lines(spark, _lines(spark, d="# h\nLINE-7 3 1.5 2.5 -9\nLINE-8 3 a b c")).collect()
    assert [tuple(r)[1:] for r in d] == [("LINE-7", 1.5, 2.5, -9.0)]
    c = spark.createDataFrame([('<crs code="EPSG:32650"><Name>UTM 50N</Name></crs>',), ("<a><description>Local grid</description><name>x</name></a>",), (None,)], "t string").select(surface_texts.crs_sidecar(F.col("t")).alias("c")).collect()
    assert [tuple(r["c"]) for r in c] == [(32650, "UTM 50N"), (None, "Local grid"), (None, None)]


def test_coverage_and_detail_of_volumes(spark):
    s = spark.createDataFrame([("s", 0.0, 0.0, 10.0, 10.0, 5.0, 5.0), ("far", 900.0, 900.0, 910.0, 910.0, 50.0, 50.0)], "surface string, x0 double, y0 double, x1 double, y1 double, dx double, dy double")
    v = spark.createDataFrame([("v", 5.0, 0.0, 25.0, 10.0, 12.5, 25.0)], "volume string, x0 double, y0 double, x1 double, y1 double, inline_spacing double, crossline_spacing double")
    assert [tuple(r) for r in search.surface_over_seismic(s, v).collect()] == [("s", "v", 25.0, 50.0, True)]
    scans = spark.createDataFrame([("a", 6, 1, 2, 5, 7, 4, 10.0), ("b", 9, None, None, None, None, 0, 8.0)], "path string, trace_count long, inline_min int, inline_max int, crossline_min int, crossline_max int, delay_ms_min int, end_ms_max double")
    assert {tuple(r) for r in search.seismic_detail(scans).collect()} == {("a", 6, 2, 3, 6.0, "2 x 3", True), ("b", 9, None, None, 8.0, "line", None)}
    assert ingest.clustering_method("som") == ("som", None) and ingest.clustering_method("hierarchical")[0] == "kmeans" and ingest.clustering_method("hierarchical")[1]


def test_profiles_and_plans(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    sig = catalog.signature(files)
    assert catalog.is_current(sig, files.repartition(3)) and not catalog.is_current(sig, files.withColumn("size", F.col("size") + 1)) and not catalog.is_current(sig.limit(0), files)
    plan = lambda at, n: json.dumps({"plan_id": "p", "name": "old", "method": "som", "k": 2, "saved_at": at, "members": [{"well": f"W{i}", "cluster": i % 2} for i in range(n)]})
    t = spark.createDataFrame([("1", plan("2020", 3)), ("2", plan("2021", 2)), ("3", "no plan"), ("4", None)], "path string, content string")
    assert sorted((r["well"], r["cluster"]) for r in catalog.saved_plans(t).collect()) == [("W0", 0), ("W1", 1)]
    h = spark.createDataFrame([("a", "W", "gr", "API", 1.0, 5.0), ("b", "W", "GR ", "GAPI", 0.0, 4.0)], "path string, well string, mnemonic string, unit string, start double, stop double")
    assert tuple(catalog.header_profile(h, files.where("size > 1")).first()) == ("W", "GR", 2, "API,GAPI", 0.0, 5.0, 1)


def test_wells_in_scope_with_a_mark(spark, tmp_path):
    w = spark.createDataFrame([(2, 5.0, 5.0, "b"), (1, 50.0, 50.0, "a"), (3, None, 1.0, "c")], "id long, x double, y double, name string")
    assert {r["id"] for r in sinks.wells_in_scope(w, (0, 0, 10, 10)).collect()} == {2} and sinks.wells_in_scope(w).count() == 3
    ring = spark.createDataFrame([("p", 0, i, x, y) for i, (x, y) in enumerate(((40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0)))], "polygon string, ring int, seq int, x double, y double")
    assert {r["id"] for r in sinks.wells_in_scope(w, rings=ring).collect()} == {1}
    sinks.write_wells(w, str(tmp_path / "w"))
    parts = list((tmp_path / "w").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_bytes().startswith(b"\xef\xbb\xbfid,x,y,name\n1,")


def test_bundles_of_logs(spark, tmp_path):
    rows = [("W", "GR", "API", 1.0, 5.0), ("W", "GR", "API", 2.0, None), ("W", "RT", None, 2.0, 7.0), ("W", "RT", None, 2.0, 7.0)]
    df = spark.createDataFrame(rows, "well string, mnemonic string, unit string, md double, value double")
    kept = spark.createDataFrame([("W", 1, "KB. 12 :"), ("W", 0, "FLD. X :")], "well string, place int, line string")
    sinks.write_texts(sinks.las_bundle(df, headers=kept), "well", str(tmp_path / "o"), ".las").collect()
    assert "FLD. X :\nKB. 12 :\n" in (tmp_path / "o" / "W.las").read_text()
    back = {(r["mnemonic"], r["md"]): r["value"] for r in tf.las_samples(spark, str(tmp_path / "o")).collect()}
    assert back == {("GR", 1.0): 5.0, ("GR", 2.0): None, ("RT", 1.0): None, ("RT", 2.0): 7.0}
    chosen = spark.createDataFrame([("W", "gamma_ray", 1), ("W", "sonic", 2)], "well string, curve_type string, curve_id long")
    samples = spark.createDataFrame([(1, 10.0, 3.0, "API"), (1, 11.0, None, "API"), (9, 1.0, 1.0, "X")], "curve_id long, md double, value double, unit string")
    merged, manifest = sinks.merged_focus(chosen, samples)
    assert sorted(tuple(r) for r in merged.collect()) == [("W", "GAMMA_RAY", "API", 10.0, 3.0), ("W", "GAMMA_RAY", "API", 11.0, None)]
    assert {(r["curve_type"], r["samples"], r["missing"]) for r in manifest.collect()} == {("gamma_ray", 1, False), ("sonic", 0, True)}


def test_manifests(spark):
    typed = spark.createDataFrame([(1, "sonic"), (1, "density"), (2, "sonic"), (3, "sp")], "las_file_id long, curve_type string")
    files = spark.createDataFrame([(1, "/a.las"), (1, "/a.las")], "las_file_id long, path string")
    assert {tuple(r) for r in sinks.files_by_type(typed, files, ["sonic", "density"]).collect()} == {(1, "/a.las", "density,sonic", "density", False), (2, None, "sonic", "sonic", True)}
    wanted = spark.createDataFrame([("A", "log"), ("A", "dev"), ("B", "log")], "well_key string, kind string")
    found = spark.createDataFrame([("A", "log", "/x/a.las"), ("A", "log", "/y/a.las"), ("B", "dev", "/b.dev")], "well_key string, kind string, path string")
    delivered, report = sinks.directory_delivery(wanted, found)
    assert sorted(r["target"] for r in delivered.collect()) == ["log/A/a.las", "log/A/a_2.las"]
    assert {tuple(r) for r in report.collect()} == {("A", "dev", 2), ("B", "log", 0)}
    heads = spark.createDataFrame([("A", 1.0), ("B", None)], "well_key string, x double")
    got = {r["well_key"]: r for r in sinks.reconstruction(heads, {"files": found.select("well_key", "path")}).collect()}
    assert json.loads(got["A"]["files"]) == [{"path": "/x/a.las"}, {"path": "/y/a.las"}] and got["B"]["files_n"] == 1 and json.loads(got["A"]["head"]) == {"x": 1.0}


def test_workbooks_are_read_back(spark, tmp_path):
    p = spark.createDataFrame([("s1", "B<&>", "perf", 2.0, 3.5), ("s1", "A", None, 1.0, 2.0), ("s2", "C", "perf", None, 9.0)], "sheet string, well string, kind string, top double, base double")
    sinks.write_texts(sinks.perforation_workbooks(p).withColumnRenamed("content", "text"), "sheet", str(tmp_path), ".xlsx").collect()
    cells = bf.workbook_cells(spark, str(tmp_path)).where("path like '%s1.xlsx'").orderBy("row_no").collect()
    assert [r["text"] for r in cells if r["name"] == "WELL"] == ["A", "B<&>"] and [r["text"] for r in cells if r["name"] == "BASE_MD"] == ["2.0", "3.5"]


def test_export_sets_keep_their_columns(spark):
    h = spark.createDataFrame([("A", "2020-01", 1.0)], "well_key string, month string, oil_rate double")
    out = sinks.export_sets({"history": h}, spark)
    assert out["history"].columns == ["well_key", "month", "oil_rate", "water_rate", "gas_rate", "days_on"] and out["markers"].count() == 0 and len(out) == 10
    assert {(r["name"], r["n"]) for r in out["availability"].where("available").collect()} == {("history", 1)}

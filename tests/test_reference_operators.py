"""Reference operators against known values; the queries have SQL besides."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import catalog, clustering, curves, production, surfaces, trajectory, wells


def test_vertical_well_and_a_bend(spark):
    rows = [("A", 1, 0.0, 0.0, 0.0), ("A", 2, 100.0, 0.0, 0.0), ("B", 3, 0.0, 0.0, 90.0), ("B", 4, 157.0796326794897, 90.0, 90.0), ("B", 5, 157.0796326794897, -1.0, 0.0)]
    p = {(r["well"], round(r["md"])): r for r in trajectory.minimum_curvature(spark.createDataFrame(rows, "well string, id long, md double, inc double, azi double")).collect()}
    assert p[("A", 100)]["tvd"] == pytest.approx(100) and p[("A", 100)]["east"] == pytest.approx(0)
    assert p[("B", 157)]["tvd"] == pytest.approx(100) and p[("B", 157)]["east"] == pytest.approx(100)


def test_horizontal_surface_cuts_at_its_depth(spark):
    d = spark.createDataFrame([("A", float(m), float(m) - 50) for m in range(0, 101, 20)], "well string, md double, diff double")
    assert trajectory.first_crossing(d).first()["md"] == pytest.approx(50)


def test_volumes_with_edge_weights(spark):
    n = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3)], "row int, col int, value double")
    v = surfaces.volumes(n, 3, 3, 1.0, 1.0, {"net": 1.0, "porosity": 20, "saturation": 0.5, "volume_factor": 1.0, "recovery": 0.5, "gas_oil_ratio": 2.0}).first()
    assert v["area"] == 4 and v["bulk"] == 4 and v["in_place"] == pytest.approx(0.4) and v["recoverable"] == pytest.approx(0.2)


def test_linear_surfaces_correlate(spark):
    rows = [("a", i, j, float(i * 5 + j)) for i in range(5) for j in range(5)]
    n = spark.createDataFrame(rows + [("b", i, j, 2 * v + 1) for _, i, j, v in rows], "surface string, row int, col int, value double")
    assert surfaces.correlations(n, ["a", "b"]).first()["r"] == pytest.approx(1)
    vec = n.groupBy("row", "col").agg(F.array(F.max(F.when(F.col("surface") == "a", F.col("value") - 12)), F.max(F.when(F.col("surface") == "b", F.col("value") - 25))).alias("v"))
    assert surfaces.principal_shares(vec, "v", 2)[0][0] == pytest.approx(1)


def test_points_on_edges_and_in_holes(spark):
    rings = [("p", 0, i, x, y) for i, (x, y) in enumerate(((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)))] + [("p", 1, i, x, y) for i, (x, y) in enumerate(((4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)))]
    r = spark.createDataFrame(rings, "polygon string, ring int, seq int, x double, y double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.0, 5.0), (4, 11.0, 5.0), (5, None, 1.0)], "id long, x double, y double")
    assert sorted(x["id"] for x in surfaces.points_in_polygons(pts, r, 3.0).collect()) == [1, 3]
    assert surfaces.polygon_areas(r).first()["area"] == 96


def test_decline_recovers_its_parameters(spark):
    t = np.arange(40)
    for b, q in ((0.0, 100 * np.exp(-0.05 * t)), (0.5, 100 / (1 + 0.5 * 0.05 * t) ** 2), (1.0, 100 / (1 + 0.05 * t))):
        got = production.fit_decline(t.astype(float), q)
        assert got[0] == pytest.approx(b) and got[1] == pytest.approx(100)


def test_two_high_and_two_low_producers(spark):
    rows = [("a", 10.0, 1.0), ("b", 11.0, 1.0), ("c", 100.0, 1.0), ("d", 101.0, None)]
    z = clustering.standardised(spark.createDataFrame(rows, "well string, f double, g double"), "well", ["f", "g"])
    out, centres, history = clustering.kmeans(z, "well", 2)
    c = {r["well"]: r["cluster"] for r in out.collect()}
    assert c["a"] == c["b"] != c["c"] == c["d"] and history == sorted(history, reverse=True)
    assert clustering.silhouette(out, "well").first()["silhouette"] > 0.5
    rank = {r["well"]: r["rank"] for r in clustering.ranked(out, centres, [1, 1]).collect()}
    assert rank["c"] == 1 and rank["a"] == 2
    s = {r["well"]: r["cluster"] for r in clustering.som(z, "well", 2, 10)[0].collect()}
    assert s["a"] == s["b"] != s["c"]


def test_names_and_similarity():
    assert wells.identity_similarity("AB-001", "Ab 001") == 1.0 and wells.identity_similarity("", "A") == 0.0
    assert wells.identity_similarity("GAS-7", "XY-7") == 0.78 and wells.identity_similarity("AB-7", "AB-7H") >= 0.9
    assert wells.well_match_score("GASFIELD-4", "GSFLD 4") == 0.96 and wells.well_match_score("GAXX-4", "GBYZW 4") == 0.88 and wells.well_match_score(None, "A") == 0.0


def test_alias_chains_with_a_circle(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "z")], "alias string, canonical string")
    got = {r["alias"]: r["canonical"] for r in wells.transitive(a).collect()}
    assert got["a"] == "c" and got["b"] == "c" and set(got) == {"a", "b", "x", "y"}


def test_histogram_of_equal_values(spark):
    s = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", -999.25), ("b", float("nan"))], "s string, v double")
    assert [(r["bin"], r["n"]) for r in curves.histogram(s, "s", "v").collect()] == [(0, 2)]


def test_plane_fit(spark):
    rows = [(i, c, 3.0 * i + 2.0 * c + 7, -1.0 * i + 0.5 * c) for i in range(4) for c in range(4)]
    f = surfaces.plane_fit(spark.createDataFrame(rows, "inline int, crossline int, x double, y double")).first()
    assert (round(f["x_inline"], 9), round(f["x_crossline"], 9), round(f["x_0"], 9)) == (3.0, 2.0, 7.0) and math.isclose(f["y_crossline"], 0.5)


def test_core_photos(spark):
    img = spark.createDataFrame([("/a/W1/x.jpg",), ("/a/W12box3.jpg",), ("/q/none.jpg",)], "path string")
    got = {r["path"]: r["well_key"] for r in catalog.core_photos(img, spark.createDataFrame([("W1",), ("W12",)], "well_key string")).collect()}
    assert got == {"/a/W1/x.jpg": "W1", "/a/W12box3.jpg": "W12", "/q/none.jpg": None}


def test_neighbours_cross_partitions(spark):
    rows = spark.createDataFrame([(i, f"n{i:03d}") for i in range(50)], "id long, name string")
    got = {tuple(r) for r in wells.next_in_order(rows, ["name"], 3).collect()}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, min(i + 4, 50))}


def test_curve_types_and_decisions(spark):
    said = [("LLD", None, "resistivity_deep"), ("ILM", None, "resistivity_medium"), ("MSFL", "", "resistivity_shallow"), ("RLL8", None, "laterolog"), ("gr_edit", None, "gamma_ray"), ("GRAPE", None, None), ("X1", "Natural gamma", "gamma_ray"), ("Y", "deep resistivity", "laterolog"), ("DENS2", None, "density"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "id int, mnemonic string, description string, want string")
    for r in df.select("*", curves.curve_rules(F.col("mnemonic"), F.col("description")).alias("got")).collect():
        assert (r["got"] and r["got"]["type"]) == r["want"], r
    types = spark.createDataFrame([("gamma_ray", "GR", "GR", 1), ("porosity", "P", None, 1)], "type_key string, name string, role string, created_at int")
    new = spark.createDataFrame([("Effective Porosity!", "porosity", 2), ("Porosity", "", 3), ("孔", None, 4)], "name string, role string, created_at int")
    assert [r["type_key"] for r in curves.created_types(types, new).orderBy("created_at", "type_key").collect()] == ["gamma_ray", "porosity", "porosity_2", "porosity_3", "custom"]
    had = spark.createDataFrame([("GR", "gamma_ray", "automatic", 1), ("RT", "porosity", "automatic", 1)], "mnemonic string, type_key string, status string, updated_at int")
    decided = spark.createDataFrame([("gr", "porosity", 2), ("gr", "gamma_ray", 3), ("RT", None, 2), ("SP", "no such type", 2)], "mnemonic string, type_key string, updated_at int")
    now = curves.assigned(had, decided, types)
    assert {tuple(r)[:3] for r in now.collect()} == {("GR", "gamma_ray", "confirmed"), ("RT", "unclassified", "confirmed")}
    rivals = spark.createDataFrame([("GR", "phi"), ("RT", "phi"), ("K", "perm")], "mnemonic string, type_key string")
    assert {r["mnemonic"] for r in curves.without_rivals(rivals, now).collect()} == {"RT", "K"}


def test_focus_prefers_long_complete_curves(spark):
    schema = "id long, well_id long, mnemonic string, description string, unit string, sample_count long, start double, stop double, step double, value_min double, value_max double"
    rows = [(1, 7, "GR", None, "API", 1001, 0.0, 100.0, 0.1, 0.0, 9.0), (2, 7, "GRC", None, "gapi", 500, 0.0, 50.0, 0.1, 0.0, 9.0), (3, 7, "SGR", None, None, None, 0.0, 100.0, None, None, None), (4, 7, "TWT", None, "ms", 9, 0.0, 1.0, 0.1, 0.0, 1.0), (5, 8, "CGR", None, "API", None, None, None, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in curves.focus(df).collect()} == {(7, "gamma_ray", 1, 100.0, 3), (8, "gamma_ray", 5, 24.7, 1)}
    decided = spark.createDataFrame([(7, "gamma_ray", 3, [1])], "well_id long, curve_type string, id long, excluded array<long>")
    assert {(r["well_id"], r["curve_id"], r["candidates"]) for r in curves.focus(df, decided).collect()} == {(7, 3, 2), (8, 5, 1)}

"""Ingest, inventories and searches on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wellspring.operators import clustering, curves, ingest, search


def test_imports_leave_an_audit_row(spark, tmp_path):
    t, log = str(tmp_path / "t"), str(tmp_path / "log")
    assert ingest.import_file(spark, "a", lambda: spark.range(3), t, log) == "ready"
    assert ingest.import_file(spark, "b", lambda: 1 / 0, t, log) == "failed"
    assert ingest.import_file(spark, "a", lambda: spark.range(2), t, log) == "ready"
    assert spark.read.parquet(t).count() == 2
    assert {(r["name"], r["status"]) for r in spark.read.parquet(log).collect()} == {("a", "ready"), ("b", "failed")}


def test_hulls_equal_those_of_all_points(spark):
    pts = [("s", float(i * 7 % 50), float(i * 13 % 47)) for i in range(300)] + [("t", 1.0, 1.0), ("t", 1.0, 1.0), (None, 1.0, 1.0), ("s", None, 1.0)]
    df = spark.createDataFrame(pts, "survey string, x double, y double")
    want = {("s", *q) for q in ingest.hull({q[1:] for q in pts if q[0] == "s" and q[1] is not None})} | {("t", 1.0, 1.0)}
    for n in (1, 6):
        assert {(r["survey"], r["x"], r["y"]) for r in ingest.convex_hulls(df.repartition(n)).collect()} == want


def test_tables_by_signature(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "A.parquet"))
    assert set(ingest.exported_tables(spark, str(tmp_path), ["A", "B"])) == {"A"}
    assert ingest.table_by_signature({"x": ["MD", "INC", "Q"], "y": ["md", "inc"]}, {"md", "inc"}) == "y"
    assert ingest.table_by_signature({}, {"md"}) is None
    assert ingest.table_category("q", ["MD", "INC"]) == "deviation" and ingest.table_category("tbl_prod", []) == "production"
    assert ingest.case_folded(spark.createDataFrame([(1, "a")], "`ID` long, Name string")).columns == ["id", "name"]


def test_filters_refuse_unknown_words(spark):
    df = spark.createDataFrame([(1, "GR", "gamma ray", 1)], "id long, mnemonic string, description string, well_id long")
    with pytest.raises(ValueError):
        ingest.curve_filter(curves.typed(df), how="maybe")
    assert ingest.curve_filter(curves.typed(df), ["gr"], ["gamma_ray"], "automatic", [1]).count() == 1


def test_fingerprints_and_text(spark):
    f = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", bytearray(b"xyz"))], "path string, content binary")
    assert ingest.fingerprint(f).select("sha1").distinct().count() == 1
    rings = ingest.rings_from_rows(spark.createDataFrame([("p", 2, 1.0, 1.0), ("p", 1, 0.0, 0.0), ("p", 3, None, 1.0)], "name string, row_no int, x double, y double"))
    assert [(r["seq"], r["x"]) for r in rings.orderBy("seq").collect()] == [(0, 0.0), (1, 1.0)]


def test_orders_aliases_and_cleaning(spark):
    q = spark.createDataFrame([(1, 1, 10.0), (1, 2, 5.0), (2, 1, 1.0), (2, 2, 2.0)], "q int, place int, md double")
    assert {r["q"]: r["changed"] for r in ingest.order_changed(q).collect()} == {1: True, 2: False}
    t = lambda s: dt.datetime(2020, 1, s, tzinfo=dt.timezone.utc)
    a = spark.createDataFrame([("x", "old", t(1))], "alias string, canonical string, saved_at timestamp")
    b = spark.createDataFrame([("x", "new", t(2))], "alias string, canonical string, saved_at timestamp")
    assert ingest.with_aliases(a, b).first()["canonical"] == "new"
    c = ingest.cleaned(spark.createDataFrame([("N/A", float("nan"), 1)], "s string, v double, i int")).first()
    assert c["s"] is None and c["v"] is None and c["i"] == 1


def test_scattered_surface_is_hit(spark):
    nodes = spark.createDataFrame([(float(i), float(j), 50.0) for i in range(5) for j in range(5)], "x double, y double, z double")
    path = spark.createDataFrame([("A", float(m), 2.0, 2.0, float(m)) for m in range(0, 101, 20)], "well string, md double, x double, y double, tvdss double")
    assert ingest.scattered_hits(path, nodes, 1.0).first()["md"] == pytest.approx(50)
    perf = spark.createDataFrame([("A", 55.0, 65.0)], "well string, p_top double, p_base double")
    assert sorted(r["md"] for r in ingest.map_layers(path, perf, 5).collect()) == [0.0, 60.0, 100.0]


def test_sections_and_searches(spark):
    tr = spark.createDataFrame([(i, c, k) for k, (i, c) in enumerate((i, c) for i in (1, 2) for c in range(10))], "inline int, crossline int, trace int")
    got = search.preview_section(tr, 3, 5).collect()
    assert {r["inline"] for r in got} == {2} and len(got) == 5
    q = spark.createDataFrame([(1, "AB-012")], "q long, text string")
    w = spark.createDataFrame([(1, "AB 12", "AB12", 1), (2, "XY 12", "XY12", 9), (3, "AB 012", "AB012", 1), (4, "AB-012", "AB012", 2)], "id long, name string, key string, sources int")
    got = search.best_wells(q, w).orderBy("place").collect()
    assert [r["id"] for r in got] == [4, 3, 1, 2] and got[0]["score"] == got[1]["score"] == 1.0
    s = search.number_suggestions(q.union(spark.createDataFrame([(2, "AB-012"), (3, "nothing"), (4, None)], q.schema)), w).collect()
    assert {(r["q"], r["id"]) for r in s} == {(1, 3), (2, 3)}
    t, why = ingest.training_set(spark.createDataFrame([(3, 1.0, None), (2, 1.0, 1.0)], "records int, a double, b double"), ["a", "b"], 2)
    assert t.count() == 1 and why


def test_evenly_spaced_ends(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = [r["k"] for r in clustering.evenly_spaced(df, ["k"], 5).orderBy("k").collect()]
    assert got == [0, 25, 50, 74, 99]

"""Sources and sinks: round trips on small files."""

import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.sources import binary_formats as bf
from wellspring.sources import headers, seismic, sinks
from wellspring.sources import text_formats as tf

LAS = "~Version\n VERS. 2.0 :\n WRAP. {wrap} :\n~Well\n STRT.M 100.0 :\n STOP.M 102.0 :\n STEP.M 1.0 :\n NULL. -999.25 :\n WELL. W-1 : WELL\n~Curve\n DEPT.M : depth\n GR.API : gamma ray\n RT.OHMM : deep\n~ASCII\n{data}\n"


def test_las(spark, tmp_path):
    (tmp_path / "a.las").write_text(LAS.format(wrap="NO", data="100 50 1\n101 -999.25 2\n102 70 3\n103 1"))
    (tmp_path / "b.las").write_text(LAS.format(wrap="YES", data="100\n50 1\n101\n60 2"), encoding="utf-8")
    (tmp_path / "c.las").write_bytes(b"\xff\xfe broken")
    heads = tf.las_headers(spark, str(tmp_path)).where("path like '%a.las'").collect()
    assert [(r["mnemonic"], r["unit"], r["start"], r["well"]) for r in heads] == [("DEPT", "M", 100.0, "W-1"), ("GR", "API", 100.0, "W-1"), ("RT", "OHMM", 100.0, "W-1")]
    s = tf.las_samples(spark, str(tmp_path))
    a = s.where("path like '%a.las' and mnemonic = 'GR'").orderBy("md").collect()
    assert [(r["md"], r["value"]) for r in a] == [(100.0, 50.0), (101.0, None), (102.0, 70.0)]
    assert s.where("path like '%b.las'").count() == 4
    st = tf.las_statistics(s).where("path like '%a.las' and mnemonic = 'RT'").first()
    assert (st["n"], st["low"], st["high"], st["p50"]) == (3, 1.0, 3.0, 2.0)


def test_las_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("W 1", 100.0, 5.0), ("W 1", 101.0, None), ("W 1", 102.0, 7.5)], "well string, md double, value double")
    files = sinks.las_files(df, "GR")
    manifest = sinks.write_texts(files, "well", str(tmp_path / "out"), ".las").collect()
    assert len(manifest) == 1 and manifest[0]["bytes"] > 100
    back = tf.las_samples(spark, str(tmp_path / "out")).orderBy("md").collect()
    assert [(r["md"], r["value"]) for r in back] == [(100.0, 5.0), (101.0, None), (102.0, 7.5)]


def test_resampled_curve(spark):
    df = spark.createDataFrame([("A", 0.0, 0.0), ("A", 1.0, 10.0), ("A", 20.0, 20.0)], "well string, md double, value double")
    out = {r["md"]: r["value"] for r in sinks.resampled_curve(df, 0.5, 1.0).collect()}
    assert out[0.5] == 5.0 and out[1.0] == 10.0 and out[10.0] is None and out[20.0] == 20.0 and len(out) == 41


def test_dev_tops_and_points(spark, tmp_path):
    (tmp_path / "w.dev").write_text("# head\nMD X Y Z TVD\n0 1 2 3 0\n10 1 2 -7 10 5\nbad line here x y\n")
    assert [tuple(r)[1:] for r in tf.dev_stations(spark, str(tmp_path)).orderBy("md").collect()] == [(0.0, 1.0, 2.0, 3.0, 0.0), (10.0, 1.0, 2.0, -7.0, 10.0)]
    (tmp_path / "t.tops").write_text('BEGIN HEADER\nX\nY\nMD\nSurface\nWell\nEND HEADER\n1 2 30 "Top Sand" "W 1"\n')
    r = tf.well_tops(spark, str(tmp_path)).first()
    assert (r["well"], r["surface"], r["md"]) == ("W 1", "Top Sand", 30.0)
    (tmp_path / "p.xyz").write_text("1 2 3\n10 20 4 5 6\nx y z\n")
    assert sorted(tuple(r)[1:] for r in tf.xyz_points(spark, str(tmp_path)).collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_grids(spark, tmp_path):
    (tmp_path / "a.grd").write_text("FSASCI 0 1\nFSLIMI 0 10 0 20 1 4\nFSNROW 2 2\nFSXINC 10 20\n->\n1 2\n1e30 4\n")
    (tmp_path / "b.zmap").write_text("! c\n@g, GRID, 5\n15, -99, , 7, 1\n2, 2, 0, 10, 0, 20\n0,0,0\n@\n1 3\n2 -99\n")
    n = {(r["path"][-6:], r["row"], r["col"]): r["value"] for r in tf.grid_nodes(spark, str(tmp_path)).collect()}
    assert [n[("/a.grd", i, j)] for i in (0, 1) for j in (0, 1)] == [None, 4.0, 1.0, 2.0]
    assert [n[("b.zmap", i, j)] for i in (0, 1) for j in (0, 1)] == [3.0, None, 1.0, 2.0]


def test_perforations(spark):
    rows = [("s", 1, "WELL", "A", None, None, None, None), ("s", 2, None, None, "perf", "2001-02-03", 10.0, 12.0), ("s", 3, "WELL", "B", None, None, None, None), ("s", 4, None, None, "perf", "03.04.2002", 5.0, 5.0), ("s", 5, None, None, None, None, 5.0, 6.0)]
    out = tf.perforations(spark.createDataFrame(rows, "sheet string, row_no int, marker string, name string, kind string, date string, top double, base double")).orderBy("row_no").collect()
    assert [(r["well"], str(r["day"]), r["thickness"], r["not_positive"]) for r in out] == [("A", "2001-02-03", 2.0, False), ("B", "2002-04-03", 0.0, True)]


def _segy(text, traces, code=5, extended=0, encoding="cp500", cut=0):
    """A file of traces (fields by place, samples)."""
    binary = bytearray(400)
    for at, v in ((16, 2000), (20, len(traces[0][1])), (24, code)):
        struct.pack_into(">H", binary, at, v)
    struct.pack_into(">h", binary, 304, extended)
    out = text.ljust(3200).encode(encoding) + bytes(binary) + b" " * 3200 * max(extended, 0)
    for fields, samples in traces:
        h = bytearray(240)
        for (at, kind), v in fields.items():
            struct.pack_into(">" + kind, h, at - 1, v)
        struct.pack_into(">H", h, 114, len(samples))
        out += bytes(h) + np.array(samples, ">f4").tobytes()
    return out[: len(out) - cut]


def test_segy_of_the_standard_layout(spark, tmp_path):
    places = [(1, 10, 100, 200), (1, 11, 110, 200), (2, 10, 100, 210), (2, 11, 110, 210)]
    traces = [({(71, "h"): -10, (189, "i"): i, (193, "i"): c, (181, "i"): x * 10, (185, "i"): y * 10, (109, "h"): 4}, [i, c, 0.5, -1]) for i, c, x, y in places]
    (tmp_path / "a.sgy").write_bytes(_segy("C01 plain", traces, extended=1, encoding="ascii"))
    out = seismic.segy_traces(spark, str(tmp_path), True, each=3).orderBy("trace").collect()
    assert [(r["trace"], r["inline"], r["crossline"], r["x"], r["y"]) for r in out] == [(k, i, c, float(x), float(y)) for k, (i, c, x, y) in enumerate(places)]
    assert out[1]["v"] == [1.0, 11.0, 0.5, -1.0] and out[0]["layout"] == "segy_rev1"
    f = seismic.segy_files(spark, str(tmp_path)).first()
    assert (f["traces"], f["exact"], f["step_us"], f["code"]) == (4, True, 2000, 5)
    s = seismic.segy_scan(spark, str(tmp_path)).first()
    assert (s["dimension"], s["trace_count"], s["x_min"], s["x_max"], s["inline_max"], s["warnings"]) == ("3D", 4, 100.0, 110.0, 2, "")
    assert s["footprint_area"] == pytest.approx(100) and (s["delay_ms_min"], s["end_ms_max"]) == (4, 10.0)
    assert (s["inline_spacing"], s["crossline_spacing"]) == (10.0, 10.0)


def test_segy_with_line_numbers_before_coordinates(spark, tmp_path):
    lines = [(i, c) for i in (310, 311) for c in (4100, 4102)]
    traces = [({(71, "h"): -100, (181, "i"): i, (185, "i"): c, (189, "i"): (700_000 + c * 20) * 100, (193, "i"): (3_100_000 + i * 25) * 100}, [1.0]) for i, c in lines]
    (tmp_path / "b.segy").write_bytes(_segy("C01 SURVEY: NEAR 3D".ljust(80) + "C02 RANGE OF INLINE: 310-311 RANGE OF XLINE: 4100-4102", traces))
    s = seismic.segy_scan(spark, str(tmp_path)).first()
    assert (s["layout"], s["dimension"], s["inline_min"], s["crossline_max"]) == ("petrel_pep_swapped", "3D", 310, 4102)
    assert (s["inline_spacing"], s["crossline_spacing"]) == (25.0, 20.0) and s["text_preview"].startswith("C01 SURVEY: NEAR 3D")


def test_segy_line_without_line_numbers(spark, tmp_path):
    traces = [({(73, "i"): 610_000 + k * 30, (77, "i"): 2_000_000, (189, "i"): 610_000 + k * 30, (193, "i"): 2_000_000}, [1.0, 2.0]) for k in range(5)]
    (tmp_path / "c.sgy").write_bytes(_segy("C01 LINEA 2D: EAST", traces))
    (tmp_path / "d.sgy").write_bytes(_segy("C01 LINEA 2D: EAST", [*traces, ({}, [1.0])], cut=2))  # other lengths, cut off
    (tmp_path / "e.sgy").write_bytes(b"x")
    s = {r["path"][-5]: r for r in seismic.segy_scan(spark, str(tmp_path)).collect()}
    assert (s["c"]["layout"], s["c"]["dimension"], s["c"]["inline_min"], s["c"]["x_max"], s["c"]["inline_spacing"]) == ("source_xy_2d", "2D", None, 610_120.0, None)
    assert s["d"]["trace_count"] == 6 and "cut off" in s["d"]["warnings"] and s["e"]["trace_count"] is None and "shorter" in s["e"]["warnings"]


def test_sample_formats():
    assert seismic.decode_samples(bytes.fromhex("42640000c276a00041100000"), 1).tolist() == [100.0, -118.625, 1.0]
    assert seismic.decode_samples(bytes.fromhex("ffffff00000100007f"), 7).tolist() == [-1.0, 1.0, 127.0]
    assert seismic.decode_samples(bytes.fromhex("ffffff000001"), 15).tolist() == [2.0**24 - 1, 1.0]
    assert seismic.decode_samples(np.array([1, -2], ">i8").tobytes(), 9).tolist() == [1.0, -2.0]


def test_polygons(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}))
    out = bf.geojson_rings(spark, str(tmp_path)).groupBy("polygon").count().collect()
    assert sorted(tuple(r) for r in out) == [("1#0", 3), ("1#1", 3), ("A", 3)]
    pts = np.array(ring, "<f8")
    rec = struct.pack("<i4d2ii", 5, 0, 0, 4, 4, 1, 4, 0) + pts.tobytes()
    (tmp_path / "b.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(rec) // 2) + rec)
    shp = bf.shapefile_rings(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["x"], r["y"]) for r in shp] == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]


def test_workbook_and_delimited(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Well</t></is></c><c r="B1" t="inlineStr"><is><t></t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>W1</t></is></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert sorted((r["name"], r["text"]) for r in bf.workbook_cells(spark, str(tmp_path)).collect()) == [("COLUMN_2", "7"), ("Well", "W1")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text("Well Name;X;Y\nA;1;2\n")
    df = headers.read_delimited(spark, str(tmp_path / "d"))
    assert df.columns == ["Well Name", "X", "Y"] and headers.field_map(df.columns) == {"well": "Well Name", "x": "X", "y": "Y"}
    assert [tuple(r) for r in df.collect()] == [("A", "1", "2")]


@pytest.mark.parametrize("encoding, sep", [("utf-8-sig", "\t"), ("utf-8", ","), ("gb18030", ";"), ("latin-1", ",")])
def test_encodings_and_separators(spark, tmp_path, encoding, sep):
    first, name = ("Señ", "Peñ") if encoding == "latin-1" else ("井号", "塔里木")
    (tmp_path / "t.txt").write_bytes(f"{first}{sep}OILPRODRATE{sep}\n{name}{sep}3.5{sep}x\n".encode(encoding))
    df = headers.read_delimited(spark, str(tmp_path / "t.txt"))
    assert df.columns == [first, "OILPRODRATE", "COLUMN_3"] and [tuple(r) for r in df.collect()] == [(name, "3.5", "x")]


def test_types_by_headers_and_names():
    assert headers.field_map(["井号", "生产日期", "日产油", "含水", "OILPRODRATE"]) == {"well": "井号", "production_month": "生产日期", "oil_rate": "OILPRODRATE", "water_cut": "含水"}
    told = lambda p, h=None: headers.detect_type(p, h)
    assert told("a/b.csv", ["WELL_NAME", "X", "Y"]) == "well_head" and told("q.LAS") == "las" and told("x.mdb") == "production" and told("L.SEGY") == "seismic" and told("p.geojson") == "polygon"
    assert told("my_prod.txt", ["well", "qo"]) == "production" and told("perforation.csv", ["WELL", "TOP", "BASE"]) == "production" and told("t.csv", ["WELL", "TOP", "BASE"]) == "interpretation"
    assert told("n.csv", ["ALIAS", "CANONICAL"]) == "alias" and told("d.csv", ["Well", "MD", "Incl", "Azimuth"]) == "deviation" and told("c.csv", ["Well", "PERM"]) == "interpretation"
    assert told("z.csv", ["X", "Y", "Name"]) == "polygon" and told("井斜.txt") == "deviation" and told("岩心.txt") == "core" and told("解释.txt") == "interpretation" and told("readme") == "well_head"


def test_predicted_types(spark):
    want = {"a/W1.las": ("las", True), "checkshots/W1.las": ("time_depth", True), "x.accdb": ("ofm_mdb", True), "l.sgy": ("seismic", True), "b.shp": ("polygon", False), "b.json": ("polygon", True), "w.dev": ("deviation", False), "horizons/top.txt": ("horizon", False), "断层.txt": ("fault", False),
            "c.tif": ("image", False), "b.dbf": ("sidecar", False), "well head.csv": ("well_head", True), "wellpath/a.txt": ("deviation", True), "孔渗.xlsx": ("interpretation", True), "core.csv": ("core", True), "alias.csv": ("alias", True), "区块.csv": ("polygon", True), "q.tsv": ("table", True), "readme.md": ("other", False)}
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", headers.predicted_type(F.col("path")).alias("t"))
    assert {r["path"]: tuple(r["t"]) for r in df.collect()} == want


def test_log_headers_without_data(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(LAS.format(wrap="NO", data="100 1 2\n101 3 4").encode() + b"9 9 9\n" * 40_000)
    got = tf.las_headers(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["well"], r["mnemonic"], r["unit"], r["start"]) for r in got] == [("W-1", "DEPT", "M", 100.0), ("W-1", "GR", "API", 100.0), ("W-1", "RT", "OHMM", 100.0)]
    lines = tf.las_header_lines(spark, str(tmp_path)).orderBy("place").collect()
    assert lines[0]["line"] == "~Version" and lines[-1]["section"] == "C" and lines[-1]["line"] == " RT.OHMM : deep"
    s = spark.createDataFrame([("a", "GR", float(i), float(i) if i % 2 else None) for i in range(100)], "path string, mnemonic string, md double, value double")
    one, two = (sorted(map(tuple, tf.curve_reservoir(s.repartition(n), 10).collect())) for n in (1, 4))
    assert one == two and len(one) == 10


def test_trajectory_summary(spark):
    rows = [("a.dev", v) for v in ("# WELL TRACE FROM PROJECT", "# WELL NAME: AB-1", "# WELL HEAD X-COORDINATE: 500.5", "# WELL HEAD Y-COORDINATE: 2000", "# WELL KB: 12.5", "MD X Y Z TVD", "0 500 2000 12 0", "10.5 500 2000 2 10")] + [("b.dev", "no stations")]
    got = {r["path"]: r for r in tf.dev_summary(spark, spark.createDataFrame(rows, "path string, value string")).collect()}
    assert (got["a.dev"]["x"], got["a.dev"]["y"], got["a.dev"]["datum"], got["a.dev"]["stations"], got["a.dev"]["base_md"]) == (500.5, 2000.0, 12.5, 2, 10.5) and got["b.dev"]["stations"] == 0


def test_versioned_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.append_version(spark.createDataFrame([("a", 1)], "k string, v int"), p)
    sinks.append_version(spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), p)
    assert sorted((r["k"], r["v"]) for r in sinks.read_latest(spark, p, ["k"]).collect()) == [("a", 2), ("b", 3)]
    q = str(tmp_path / "r")
    for run, n in (("one", 3), ("two", 2), ("one", 1)):
        sinks.write_versioned(spark.range(n), q, run)
    assert spark.read.parquet(q).groupBy("run_id").count().orderBy("run_id").collect()[0]["count"] == 1 and spark.read.parquet(q).count() == 3


def test_streams(spark, tmp_path):
    from wellspring.streaming.ingest import arriving, ingest, windowed_counts

    src = spark.sql("select timestamp'2001-01-01 00:10:00' + make_interval(0,0,0,0,id) as ts, concat('t', id % 2) as event_type, double(id) as value from range(8)")
    src.write.parquet(str(tmp_path / "in"))
    s = arriving(spark, str(tmp_path / "in"), src.schema)
    q = ingest(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    got = windowed_counts(src).collect()
    assert sum(r["n"] for r in got) == 8 and pytest.approx(sum(r["total"] for r in got)) == 28.0

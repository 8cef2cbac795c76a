"""Queries of single operators that the other plans only use inside, and their SQL.

File formats are tried on texts made from whole tables: every table is written in the
format by column functions and parsed again, so the SQL is that of the table itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions import scalars
from wellspring.functions.text import clean_text, finite, finite_number, well_key
from wellspring.operators import catalog, curves, ingest, production, search, surfaces, trajectory, wells
from wellspring.plans.geometry_queries import _BASE, _PTS, _RINGS, _XYZ, COLS, GRID, _points, _rings, _rows, _several, _xyz
from wellspring.plans.relations import CM, CURVE_TYPE, FILES, IV, PM, SAMPLES, SC, SPANNED, ST, cm, files, heads, intervals, nodes, pm, rounded, rounding_alike, samples, spanned_curves, stations
from wellspring.plans.relations import curves as las
from wellspring.sources import binary_formats, headers, sinks, text_formats
from wellspring.tables import table


@F.pandas_udf(T.StringType())
def _detected(paths: pd.Series) -> pd.Series:
    return paths.map(headers.detect_type)


def _number(c):
    """A number as log files write it: unknown ones as the null value."""
    return F.coalesce(finite(F.col(c)).cast("string"), F.lit("-999.25"))


def _texts(lines, by, head, order):
    """(path, content): head and ordered lines (line) of each group, one file a group."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(by.alias("path")).agg(F.encode(F.concat(head, body, F.lit("\n")), "UTF-8").alias("content"))


def _log_files(s, d):
    """interpretation_v1 as log files of 200 rows each."""
    i = table(s, d, "interpretation_v1").where("top_md is not null and not isnan(top_md)")
    line = F.concat_ws(" ", F.col("top_md").cast("string"), *[_number(c) for c in ("phi", "perm", "sw")])
    head = F.lit("~Version\nVERS. 2.0 :\nWRAP. NO :\n~Well\nSTRT.M 0 :\nNULL. -999.25 :\nWELL. W-1 :\n~Curve\nDEPT.M : depth\nPHI.V/V : porosity\nPERM.MD : permeability\nSW.V/V : saturation\n~ASCII\n")
    return _texts(i.withColumn("line", line), F.concat(F.lit("/logs/"), F.floor(F.col("row_no") / 200), F.lit(".las")), head, ["top_md", "row_no"])


def _log_samples(s, d):
    return text_formats.las_samples(s, _log_files(s, d))


def _header_files(s, d, names, values, source, key):
    """A table as text with a list of columns before quoted rows."""
    head = F.lit("BEGIN HEADER\n" + "\n".join(names) + "\nEND HEADER\n")
    line = F.concat_ws(" ", *[F.concat(F.lit('"'), F.coalesce(v, F.lit("-")), F.lit('"')) for v in values])
    return _texts(source.withColumn("line", line), F.concat(F.lit("/t/"), F.col(key) % 16), head, [key])


def _tops(s, d):
    i = table(s, d, "interpretation_v1").where("well is not null and not contains(well, '\"') and facies is not null and top_md is not null and not isnan(top_md)")
    f = _header_files(s, d, ["X", "MD", "Surface", "Well"], [F.lit("1.5"), F.col("top_md").cast("string"), F.col("facies"), F.regexp_replace("well", r"[\\\\']", "")], i, "row_no")
    return text_formats.well_tops(s, f)


def _heads_text(s, d):
    w = table(s, d, "wells").where("x is not null and not isnan(x) and y is not null and not isnan(y)")
    names = ["Name", "UWI", "Surface X", "Surface Y", "Well datum value", "TD (MD)"]
    text = lambda c: finite(F.col(c)).cast("string")
    f = _header_files(s, d, names, [F.col("canonical_name"), F.col("uwi"), text("x"), text("y"), text("kb_elevation"), text("total_depth")], w, "id")
    return text_formats.well_heads(s, f).drop("path")


def _shots(s, d):
    e = stations(s, d)
    return text_formats.checkshots(s, _header_files(s, d, ["Well", "MD", "TWT"], [F.col("well"), F.col("md").cast("string"), (F.col("md") / 2).cast("string")], e, "id"))


def _grid_text(s, d):
    """The node grid in the exchange format by columns, north first."""
    n = nodes(s, d)
    rows = _rows(n)
    every = s.range(rows * COLS).select(F.floor(F.col("id") / COLS).cast("int").alias("row"), (F.col("id") % COLS).cast("int").alias("col")).join(n, ["row", "col"], "left")
    head = F.lit(f"! grid\n@grid, GRID, 5\n15, -99999, , 7, 1\n{rows}, {COLS}, 0, {(COLS - 1) * 10}, 0, {(rows - 1) * 10}\n0, 0, 0\n@\n")
    lines = every.select(F.lit(1).alias("k"), "col", (-F.col("row")).alias("up"), F.coalesce(F.col("value").cast("string"), F.lit("-99999")).alias("line"))
    return text_formats.grid_nodes(s, _texts(lines, F.lit("/g/a.zmap"), head, ["col", "up"])).drop("path")


def _lines(df, path, *columns):
    return df.select(path.alias("path"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))


def _geojson(s, d):
    """A square for every well with a place."""
    w = table(s, d, "wells").where("x is not null and not isnan(x) and y is not null and not isnan(y)")
    x, y = F.col("x"), F.col("y")
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])
    doc = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("normalized_key").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return binary_formats.geojson_rings(s, w.select(F.concat(F.lit("/p/"), "id").alias("path"), F.encode(F.to_json(doc), "UTF-8").alias("content")))


def _head_rings(s, d):
    h = table(s, d, "well_head").select(F.coalesce("field", F.lit("?")).alias("name"), "row_no", finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y"))
    return ingest.rings_from_rows(h)


def _sheet(s, d):
    """A sheet per facies: a header row for every hundredth row, details below."""
    i = table(s, d, "interpretation_v1").select(F.coalesce("facies", F.lit("none")).alias("sheet"), "row_no", finite(F.col("top_md")).alias("top"), finite(F.col("base_md")).alias("base"))
    head = F.col("row_no") % 100 == 0
    return i.select("sheet", "row_no", F.when(head, "WELL").alias("marker"), F.when(head, F.concat(F.lit("H"), F.col("row_no"))).alias("name"), F.when(F.col("row_no") % 3 != 0, "perforation").alias("kind"), F.when(F.col("row_no") % 2 == 0, "2019/03/05").otherwise("20200106").alias("date"), "top", "base")


def _curve_intervals(s, d):
    return spanned_curves(s, d).where("well_id is not null").select(F.col("well_id").cast("string").alias("well"), "id", F.col("start").alias("top"), F.col("stop").alias("base"))


def _layer_intervals(s, d):
    return table(s, d, "wells").select(F.col("id").cast("string").alias("well"), "id", F.lit(1200.0).alias("top"), F.lit(1300.0).alias("base"))


def _picks(s, d):
    i = table(s, d, "interpretation_v1")
    return i.where("facies is not null and top_md is not null and not isnan(top_md)").groupBy(F.upper("well").alias("well"), F.upper("facies").alias("layer")).agg(F.min("top_md").alias("md"))


def _traces(s, d):
    return table(s, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("inline"), (F.col("p_partkey") % 40).cast("int").alias("crossline"), F.col("p_partkey").alias("trace"))


def _side(s, d, key):
    return las(s, d).where((F.upper("mnemonic") == key) & F.col("well_id").isNotNull()).select("well_id", finite(F.col("value_min")).alias("low"), finite(F.col("value_max")).alias("high"))


def _corrected(s, d):
    """Months with the corrected volume where a run has one."""
    o = cm(s, d).select("well_key", "month", "monthly_oil")
    return ingest.corrected_or_original(o, o.withColumn("monthly_oil", F.coalesce("monthly_oil", F.lit(0.0))))


def _members(s, d):
    c = las(s, d).where("well_id is not null").select(F.col("well_id").alias("well_key"), F.upper("mnemonic").alias("m"))
    return {n: c.where(F.col("m") == n.upper()) for n in ("gr", "rt", "dts")}


def _first(s, d, *columns):
    return production.first_and_last(pm(s, d)).select("well_key", *columns)


QUERIES = {
    # sources
    "src03_types": lambda s, d: files(s, d).select("path", _detected("path").alias("type")),
    "src04_fields": lambda s, d: las(s, d).select("id", headers.field_of(F.col("mnemonic")).alias("field")),
    "src05_log_headers": lambda s, d: text_formats.las_headers(s, _log_files(s, d)).select("path", "well", "place", "mnemonic", "unit"),
    "src06_log_statistics": lambda s, d: rounded(text_formats.las_statistics(_log_samples(s, d)).select("path", "mnemonic", "n", "low", "high", "mean", "p50"), 5),
    "src08_header_lines": lambda s, d: text_formats.las_header_lines(s, _log_files(s, d)).groupBy("path", "section").agg(F.count("*").alias("lines"), F.max("line").alias("last")),
    "src09_well_heads": _heads_text,
    "src10_stations": lambda s, d: text_formats.dev_stations(s, _lines(stations(s, d).withColumn("z", F.lit(1.5)), F.col("well"), "md", "inc", "azi", "z", "md")),
    "src12_tops": lambda s, d: _tops(s, d).select("well", "surface", "md", "x"),
    "src13_top_names": lambda s, d: _tops(s, d).groupBy("surface").agg(F.count("*").alias("picks")),
    "src14_checkshots": lambda s, d: _shots(s, d).groupBy("well").agg(F.count("*").alias("points"), F.min("md").alias("top_md"), F.max("md").alias("base_md"), F.max("time").alias("last_time")),
    "src16_grid": _grid_text,
    "src18_points": lambda s, d: text_formats.xyz_points(s, _lines(_points(s, d).withColumns({"i": F.col("id") % 7, "z": F.lit(-2.5)}), F.lit("/x.xyz"), "i", "id", "x", "y", "z")).groupBy("x", "y", "z").agg(F.count("*").alias("n")),
    "src23_polygons": lambda s, d: surfaces.polygon_areas(_geojson(s, d)).select("polygon", F.round("area", 3).alias("area")),
    "src24_rings": _head_rings,
    "src33_page": lambda s, d: catalog.page(table(s, d, "production_corrected").select("id", "wellkey"), [F.col("wellkey"), F.col("id")], 3, 50),
    "src36_perforations": lambda s, d: text_formats.perforations(_sheet(s, d)).select("sheet", "row_no", "well", "day", F.round("thickness", 4).alias("thickness"), "not_positive"),
    "win14_filled_headers": lambda s, d: text_formats.perforations(_sheet(s, d)).groupBy("sheet", "well").agg(F.count("*").alias("details")),
    "hlp22_perforation_page": lambda s, d: catalog.page(text_formats.perforations(_sheet(s, d)).select("sheet", "row_no", "well"), [F.col("sheet"), F.col("row_no")], 1, 500),
    "ing06_log_curves": lambda s, d: ingest.las_import(text_formats.las_headers(s, _log_files(s, d))).groupBy("mnemonic").agg(F.count("*").alias("files")),
    "ing13_rings": lambda s, d: rounded(surfaces.polygon_areas(_rings(s, d)).select("polygon", "area", "min_x", "max_y"), 3),
    "ing20_not_catalogued": lambda s, d: catalog.anti_catalog(table(s, d, "sources"), files(s, d).where("ext <> 'csv'")).select("id"),
    # filters
    "flt03_any_polygon": lambda s, d: surfaces.points_in_polygons(_points(s, d), _rings(s, d), 64.0).select("id").distinct(),
    "flt06_no_filter": lambda s, d: ingest.curve_filter(curves.typed(las(s, d))).groupBy("how").agg(F.count("*").alias("n")),
    "flt10_time_depth_files": lambda s, d: ingest.time_depth_inventory(las(s, d).withColumn("mnemonic", F.when(F.col("id") % 5 == 0, F.concat(F.lit("TWT"), F.col("id") % 3)).otherwise(F.col("mnemonic"))), table(s, d, "sources")),
    "flt11_any_condition": lambda s, d: curves.with_conditions(table(s, d, "wells").select(F.col("id").alias("well_key")), _members(s, d), [("gr", True), ("rt", True), ("dts", False)], False),
    "flt15_compact_search": lambda s, d: catalog.tiers(table(s, d, "wells").select("id", F.col("canonical_name").alias("name")), "1-0"),
    "flt16_ready_sources": lambda s, d: table(s, d, "sources").where("status = 'ready'").select("id"),
    "flt17_corrected": _corrected,
    # joins
    "join09_layer_lookup": lambda s, d: table(s, d, "horizon_name_aliases").select("alias_id", scalars.layer_key(F.col("alias_name")).alias("layer")).join(table(s, d, "horizon_name_groups").select(F.col("canonical_key").alias("layer"), "canonical_name"), "layer", "left").select("alias_id", F.coalesce("canonical_name", "layer").alias("name")),
    "join12_covering_curves": lambda s, d: curves.overlaps(_layer_intervals(s, d), _curve_intervals(s, d), "well", 200.0).groupBy("well").agg(F.count("*").alias("curves"), F.count_if("covered").alias("covering")),
    "join13_containing": lambda s, d: curves.within(_picks(s, d).select("well", "layer", "md"), intervals(s, d).select("well", "id", "top", "base"), "well", 50.0).groupBy("well", "layer").agg(F.count("*").alias("n")),
    "join15_in_polygon": lambda s, d: surfaces.points_in_polygons(_points(s, d), _rings(s, d), 64.0).groupBy("polygon").agg(F.count("*").alias("points")),
    "join19_nearest_trace": lambda s, d: rounded(search.nearest_trace(_points(s, d), nodes(s, d).select((F.col("col") * 10.0).alias("x"), (F.col("row") * 10.0).alias("y")), 4.0), 4),
    # aggregations
    "agg10_histogram": lambda s, d: curves.histogram(samples(s, d), "series", "value", 12).select("series", "bin", "n"),
    "agg20_folders": lambda s, d: catalog.folders(files(s, d), 3),
    "agg22_inventory": lambda s, d: catalog.live_overlay(s.createDataFrame([(k,) for k, _ in (*search.MODEL_ITEMS, ("other", ""))], "kind string"), files(s, d).select(search.model_item(F.col("path")).alias("kind"))),
    # windows and orders
    "win02_pressures": lambda s, d: _first(s, d, "first_pressure", "last_pressure", "min_pressure", "max_pressure"),
    "win03_last_status": lambda s, d: _first(s, d, "last_status"),
    "win04_last_cumulative": lambda s, d: _first(s, d, "last_cum_oil"),
    "win05_latest_rate": lambda s, d: _first(s, d, "latest_month", "latest_oil_rate"),
    "win09_month_index": lambda s, d: production.running(cm(s, d)).select("well_key", "month", "month_index"),
    "win15_changes": lambda s, d: production.status_changes(pm(s, d)).groupBy("status").agg(F.count("*").alias("changes"), F.countDistinct("well_key").alias("wells")),
    "win19_thickness": lambda s, d: rounded(trajectory.layer_segments(_picks(s, d).withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "z": -F.col("md")})).select("well", "layer", "next_layer", "vertical"), 4),
    "win23_order": lambda s, d: ingest.order_changed(_picks(s, d).select(F.col("well").alias("q"), F.hash("layer").alias("place"), "md").dropDuplicates(["q", "md"]).dropDuplicates(["q", "place"])).groupBy("changed").agg(F.count("*").alias("n")).agg(F.sum("n").alias("wells")),
    "srt02_mixed_order": lambda s, d: table(s, d, "horizon_name_aliases").orderBy("project_root", F.desc("created_at"), "alias_id").select("alias_id", "project_root"),
    "srt09_first_of_most": lambda s, d: curves.modal(las(s, d), "well_id", "unit", "id"),
    "set02_distinct_union": lambda s, d: pm(s, d).select("well_key").union(table(s, d, "wells").select("normalized_key")).distinct().agg(F.count("*").alias("wells")),
    "set05_intersections": lambda s, d: catalog.coverage({"head": table(s, d, "well_head").select(well_key(F.col("well_name")).alias("k")).where("k is not null"), "las": las(s, d).join(table(s, d, "wells").select(F.col("id").alias("well_id"), F.col("normalized_key").alias("k")), "well_id").select("k"), "prod": pm(s, d).select(F.col("well_key").alias("k"))}, "k"),
    "set10_precedence": lambda s, d: wells.merged(table(s, d, "wells").select(F.col("normalized_key").alias("key"), F.lit(1).alias("rank")), pm(s, d).select(F.col("well_key").alias("key"), F.lit(2).alias("rank")).distinct(), "key"),
    # scalars
    "sc02_clean_text": lambda s, d: table(s, d, "sources").select("id", clean_text(F.col("data_type")).alias("data_type"), clean_text(F.col("warning")).alias("warning")),
    "sc03_numbers": lambda s, d: table(s, d, "well_sources").select("id", finite_number(F.concat(F.lit(" 1,0"), F.col("total_depth").cast("string"))).alias("v"), finite_number(F.col("raw_name")).alias("none")),
    "sc12_water_cut": lambda s, d: rounded(pm(s, d).select("id", scalars.water_cut_percent(F.col("water_cut") / F.when(F.col("id") % 2 == 0, 100).otherwise(1)).alias("pct"))),
    "sc14_days": lambda s, d: pm(s, d).select("id", scalars.days_in_month(F.when(F.col("id") % 9 == 0, F.lit("unknown")).otherwise(F.col("month"))).cast("int").alias("days")),
    "sc15_changed": lambda s, d: pm(s, d).select("id", scalars.changed(F.col("oil_rate"), F.col("oil_rate") + F.when(F.col("id") % 4 == 0, 1.0).when(F.col("id") % 4 == 1, 0.0)).alias("changed")),
    "sc16_depth_units": lambda s, d: las(s, d).select("id", scalars.depth_factor(F.when(F.col("id") % 3 == 0, " ft ").when(F.col("id") % 3 == 1, "Metres").otherwise(F.col("unit"))).alias("f")),
    "sc18_kinds": lambda s, d: files(s, d).select("path", "kind"),
    "sc20_predicted": lambda s, d: files(s, d).select("path", headers.predicted_type(F.col("path")).alias("t")).select("path", "t.type", "t.importable"),
    "sc23_lines": lambda s, d: table(s, d, "sources").select("id", scalars.line_name(F.concat("filename", F.lit("_mig_V2"))).alias("line")),
    "sc28_range_similarity": lambda s, d: rounded(las(s, d).select("id", scalars.similarity_of_ranges(finite(F.col("value_min")), finite(F.col("value_max")), F.lit(0.0), F.lit(100.0)).alias("similarity"))),
    "sc31_equivalent": lambda s, d: rounded(pm(s, d).select("id", scalars.barrels_of_oil_equivalent(F.col("oil_rate"), F.col("gas_rate")).alias("boe"))),
    "sc35_log_numbers": lambda s, d: las(s, d).select("id", F.format_string("%.4f", F.col("sample_count") / 8.0).alias("text")),
    "geo03_holes": lambda s, d: surfaces.polygon_areas(_rings(s, d)).where("polygon = 'square'").select(F.round("area", 3).alias("area")),
    # models
    "mdl03_angles": lambda s, d: trajectory.rebuilt_angles(_xyz(s, d)).where("inc is not null").groupBy("well").agg(F.round(F.max("inc"), 3).alias("steepest"), F.count("*").alias("n")),
    "mdl08_scattered_hits": lambda s, d: rounded(ingest.scattered_hits(stations(s, d).select("well", "md", (F.col("id") * 0.0 + 55.0).alias("x"), F.lit(45.0).alias("y"), F.col("md").alias("tvdss")), nodes(s, d).select((F.col("col") * 10.0).alias("x"), (F.col("row") * 10.0).alias("y"), F.lit(75.0).alias("z")), 10.0), 4),
    "mdl31_sampled_statuses": lambda s, d: surfaces.sampled(_points(s, d), nodes(s, d), *GRID, _rows(nodes(s, d)), COLS).groupBy("status").agg(F.count("*").alias("n")),
    "mdl33_section": lambda s, d: search.preview_section(_traces(s, d), 3, 10),
    "mdl34_resampled": lambda s, d: sinks.resampled_curve(stations(s, d).select("well", "md", (F.col("md") * 2).alias("value")), 15.0, 30.0).groupBy("well").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("last")),
    "mdl35_compared_curves": lambda s, d: rounded(curves.compare(_side(s, d, "GR"), _side(s, d, "RT"))),
    "mdl39_strong": lambda s, d: search.strong_trajectories(stations(s, d).select(F.col("well").alias("a"), (F.col("id") % 5).alias("b")).distinct(), stations(s, d).groupBy(F.col("well").alias("a"), (F.col("id") % 5).alias("b")).agg((F.max("inc") - 49).alias("max_distance"))).select("a", "b"),
    "mdl45_core_photos": lambda s, d: catalog.core_photos(table(s, d, "wells").select(F.concat(F.lit("/core/"), "normalized_key", F.lit("/box_1.jpg")).alias("path")), table(s, d, "wells").select(F.col("normalized_key").alias("well_key"))),
    "mdl47_layers": lambda s, d: ingest.map_layers(stations(s, d).select("well", "md", F.col("inc").alias("x"), F.col("azi").alias("y")), heads(s, d).select("well", F.lit(50.0).alias("p_top"), F.lit(100.0).alias("p_base")), 5).groupBy("well").agg(F.count("*").alias("n"), F.count_if("perforated").alias("perforated")),
    # helpers
    "hlp02_options": lambda s, d: ingest.filter_options(las(s, d), curves.typed(las(s, d))).groupBy("curve_type", "how").agg(F.count("*").alias("mnemonics")),
    "hlp03_saved_filter": lambda s, d: ingest.curve_filter(curves.typed(las(s, d)), None, ["gamma_ray", "density"], "automatic").select("id"),
    "hlp04_hits": lambda s, d: search.hit_coverage(_picks(s, d).withColumn("hit", F.col("md") < 2000)).select("layer", "hits"),
    "hlp10_grids": lambda s, d: ingest.surface_inventory(files(s, d).select(F.regexp_replace("path", r"\.csv$", ".grd").alias("path")), files(s, d).where("ext = 'las'").select("path")),
    "hlp18_layers": lambda s, d: ingest.surface_inventory(files(s, d).select(F.regexp_replace("path", r"\.csv$", ".xyz").alias("path")), files(s, d).where("ext = 'csv'").select(F.regexp_replace("path", r"\.csv$", ".xyz").alias("path"))).groupBy("origin").agg(F.count("*").alias("n")),
    "hlp20_relations": lambda s, d: curves.time_depth_curves(las(s, d).withColumn("mnemonic", F.when(F.col("id") % 4 == 0, "One_Way-Time").when(F.col("id") % 4 == 1, "TWT 2").when(F.col("id") % 4 == 2, "Velocity").otherwise(F.col("mnemonic")))),
    "hlp21_survey": lambda s, d: ingest.survey_row(_traces(s, d).withColumns({"path": F.lit("/v.sgy"), "x": F.col("crossline") * 25.0, "y": F.col("inline") * 25.0})),
    "hlp23_folded_columns": lambda s, d: ingest.case_folded(table(s, d, "sources").select(F.col("id").alias("ID"), F.upper("filename").alias("FileName"))),
}

_NUM = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
_LOGS = "lg AS (SELECT '/logs/' || CAST(row_no // 200 AS VARCHAR) || '.las' AS path, * FROM interpretation_v1 WHERE top_md IS NOT NULL AND NOT isnan(top_md))"
_VALUES = "vl AS (SELECT path, unnest(['PHI', 'PERM', 'SW']) AS mnemonic, unnest([phi, perm, sw]) AS v FROM lg)"
_TOPS = "tp AS (SELECT regexp_replace(well, '[\\\\'']', '', 'g') AS well, facies AS surface, top_md AS md FROM interpretation_v1 WHERE well IS NOT NULL AND NOT contains(well, '\"') AND facies IS NOT NULL AND top_md IS NOT NULL AND NOT isnan(top_md))"
_SHEET = "sh AS (SELECT coalesce(facies, 'none') AS sheet, row_no, row_no % 100 = 0 AS head, row_no % 3 <> 0 AS kind, CASE WHEN row_no % 2 = 0 THEN DATE '2019-03-05' ELSE DATE '2020-01-06' END AS day, " + f"{_NUM('top_md')} AS top, {_NUM('base_md')} AS base FROM interpretation_v1), pf AS (SELECT *, last_value(CASE WHEN head THEN 'H' || row_no END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS well FROM sh), pd AS (SELECT * FROM pf WHERE NOT head AND kind AND top IS NOT NULL AND base IS NOT NULL AND well IS NOT NULL)"
_TYPES = f"ty AS (SELECT *, {CURVE_TYPE} AS curve_type FROM las_curves)"
_PICK = "pk AS (SELECT upper(well) AS well, upper(facies) AS layer, min(top_md) AS md FROM interpretation_v1 WHERE facies IS NOT NULL AND top_md IS NOT NULL AND NOT isnan(top_md) GROUP BY ALL)"
_KEY = lambda c: f"regexp_replace(upper(trim({c})), '[^0-9A-Z一-鿿]', '', 'g')"
_TOKENS = "('', 'NULL', 'NONE', 'N/A', 'NA', 'NAN', '-999.25')"
_CLEAN = lambda c: f"CASE WHEN upper(trim({c})) NOT IN {_TOKENS} THEN {c} END"
_RATED = "coalesce(oil_rate, water_rate, gas_rate)"
_MODEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in search.MODEL_ITEMS) + " ELSE 'other' END"
_ENDED = lambda words: "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"

ORACLE = {
    "src03_types": f"WITH {FILES}, n AS (SELECT path, lower(regexp_replace(path, '^.*/', '')) AS name, ext FROM ct) SELECT path, CASE WHEN ext = 'las' THEN 'las' WHEN ext IN ('mdb', 'accdb') THEN 'production' WHEN ext IN ('sgy', 'segy', 'zgy') THEN 'seismic' WHEN ext IN ('json', 'geojson') THEN 'polygon' WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), 'dev|轨迹|井斜') THEN 'deviation' WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), 'core|岩心') THEN 'core' WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), 'top|interpret|解释') THEN 'interpretation' ELSE 'well_head' END AS type FROM n",
    "src04_fields": "SELECT id, CASE " + " ".join(f"WHEN regexp_replace(upper(mnemonic), '[^0-9A-Z一-鿿]', '', 'g') IN ({', '.join(chr(39) + a + chr(39) for a in names.split())}) THEN '{f}'" for f, names in headers.FIELD_ALIASES.items()) + " END AS field FROM las_curves",
    "src05_log_headers": f"WITH {_LOGS} SELECT DISTINCT path, 'W-1' AS well, unnest([0, 1, 2, 3]) AS place, unnest(['DEPT', 'PHI', 'PERM', 'SW']) AS mnemonic, unnest(['M', 'V/V', 'MD', 'V/V']) AS unit FROM lg",
    "src06_log_statistics": f"WITH {_LOGS}, {_VALUES} SELECT path, mnemonic, count(*) AS n, round(min(v), 5) AS low, round(max(v), 5) AS high, round(avg(v), 5) AS mean, round(median(v), 5) AS p50 FROM vl WHERE isfinite(v) AND abs(v + 999.25) >= 1e-10 GROUP BY ALL",
    "src08_header_lines": f"WITH {_LOGS}, p AS (SELECT DISTINCT path FROM lg) SELECT path, unnest(['V', 'W', 'C']) AS section, unnest([3, 4, 5]) AS lines, unnest(['~Version', '~Well', '~Curve']) AS last FROM p",
    "src09_well_heads": f"SELECT canonical_name AS well, coalesce(uwi, '-') AS uwi, x, y, {_NUM('kb_elevation')} AS kb, {_NUM('total_depth')} AS td FROM wells WHERE NOT isnan(x) AND NOT isnan(y)",
    "src10_stations": f"WITH {ST} SELECT well AS path, md, inc AS x, azi AS y, CAST(1.5 AS DOUBLE) AS z, md AS tvd FROM st",
    "src12_tops": f"WITH {_TOPS} SELECT well, surface, md, CAST(1.5 AS DOUBLE) AS x FROM tp",
    "src13_top_names": f"WITH {_TOPS} SELECT surface, count(*) AS picks FROM tp GROUP BY 1",
    "src14_checkshots": f"WITH {ST} SELECT well, count(*) AS points, min(md) AS top_md, max(md) AS base_md, max(md) / 2 AS last_time FROM st GROUP BY 1",
    "src16_grid": f"{_BASE}, e AS (SELECT CAST(i // 40 AS INT) AS row, CAST(i % 40 AS INT) AS col FROM range(0, (SELECT (max(row) + 1) * 40 FROM nodes)) r(i)) SELECT e.row, e.col, CAST(e.col * 10.0 AS DOUBLE) AS x, CAST(e.row * 10.0 AS DOUBLE) AS y, value FROM e LEFT JOIN nodes n ON n.row = e.row AND n.col = e.col",
    "src18_points": f"{_BASE}, {_PTS} SELECT x, y, CAST(-2.5 AS DOUBLE) AS z, count(*) AS n FROM pt GROUP BY ALL",
    "src23_polygons": "SELECT normalized_key AS polygon, CAST(100.0 AS DOUBLE) AS area FROM wells WHERE NOT isnan(x) AND NOT isnan(y)",
    "src24_rings": f"WITH h AS (SELECT coalesce(field, '?') AS polygon, row_no, {_NUM('x')} AS x, {_NUM('y')} AS y FROM well_head) SELECT polygon, 0 AS ring, CAST(row_number() OVER (PARTITION BY polygon ORDER BY row_no) - 1 AS INT) AS seq, x, y FROM h WHERE x IS NOT NULL AND y IS NOT NULL",
    "src33_page": "SELECT id, wellkey FROM production_corrected ORDER BY wellkey, id LIMIT 50 OFFSET 100",
    "src36_perforations": f"WITH {_SHEET} SELECT sheet, row_no, well, day, round(base - top, 4) AS thickness, base <= top AS not_positive FROM pd",
    "win14_filled_headers": f"WITH {_SHEET} SELECT sheet, well, count(*) AS details FROM pd GROUP BY ALL",
    "hlp22_perforation_page": f"WITH {_SHEET} SELECT sheet, row_no, well FROM pd ORDER BY sheet, row_no LIMIT 500",
    "ing06_log_curves": f"WITH {_LOGS} SELECT unnest(['PHI', 'PERM', 'SW']) AS mnemonic, count(DISTINCT path) AS files FROM lg",
    "ing13_rings": _RINGS.format("polygon, area, min_x, max_y"),
    "ing20_not_catalogued": f"WITH {FILES} SELECT id FROM sources WHERE file_path IS NOT NULL AND lower(file_path) NOT IN (SELECT lower(path) FROM ct WHERE ext <> 'csv')",
    "flt03_any_polygon": f"{_BASE}, {_PTS} SELECT id FROM pt WHERE (x > 50.5 AND x < 250.5 AND y > 50.5 AND y < 250.5 AND NOT (x > 100.5 AND x < 150.5 AND y > 100.5 AND y < 150.5)) OR (y > 300.5 AND y - 300.5 < 2 * (x - 200.5) AND y - 300.5 < 2 * (400.5 - x))",
    "flt06_no_filter": f"WITH {_TYPES} SELECT CASE WHEN curve_type IS NULL THEN 'unclassified' ELSE 'automatic' END AS how, count(*) AS n FROM ty GROUP BY 1",
    "flt10_time_depth_files": "SELECT 'TWT' || id % 3 AS mnemonic, count(DISTINCT las_file_id) AS files, count(DISTINCT well_id) AS wells, count(*) AS curves FROM las_curves WHERE id % 5 = 0 AND source_id IN (SELECT id FROM sources WHERE status = 'ready') GROUP BY 1",
    "flt11_any_condition": "SELECT id AS well_key FROM wells WHERE id IN (SELECT well_id FROM las_curves WHERE upper(mnemonic) IN ('GR', 'RT')) OR id NOT IN (SELECT well_id FROM las_curves WHERE upper(mnemonic) = 'DTS' AND well_id IS NOT NULL)",
    "flt15_compact_search": f"SELECT id, canonical_name AS name, CASE WHEN contains(upper(canonical_name), '1-0') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.94 AS DOUBLE) END AS score FROM wells WHERE contains(upper(canonical_name), '1-0') OR contains({_KEY('canonical_name')}, '10')",
    "flt16_ready_sources": "SELECT id FROM sources WHERE status = 'ready'",
    "flt17_corrected": f"WITH {CM} SELECT well_key, month, coalesce(monthly_oil, 0) AS monthly_oil FROM cm",
    "join09_layer_lookup": "WITH k AS (SELECT alias_id, regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(alias_name, '\\.[A-Za-z0-9]{1,4}$', '')), '[\\s_\\-.]*(V|VER|REV)\\s*\\d+$', ''), '[\\s_\\-.]*20\\d{2}$', ''), '[^0-9A-Z一-鿿]', '', 'g') AS layer FROM horizon_name_aliases) SELECT alias_id, coalesce(canonical_name, layer) AS name FROM k LEFT JOIN horizon_name_groups g ON g.canonical_key = layer",
    "join12_covering_curves": f"WITH {SPANNED} SELECT CAST(well_id AS VARCHAR) AS well, count(*) AS curves, count(*) FILTER (start <= 1200 AND stop >= 1300) AS covering FROM sc WHERE well_id IN (SELECT id FROM wells) AND greatest(start, 1200) < least(stop, 1300) GROUP BY 1",
    "join13_containing": f"WITH {_PICK}, {IV} SELECT pk.well, layer, count(*) AS n FROM pk JOIN iv ON iv.well = pk.well AND md BETWEEN top AND base GROUP BY ALL",
    "join15_in_polygon": f"{_BASE}, {_PTS} SELECT 'square' AS polygon, count(*) AS points FROM pt WHERE x > 50.5 AND x < 250.5 AND y > 50.5 AND y < 250.5 AND NOT (x > 100.5 AND x < 150.5 AND y > 100.5 AND y < 150.5) HAVING count(*) > 0 UNION ALL SELECT 'triangle', count(*) FROM pt WHERE y > 300.5 AND y - 300.5 < 2 * (x - 200.5) AND y - 300.5 < 2 * (400.5 - x) HAVING count(*) > 0",
    "join19_nearest_trace": f"{_BASE}, {_PTS}, q AS (SELECT pt.id, min(sqrt(pow(pt.x - n.col * 10.0, 2) + pow(pt.y - n.row * 10.0, 2))) AS d FROM pt JOIN nodes n ON abs(pt.x - n.col * 10.0) <= 4 AND abs(pt.y - n.row * 10.0) <= 4 GROUP BY 1) SELECT id, round(d, 4) AS distance FROM q WHERE d <= 4",
    "agg10_histogram": f"WITH {SAMPLES}, l AS (SELECT series, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM samples GROUP BY 1), b AS (SELECT series, CAST(least(11, greatest(0, floor((value - lo) / (hi - lo) * 12))) AS INT) AS bin, count(*) AS n FROM samples JOIN l USING (series) GROUP BY ALL), e AS (SELECT series, CAST(unnest(range(12)) AS INT) AS bin FROM l) SELECT e.series, e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN b ON b.series = e.series AND b.bin = e.bin",
    "agg20_folders": f"WITH {FILES}, n AS (SELECT folder, ext, count(*) AS n, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, ext) AS k FROM ct GROUP BY folder, ext) SELECT folder, CAST(sum(n) AS BIGINT) AS files, string_agg(ext || ':' || n, ',' ORDER BY k) FILTER (k <= 3) AS endings FROM n GROUP BY folder",
    "agg22_inventory": f"WITH {FILES}, m AS (SELECT {_MODEL} AS kind FROM ct), k AS (SELECT unnest([{', '.join(chr(39) + n + chr(39) for n, _ in search.MODEL_ITEMS)}, 'other']) AS kind) SELECT k.kind, (SELECT count(*) FROM m WHERE m.kind = k.kind) AS n, k.kind NOT IN (SELECT kind FROM m) AS missing FROM k",
    "win02_pressures": f"WITH {PM} SELECT well_key, arg_min(pressure, ROW(month, id)) FILTER (pressure IS NOT NULL) AS first_pressure, arg_max(pressure, ROW(month, id)) FILTER (pressure IS NOT NULL) AS last_pressure, min(pressure) AS min_pressure, max(pressure) AS max_pressure FROM pm GROUP BY 1",
    "win03_last_status": f"WITH {PM} SELECT well_key, arg_max(status, ROW(month, id)) FILTER (status IS NOT NULL) AS last_status FROM pm GROUP BY 1",
    "win04_last_cumulative": f"WITH {PM} SELECT well_key, arg_max(cum_oil, ROW(month, id)) FILTER (cum_oil IS NOT NULL) AS last_cum_oil FROM pm GROUP BY 1",
    "win05_latest_rate": f"WITH {PM}, r AS (SELECT *, row_number() OVER (PARTITION BY well_key ORDER BY month DESC, id DESC) AS n FROM pm WHERE {_RATED} IS NOT NULL) SELECT w.well_key, r.month AS latest_month, r.oil_rate AS latest_oil_rate FROM (SELECT DISTINCT well_key FROM pm) w LEFT JOIN r ON r.well_key = w.well_key AND n = 1",
    "win09_month_index": f"WITH {CM} SELECT well_key, month, CAST(row_number() OVER (PARTITION BY well_key ORDER BY month) AS INT) AS month_index FROM cm",
    "win15_changes": f"WITH {PM}, {SC} SELECT status, count(*) AS changes, count(DISTINCT well_key) AS wells FROM sc GROUP BY 1",
    "win19_thickness": f"WITH {_PICK}, n AS (SELECT *, lead(layer) OVER w AS next_layer, lead(md) OVER w AS m1 FROM pk WINDOW w AS (PARTITION BY well ORDER BY md, layer)) SELECT well, layer, next_layer, round(abs(m1 - md), 4) AS vertical FROM n WHERE next_layer IS NOT NULL",
    "win23_order": f"WITH {_PICK} SELECT CAST(count(DISTINCT well) AS BIGINT) AS wells FROM pk",
    "srt02_mixed_order": "SELECT alias_id, project_root FROM horizon_name_aliases ORDER BY project_root, created_at DESC, alias_id",
    "srt09_first_of_most": "WITH n AS (SELECT well_id, unit, count(*) AS n, min(id) AS f FROM las_curves WHERE unit IS NOT NULL GROUP BY ALL) SELECT well_id, arg_max(unit, ROW(n, -f)) AS mode, count(*) AS kinds, count(*) > 1 AS mixed FROM n GROUP BY 1",
    "set02_distinct_union": f"WITH {PM} SELECT count(*) AS wells FROM (SELECT well_key FROM pm UNION SELECT normalized_key FROM wells)",
    "set05_intersections": f"WITH {PM}, k AS (SELECT DISTINCT {_KEY('well_name')} AS k, 'h' AS s FROM well_head WHERE well_name IS NOT NULL UNION SELECT w.normalized_key, 'l' FROM las_curves c JOIN wells w ON w.id = c.well_id UNION SELECT well_key, 'p' FROM pm), f AS (SELECT k, bool_or(s = 'h') AS h, bool_or(s = 'l') AS l, bool_or(s = 'p') AS p FROM k GROUP BY k) SELECT count(*) FILTER (h) AS head, count(*) FILTER (l) AS las, count(*) FILTER (p) AS prod, count(*) FILTER (h AND l) AS head_las, count(*) FILTER (h AND p) AS head_prod, count(*) FILTER (l AND p) AS las_prod, count(*) FILTER (h AND l AND p) AS every, count(*) AS \"any\" FROM f",
    "set10_precedence": f"WITH {PM} SELECT normalized_key AS key, 1 AS rank FROM wells UNION ALL SELECT DISTINCT well_key, 2 FROM pm WHERE well_key NOT IN (SELECT normalized_key FROM wells)",
    "sc02_clean_text": f"SELECT id, {_CLEAN('data_type')} AS data_type, {_CLEAN('warning')} AS warning FROM sources",
    "sc03_numbers": "SELECT id, CASE WHEN isfinite(total_depth) THEN TRY_CAST('10' || CAST(total_depth AS VARCHAR) AS DOUBLE) END AS v, CAST(NULL AS DOUBLE) AS none FROM well_sources",
    "sc12_water_cut": f"WITH {PM}, w AS (SELECT id, water_cut / CASE WHEN id % 2 = 0 THEN 100 ELSE 1 END AS c FROM pm) SELECT id, round(CASE WHEN c BETWEEN 0 AND 1 THEN c * 100 ELSE c END, 6) AS pct FROM w",
    "sc14_days": f"WITH {PM} SELECT id, CASE WHEN id % 9 = 0 THEN 30 ELSE CAST(day(last_day(CAST(month || '-01' AS DATE))) AS INT) END AS days FROM pm",
    "sc15_changed": f"WITH {PM} SELECT id, CASE id % 4 WHEN 0 THEN oil_rate IS NOT NULL AND 1.0 > greatest(1e-7, greatest(abs(oil_rate), abs(oil_rate + 1)) * 1e-6) WHEN 1 THEN false ELSE oil_rate IS NOT NULL END AS changed FROM pm",
    "sc16_depth_units": "SELECT id, CASE id % 3 WHEN 0 THEN CAST(0.3048 AS DOUBLE) WHEN 1 THEN CAST(1.0 AS DOUBLE) ELSE CASE WHEN upper(trim(unit)) IN ('M', 'METER', 'METRE', 'METERS', 'METRES') THEN CAST(1.0 AS DOUBLE) WHEN upper(trim(unit)) IN ('F', 'FT', 'FEET', 'FOOT') THEN CAST(0.3048 AS DOUBLE) END END AS f FROM las_curves",
    "sc18_kinds": f"WITH {FILES} SELECT path, kind FROM ct",
    "sc20_predicted": f"WITH {FILES}, p AS (SELECT path, ext, lower(replace(path, '/', '\\')) AS low FROM ct), k AS (SELECT path, ext, CASE WHEN ext = 'las' AND regexp_matches(low, 'checkshot|time-depth') THEN 'time_depth' WHEN ext = 'las' THEN 'las' WHEN ext IN ('mdb', 'accdb') THEN 'ofm_mdb' WHEN ext IN ('sgy', 'segy') THEN 'seismic' WHEN ext IN ('geojson', 'json', 'shp') THEN 'polygon' WHEN ext = 'dev' THEN 'deviation' WHEN ext = 'ptd' OR contains(low, 'horizon') THEN 'horizon' WHEN contains(low, 'fault') THEN 'fault' WHEN ext IN {_ENDED(headers.IMAGES)} THEN 'image' WHEN ext IN {_ENDED(headers.SIDECARS)} THEN 'sidecar' WHEN ext IN {_ENDED(headers.TABLES)} THEN CASE WHEN regexp_matches(low, 'wellhead|well head|井头|井坐标') THEN 'well_head' WHEN regexp_matches(low, 'deviation|wellpath|well path|轨迹|井斜') THEN 'deviation' WHEN regexp_matches(low, 'interpret|reservoir|解释|孔渗|饱和') THEN 'interpretation' WHEN regexp_matches(low, 'core|rock|岩心|岩芯|取心') THEN 'core' WHEN contains(regexp_replace(low, '^.*\\\\', ''), 'alias') THEN 'alias' WHEN regexp_matches(low, 'polygon|边界|区块') THEN 'polygon' ELSE 'table' END ELSE 'other' END AS type FROM p) SELECT path, type, type NOT IN ('image', 'horizon', 'fault', 'sidecar', 'other') AND ext NOT IN ('dev', 'shp') AS importable FROM k",
    "sc23_lines": "SELECT id, trim(regexp_replace(regexp_replace(upper(filename || '_mig_V2'), '[\\s_\\-]*(MIG|STACK|PSTM|PSDM|FINAL|RAW|V\\d+)\\b', '', 'g'), '^ +| +$', '', 'g')) AS line FROM sources",
    "sc28_range_similarity": "WITH r AS (SELECT id, CASE WHEN isfinite(value_min) THEN value_min END AS lo, CASE WHEN isfinite(value_max) THEN value_max END AS hi FROM las_curves) SELECT id, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN round(greatest(0, least(hi, 100) - greatest(lo, 0)) / nullif(greatest(hi, 100) - least(lo, 0), 0), 6) END AS similarity FROM r",
    "sc31_equivalent": f"WITH {PM} SELECT id, round(oil_rate + gas_rate / 6000.0, 6) AS boe FROM pm",
    "sc35_log_numbers": "SELECT id, CASE WHEN sample_count IS NULL THEN 'null' ELSE printf('%.4f', sample_count / 8.0) END AS text FROM las_curves",
    "geo03_holes": "SELECT CAST(37500.0 AS DOUBLE) AS area",
    "mdl03_angles": f"WITH {_XYZ}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM xyz WINDOW w AS (PARTITION BY well ORDER BY md)), a AS (SELECT well, degrees(atan2(sqrt(dx * dx + dy * dy), abs(dz))) AS inc FROM d WHERE dx IS NOT NULL) SELECT well, round(max(inc), 3) AS steepest, count(*) AS n FROM a GROUP BY 1",
    "mdl08_scattered_hits": f"WITH {ST}, {_BASE.removeprefix('WITH ')} SELECT well, CAST(75.0 AS DOUBLE) AS md FROM st GROUP BY well HAVING max(md) >= 75 AND (SELECT count(*) FROM nodes WHERE abs(col * 10 - 55) <= 25 AND abs(row * 10 - 45) <= 25) > 0",
    "mdl31_sampled_statuses": f"{_BASE}, {_PTS}, p AS (SELECT *, CAST(round_even(x / 10.0, 0) AS INT) AS c, CAST(round_even(y / 10.0, 0) AS INT) AS r FROM pt) SELECT CASE WHEN NOT (r BETWEEN 0 AND (SELECT max(row) FROM nodes) AND c BETWEEN 0 AND 39) THEN 'outside' WHEN value IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM p LEFT JOIN nodes ON nodes.row = r AND nodes.col = c GROUP BY 1",
    "mdl33_section": "WITH t AS (SELECT CAST(p_partkey // 40 AS INT) AS inline, CAST(p_partkey % 40 AS INT) AS crossline, p_partkey AS trace FROM part), k AS (SELECT arg_min(inline, ROW(abs(inline - 3), inline)) AS i FROM t), r AS (SELECT t.*, row_number() OVER (ORDER BY crossline, trace) - 1 AS rn, greatest(1.0, count(*) OVER () / 10) AS step FROM t, k WHERE inline = i) SELECT inline, crossline, trace FROM r WHERE rn = 0 OR floor(rn / step) <> floor((rn - 1) / step)",
    "mdl34_resampled": f"WITH {ST} SELECT well, CAST(floor((max(md) - min(md)) / 15) + 1 AS BIGINT) AS n, round(max(md) * 2, 4) AS last FROM st GROUP BY 1",
    "mdl35_compared_curves": "WITH c AS (SELECT well_id, upper(mnemonic) AS m, min(value_min) FILTER (isfinite(value_min)) AS lo, max(value_max) FILTER (isfinite(value_max)) AS hi FROM las_curves WHERE well_id IS NOT NULL AND upper(mnemonic) IN ('GR', 'RT') GROUP BY ALL), j AS (SELECT a.lo AS al, a.hi AS ah, b.lo AS bl, b.hi AS bh FROM (SELECT * FROM c WHERE m = 'GR') a FULL JOIN (SELECT * FROM c WHERE m = 'RT') b USING (well_id)) SELECT count(*) FILTER (al IS NOT NULL AND bl IS NOT NULL) AS both, count(*) FILTER (al IS NOT NULL AND bl IS NULL) AS only_a, count(*) FILTER (al IS NULL AND bl IS NOT NULL) AS only_b, round(median(CASE WHEN al IS NOT NULL AND ah IS NOT NULL AND bl IS NOT NULL AND bh IS NOT NULL THEN greatest(0, least(ah, bh) - greatest(al, bl)) / nullif(greatest(ah, bh) - least(al, bl), 0) END), 6) AS similarity FROM j",
    "mdl39_strong": f"WITH {ST} SELECT well AS a, id % 5 AS b FROM st GROUP BY ALL HAVING max(inc) - 49 <= 10",
    "mdl45_core_photos": "SELECT '/core/' || normalized_key || '/box_1.jpg' AS path, normalized_key AS well_key FROM wells",
    "mdl47_layers": f"WITH {ST}, r AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY md) - 1 AS rn FROM st) SELECT well, count(*) AS n, count(*) FILTER (md BETWEEN 50 AND 100) AS perforated FROM r WHERE rn % 5 = 0 OR md BETWEEN 50 AND 100 GROUP BY 1",
    "hlp02_options": f"WITH {_TYPES}, o AS (SELECT DISTINCT upper(trim(mnemonic)) AS mnemonic, curve_type FROM ty) SELECT curve_type, CASE WHEN curve_type IS NULL THEN 'unclassified' ELSE 'automatic' END AS how, count(*) AS mnemonics FROM o GROUP BY ALL",
    "hlp03_saved_filter": f"WITH {_TYPES} SELECT id FROM ty WHERE curve_type IN ('gamma_ray', 'density')",
    "hlp04_hits": f"WITH {_PICK} SELECT layer, count(*) FILTER (md < 2000) AS hits FROM pk GROUP BY 1",
    "hlp10_grids": f"WITH {FILES} SELECT path, 'imported' AS origin FROM ct WHERE ext = 'las' UNION ALL SELECT regexp_replace(path, '\\.csv$', '.grd'), 'catalog' FROM ct WHERE regexp_matches(path, '\\.csv$') OR ext IN ('grd', 'zmap', 'xyz')",
    "hlp18_layers": f"WITH {FILES} SELECT 'imported' AS origin, count(*) AS n FROM ct WHERE ext = 'csv' HAVING count(*) > 0",
    "hlp20_relations": "SELECT id, CASE id % 4 WHEN 0 THEN 'owt' WHEN 1 THEN 'twt' ELSE 'time_depth' END AS relation FROM las_curves WHERE id % 4 < 3 OR regexp_matches(regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g'), '^(ONEWAYTIME|OWT|TWT|GENERALTIME|VELOCITY)')",
    "hlp21_survey": "SELECT '/v.sgy' AS path, count(*) AS traces, count(DISTINCT p_partkey // 40) AS inlines, count(DISTINCT p_partkey % 40) AS crosslines, min(p_partkey % 40) * 25.0::DOUBLE AS min_x, max(p_partkey % 40) * 25.0::DOUBLE AS max_x, min(p_partkey // 40) * 25.0::DOUBLE AS min_y, max(p_partkey // 40) * 25.0::DOUBLE AS max_y, CASE WHEN count(DISTINCT p_partkey // 40) > 1 AND count(DISTINCT p_partkey % 40) > 1 THEN '3d' ELSE '2d' END AS dimension FROM part",
    "hlp23_folded_columns": "SELECT id, upper(filename) AS filename FROM sources",
}
_EXACT = ("geo03_holes", "sc35_log_numbers")
ORACLE = {k: v if k in _EXACT else rounding_alike(v) for k, v in ORACLE.items()}

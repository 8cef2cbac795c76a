"""Comparisons, texts of surfaces and faults, exports: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions.text import finite
from wellspring.operators import catalog, compare, curves, search, surfaces, trajectory
from wellspring.plans.detail_queries import _LOGS, _PICK, _TYPES, _lines, _log_files, _log_samples, _picks
from wellspring.plans.geometry_queries import _BASE, _MC, _path, _rings
from wellspring.plans.relations import FILES, IV, PM, SPANNED, ST, files, heads, intervals, nodes, pm, rounded, rounding_alike, spanned_curves, stations
from wellspring.plans.relations import curves as las
from wellspring.sources import sinks, surface_texts, text_formats
from wellspring.tables import table


def _asked(s, d):
    """Questions of two to five wells by their ids."""
    w = table(s, d, "wells")
    return w.select(F.floor((F.col("id") - 1) / (F.floor(F.col("id") / 60) % 4 + 2)).alias("q"), F.col("normalized_key").alias("well"))


def _places(s, d):
    return table(s, d, "wells").select(F.col("normalized_key").alias("well"), "x", "y")


def _layers(s, d):
    """Every layer of every well asked for, in the order of its name."""
    p = _picks(s, d)
    asked = p.select(F.col("well").alias("q"), "well", "layer", F.hash("layer").alias("place"))
    tops = p.where(F.length("layer") % 2 == 0).select("well", "layer", "md", F.lit("f").alias("file"))
    hits = p.select("well", "layer", "md", (F.col("md") < 2200).alias("hit"), (F.col("md") < 2600).alias("computed"))
    return compare.resolved_layers(asked, tops, hits)


def _segments(s, d):
    p = _picks(s, d).select(F.col("well").alias("q"), "well", "layer", F.col("md").alias("place"), "md").groupBy("q", "well", "place", "md").agg(F.min("layer").alias("layer"))
    ends = p.groupBy("well").agg(F.max("md").alias("md"))
    line = ends.select("well", F.explode(F.array(F.lit(0.0), F.col("md"))).alias("md")).select("well", "md", (F.col("md") / 2).alias("x"), F.lit(0.0).alias("y"), (F.col("md") * 0.8).alias("tvd"))
    c = intervals(s, d).select("well", "id", F.concat(F.lit("C"), F.col("id") % 3).alias("mnemonic"), "top", "base")
    return compare.layer_intervals(p, line, c, intervals(s, d).where("id % 4 = 0").select("well", "id", "top", "base"))


def _profile_lines(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") * 13 % 420).alias("x"), (F.col("event_id") * 29 % 530).alias("y"), (F.col("event_id") % 97).alias("z"))
    body = e.select((F.col("event_id") % 5).alias("f"), F.concat_ws(" ", "x", "y", F.lit("0 0"), "z", F.lit("0 0"), F.col("event_id") % 11, F.lit("0"), F.concat(F.lit("L"), F.col("event_id") % 3)).alias("value"))
    head = s.createDataFrame([(f, f"PROFILE {f} TYPE {1 if f < 4 else 2}") for f in range(5)], "f long, value string")
    return body.unionByName(head).select(F.concat(F.lit("/p/"), "f", F.lit(".txt")).alias("path"), "value")


def _surface_files(s, d):
    """A file a brand: points for most, a grid head for some."""
    p = table(s, d, "part")
    line = F.concat_ws(" ", (F.col("p_partkey") * 3.0).cast("string"), (F.col("p_size") * 7.0).cast("string"), (-F.col("p_retailprice")).cast("string"))
    g = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda r: r["l"]), "\n").alias("t"), F.count("*").alias("n"))
    text = F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("FSASCI\nFSLIMI 0 10 0 20 -1 1\nFSNROW 3 "), F.col("n").cast("string"), F.lit("\n->\n"))).otherwise(F.col("t"))
    return g.select(F.concat("p_brand", F.lit(".txt")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def _boxes(s, d):
    k = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") * 37 % 1000).cast("double").alias("x0"), (F.col("p_partkey") * 91 % 1000).cast("double").alias("y0"))
    box = k.select("p_partkey", "x0", "y0", (F.col("x0") + F.col("w") + 1).alias("x1"), (F.col("y0") + F.col("w") + 1).alias("y1"))
    a = box.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("surface"), "x0", "y0", "x1", "y1", F.lit(5.0).alias("dx"), (F.col("p_partkey") % 30).cast("double").alias("dy"))
    b = box.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("volume"), "x0", "y0", "x1", "y1", F.lit(12.5).alias("inline_spacing"), (F.col("p_partkey") % 20).cast("double").alias("crossline_spacing"))
    return a, b


def _plan_texts(s, d):
    o = table(s, d, "orders")
    m = o.groupBy((F.col("o_custkey") % 20).alias("p"), "o_orderstatus").agg(F.array_sort(F.collect_set(F.struct(F.col("o_custkey").cast("string").alias("well"), (F.col("o_custkey") % 4).cast("int").alias("cluster")))).alias("members"))
    doc = F.struct(F.concat(F.lit("plan"), "p").alias("plan_id"), F.lit("n").alias("name"), F.lit("kmeans").alias("method"), F.lit(4).alias("k"), F.col("o_orderstatus").alias("saved_at"), "members")
    return m.select(F.concat_ws("/", "p", "o_orderstatus").alias("path"), F.to_json(doc).alias("content"))


def _chosen(s, d):
    return curves.focus(spanned_curves(s, d)).select(F.col("well_id").cast("string").alias("well"), "curve_type", "curve_id")


def _curve_points(s, d):
    c = spanned_curves(s, d).where("id % 3 > 0")
    return c.select(F.col("id").alias("curve_id"), F.explode(F.array(F.col("start"), F.col("stop"))).alias("md"), finite(F.col("value_max")).alias("value"), "unit")


def _deliverable(s, d):
    f = files(s, d).select("well_key", "kind", "path")
    return table(s, d, "wells").select(F.col("normalized_key").alias("well_key"), F.explode(F.array(F.lit("well_log"), F.lit("production"))).alias("kind")).unionByName(f.select("well_key", "kind")), f


def _events(s, d):
    return table(s, d, "events")


QUERIES = {
    "mdl42_wells": lambda s, d: rounded(compare.compared_wells(_asked(s, d), _places(s, d), _places(s, d).select("well", (F.col("x") + F.length("well")).alias("x"), "y")), 4),
    "mdl42_shared": lambda s, d: compare.shared_items(_asked(s, d), las(s, d).join(table(s, d, "wells").select(F.col("id").alias("well_id"), F.col("normalized_key").alias("well")), "well_id").select("well", F.upper("mnemonic").alias("item"))),
    "mdl43_layers": lambda s, d: _layers(s, d).select("well", "layer", "status", "evidence", "md", "versions"),
    "mdl43_segments": lambda s, d: rounded(_segments(s, d).drop("q"), 4),
    "mdl12_quality": lambda s, d: compare.quality_grade(compare.quality_checks(files(s, d).groupBy("kind").agg(F.count("*").alias("files")), s.createDataFrame([("deviation", 0.5), ("well_log", 0.9)], "kind string, share double"))),
    "ing12_merged": lambda s, d: compare.merged_wells(table(s, d, "well_sources").select("id", "well_id"), table(s, d, "wells").where("id % 10 = 0").select(F.col("id").alias("merged_id"), (F.col("id") - 1).alias("into_id"))),
    "hlp01_new_mentions": lambda s, d: compare.with_mention(table(s, d, "well_sources").where("id % 7 > 0"), table(s, d, "well_sources").where("id % 7 = 0"), table(s, d, "sources")).select("well_id", "confidence"),
    "hlp09_dispatch": lambda s, d: rounded(compare.hits_by_kind(_path(s, d).select("well", "md", F.lit(55.0).alias("x"), F.lit(45.0).alias("y"), F.col("md").alias("tvdss")), "xyz_surface", nodes(s, d).select((F.col("col") * 10.0).alias("x"), (F.col("row") * 10.0).alias("y"), F.lit(45.0).alias("z")), cell=10.0), 4),
    "flt04_mask": lambda s, d: surfaces.grid_mask(nodes(s, d), _rings(s, d), 0.0, 0.0, 10.0, 10.0).select("row", "col", "inside"),
    "mdl01_subsea": lambda s, d: rounded(trajectory.minimum_curvature(stations(s, d), heads(s, d)).select("well", "md", "tvdss"), 4),
    "mdl11_coverage": lambda s, d: search.surface_over_seismic(*_boxes(s, d), finish=lambda df: rounded(df, 4)),
    "hlp05_profile": lambda s, d: catalog.header_profile(text_formats.las_headers(s, _log_files(s, d)), files(s, d).where("size = 0")).select("mnemonic", "files", "units", "errors"),
    "hlp08_detail": lambda s, d: search.seismic_detail(table(s, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("trace_count"), F.min("p_size").alias("inline_min"), F.max("p_size").alias("inline_max"), F.min(F.col("p_partkey") % 9).alias("crossline_min"), F.max(F.col("p_partkey") % 9).alias("crossline_max"), F.lit(0).alias("delay_ms_min"), F.max("p_size").alias("end_ms_max"))),
    "hlp12_plans": lambda s, d: catalog.saved_plans(_plan_texts(s, d)).select("plan_id", "saved_at", "well", "cluster"),
    "src15_grid_scan": lambda s, d: rounded(surface_texts.grid_scan(nodes(s, d).withColumns({"path": F.lit("a"), "x": F.lit(0.0), "y": F.lit(0.0)})), 4),
    "src19_surfaces": lambda s, d: rounded(surface_texts.surface_metadata(s, _surface_files(s, d)).select("path", "kind", "points", "rows", "cols", "x_min", "x_max", "low"), 4),
    "src20_profiles": lambda s, d: surface_texts.point_summary(surface_texts.profile_points(s, _profile_lines(s, d)), "line"),
    "src21_sticks": lambda s, d: surface_texts.point_summary(surface_texts.fault_sticks(s, _lines(_events(s, d).select(F.when(F.col("event_id") % 2 == 0, "INLINE-").otherwise("OTHER").alias("a"), F.lit(1).alias("b"), F.lit(2).alias("c"), F.col("event_id").alias("x"), F.lit(5).alias("y"), (F.col("event_id") % 50).alias("z"), F.lit(0).alias("e"), (F.col("event_id") % 13).alias("g")), F.lit("/s"), "a", "b", "c", "x", "y", "z", "e", "g")), "stick"),
    "src21_model": lambda s, d: surface_texts.fault_model(s, _events(s, d).select(F.lit("/m").alias("path"), F.when(F.col("event_id") % 9 == 0, F.concat(F.lit('FAULT "F'), F.col("event_id") % 4, F.lit('"'))).otherwise(F.concat_ws(" ", F.lit("PILLAR"), "event_id", F.lit("2"), F.lit("3"))).alias("value"))).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.max("x").alias("x")),
    "src21_lines": lambda s, d: surface_texts.point_summary(surface_texts.faults_on_lines(s, _lines(_events(s, d).select(F.concat(F.lit("L"), F.col("event_id") % 6).alias("a"), F.lit(1).alias("b"), F.col("event_id").alias("x"), F.lit(5).alias("y"), (F.col("event_id") % 50).alias("z")), F.lit("/l"), "a", "b", "x", "y", "z")), "line"),
    "src22_sidecars": lambda s, d: table(s, d, "sources").select("id", surface_texts.crs_sidecar(F.concat(F.lit("<crs id='EPSG:"), 32600 + F.col("id") % 60, F.lit("'><name> "), F.coalesce("crs", F.lit("none")), F.lit(" </name></crs>"))).alias("c")).select("id", "c.epsg", "c.description"),
    "src11_summaries": lambda s, d: text_formats.dev_summary(s, _lines(stations(s, d).withColumn("z", F.lit(1.5)), F.col("well"), "md", "inc", "azi", "z", "md").unionByName(heads(s, d).select(F.col("well").alias("path"), F.concat(F.lit("# WELL HEAD X-COORDINATE: "), "x").alias("value")))).select("path", "x", "stations", "base_md"),
    "src07_reservoir": lambda s, d: text_formats.curve_reservoir(_log_samples(s, d), 20).groupBy("path", "mnemonic").agg(F.count("*").alias("n")),
    "snk01_scope": lambda s, d: sinks.wells_in_scope(table(s, d, "wells").select("id", "x", "y"), (400000.0, 4000000.0, 470000.0, 4005000.0)).select("id"),
    "snk02_sets": lambda s, d: sinks.export_sets({"history": pm(s, d), "markers": _picks(s, d), "deviations": stations(s, d)}, s)["availability"],
    "snk05_logs": lambda s, d: text_formats.las_samples(s, sinks.las_bundle(_log_samples(s, d).select(F.col("path").alias("well"), "mnemonic", F.lit("x").alias("unit"), "md", "value")).select(F.col("well").alias("path"), F.encode("text", "UTF-8").alias("content"))).groupBy("path", "mnemonic").agg(F.count("*").alias("depths"), F.count("value").alias("samples")),
    "snk06_focus": lambda s, d: sinks.merged_focus(_chosen(s, d), _curve_points(s, d))[1].select("well", "curve_type", "curve_id", "samples", "missing"),
    "snk07_by_type": lambda s, d: sinks.files_by_type(curves.typed(las(s, d)), las(s, d).where("las_file_id % 5 > 0").select("las_file_id", F.concat(F.lit("/"), "las_file_id").alias("path")), ["sonic", "density", "gamma_ray"]),
    "snk09_delivery": lambda s, d: sinks.directory_delivery(*_deliverable(s, d))[1],
    "snk10_bundles": lambda s, d: sinks.reconstruction(table(s, d, "wells").select(F.col("normalized_key").alias("well_key"), "uwi"), {"files": files(s, d).select("well_key", "path"), "months": pm(s, d).select("well_key", "month").distinct()}).select("well_key", "files_n", "months_n"),
}

_OKXY = "NOT isnan(x) AND NOT isnan(y)"
_Q = "aq AS (SELECT DISTINCT CAST(floor((id - 1) / (id // 60 % 4 + 2)) AS BIGINT) AS q, normalized_key AS well FROM wells)"
ORACLE = {
    "mdl42_wells": f"WITH {_Q}, n AS (SELECT q, aq.well, CASE WHEN NOT isnan(x) THEN x END AS x, CASE WHEN NOT isnan(y) THEN y END AS y, w.x + length(aq.well) AS bx, w.y AS by, count(*) OVER (PARTITION BY q) AS n FROM aq JOIN wells w ON w.normalized_key = aq.well) SELECT a.q, a.well AS left_well, b.well AS right_well, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS head_distance, round(sqrt(pow(a.bx - b.bx, 2) + pow(a.by - b.by, 2)), 4) AS bottom_distance, round(sqrt(pow(a.bx - b.bx, 2) + pow(a.by - b.by, 2)) - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS separation_change FROM n a JOIN n b ON a.q = b.q AND a.well < b.well WHERE a.n BETWEEN 2 AND 4",
    "mdl42_shared": f"WITH {_Q}, i AS (SELECT DISTINCT q, aq.well, upper(mnemonic) AS item FROM aq JOIN wells w ON w.normalized_key = aq.well JOIN las_curves c ON c.well_id = w.id) SELECT q, item, count(*) AS wells, count(*) = (SELECT count(DISTINCT well) FROM i j WHERE j.q = i.q) AS common FROM i GROUP BY q, item",
    "mdl43_layers": f"WITH {_PICK} SELECT well, layer, CASE WHEN length(layer) % 2 = 0 OR md < 2200 THEN 'resolved' WHEN md < 2600 THEN 'not_intersected' ELSE 'not_computed' END AS status, CASE WHEN length(layer) % 2 = 0 THEN 'well top' WHEN md < 2200 THEN 'surface' END AS evidence, CASE WHEN length(layer) % 2 = 0 OR md < 2200 THEN md END AS md, 1 AS versions FROM pk",
    "mdl43_segments": f"""WITH {_PICK}, {IV}, p AS (SELECT well, md, min(layer) AS lo, max(layer) AS hi FROM pk GROUP BY ALL), n AS (SELECT *, lead(md) OVER w AS m1, lead(lo) OVER w AS lo1, lead(hi) OVER w AS hi1 FROM p WINDOW w AS (PARTITION BY well ORDER BY md)), s AS (SELECT * FROM n WHERE m1 IS NOT NULL),
 u AS (SELECT well, top, base, min(id) AS id FROM iv GROUP BY ALL), c AS (SELECT s.well, s.md, string_agg(DISTINCT 'C' || id % 3, ',' ORDER BY 'C' || id % 3) FILTER (top <= md AND base >= m1) AS f, string_agg(DISTINCT 'C' || id % 3, ',' ORDER BY 'C' || id % 3) FILTER (NOT (top <= md AND base >= m1)) AS g FROM s JOIN iv ON iv.well = s.well AND greatest(top, md) < least(base, m1) GROUP BY ALL),
 q AS (SELECT s.well, s.md, count(*) AS n, sum(least(base, m1) - greatest(top, md)) AS l FROM s JOIN iv ON iv.well = s.well AND id % 4 = 0 AND greatest(top, md) < least(base, m1) GROUP BY ALL)
 SELECT s.well, lo AS top_layer, lo1 AS base_layer, round(s.md, 4) AS top, round(m1, 4) AS base, round(m1 - s.md, 4) AS md_thickness, CASE WHEN s.md >= 0 THEN round((m1 - s.md) * 0.8, 4) END AS tvd_thickness, CASE WHEN s.md >= 0 THEN round((m1 - s.md) / 2, 4) END AS displacement, false AS reordered, coalesce(f, '') AS full_curves, coalesce(g, '') AS partial_curves, coalesce(n, 0) AS perforations, round(coalesce(l, 0), 4) AS perforated FROM s LEFT JOIN c ON c.well = s.well AND c.md = s.md LEFT JOIN q ON q.well = s.well AND q.md = s.md""",
    "mdl12_quality": f"WITH {FILES}, k AS (SELECT DISTINCT kind FROM ct), c AS (SELECT unnest([8, 12, 12, 8, 16, 14, 10, 8, 8]) AS w, unnest(['well_head', '', '', 'well_top', 'seismic', 'horizon', 'fault', 'polygon', 'production']) AS kind, unnest([NULL, 0.5, 0.9, NULL, NULL, NULL, NULL, NULL, NULL]) AS share), s AS (SELECT CAST(round_even(sum(w * coalesce(share, CASE WHEN kind IN (SELECT kind FROM k) THEN 1 ELSE 0 END)), 0) AS INT) AS score, bool_or(kind = 'fault' AND kind IN (SELECT kind FROM k)) AS faults FROM c) SELECT score, CASE WHEN score >= 85 THEN 'complete' WHEN score >= 70 THEN 'mostly complete' ELSE 'to be completed' END AS grade, 'few head wells have trajectories' || CASE WHEN faults THEN '' ELSE '; no fault model' END AS alerts FROM s",
    "ing12_merged": "SELECT s.id, CASE WHEN s.well_id % 10 = 0 AND s.well_id IN (SELECT id FROM wells) THEN s.well_id - 1 ELSE s.well_id END AS well_id FROM well_sources s",
    "hlp01_new_mentions": None,
    "hlp09_dispatch": f"WITH {ST}, {_BASE.removeprefix('WITH ')}, v AS (SELECT well, md FROM st WHERE md >= 0 AND inc BETWEEN 0 AND 180 GROUP BY ALL) SELECT well, CAST(45.0 AS DOUBLE) AS md FROM v GROUP BY well HAVING max(md) >= 45 AND (SELECT count(*) FROM nodes WHERE abs(col * 10 - 55) <= 25 AND abs(row * 10 - 45) <= 25) > 0",
    "flt04_mask": f"{_BASE}, p AS (SELECT *, col * 10.0 AS x, row * 10.0 AS y FROM nodes) SELECT row, col, value IS NOT NULL AND ((x > 50.5 AND x < 250.5 AND y > 50.5 AND y < 250.5 AND NOT (x > 100.5 AND x < 150.5 AND y > 100.5 AND y < 150.5)) OR (y > 300.5 AND y - 300.5 < 2 * (x - 200.5) AND y - 300.5 < 2 * (400.5 - x))) AS inside FROM p",
    "mdl01_subsea": f"WITH {_MC} SELECT well, md, round(tvd - 100, 4) AS tvdss FROM mc",
    "mdl11_coverage": "WITH k AS (SELECT p_partkey AS id, p_partkey * 37 % 1000 AS x0, p_partkey * 91 % 1000 AS y0, p_size + 1 AS w FROM part), j AS (SELECT a.id AS surface, b.id AS volume, greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.w, b.y0 + b.w) - greatest(a.y0, b.y0)) AS s, a.w * a.w AS aa, b.w * b.w AS bb, least(5.0, a.id % 30) < least(12.5, b.id % 20) * 0.95 AS f FROM k a JOIN k b ON a.id % 3 > 0 AND b.id % 3 = 0) SELECT surface, volume, round(s / bb * 100, 4) AS volume_pct, round(s / aa * 100, 4) AS surface_pct, f AS resampled_finer FROM j WHERE s > 0",
    "hlp05_profile": f"WITH {_LOGS}, {FILES}, n AS (SELECT count(DISTINCT path) AS files FROM lg) SELECT unnest(['DEPT', 'PHI', 'PERM', 'SW']) AS mnemonic, files, unnest(['M', 'V/V', 'MD', 'V/V']) AS units, (SELECT count(*) FROM ct WHERE size = 0) AS errors FROM n WHERE files > 0",
    "hlp08_detail": "WITH g AS (SELECT p_brand AS path, count(*) AS trace_count, max(p_size) - min(p_size) + 1 AS inlines, max(p_partkey % 9) - min(p_partkey % 9) + 1 AS crosslines, max(p_size) AS extent_ms FROM part GROUP BY 1) SELECT path, trace_count, inlines, crosslines, extent_ms, inlines || ' x ' || crosslines AS grid, trace_count >= inlines * crosslines AS \"full\" FROM g",
    "hlp12_plans": "WITH l AS (SELECT o_custkey % 20 AS p, max(o_orderstatus) AS last FROM orders GROUP BY 1) SELECT DISTINCT 'plan' || p AS plan_id, last AS saved_at, CAST(o_custkey AS VARCHAR) AS well, CAST(o_custkey % 4 AS INT) AS cluster FROM orders JOIN l ON l.p = o_custkey % 20 AND o_orderstatus = last",
    "src15_grid_scan": f"{_BASE} SELECT 'a' AS path, count(*) AS nodes, count(value) AS valid, round(min(value), 4) AS low, round(max(value), 4) AS high, max(row) + 1 AS rows, max(col) + 1 AS cols FROM nodes",
    "src19_surfaces": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS m, p_brand LIKE '%1' AS grid FROM part) SELECT p_brand || '.txt' AS path, CASE WHEN any_value(grid) THEN 'regular_surface' ELSE 'xyz_surface' END AS kind, CASE WHEN any_value(grid) THEN 0 ELSE CAST(count(*) AS INT) END AS points, CASE WHEN any_value(grid) THEN 3 END AS rows, CASE WHEN any_value(grid) THEN CAST(any_value(m) AS INT) END AS cols, CASE WHEN any_value(grid) THEN 0.0::DOUBLE ELSE min(p_partkey * 3.0::DOUBLE) END AS x_min, CASE WHEN any_value(grid) THEN 10.0::DOUBLE ELSE max(p_partkey * 3.0::DOUBLE) END AS x_max, round(CASE WHEN any_value(grid) THEN -1.0 ELSE min(-p_retailprice) END, 4) AS low FROM r WHERE n <= 4000 GROUP BY p_brand",
    "src20_profiles": "SELECT '/p/' || event_id % 5 || '.txt' AS path, count(*) AS points, CASE WHEN event_id % 5 < 4 THEN count(DISTINCT event_id % 3) ELSE 1 END AS \"groups\", CAST(min(CASE WHEN event_id % 5 < 4 THEN event_id % 97 ELSE 0 END) AS DOUBLE) AS low, CAST(max(CASE WHEN event_id % 5 < 4 THEN event_id % 97 ELSE 0 END) AS DOUBLE) AS high, CAST(min(event_id * 13 % 420) AS DOUBLE) AS x_min, CAST(max(event_id * 13 % 420) AS DOUBLE) AS x_max, CAST(min(event_id * 29 % 530) AS DOUBLE) AS y_min, CAST(max(event_id * 29 % 530) AS DOUBLE) AS y_max FROM events GROUP BY event_id % 5",
    "src21_sticks": "SELECT '/s' AS path, count(*) AS points, count(DISTINCT event_id % 13) AS \"groups\", CAST(min(event_id % 50) AS DOUBLE) AS low, CAST(max(event_id % 50) AS DOUBLE) AS high, CAST(min(event_id) AS DOUBLE) AS x_min, CAST(max(event_id) AS DOUBLE) AS x_max, 5.0::DOUBLE AS y_min, 5.0::DOUBLE AS y_max FROM events WHERE event_id % 2 = 0",
    "src21_model": "SELECT 'fault' AS kind, count(*) AS n, count(DISTINCT event_id % 4) AS names, CAST(NULL AS DOUBLE) AS x FROM events WHERE event_id % 9 = 0 UNION ALL SELECT 'pillar', count(*), 0, CAST(max(event_id) AS DOUBLE) FROM events WHERE event_id % 9 <> 0",
    "src21_lines": "SELECT '/l' AS path, count(*) AS points, count(DISTINCT event_id % 6) AS \"groups\", CAST(min(event_id % 50) AS DOUBLE) AS low, CAST(max(event_id % 50) AS DOUBLE) AS high, CAST(min(event_id) AS DOUBLE) AS x_min, CAST(max(event_id) AS DOUBLE) AS x_max, 5.0::DOUBLE AS y_min, 5.0::DOUBLE AS y_max FROM events",
    "src22_sidecars": "SELECT id, CAST(32600 + id % 60 AS INT) AS epsg, nullif(trim(coalesce(crs, 'none')), '') AS description FROM sources",
    "src11_summaries": f"WITH {ST} SELECT well AS path, CAST(substr(well, 2) AS INT) * 10.0::DOUBLE AS x, count(*) AS stations, max(md) AS base_md FROM st GROUP BY 1, 2",
    "src07_reservoir": f"WITH {_LOGS}, v AS (SELECT path, unnest(['PHI', 'PERM', 'SW']) AS mnemonic, unnest([phi, perm, sw]) AS v FROM lg) SELECT path, mnemonic, least(20, count(*)) AS n FROM v WHERE isfinite(v) AND abs(v + 999.25) >= 1e-10 GROUP BY ALL",
    "snk01_scope": "SELECT id FROM wells WHERE x BETWEEN 400000 AND 470000 AND y BETWEEN 4000000 AND 4005000",
    "snk02_sets": f"WITH {PM}, {_PICK}, n AS (SELECT unnest([{', '.join(chr(39) + k + chr(39) for k in sinks.EXPORT_COLUMNS)}]) AS name) SELECT name, CASE name WHEN 'history' THEN (SELECT count(*) FROM pm) WHEN 'markers' THEN (SELECT count(*) FROM pk) WHEN 'deviations' THEN (SELECT count(*) FROM events) ELSE 0 END AS n, name IN ('history', 'markers', 'deviations') AS available FROM n",
    "snk05_logs": f"WITH {_LOGS}, v AS (SELECT path, unnest(['PHI', 'PERM', 'SW']) AS mnemonic, top_md, unnest([phi, perm, sw]) AS v FROM lg), w AS (SELECT path, mnemonic, top_md, max(v) FILTER (isfinite(v) AND abs(v + 999.25) >= 1e-10) AS v FROM v GROUP BY ALL) SELECT path, mnemonic, count(*) AS depths, count(v) AS samples FROM w GROUP BY ALL",
    "snk06_focus": None,
    "snk07_by_type": f"WITH {_TYPES}, h AS (SELECT las_file_id, string_agg(DISTINCT curve_type, ',' ORDER BY curve_type) AS types, min(curve_type) AS folder FROM ty WHERE curve_type IN ('sonic', 'density', 'gamma_ray') GROUP BY 1) SELECT las_file_id, CASE WHEN las_file_id % 5 > 0 THEN '/' || las_file_id END AS path, types, folder, coalesce(las_file_id % 5 = 0, true) AS missing FROM h",
    "snk09_delivery": f"WITH {FILES}, w AS (SELECT normalized_key AS well_key, unnest(['well_log', 'production']) AS kind FROM wells UNION SELECT well_key, kind FROM ct) SELECT w.well_key, coalesce(string_agg(DISTINCT w.kind, ',' ORDER BY w.kind) FILTER (path IS NULL), '') AS lacks, count(DISTINCT path) AS files FROM w LEFT JOIN ct USING (well_key, kind) GROUP BY 1",
    "snk10_bundles": f"WITH {FILES}, {PM} SELECT normalized_key AS well_key, (SELECT count(*) FROM ct WHERE ct.well_key = normalized_key) AS files_n, (SELECT count(DISTINCT month) FROM pm WHERE pm.well_key = normalized_key) AS months_n FROM wells",
}
_EXACT = ("mdl12_quality",)
ORACLE = {k: v if k in _EXACT else rounding_alike(v) for k, v in ORACLE.items() if v}

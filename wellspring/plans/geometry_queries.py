"""Trajectory, surface and grouping queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators import clustering, surfaces, trajectory
from wellspring.plans.relations import NODES, ST, heads, nodes, rounded, rounding_alike, stations
from wellspring.tables import table

GRID = (0.0, 0.0, 10.0, 10.0)  # origin and spacing of the node grid
COLS = 40


def _path(s, d):
    return trajectory.minimum_curvature(stations(s, d))


def _xyz(s, d):
    return trajectory.absolute(_path(s, d), heads(s, d))


def _shifted(s, d):
    return _xyz(s, d).select("well", "md", (F.col("x") + F.col("md") / 1000).alias("x"), "y", "z")


def _asked(s, d):
    return heads(s, d).select("well", F.explode(F.array(*[F.lit(float(x)) for x in (0, 45, 100, 777, 1e6)])).alias("md"))


def _diff(s, d):
    return _path(s, d).select("well", "md", (F.col("tvd") - 150).alias("diff"))


def _rows(n):
    """Rows of the grid of these nodes."""
    return (n.agg(F.max("row")).first()[0] or 0) + 1


def _points(s, d, rows=None):
    rows = rows or _rows(nodes(s, d))
    return table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 13 % 420).cast("double").alias("x"), (F.col("event_id") * 29 % (rows * 10 + 30)).cast("double").alias("y"))


def _sampled(s, d):
    n = nodes(s, d)
    rows = _rows(n)
    return surfaces.sampled(_points(s, d, rows), n, *GRID, rows, COLS)


def _volumes(s, d):
    n = nodes(s, d)
    return surfaces.volumes(n, _rows(n), COLS, 10.0, 10.0, {"net": 0.8, "porosity": 20, "saturation": 0.7, "volume_factor": 1.2, "recovery": 30, "gas_oil_ratio": 90})


def _resampled(s, d):
    n = nodes(s, d)
    rows = _rows(n)
    return surfaces.resampled(n, (*GRID, rows, COLS), (5.0, 5.0, 7.0, 7.0, rows, COLS))


def _preview(s, d):
    n = nodes(s, d)
    return surfaces.preview(n, _rows(n), COLS, 20)


def _missing_map(s, d):
    n = nodes(s, d)
    return surfaces.missing_map(n, _rows(n), COLS)


def _hits(s, d):
    n = nodes(s, d)
    rows = _rows(n)
    path = _xyz(s, d).select("well", "md", (F.col("x") % 390).alias("x"), (F.col("y") % (rows * 10 - 10)).alias("y"), (-F.col("z") / 10).alias("tvdss"))
    return surfaces.surface_hits(path, n, (*GRID, rows, COLS))


def _rings(s, d):
    """A square with a hole, and a triangle."""
    rows = [("square", 0, i, x, y) for i, (x, y) in enumerate(((50.5, 50.5), (250.5, 50.5), (250.5, 250.5), (50.5, 250.5)))]
    rows += [("square", 1, i, x, y) for i, (x, y) in enumerate(((100.5, 100.5), (150.5, 100.5), (150.5, 150.5), (100.5, 150.5)))]
    rows += [("triangle", 0, i, x, y) for i, (x, y) in enumerate(((200.5, 300.5), (400.5, 300.5), (300.5, 500.5)))]
    return s.createDataFrame(rows, "polygon string, ring int, seq int, x double, y double")


def _several(s, d):
    n = nodes(s, d)
    a = n.select(F.lit("a").alias("surface"), "row", "col", "value")
    b = n.select(F.lit("b").alias("surface"), "row", "col", (F.col("value") * 2 + F.col("col") % 3).alias("value"))
    c = n.select(F.lit("c").alias("surface"), "row", "col", ((F.col("row") * 31 + F.col("col") * 17) % 23).cast("double").alias("value"))
    return a.unionByName(b).unionByName(c)


def _components(s, d):
    return table(s, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


def _vectors(s, d):
    """All components of the vectors, under their number."""
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(_components(s, d))], F.col("label").cast("int").alias("cluster"))


def _scaled(s, d):
    v = _vectors(s, d).drop("cluster")
    return clustering.standardised(v, "id", [c for c in v.columns if c != "id"])


def _kmeans(s, d):
    rows, centres, _ = clustering.kmeans(_scaled(s, d), "id", 4, 500)
    return clustering.ranked(rows.drop("v"), centres, [1] * len(centres[0]))


def _silhouette(s, d):
    e = table(s, d, "embeddings")
    return clustering.silhouette(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("cluster")), "id")


def _profiles(s, d):
    v = _vectors(s, d).drop("id")
    return clustering.profiles(v, [c for c in v.columns if c != "cluster"])


def _plans(s, d):
    o = table(s, d, "orders")
    a = o.groupBy(F.col("o_custkey").alias("well")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    return a.select("well", F.lit("p").alias("plan"), (F.col("n") % 4 + 1).cast("int").alias("rank"), F.lit(4).alias("k")).unionByName(a.select("well", F.lit("q").alias("plan"), (F.col("m") % 4 + 1).cast("int").alias("rank"), F.lit(4).alias("k")))


def _members(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("well"), (F.col("o_totalprice") / 100).alias("value"))


QUERIES = {
    "mdl01_minimum_curvature": lambda s, d: rounded(_path(s, d).select("well", "md", "dogleg", "north", "east", "tvd"), 4),
    "mdl02_absolute": lambda s, d: rounded(_xyz(s, d), 4),
    "win16_rebuilt_angles": lambda s, d: rounded(trajectory.rebuilt_angles(_xyz(s, d)).where("inc is not null"), 3),
    "join14_at_depths": lambda s, d: rounded(trajectory.at_depths(_xyz(s, d), _asked(s, d), ("x", "y", "z")), 4),
    "mdl04_compared": lambda s, d: rounded(trajectory.compared(_xyz(s, d), _shifted(s, d), 20), 4),
    "mdl06_copies": lambda s, d: trajectory.copies(stations(s, d).select(F.col("well").alias("path_id"), "md", F.col("inc").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).select("copies", "stations").groupBy("copies", "stations").agg(F.count("*").alias("n")),
    "win17_first_crossing": lambda s, d: rounded(trajectory.first_crossing(_diff(s, d)), 4),
    "win18_layer_segments": lambda s, d: rounded(trajectory.layer_segments(_xyz(s, d).withColumn("layer", F.col("md").cast("int").cast("string"))), 4),
    "win21_thinned": lambda s, d: trajectory.thinned(stations(s, d).select("well", "md", "id"), "well", "md", 5),
    "hlp16_bottoms": lambda s, d: rounded(trajectory.bottoms(_xyz(s, d)), 4),
    "srt08_best_path": lambda s, d: trajectory.best_path(stations(s, d).select("well", (F.col("id") % 3).alias("path_id"), "md")),
    "geo02_polygon_areas": lambda s, d: rounded(surfaces.polygon_areas(_rings(s, d))),
    "flt02_points_in_polygons": lambda s, d: surfaces.points_in_polygons(_points(s, d), _rings(s, d), 64.0),
    "join18_sampled": lambda s, d: rounded(_sampled(s, d), 4),
    "mdl27_resampled": lambda s, d: rounded(_resampled(s, d), 4),
    "mdl28_volumes": lambda s, d: rounded(_volumes(s, d), 2),
    "mdl29_preview": lambda s, d: rounded(_preview(s, d), 4),
    "mdl30_quality": lambda s, d: rounded(surfaces.quality(nodes(s, d)), 4),
    "mdl30_missing_map": lambda s, d: rounded(_missing_map(s, d), 4),
    "mdl32_correlations": lambda s, d: surfaces.correlations(_several(s, d), ["a", "b", "c"]),
    "join17_nearest_nodes": lambda s, d: rounded(surfaces.nearest_nodes(_points(s, d), nodes(s, d).where("value is not null").select((F.col("col") * 10.0).alias("x"), (F.col("row") * 10.0 + F.col("col") * 0.013).alias("y"), F.col("value").alias("z")), 10.0, 25.0).select("id", "distance"), 4),
    "mdl07_surface_hits": lambda s, d: rounded(_hits(s, d), 3),
    "mdl10_plane_fit": lambda s, d: rounded(surfaces.plane_fit(nodes(s, d).select(F.col("row").alias("inline"), F.col("col").alias("crossline"), (F.col("row") * 12.5 + F.col("col") * 3 + 1000 + F.col("value") / 100).alias("x"), (F.col("col") * 25.0 - F.col("row") * 2 + 5).alias("y")).where("x is not null")), 5),
    "mdl18_standardised": lambda s, d: rounded(_scaled(s, d).select("id", F.posexplode("v").alias("component", "z")), 5),
    "mdl19_kmeans": _kmeans,
    "mdl20_som": lambda s, d: clustering.som(_scaled(s, d), "id", 4, 50)[0],
    "mdl21_silhouette": lambda s, d: _silhouette(s, d),
    "mdl23_profiles": lambda s, d: rounded(_profiles(s, d), 5),
    "agg35_group_statistics": lambda s, d: rounded(clustering.group_statistics(_members(s, d), "value"), 4),
    "mdl25_plan_agreement": lambda s, d: rounded(clustering.plan_agreement(_plans(s, d)), 5),
    "set07_jaccard": lambda s, d: rounded(clustering.jaccard_by_rank(_plans(s, d), "p", "q"), 6),
    "win22_evenly_spaced": lambda s, d: clustering.evenly_spaced(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 101).select("o_orderkey", F.col("place").cast("long").alias("place")),
}

_R = 3.141592653589793 / 180
_MC = f"""{ST}, v AS (SELECT well, md, arg_max(inc, id) AS inc, arg_max(azi, id) AS azi FROM st WHERE md >= 0 AND inc BETWEEN 0 AND 180 GROUP BY ALL),
 l AS (SELECT *, coalesce(lag(md) OVER w, 0.0) AS md0, coalesce(lag(inc) OVER w, inc) * {_R} AS i0, coalesce(lag(azi) OVER w, azi) * {_R} AS a0, inc * {_R} AS i1, azi * {_R} AS a1 FROM v WINDOW w AS (PARTITION BY well ORDER BY md)),
 g AS (SELECT *, acos(greatest(-1.0, least(1.0, cos(i1 - i0) - sin(i0) * sin(i1) * (1 - cos(a1 - a0))))) AS dog FROM l),
 h AS (SELECT *, (md - md0) / 2 * CASE WHEN dog < 1e-10 THEN 1.0 ELSE 2 / dog * tan(dog / 2) END AS k FROM g),
 mc AS (SELECT well, md, dog / {_R} AS dogleg, sum(k * (sin(i0) * cos(a0) + sin(i1) * cos(a1))) OVER w AS north, sum(k * (sin(i0) * sin(a0) + sin(i1) * sin(a1))) OVER w AS east, sum(k * (cos(i0) + cos(i1))) OVER w AS tvd FROM h WINDOW w AS (PARTITION BY well ORDER BY md ROWS UNBOUNDED PRECEDING))"""
_XYZ = f"{_MC}, xyz AS (SELECT well, md, CAST(substr(well, 2) AS INT) * 10.0 + east AS x, CAST(substr(well, 2) AS INT) * 20.0 + north AS y, 100.0 - tvd AS z FROM mc)"
_SEG = "sg AS (SELECT *, lead(md) OVER w AS m1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM {t} WINDOW w AS (PARTITION BY well ORDER BY md))"
_PTS = "pt AS (SELECT event_id AS id, CAST(event_id * 13 % 420 AS DOUBLE) AS x, CAST(event_id * 29 % ((SELECT max(row) + 1 FROM nodes) * 10 + 30) AS DOUBLE) AS y FROM events)"
_LASTROW = "(SELECT max(row) FROM nodes)"
_VEC = "vc AS (SELECT vec_id AS id, CAST(label AS INT) AS cluster, unnest(range(len(embedding))) AS component, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_PL = "a AS (SELECT o_custkey AS well, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY 1), pl AS (SELECT well, 'p' AS plan, n % 4 + 1 AS rank FROM a UNION ALL SELECT well, 'q', m % 4 + 1 FROM a)"
_BASE = f"WITH {NODES}"
_RINGS = "SELECT {} FROM (SELECT polygon, CAST(area AS DOUBLE) AS area, CAST(min_x AS DOUBLE) AS min_x, CAST(max_x AS DOUBLE) AS max_x, CAST(min_y AS DOUBLE) AS min_y, CAST(max_y AS DOUBLE) AS max_y FROM (VALUES ('square', 37500.0, 50.5, 250.5, 50.5, 250.5), ('triangle', 20000.0, 200.5, 400.5, 300.5, 500.5)) t(polygon, area, min_x, max_x, min_y, max_y))"

ORACLE = {
    "mdl01_minimum_curvature": f"WITH {_MC} SELECT well, md, round(dogleg, 4) AS dogleg, round(north, 4) AS north, round(east, 4) AS east, round(tvd, 4) AS tvd FROM mc",
    "mdl02_absolute": f"WITH {_XYZ} SELECT well, md, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM xyz",
    "join14_at_depths": f"WITH {_XYZ}, {_SEG.format(t='xyz')}, k AS (SELECT DISTINCT well, CAST(unnest([0.0, 45.0, 100.0, 777.0, 1000000.0]) AS DOUBLE) AS q FROM mc), j AS (SELECT k.well, q, sg.md AS m0, x + (x1 - x) * (q - md) / (m1 - md) AS x, y + (y1 - y) * (q - md) / (m1 - md) AS y, z + (z1 - z) * (q - md) / (m1 - md) AS z FROM k LEFT JOIN sg ON sg.well = k.well AND q BETWEEN md AND m1) SELECT well, q AS md, round(arg_min(x, m0), 4) AS x, round(arg_min(y, m0), 4) AS y, round(arg_min(z, m0), 4) AS z FROM j GROUP BY ALL",
    "mdl04_compared": f"""WITH {_XYZ}, b AS (SELECT well, min(md) AS lo, max(md) AS hi FROM xyz GROUP BY well HAVING max(md) > min(md)), q AS (SELECT well, lo + (hi - lo) * i / 20 AS q FROM b, range(0, 21) r(i)), d AS (SELECT well, abs(q / 1000) AS d FROM q)
 SELECT well, round(avg(d), 4) AS mean_distance, round(max(d), 4) AS max_distance, CASE WHEN max(d) <= 1e-6 THEN 'identical' WHEN max(d) <= 2 THEN 'close' WHEN max(d) <= 10 THEN 'near' ELSE 'different' END AS class FROM d GROUP BY well""",
    "win17_first_crossing": f"WITH {_MC}, s AS (SELECT well, md, tvd - 150 AS d, lag(md) OVER w AS m0, lag(tvd - 150) OVER w AS d0 FROM mc WINDOW w AS (PARTITION BY well ORDER BY md)) SELECT well, round(arg_min(CASE WHEN m0 IS NULL OR d0 >= 0 THEN md ELSE m0 + (md - m0) * (-d0) / (d - d0) END, md), 4) AS md FROM s WHERE d >= 0 GROUP BY well",
    "win18_layer_segments": f"WITH {_XYZ}, p AS (SELECT *, CAST(CAST(md AS INT) AS VARCHAR) AS layer FROM xyz), n AS (SELECT *, lead(layer) OVER w AS nl, lead(md) OVER w AS m1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY well ORDER BY md, layer)) SELECT well, layer, nl AS next_layer, round(m1 - md, 4) AS md_thickness, round(abs(z1 - z), 4) AS vertical, round(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)), 4) AS displacement FROM n WHERE nl IS NOT NULL",
    "win21_thinned": f"WITH {ST}, r AS (SELECT well, md, id, row_number() OVER (PARTITION BY well ORDER BY md) AS k, count(*) OVER (PARTITION BY well) AS n FROM st) SELECT well, md, id FROM r WHERE (k - 1) % 5 = 0 OR k = n",
    "hlp16_bottoms": f"WITH {_XYZ}, e AS (SELECT well, max(md) AS md, arg_max(x, md) AS x, arg_max(y, md) AS y, arg_max(z, md) AS z, arg_min(x, md) AS tx, arg_min(y, md) AS ty FROM xyz GROUP BY well) SELECT well, round(md, 4) AS md, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(sqrt(pow(x - tx, 2) + pow(y - ty, 2)), 4) AS reach FROM e",
    "srt08_best_path": f"WITH {ST}, n AS (SELECT well, id % 3 AS path_id, count(*) AS n FROM st GROUP BY ALL) SELECT well, arg_min(path_id, ROW(-n, path_id)) AS path_id, max(n) AS stations FROM n GROUP BY well",
    "win16_rebuilt_angles": f"""WITH {_XYZ}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, md - lag(md) OVER w AS dm FROM xyz WINDOW w AS (PARTITION BY well ORDER BY md)),
 a AS (SELECT well, md, dm, degrees(atan2(sqrt(dx * dx + dy * dy), abs(dz))) AS inc, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-9 THEN degrees(atan2(dx, dy)) - 360 * floor(degrees(atan2(dx, dy)) / 360) END AS az FROM d),
 b AS (SELECT *, last_value(az IGNORE NULLS) OVER (PARTITION BY well ORDER BY md ROWS UNBOUNDED PRECEDING) AS azi FROM a),
 c AS (SELECT *, azi - lag(azi) OVER w + 180 AS q, inc - lag(inc) OVER w AS di FROM b WINDOW w AS (PARTITION BY well ORDER BY md))
 SELECT well, md, round(inc, 3) AS inc, round(azi, 3) AS azi, round(sqrt(pow(di, 2) + pow((q - 360 * floor(q / 360) - 180) * sin(radians(inc)), 2)) / nullif(dm, 0) * 30, 3) AS severity FROM c WHERE inc IS NOT NULL""",
    "mdl06_copies": f"WITH {ST}, g AS (SELECT well, string_agg(CAST(md AS VARCHAR) || '|' || CAST(inc AS VARCHAR), ';' ORDER BY md, inc) AS s, count(*) AS n FROM st GROUP BY well), k AS (SELECT s, count(*) AS copies, any_value(n) AS stations FROM g GROUP BY s) SELECT copies, stations, count(*) AS n FROM k GROUP BY ALL",
    "mdl21_silhouette": """WITH e AS (SELECT vec_id AS id, CAST(label AS INT) AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT a.id, a.cluster AS ca, b.cluster AS cb, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
 p AS (SELECT id, min(d) FILTER (ca = cb) AS own, min(d) FILTER (ca <> cb) AS other FROM d GROUP BY id) SELECT round(avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / nullif(greatest(own, other), 0) END), 4) AS silhouette, count(*) AS n FROM p""",
    "geo02_polygon_areas": _RINGS.format("*"),
    "flt02_points_in_polygons": f"{_BASE}, {_PTS} SELECT id, 'square' AS polygon FROM pt WHERE x > 50.5 AND x < 250.5 AND y > 50.5 AND y < 250.5 AND NOT (x > 100.5 AND x < 150.5 AND y > 100.5 AND y < 150.5) UNION ALL SELECT id, 'triangle' FROM pt WHERE y > 300.5 AND y - 300.5 < 2 * (x - 200.5) AND y - 300.5 < 2 * (400.5 - x)",
    "join18_sampled": f"{_BASE}, {_PTS}, p AS (SELECT *, CAST(round_even(x / 10.0, 0) AS INT) AS c, CAST(round_even(y / 10.0, 0) AS INT) AS r FROM pt) SELECT p.id, CASE WHEN NOT (r BETWEEN 0 AND {_LASTROW} AND c BETWEEN 0 AND 39) THEN 'outside' WHEN value IS NULL THEN 'missing' ELSE 'ok' END AS status, round(CASE WHEN r BETWEEN 0 AND {_LASTROW} AND c BETWEEN 0 AND 39 THEN value END, 4) AS value, round(CASE WHEN r BETWEEN 0 AND {_LASTROW} AND c BETWEEN 0 AND 39 THEN sqrt(pow(x - c * 10.0, 2) + pow(y - r * 10.0, 2)) END, 4) AS distance FROM p LEFT JOIN nodes ON nodes.row = r AND nodes.col = c",
    "mdl27_resampled": f"{_BASE}, t AS (SELECT CAST(i // 40 AS INT) AS row, CAST(i % 40 AS INT) AS col FROM range(0, ({_LASTROW} + 1) * 40) r(i)) SELECT t.row, t.col, round(value, 4) AS value FROM t LEFT JOIN nodes n ON n.row = CAST(round_even((5.0 + t.row * 7.0) / 10.0, 0) AS INT) AND n.col = CAST(round_even((5.0 + t.col * 7.0) / 10.0, 0) AS INT)",
    "mdl28_volumes": f"{_BASE}, g AS (SELECT *, CASE WHEN row IN (0, {_LASTROW}) THEN 0.5 ELSE 1 END * CASE WHEN col IN (0, 39) THEN 0.5 ELSE 1 END AS w FROM nodes WHERE value > 0), v AS (SELECT count(*) AS nodes, sum(w) * 100 AS area, sum(value * w) * 100 AS bulk FROM g), o AS (SELECT *, bulk * 0.8 * 0.2 AS pore, bulk * 0.8 * 0.2 * 0.7 / 1.2 AS oil FROM v) SELECT nodes, round(area, 2) AS area, round(bulk, 2) AS bulk, round(pore, 2) AS pore, round(oil, 2) AS in_place, round(oil * 0.3, 2) AS recoverable, round(oil * 6.28981077, 2) AS in_place_bbl, round(oil * 90, 2) AS gas FROM o",
    "mdl29_preview": f"{_BASE} SELECT row, col, round(value, 4) AS value FROM nodes WHERE row % CAST(ceil(({_LASTROW} + 1) / 20.0) AS INT) = 0 AND col % 2 = 0",
    "mdl30_quality": f"{_BASE}, q AS (SELECT count(*) AS n, count(value) AS valid, " + ", ".join(f"quantile_cont(value, {x}) AS {n}" for n, x in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))) + ", avg(value) AS mean, stddev_pop(value) AS std FROM nodes) SELECT any_value(q.n) AS n, any_value(valid) AS valid, round(any_value((q.n - valid) / q.n * 100), 4) AS missing_pct, " + ", ".join(f"round(any_value({x}), 4) AS {x}" for x in ("p05", "p25", "p50", "p75", "p95", "mean", "std")) + ", count(*) FILTER (value < p25 - 3 * (p75 - p25) OR value > p75 + 3 * (p75 - p25)) AS outliers FROM nodes, q",
    "mdl30_missing_map": f"{_BASE}, g AS (SELECT (max(row) + 1) // 16 AS q, (max(row) + 1) % 16 AS r, max(row) AS m FROM nodes), b AS (SELECT CASE WHEN m - row < r * (q + 1) THEN (m - row) // (q + 1) ELSE r + (m - row - r * (q + 1)) // greatest(q, 1) END AS br, CASE WHEN col < 8 * 3 THEN col // 3 ELSE 8 + (col - 24) // 2 END AS bc, value FROM nodes, g) SELECT CAST(br AS INT) AS block_row, CAST(bc AS INT) AS block_col, round(count(*) FILTER (value IS NULL) / count(*) * 100, 4) AS missing_pct FROM b GROUP BY ALL",
    "mdl32_correlations": f"{_BASE}, w AS (SELECT value AS a, value * 2 + col % 3 AS b, CAST((row * 31 + col * 17) % 23 AS DOUBLE) AS c FROM nodes WHERE value IS NOT NULL), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM w) SELECT x[1] AS a, x[2] AS b, round(r, 4) AS r, abs(round(r, 4)) >= 0.9 AS strong FROM (SELECT ['a', 'b'] AS x, ab AS r FROM r UNION ALL SELECT ['a', 'c'], ac FROM r UNION ALL SELECT ['b', 'c'], bc FROM r)",
    "join17_nearest_nodes": f"{_BASE}, {_PTS}, n AS (SELECT col * 10.0 AS x, row * 10.0 + col * 0.013 AS y FROM nodes WHERE value IS NOT NULL), d AS (SELECT p.id, min(sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2))) AS d FROM pt p JOIN n ON abs(p.x - n.x) <= 25 AND abs(p.y - n.y) <= 25 GROUP BY p.id) SELECT id, round(d, 4) AS distance FROM d WHERE d <= 25",
    "mdl10_plane_fit": f"""{_BASE}, t AS (SELECT row AS i, col AS c, row * 12.5 + col * 3 + 1000 + value / 100 AS x, col * 25.0 - row * 2 + 5 AS y FROM nodes WHERE value IS NOT NULL), m AS (SELECT count(*) AS n, avg(i) AS mi, avg(c) AS mc, avg(x) AS mx, avg(y) AS my FROM t),
 s AS (SELECT any_value(n) AS n, any_value(mi) AS mi, any_value(mc) AS mc, any_value(mx) AS mx, any_value(my) AS my, sum((i-mi)*(i-mi)) AS ii, sum((i-mi)*(c-mc)) AS ic, sum((c-mc)*(c-mc)) AS cc, sum((i-mi)*(x-mx)) AS ix, sum((c-mc)*(x-mx)) AS cx, sum((i-mi)*(y-my)) AS iy, sum((c-mc)*(y-my)) AS cy FROM t, m),
 k AS (SELECT *, (ix*cc - cx*ic) / (ii*cc - ic*ic) AS xi, (cx*ii - ix*ic) / (ii*cc - ic*ic) AS xc, (iy*cc - cy*ic) / (ii*cc - ic*ic) AS yi, (cy*ii - iy*ic) / (ii*cc - ic*ic) AS yc FROM s)
 SELECT n, round(xi, 5) AS x_inline, round(xc, 5) AS x_crossline, round(mx - xi * mi - xc * mc, 5) AS x_0, round(yi, 5) AS y_inline, round(yc, 5) AS y_crossline, round(my - yi * mi - yc * mc, 5) AS y_0 FROM k""",
    "mdl18_standardised": f"WITH {_VEC}, s AS (SELECT component, avg(v) AS a, stddev_pop(v) AS s FROM vc GROUP BY component) SELECT id, CAST(component AS INT) AS component, round((v - a) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS z FROM vc JOIN s USING (component)",
    "mdl23_profiles": f"WITH {_VEC} SELECT cluster, 'f' || component AS feature, count(*) AS n, round(quantile_cont(v, 0.25), 5) AS q1, round(quantile_cont(v, 0.5), 5) AS q2, round(quantile_cont(v, 0.75), 5) AS q3 FROM vc GROUP BY ALL",
    "agg35_group_statistics": "SELECT o_orderpriority AS grp, count(DISTINCT o_custkey) AS wells, count(*) - count(DISTINCT o_custkey) AS repeats, round(quantile_cont(o_totalprice / 100, 0.1), 4) AS p10, round(quantile_cont(o_totalprice / 100, 0.5), 4) AS p50, round(quantile_cont(o_totalprice / 100, 0.9), 4) AS p90 FROM orders GROUP BY 1",
    "mdl25_plan_agreement": f"WITH {_PL}, s AS (SELECT well, quantile_cont(rank / 4.0, 0.9) - quantile_cont(rank / 4.0, 0.1) AS d FROM pl GROUP BY well) SELECT well, round(d, 5) AS spread, round(greatest(0.0, 1 - d), 5) AS reliability, d <= 0.2 AS stable FROM s",
    "set07_jaccard": f"WITH {_PL}, x AS (SELECT rank, well FROM pl WHERE plan = 'p'), y AS (SELECT rank, well FROM pl WHERE plan = 'q') SELECT CAST(rank AS INT) AS rank, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM (SELECT coalesce(x.rank, y.rank) AS rank, x.well IS NOT NULL AS a, y.well IS NOT NULL AS b FROM x FULL JOIN y ON x.rank = y.rank AND x.well = y.well) GROUP BY rank",
    "win22_evenly_spaced": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders) SELECT o_orderkey, place FROM r WHERE place IN (SELECT CAST(round_even(i * (n - 1) / 100.0, 0) AS BIGINT) FROM range(0, 101) t(i))",
}
_EXACT = ("mdl32_correlations", "mdl21_silhouette")
ORACLE = {k: v if k in _EXACT else rounding_alike(v) for k, v in ORACLE.items()}

"""Well, curve and catalogue queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions import scalars
from wellspring.functions.text import clean_text, finite_number, well_key
from wellspring.operators import catalog, curves, wells
from wellspring.plans.relations import CURVE_TYPE, FILES, IV, MATCH_SCORE, PM, SAMPLES, SIMILARITY, SPANNED, SRC, WELL_KEYS, files, intervals, pair_ratio, pm, rounded, rounding_alike, samples, sources_kind, spanned_curves
from wellspring.plans.relations import curves as las
from wellspring.tables import table


def _mentions(s, d):
    return table(s, d, "well_sources")


def _sources(s, d):
    return table(s, d, "sources")


def _wells(s, d):
    return table(s, d, "wells")


def _resolve(s, d):
    m = _mentions(s, d).select("id", well_key(F.col("raw_name")).alias("key"), "uwi")
    a = table(s, d, "horizon_name_groups").select(F.col("canonical_key").alias("alias"), F.lower("canonical_key").alias("canonical"))
    return wells.resolve_wells(m, a, _wells(s, d).select("id", F.col("normalized_key").alias("key"), "uwi"))


def _chain(s, d):
    n = table(s, d, "nation")
    return n.where("n_nationkey > 0").select(F.col("n_nationkey").cast("string").alias("alias"), F.floor(F.col("n_nationkey") / 2).cast("string").alias("canonical"))


def _named(s, d):
    return _wells(s, d).select("id", F.col("canonical_name").alias("name"), F.col("normalized_key").alias("key"), "uwi", "x", "y")


def _mention_names(s, d):
    """Every mention's name against that of its well."""
    return _mentions(s, d).join(_wells(s, d).select(F.col("id").alias("well_id"), F.col("normalized_key").alias("b")), "well_id").select("id", F.col("normalized_name").alias("a"), "b")


def _places(s, d):
    return _wells(s, d).select("id", "x", "y", F.substring("normalized_key", 1, 3).alias("formation"))


def _sets(s, d):
    c = las(s, d).where("well_id is not null").select(F.col("well_id").alias("well_key"), F.upper("mnemonic").alias("m"))
    return {"gr": c.where("m = 'GR'"), "rt": c.where("m = 'RT'"), "dts": c.where("m = 'DTS'")}


def _filtered(s, d, all_of):
    return curves.with_conditions(_wells(s, d).select(F.col("id").alias("well_key")), _sets(s, d), [("gr", True), ("rt", True), ("dts", False)], all_of)


def _points(s, d):
    i = intervals(s, d)
    return i.select(F.col("id").alias("point"), "well", ((F.col("top") + F.col("base")) / 2).alias("md"))


def _distinct(s, d):
    """Intervals, exact copies once."""
    return intervals(s, d).groupBy("well", "top", "base").agg(F.min("id").alias("id"))


def _flat(s, d, m):
    c = las(s, d).where(F.upper("mnemonic") == m).where("well_id is not null and not isnan(value_min) and not isnan(value_max)")
    return c.select("well_id", F.col("value_min").alias("low"), F.col("value_max").alias("high"))


def _scalar_counts(s, d):
    src = _sources(s, d).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "ready").alias("ready"), F.sum("record_count").alias("records"))
    w = _wells(s, d).agg(F.count("*").alias("wells"), F.count("uwi").alias("with_uwi"))
    c = las(s, d).agg(F.countDistinct("las_file_id").alias("las_files"), F.countDistinct(F.upper("mnemonic")).alias("mnemonics"))
    return src.crossJoin(w).crossJoin(c)  # one row each


QUERIES = {
    "agg01_counts": _scalar_counts,
    "agg02_source_breakdown": lambda s, d: wells.source_breakdown(_mentions(s, d), _sources(s, d)),
    "ing02_resolved_wells": _resolve,
    "ing03_preferred_attributes": lambda s, d: wells.preferred_attributes(_mentions(s, d), _sources(s, d)),
    "agg31_evidence_matrix": lambda s, d: wells.evidence_matrix(_mentions(s, d), _sources(s, d)),
    "sc08_coordinate_spread": lambda s, d: rounded(wells.coordinate_spread(_mentions(s, d)), 3),
    "sc09_identity_classes": lambda s, d: wells.identity_classes(_mentions(s, d), _sources(s, d)),
    "agg30_coordinate_overlaps": lambda s, d: wells.coordinate_overlaps(table(s, d, "well_head").select(F.col("well_name").alias("well"), "x", "y")),
    "flt01_box": lambda s, d: wells.in_box(_wells(s, d), 400000, 4000000, 420000, 4005000).select("id", "canonical_name"),
    "join24_merged": lambda s, d: wells.merged(_wells(s, d).select(F.col("normalized_key").alias("key"), F.lit("imported").alias("origin")), table(s, d, "well_head").select(well_key(F.col("well_name")).alias("key"), F.lit("scanned").alias("origin")).distinct(), "key"),
    "join08_alias_chains": lambda s, d: wells.transitive(_chain(s, d)),
    "join16_nearest": lambda s, d: rounded(wells.nearest_same_formation(_places(s, d)), 4),
    "join20_near_names": lambda s, d: wells.near_names(_wells(s, d).select("id", F.col("normalized_key").alias("key"))),
    "join21_multi_key_links": lambda s, d: wells.multi_key_links(_named(s, d)),
    "sc06_identity_similarity": lambda s, d: _mention_names(s, d).select("id", F.round(wells.identity_similarity_udf("a", "b"), 6).alias("score")),
    "sc07_match_score": lambda s, d: _mention_names(s, d).select("id", F.round(wells.well_match_score_udf("a", "b"), 6).alias("score")),
    "mdl37_identity_suggestions": lambda s, d: wells.identity_suggestions(_named(s, d)),
    "join05_sources_with_rows": lambda s, d: _sources(s, d).join(pm(s, d).select(F.col("source_id").alias("id")).distinct(), "id", "left_semi").select("id", "filename"),
    "join01_rows_by_kind": lambda s, d: pm(s, d).join(sources_kind(s, d), "source_id").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("well_key").alias("wells")),
    "join04_not_catalogued": lambda s, d: catalog.anti_catalog(_sources(s, d).select("id", "file_path"), files(s, d).where("kind <> 'production'")).select("id"),
    "join07_well_keys": lambda s, d: pm(s, d).groupBy("well_key").agg(F.count("*").alias("months")).join(_wells(s, d).select(F.col("normalized_key").alias("well_key"), "id"), "well_key", "full"),
    "set01_all_well_keys": lambda s, d: pm(s, d).select("well_key").union(_wells(s, d).select("normalized_key")).distinct(),
    "set04_curve_wells": lambda s, d: curves.compare(_flat(s, d, "GR"), _flat(s, d, "RT")).select("both", "only_a", "only_b", F.round(F.col("similarity") + 1.3e-7, 6).alias("similarity")),
    "set09_wells_without_heads": lambda s, d: _wells(s, d).select(F.col("normalized_key").alias("key")).join(table(s, d, "well_head").select(well_key(F.col("well_name")).alias("key")), "key", "left_anti"),
    "agg03_curve_statistics": lambda s, d: curves.statistics(las(s, d)),
    "agg06_type_coverage": lambda s, d: curves.type_coverage(las(s, d)),
    "agg07_modal_units": lambda s, d: curves.modal(las(s, d).select(F.upper("mnemonic").alias("mnemonic"), F.upper("unit").alias("unit"), "id"), "mnemonic", "unit", "id"),
    "agg08_description": lambda s, d: rounded(curves.description(samples(s, d), "series", "value"), 4),
    "agg09_histogram": lambda s, d: rounded(curves.histogram(samples(s, d), "series", "value").select("series", "bin", "n")),
    "flt05_filter_all": lambda s, d: _filtered(s, d, True),
    "flt05_filter_any": lambda s, d: _filtered(s, d, False),
    "flt09_time_depth": lambda s, d: curves.time_depth_curves(las(s, d)),
    "join10_within": lambda s, d: curves.within(_points(s, d), intervals(s, d), "well", 25.0).select("well", "point", "id"),
    "join11_overlaps": lambda s, d: rounded(curves.overlaps(_distinct(s, d), _distinct(s, d), "well", 25.0).where("a_id < b_id"), 4),
    "mdl36_focus": lambda s, d: curves.focus(spanned_curves(s, d)),
    "mdl46_typed_curves": lambda s, d: curves.typed(las(s, d)).select("id", "curve_type", "how"),
    "agg39_presence": lambda s, d: curves.presence(las(s, d).select("well_id", F.upper("mnemonic").alias("mnemonic")), "mnemonic"),
    "ing07_unpivoted": lambda s, d: curves.unpivoted(table(s, d, "interpretation_v1").select("row_no", "well", "phi", "perm", "sw", "facies"), ["row_no", "well"]).select("row_no", "attribute", F.round(F.col("number") + 1.3e-7, 6).alias("number")),
    "agg04_interpretation": lambda s, d: curves.unpivoted(table(s, d, "interpretation_v1").select("row_no", "well", "phi", "perm", "sw", "facies"), ["row_no", "well"]).groupBy("attribute").agg(F.count("*").alias("n"), F.countDistinct("well").alias("wells")),
    "src34_catalog": lambda s, d: files(s, d),
    "agg15_composition": lambda s, d: catalog.composition(files(s, d)),
    "agg16_categories": lambda s, d: catalog.overlapping_categories(files(s, d), {"tables": F.col("ext") == "csv", "logs": F.col("kind") == "well_log", "large": F.col("size") > 2000}),
    "agg17_folders": lambda s, d: catalog.folders(files(s, d)),
    "agg19_facets": lambda s, d: catalog.facets(files(s, d)),
    "agg18_coverage": lambda s, d: catalog.coverage({"production": pm(s, d).select("well_key"), "wells": _wells(s, d).select(F.col("normalized_key").alias("well_key")), "documents": table(s, d, "documents").where("well_key is not null").select("well_key")}, "well_key"),
    "agg21_overlay": lambda s, d: catalog.live_overlay(s.createDataFrame([(k,) for k in ("well_log", "seismic", "deviation", "polygon", "core")], "kind string"), files(s, d)),
    "srt06_representative": lambda s, d: catalog.representative(files(s, d)),
    "srt03_page": lambda s, d: catalog.page(files(s, d).select("path", "size"), [F.lower("path"), F.col("path")], 2, 20),
    "mdl44_tiers": lambda s, d: catalog.tiers(_wells(s, d).select("id", F.col("canonical_name").alias("name")), "s-01"),
    "agg27_layer_registry": lambda s, d: catalog.layer_registry(table(s, d, "horizon_name_aliases")),
    "snk15_latest": lambda s, d: catalog.latest(table(s, d, "horizon_name_aliases").select(F.col("alias_key").alias("k"), "alias_id", "created_at", "alias_name"), ["k"], ["created_at", "alias_id"]).select("k", "alias_id", "alias_name"),
    "hlp24_sources_newest": lambda s, d: _sources(s, d).orderBy(F.desc("imported_at"), F.desc("id")).select("id", "filename"),
    "sc01_text_keys": lambda s, d: table(s, d, "well_head").select("row_no", well_key(F.col("well_name")).alias("k"), clean_text(F.col("remark")).alias("remark"), finite_number(F.col("total_depth").cast("string")).alias("depth")),
    "sc04_layer_keys": lambda s, d: table(s, d, "horizon_name_aliases").select("alias_id", scalars.layer_key(F.col("alias_name")).alias("k")),
    "sc05_file_keys": lambda s, d: _sources(s, d).select("id", scalars.file_well_key(F.col("filename")).alias("k"), scalars.extension(F.col("filename")).alias("ext")),
    "sc13_dates": lambda s, d: pm(s, d).select("id", scalars.date_parts(F.col("month")).alias("parts"), scalars.days_in_month(F.col("month")).alias("days")),
    "sc25_repointed": lambda s, d: _sources(s, d).where("file_path is not null").select("id", scalars.repointed(F.col("file_path"), "/Archive/batch02", "/new").alias("p")),
    "sc34_json": lambda s, d: _sources(s, d).select("id", F.get_json_object("metadata_json", "$.encoding").alias("encoding"), F.get_json_object("metadata_json", "$.rows_skipped").try_cast("int").alias("skipped")),
    "sc32_signature": lambda s, d: files(s, d).groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("size").cast("string")))), ";"), 256).alias("signature")),
    "sc36_angles": lambda s, d: table(s, d, "events").select("event_id", F.round(scalars.signed_angle(F.col("event_id") * 7.5) + 1.3e-7, 6).alias("signed"), F.round(scalars.whole_angle(F.col("event_id") * -7.5) + 1.3e-7, 6).alias("whole")),
}

_KEY = lambda c: f"regexp_replace(upper(trim({c})), '[^0-9A-Z一-鿿]', '', 'g')"
_TYPE = CURVE_TYPE
_TY = f"ty AS (SELECT *, {_TYPE} AS curve_type FROM las_curves)"
_VALID = "value IS NOT NULL AND isfinite(value) AND abs(value) < 1e29 AND " + " AND ".join(f"abs(value - ({x})) > 1e-6" for x in scalars.SENTINELS)
_CLEAN = lambda c: f"CASE WHEN upper(trim({c})) NOT IN ('', 'NULL', 'NONE', 'N/A', 'NA', 'NAN', '-999.25') THEN {c} END"
_HAS = "h AS (SELECT w.id AS well_key, bool_or(upper(c.mnemonic) = 'GR') AS gr, bool_or(upper(c.mnemonic) = 'RT') AS rt, bool_or(upper(c.mnemonic) = 'DTS') AS dts FROM wells w LEFT JOIN las_curves c ON c.well_id = w.id GROUP BY w.id)"
_LONG = "lg AS (SELECT row_no, well, attribute, t AS text FROM (UNPIVOT (SELECT row_no, well, CASE WHEN isnan(phi) THEN NULL ELSE CAST(phi AS VARCHAR) END AS phi, CASE WHEN isnan(perm) THEN NULL ELSE CAST(perm AS VARCHAR) END AS perm, CASE WHEN isnan(sw) THEN NULL ELSE CAST(sw AS VARCHAR) END AS sw, facies FROM interpretation_v1) ON phi, perm, sw, facies INTO NAME attribute VALUE t) WHERE upper(trim(t)) NOT IN ('', 'NULL', 'NONE', 'N/A', 'NA', 'NAN', '-999.25'))"

_BLOCK = "CASE WHEN regexp_matches(normalized_key, '[0-9]') THEN 'N:' || array_to_string(regexp_extract_all(normalized_key, '[0-9]+'), '-') ELSE 'P:' || substr(normalized_key, 1, 4) END"
_SAID = "m AS (SELECT s.id, regexp_replace(upper(normalized_name), '[^0-9A-Z一-鿿]', '', 'g') AS ka, normalized_key AS kb FROM well_sources s JOIN wells w ON w.id = s.well_id), pr AS (SELECT row_number() OVER () AS pid, ka, kb FROM (SELECT DISTINCT ka, kb FROM m))"
_SIM = SIMILARITY
_SCORE = MATCH_SCORE
_KEYS = WELL_KEYS

ORACLE = {
    "agg01_counts": "SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE status = 'ready') AS ready, (SELECT CAST(sum(record_count) AS BIGINT) FROM sources) AS records, (SELECT count(*) FROM wells) AS wells, (SELECT count(uwi) FROM wells) AS with_uwi, (SELECT count(DISTINCT las_file_id) FROM las_curves) AS las_files, (SELECT count(DISTINCT upper(mnemonic)) FROM las_curves) AS mnemonics",
    "agg02_source_breakdown": f"WITH {SRC}, r AS (SELECT * FROM src WHERE status = 'ready'), f AS (SELECT kind, count(*) AS files, CAST(sum(record_count) AS BIGINT) AS records FROM r GROUP BY kind), w AS (SELECT kind, count(DISTINCT well_id) AS wells FROM well_sources m JOIN r ON r.id = m.source_id GROUP BY kind) SELECT kind, files, records, coalesce(wells, 0) AS wells FROM f LEFT JOIN w USING (kind)",
    "ing02_resolved_wells": f"""WITH m AS (SELECT id, {_KEY('raw_name')} AS key, uwi FROM well_sources), a AS (SELECT m.*, g.canonical_key AS al, coalesce(lower(g.canonical_key), m.key) AS known FROM m LEFT JOIN horizon_name_groups g ON g.canonical_key = m.key),
 u AS (SELECT uwi, min(id) AS uid FROM wells WHERE uwi IS NOT NULL GROUP BY uwi) SELECT a.id, coalesce(w.id, u.uid) AS well_id, CASE WHEN w.id IS NOT NULL THEN CASE WHEN al IS NOT NULL THEN 'alias' ELSE 'key' END WHEN u.uid IS NOT NULL THEN 'uwi' ELSE 'new' END AS how FROM a LEFT JOIN wells w ON w.normalized_key = a.known LEFT JOIN u ON u.uwi = a.uwi""",
    "ing03_preferred_attributes": f"""WITH {SRC}, r AS (SELECT m.*, kind, CASE kind WHEN 'well_head' THEN 90 WHEN 'deviation' THEN 76 WHEN 'las' THEN 62 WHEN 'core' THEN 54 WHEN 'interpretation' THEN 48 WHEN 'production' THEN 44 ELSE 30 END AS p FROM well_sources m JOIN src ON src.id = m.source_id WHERE well_id IS NOT NULL),
 g AS (SELECT well_id, arg_max(uwi, ROW(p, -r.id)) FILTER (uwi IS NOT NULL) AS uwi, {", ".join(f"arg_max({c}, ROW(p, -r.id)) FILTER ({c} IS NOT NULL AND NOT isnan({c})) AS {c}" for c in ("x", "y", "kb_elevation", "total_depth"))}, max(p) AS top, count(DISTINCT kind) AS k FROM r GROUP BY well_id)
 SELECT well_id, uwi, x, y, kb_elevation, total_depth, CAST(least(100, top + CASE WHEN uwi IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 3 ELSE 0 END + least(4, 2 * (k - 1))) AS INT) AS confidence FROM g""",
    "agg31_evidence_matrix": f"WITH {SRC}, r AS (SELECT DISTINCT well_id, source_id, kind FROM well_sources m JOIN src ON src.id = m.source_id WHERE well_id IS NOT NULL) SELECT well_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("well_head", "deviation", "las", "core", "interpretation", "production", "other")) + " FROM r GROUP BY well_id",
    "sc08_coordinate_spread": "SELECT well_id, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)), 3) AS spread, count(*) AS n FROM well_sources WHERE well_id IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY well_id",
    "sc09_identity_classes": f"""WITH {SRC}, k AS (SELECT well_id, count(DISTINCT kind) FILTER (kind IN ('well_head', 'deviation', 'las')) AS n FROM well_sources m JOIN src ON src.id = m.source_id WHERE well_id IS NOT NULL GROUP BY well_id),
 sp AS (SELECT well_id, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS spread FROM well_sources WHERE well_id IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY well_id)
 SELECT well_id, CAST(CASE WHEN n = 0 THEN 40 WHEN coalesce(spread, 0) > 5 THEN 68 WHEN n >= 2 THEN least(98, 84 + 4 * n) ELSE 80 END AS INT) AS score FROM k LEFT JOIN sp USING (well_id)""",
    "agg30_coordinate_overlaps": "SELECT round(x, 2) AS x, round(y, 2) AS y, count(DISTINCT well_name) AS wells FROM well_head WHERE NOT isnan(x) AND NOT isnan(y) GROUP BY ALL HAVING count(DISTINCT well_name) > 1",
    "flt01_box": "SELECT id, canonical_name FROM wells WHERE x BETWEEN 400000 AND 420000 AND y BETWEEN 4000000 AND 4005000",
    "join24_merged": f"SELECT normalized_key AS key, 'imported' AS origin FROM wells UNION ALL SELECT key, 'scanned' FROM (SELECT DISTINCT {_KEY('well_name')} AS key FROM well_head) h WHERE NOT EXISTS (SELECT 1 FROM wells w WHERE w.normalized_key = h.key)",
    "join08_alias_chains": "WITH RECURSIVE r(a, c) AS (SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0 UNION ALL SELECT a, c // 2 FROM r WHERE c > 0) SELECT CAST(a AS VARCHAR) AS alias, CAST(min(c) AS VARCHAR) AS canonical FROM r GROUP BY a",
    "join16_nearest": "WITH g AS (SELECT id, x, y, substr(normalized_key, 1, 3) AS f FROM wells WHERE NOT isnan(x) AND NOT isnan(y)), d AS (SELECT a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) FILTER (a.f = b.f) AS s, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS o FROM g a JOIN g b ON a.id <> b.id GROUP BY a.id) SELECT id, round(coalesce(s, o), 4) AS distance FROM d",
    "join20_near_names": f"""WITH w AS (SELECT id, normalized_key AS key, {_BLOCK} AS bl FROM wells), o AS (SELECT *, row_number() OVER (ORDER BY key, id) AS n FROM w)
 SELECT a.id, (SELECT min(id) FROM w WHERE w.bl = a.bl) AS class_id, (SELECT count(*) FROM o b WHERE b.id <> a.id AND (b.bl = a.bl OR abs(b.n - a.n) <= 3)) AS links FROM o a""",
    "join21_multi_key_links": f"""WITH {_KEYS} SELECT a.id, CASE WHEN a.d IS NOT NULL THEN (SELECT min(id) FROM k WHERE k.d = a.d) END AS digits_class, CASE WHEN a.v IS NOT NULL THEN (SELECT min(id) FROM k WHERE k.v = a.v) END AS bare_class,
 CASE WHEN a.p IS NOT NULL THEN (SELECT min(id) FROM k WHERE k.p = a.p) END AS place_class, (SELECT count(*) FROM k b WHERE b.id <> a.id AND (b.d = a.d OR b.v = a.v OR b.p = a.p)) AS links FROM k a""",
    "sc06_identity_similarity": f"WITH {_SAID}, {pair_ratio('pr', 18)}, {_SIM} SELECT m.id, round(sim, 6) AS score FROM m JOIN sim USING (ka, kb)",
    "sc07_match_score": f"WITH {_SAID}, {pair_ratio('pr', 18)}, {_SIM}, {_SCORE} SELECT m.id, round(score, 6) AS score FROM m JOIN score USING (ka, kb)",
    "mdl37_identity_suggestions": f"""WITH w AS (SELECT *, normalized_key AS key, {_BLOCK} AS bl FROM wells), n AS (SELECT *, row_number() OVER (ORDER BY key, id) AS n, count(*) OVER (PARTITION BY bl) AS size, row_number() OVER (PARTITION BY bl ORDER BY key, id) AS q, row_number() OVER (PARTITION BY bl ORDER BY reverse(key), id) AS r, row_number() OVER (PARTITION BY bl ORDER BY regexp_replace(key, '[AEIOU]', '', 'g'), id) AS v FROM w),
 m AS (SELECT a.id AS a, b.id AS b, a.key AS ka, b.key AS kb, a.uwi = b.uwi AS same, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 5 AS near FROM n a JOIN n b ON a.id < b.id AND (abs(a.n - b.n) <= 3 OR a.bl = b.bl AND (a.size <= 200 OR abs(a.q - b.q) <= 6 OR abs(a.r - b.r) <= 6 OR abs(a.v - b.v) <= 6))),
 pr AS (SELECT row_number() OVER () AS pid, ka, kb FROM (SELECT DISTINCT ka, kb FROM m)), {pair_ratio('pr')}, {_SIM}
 SELECT a, b, round(least(1.0, CASE WHEN same THEN 1.0 ELSE sim END + CASE WHEN near THEN 0.08 ELSE 0 END), 6) AS score FROM m JOIN sim USING (ka, kb) WHERE score >= 0.72 ORDER BY score DESC, a, b LIMIT 100""",
    "join05_sources_with_rows": f"WITH {PM} SELECT id, filename FROM sources WHERE id IN (SELECT source_id FROM pm)",
    "join01_rows_by_kind": f"WITH {PM}, {SRC} SELECT kind, count(*) AS n, count(DISTINCT well_key) AS wells FROM pm JOIN src ON src.id = pm.source_id GROUP BY kind",
    "join04_not_catalogued": f"WITH {FILES} SELECT id FROM sources WHERE file_path IS NOT NULL AND lower(file_path) NOT IN (SELECT lower(path) FROM ct WHERE kind <> 'production')",
    "join07_well_keys": f"WITH {PM}, k AS (SELECT well_key, count(*) AS months FROM pm GROUP BY well_key) SELECT coalesce(k.well_key, w.normalized_key) AS well_key, months, w.id FROM k FULL JOIN wells w ON w.normalized_key = k.well_key",
    "set01_all_well_keys": f"WITH {PM} SELECT well_key FROM pm UNION SELECT normalized_key FROM wells",
    "set04_curve_wells": "WITH c AS (SELECT well_id, upper(mnemonic) AS m, min(value_min) AS l, max(value_max) AS h FROM las_curves WHERE well_id IS NOT NULL AND NOT isnan(value_min) AND NOT isnan(value_max) GROUP BY ALL), a AS (SELECT * FROM c WHERE m = 'GR'), b AS (SELECT * FROM c WHERE m = 'RT'), j AS (SELECT a.l AS al, a.h AS ah, b.l AS bl, b.h AS bh FROM a FULL JOIN b USING (well_id)) SELECT count(*) FILTER (al IS NOT NULL AND bl IS NOT NULL) AS both, count(*) FILTER (bl IS NULL) AS only_a, count(*) FILTER (al IS NULL) AS only_b, round(quantile_cont(CASE WHEN al IS NOT NULL AND bl IS NOT NULL THEN greatest(0, least(ah, bh) - greatest(al, bl)) / nullif(greatest(ah, bh) - least(al, bl), 0) END, 0.5), 6) AS similarity FROM j",
    "set09_wells_without_heads": f"SELECT normalized_key AS key FROM wells WHERE normalized_key NOT IN (SELECT {_KEY('well_name')} FROM well_head WHERE well_name IS NOT NULL)",
    "agg03_curve_statistics": f"SELECT upper(trim(mnemonic)) AS mnemonic, count(DISTINCT well_id) AS wells, count(DISTINCT las_file_id) AS files, coalesce(string_agg(DISTINCT upper(trim({_CLEAN('unit')})), ',' ORDER BY upper(trim({_CLEAN('unit')}))), '') AS units, CAST(sum(sample_count) AS BIGINT) AS samples, min(value_min) FILTER (isfinite(value_min)) AS low, max(value_max) FILTER (isfinite(value_max)) AS high FROM las_curves GROUP BY 1",
    "agg06_type_coverage": f"WITH {_TY}, n AS (SELECT count(DISTINCT well_id) AS n FROM las_curves) SELECT curve_type, count(DISTINCT well_id) AS wells, round(count(DISTINCT well_id) / any_value(n) * 100, 2) AS pct FROM ty, n WHERE well_id IS NOT NULL AND curve_type IS NOT NULL GROUP BY curve_type",
    "agg07_modal_units": "WITH g AS (SELECT upper(mnemonic) AS mnemonic, upper(unit) AS u, count(*) AS n, min(id) AS f FROM las_curves WHERE unit IS NOT NULL GROUP BY ALL) SELECT mnemonic, arg_max(u, ROW(n, -f)) AS mode, count(DISTINCT u) AS kinds, count(DISTINCT u) > 1 AS mixed FROM g GROUP BY mnemonic",
    "agg08_description": f"WITH {SAMPLES} SELECT series, count(*) AS n, round(min(value), 4) AS low, {', '.join(f'round(quantile_cont(value, {q}), 4) AS {n}' for n, q in (('p05', .05), ('p25', .25), ('p50', .5), ('p75', .75), ('p95', .95)))}, round(max(value), 4) AS high, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM samples WHERE {_VALID} GROUP BY series",
    "agg09_histogram": f"WITH {SAMPLES}, v AS (SELECT * FROM samples WHERE {_VALID}), l AS (SELECT series, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM v GROUP BY series), b AS (SELECT series, CAST(least(27, greatest(0, floor((value - lo) / (hi - lo) * 28))) AS INT) AS bin, count(*) AS n FROM v JOIN l USING (series) GROUP BY ALL), e AS (SELECT series, CAST(r.range AS INT) AS bin FROM l, range(0, 28) r) SELECT e.series, e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN b USING (series, bin)",
    "flt05_filter_all": f"WITH {_HAS} SELECT well_key FROM h WHERE coalesce(gr, false) AND coalesce(rt, false) AND NOT coalesce(dts, false)",
    "flt05_filter_any": f"WITH {_HAS} SELECT well_key FROM h WHERE coalesce(gr, false) OR coalesce(rt, false) OR NOT coalesce(dts, false)",
    "flt09_time_depth": "WITH m AS (SELECT id, regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g') AS k FROM las_curves) SELECT id, CASE WHEN k LIKE 'TWT%' THEN 'twt' WHEN regexp_matches(k, '^(OWT|ONEWAYTIME)') THEN 'owt' ELSE 'time_depth' END AS relation FROM m WHERE regexp_matches(k, '^(ONEWAYTIME|OWT|TWT|GENERALTIME|VELOCITY)')",
    "join10_within": f"WITH {IV} SELECT p.well, p.id AS point, i.id FROM iv p JOIN iv i ON i.well = p.well AND (p.top + p.base) / 2 BETWEEN i.top AND i.base",
    "join11_overlaps": f"WITH {IV}, u AS (SELECT well, top, base, min(id) AS id FROM iv GROUP BY ALL) SELECT a.well, a.id AS a_id, b.id AS b_id, round(least(a.base, b.base) - greatest(a.top, b.top), 4) AS shared, b.top <= a.top AND b.base >= a.base AS covered FROM u a JOIN u b ON a.well = b.well AND a.id < b.id AND greatest(a.top, b.top) < least(a.base, b.base)",
    "mdl36_focus": f"""WITH {SPANNED}, ty AS (SELECT *, {_TYPE} AS curve_type FROM sc), r AS (SELECT *, nullif(upper(trim(unit)), '') AS u, greatest(0, stop - start) AS span, nullif(abs(step), 0) AS st FROM ty WHERE well_id IS NOT NULL AND curve_type IS NOT NULL AND NOT regexp_matches(regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g'), '^(ONEWAYTIME|OWT|TWT|GENERALTIME|VELOCITY)')),
 m AS (SELECT well_id, curve_type, max(span) AS most FROM r GROUP BY ALL), n AS (SELECT curve_type, u, count(*) AS n, min(id) AS f FROM r WHERE u IS NOT NULL GROUP BY ALL), k AS (SELECT curve_type, arg_max(u, ROW(n, -f)) AS usual FROM n GROUP BY curve_type),
 s AS (SELECT r.*, round((0.40 * span / coalesce(nullif(most, 0), 1) + 0.34 * CASE WHEN sample_count IS NULL THEN 0.55 WHEN st IS NULL THEN 1 ELSE least(1, sample_count / (span / st + 1)) END + CASE WHEN regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g') = CASE curve_type {" ".join(f"WHEN '{t}' THEN '{r}'" for t, r, _ in curves.CURVE_TYPES)} END THEN 0.10 ELSE 0 END
  + CASE WHEN usual IS NULL OR u IS NULL OR u = usual THEN 0.06 ELSE 0 END + CASE WHEN value_max > value_min THEN 0.06 ELSE 0 END + CASE WHEN st IS NOT NULL THEN 0.04 ELSE 0 END) * 100, 1) AS score FROM r JOIN m USING (well_id, curve_type) LEFT JOIN k USING (curve_type))
 SELECT well_id, curve_type, arg_max(id, ROW(score, span, upper(mnemonic), -id)) AS curve_id, max(score) AS score, count(*) AS candidates FROM s GROUP BY ALL""",
    "mdl46_typed_curves": f"WITH {_TY} SELECT id, curve_type, CASE WHEN curve_type IS NOT NULL THEN 'automatic' ELSE 'unclassified' END AS how FROM ty",
    "agg39_presence": "WITH p AS (SELECT DISTINCT upper(mnemonic) AS mnemonic, well_id FROM las_curves WHERE well_id IS NOT NULL), n AS (SELECT mnemonic, count(*) AS wells FROM p GROUP BY 1) SELECT mnemonic, well_id, wells, wells = (SELECT count(DISTINCT well_id) FROM p) AS common FROM p JOIN n USING (mnemonic)",
    "ing07_unpivoted": f"WITH {_LONG} SELECT row_no, attribute, round(CASE WHEN isfinite(try_cast(text AS DOUBLE)) THEN try_cast(text AS DOUBLE) END, 6) AS number FROM lg",
    "agg04_interpretation": f"WITH {_LONG} SELECT attribute, count(*) AS n, count(DISTINCT well) AS wells FROM lg GROUP BY attribute",
    "src34_catalog": f"WITH {FILES} SELECT path, size, ext, kind, folder, well_key FROM ct",
    "agg15_composition": f"WITH {FILES}, p AS (SELECT kind, well_key, count(*) AS n FROM ct GROUP BY ALL) SELECT kind, CAST(sum(n) AS BIGINT) AS files, count(*) AS keys, count(*) FILTER (n > 1) AS repeated FROM p GROUP BY kind",
    "agg16_categories": f"WITH {FILES} " + " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER ({p}) AS files, CAST(coalesce(sum(size) FILTER ({p}), 0) AS BIGINT) AS bytes FROM ct" for k, p in (("tables", "ext = 'csv'"), ("logs", "kind = 'well_log'"), ("large", "size > 2000"))),
    "agg17_folders": f"WITH {FILES}, n AS (SELECT folder, ext, count(*) AS n FROM ct GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, ext) AS k, sum(n) OVER (PARTITION BY folder) AS t FROM n) SELECT folder, CAST(any_value(t) AS BIGINT) AS files, string_agg(ext || ':' || n, ',' ORDER BY n DESC, ext) AS endings FROM r WHERE k <= 8 GROUP BY folder",
    "agg19_facets": f"WITH {FILES} SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM ct GROUP BY kind UNION ALL (SELECT 'folder', folder, count(*) AS n FROM ct GROUP BY folder ORDER BY n DESC, folder LIMIT 80)",
    "agg18_coverage": f"""WITH {PM}, f AS (SELECT k, bool_or(s = 1) AS p, bool_or(s = 2) AS w, bool_or(s = 3) AS d FROM (SELECT DISTINCT well_key AS k, 1 AS s FROM pm UNION ALL SELECT normalized_key, 2 FROM wells UNION ALL SELECT DISTINCT well_key, 3 FROM documents WHERE well_key IS NOT NULL) GROUP BY k)
 SELECT count(*) FILTER (p) AS production, count(*) FILTER (w) AS wells, count(*) FILTER (d) AS documents, count(*) FILTER (p AND w) AS production_wells, count(*) FILTER (p AND d) AS production_documents, count(*) FILTER (w AND d) AS wells_documents, count(*) FILTER (p AND w AND d) AS every, count(*) AS "any" FROM f""",
    "agg21_overlay": f"WITH {FILES}, t(kind) AS (VALUES ('well_log'), ('seismic'), ('deviation'), ('polygon'), ('core')) SELECT t.kind, count(ct.path) AS n, count(ct.path) = 0 AS missing FROM t LEFT JOIN ct USING (kind) GROUP BY t.kind",
    "srt06_representative": f"WITH {FILES}, n AS (SELECT folder, ext, count(*) AS n FROM ct GROUP BY ALL), b AS (SELECT folder, arg_min(ext, ROW(-n, ext)) AS ext, max(n) AS n FROM n GROUP BY folder), r AS (SELECT ct.*, b.n, row_number() OVER (PARTITION BY folder ORDER BY size, path) - 1 AS k FROM ct JOIN b USING (folder, ext)) SELECT folder, path, size FROM r WHERE k = (n - 1) // 2",
    "srt03_page": f"WITH {FILES} SELECT path, size FROM ct ORDER BY lower(path), path LIMIT 20 OFFSET 20",
    "mdl44_tiers": "SELECT id, canonical_name AS name, CASE WHEN contains(upper(canonical_name), 'S-01') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.94 AS DOUBLE) END AS score FROM wells WHERE contains(upper(canonical_name), 'S-01') OR contains(regexp_replace(upper(canonical_name), '[^0-9A-Z]', '', 'g'), 'S01')",
    "agg27_layer_registry": "WITH k AS (SELECT regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(alias_name, '\\.[A-Za-z0-9]{1,4}$', '')), '[\\s_\\-.]*(V|VER|REV)\\s*\\d+$', ''), '[\\s_\\-.]*20\\d{2}$', ''), '[^0-9A-Z一-鿿]', '', 'g') AS layer, project_root, canonical_key FROM horizon_name_aliases) SELECT layer, count(*) AS names, count(DISTINCT project_root) AS projects, min(canonical_key) AS canonical FROM k GROUP BY layer",
    "snk15_latest": "SELECT alias_key AS k, arg_max(alias_id, ROW(created_at, alias_id)) AS alias_id, arg_max(alias_name, ROW(created_at, alias_id)) AS alias_name FROM horizon_name_aliases GROUP BY 1",
    "hlp24_sources_newest": "SELECT id, filename FROM sources ORDER BY imported_at DESC NULLS LAST, id DESC",
    "sc01_text_keys": f"SELECT row_no, {_KEY('well_name')} AS k, {_CLEAN('remark')} AS remark, CASE WHEN isfinite(total_depth) THEN total_depth END AS depth FROM well_head",
    "sc04_layer_keys": "SELECT alias_id, regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(alias_name, '\\.[A-Za-z0-9]{1,4}$', '')), '[\\s_\\-.]*(V|VER|REV)\\s*\\d+$', ''), '[\\s_\\-.]*20\\d{2}$', ''), '[^0-9A-Z一-鿿]', '', 'g') AS k FROM horizon_name_aliases",
    "sc05_file_keys": "SELECT id, regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace(filename, '^.*[/\\\\]', ''), '\\.[A-Za-z0-9]{1,4}$', '')), '[\\s_\\-]*(COPY|RUN\\s*\\d+|FINAL|V\\d+)$', ''), '[^0-9A-Z]', '', 'g') AS k, lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM sources",
    "sc13_dates": f"WITH {PM} SELECT id, month || '-99' AS parts, CAST(day(last_day(CAST(month || '-01' AS DATE))) AS INT) AS days FROM pm",
    "sc25_repointed": "SELECT id, CASE WHEN lower(file_path) = '/archive/batch02' OR starts_with(lower(file_path), '/archive/batch02/') THEN '/new' || substr(file_path, 17) ELSE file_path END AS p FROM sources WHERE file_path IS NOT NULL",
    "sc34_json": "SELECT id, json_extract_string(metadata_json, '$.encoding') AS encoding, TRY_CAST(json_extract_string(metadata_json, '$.rows_skipped') AS INT) AS skipped FROM sources",
    "sc32_signature": f"WITH {FILES} SELECT folder, sha256(string_agg(path || ':' || size, ';' ORDER BY path || ':' || size)) AS signature FROM ct GROUP BY folder",
    "sc36_angles": "SELECT event_id, round(((event_id * 7.5 + 180) - 360 * floor((event_id * 7.5 + 180) / 360)) - 180, 6) AS signed, round((event_id * -7.5) - 360 * floor((event_id * -7.5) / 360), 6) AS whole FROM events",
}
_EXACT = ("mdl37_identity_suggestions", "sc06_identity_similarity", "sc07_match_score", "agg30_coordinate_overlaps", "agg06_type_coverage", "mdl36_focus")  # rounded inside their operators
ORACLE = {k: v if k in _EXACT else rounding_alike(v) for k, v in ORACLE.items()}

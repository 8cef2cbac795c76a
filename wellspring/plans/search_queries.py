"""Search, horizon and remaining catalogue queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions import scalars
from wellspring.functions.text import well_key
from wellspring.operators import catalog, clustering, curves, search
from wellspring.plans.relations import CURVE_TYPE, FILES, IV, MATCH_SCORE, PM, SIMILARITY, WELL_KEYS, files, intervals, pair_ratio, pm, rounded, rounding_alike
from wellspring.plans.relations import curves as las
from wellspring.tables import table


def _picks(s, d):
    i = table(s, d, "interpretation_v1")
    return i.where("facies is not null and top_md is not null and not isnan(top_md)").select(F.upper("well").alias("well"), F.col("facies").alias("name"), (F.col("row_no") % 5).cast("string").alias("file"), F.col("top_md").alias("md"))


def _hits(s, d):
    return _picks(s, d).groupBy("well", F.upper("name").alias("layer")).agg(F.min("md").alias("md")).withColumn("hit", F.col("md") < 2500)


def _curve_spans(s, d):
    return intervals(s, d).select("well", F.concat(F.lit("C"), F.col("id") % 7).alias("mnemonic"), F.col("top").alias("start"), F.col("base").alias("stop"))


def _versions(s, d):
    return table(s, d, "part").groupBy(F.col("p_brand").alias("layer"), F.col("p_size").cast("string").alias("version")).agg(F.count("*").alias("nodes"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


def _perforations(s, d):
    return intervals(s, d).select("well", F.col("top").alias("p_top"), F.col("base").alias("p_base"))


def _bottoms(s, d):
    return intervals(s, d).groupBy("well").agg(F.max("base").alias("md"))


def _unified(s, d):
    heads = table(s, d, "well_head").select(well_key(F.col("well_name")).alias("key"), F.when(~F.isnan("x"), F.col("x")).alias("x"), F.when(~F.isnan("y"), F.col("y")).alias("y"))
    logs = las(s, d).join(table(s, d, "wells").select(F.col("id").alias("well_id"), F.col("normalized_key").alias("key")), "well_id")
    tops = table(s, d, "interpretation_v1").select(well_key(F.col("well")).alias("key"))
    return search.unified_wells(heads, logs, tops, pm(s, d).select(F.col("well_key").alias("key")))


def _texts(s, d):
    return table(s, d, "wells").select(F.col("id").alias("q"), F.concat("canonical_name", F.lit("; gr，Quarrin Shale\nnothing")).alias("text"))


def _named(s, d):
    return table(s, d, "wells").select("id", F.col("canonical_name").alias("name"), F.col("normalized_key").alias("key"), "x", "y")


def _evident(s, d):
    n = table(s, d, "well_sources").where("well_id is not null").groupBy(F.col("well_id").alias("id")).agg(F.countDistinct("source_id").alias("sources"))
    return _named(s, d).join(n, "id", "left").select("id", "name", "key", F.coalesce("sources", F.lit(0)).alias("sources"))


QUERIES = {
    "sc19_time_depth_evidence": lambda s, d: files(s, d).select("path", F.array_join(search.time_depth_evidence(F.concat("path", F.lit("_checkshot"))), ",").alias("e")),
    "sc21_model_items": lambda s, d: files(s, d).select("path", search.model_item(F.col("path")).alias("item")),
    "sc22_semantics": lambda s, d: files(s, d).select("path", search.volume_semantics(F.col("path"))["dimension"].alias("dimension"), search.volume_semantics(F.col("path"))["domain"].alias("domain")),
    "sc24_translated": lambda s, d: table(s, d, "sources").select("id", search.translated(F.regexp_replace("filename", r"\..*$", ""), {"well": "pozo", "head": "cabeza", "production": "produccion"}).alias("name")),
    "sc17_core_depths": lambda s, d: intervals(s, d).select("id", F.concat(F.col("top").cast("string"), F.lit("-"), F.col("base").cast("string"), F.lit("ft")).alias("n")).select("id", scalars.core_depths(F.col("n"))[0].alias("top"), scalars.core_depths(F.col("n"))[1].alias("base")),
    "sc29_affine": lambda s, d: rounded(table(s, d, "part").select("p_partkey", *[c.alias(n) for c, n in zip(scalars.affine_lines(*scalars.affine_xy(F.col("p_partkey"), F.col("p_size"), (12.5, 3.0, 1000.0), (-2.0, 25.0, 5.0)), (12.5, 3.0, 1000.0), (-2.0, 25.0, 5.0)), ("inline", "crossline"))])),
    "sc30_overlap_area": lambda s, d: rounded(table(s, d, "part").select("p_partkey", scalars.overlap_area((F.lit(0.0), F.lit(0.0), F.lit(25.0), F.lit(25.0)), (F.col("p_size") * 1.0, F.lit(5.0), F.col("p_size") + 10.0, F.lit(30.0))).alias("area"))),
    "sc33_listed": lambda s, d: _texts(s, d).select("q", F.array_join(scalars.listed(F.col("text")), "|").alias("parts")),
    "flt12_valid_samples": lambda s, d: las(s, d).where(scalars.valid_sample(F.col("value_min"))).select("id"),
    "flt08_windows": lambda s, d: rounded(curves.window_of(table(s, d, "interpretation_v1").select("row_no", F.col("top_md").alias("top"), F.col("base_md").alias("base")), F.when(F.col("row_no") % 2 == 0, "ft").when(F.col("row_no") % 3 == 0, "fathom").otherwise("m")).select("row_no", "top_m", "base_m"), 4),
    "agg25_workbench": lambda s, d: search.horizon_workbench(_picks(s, d), table(s, d, "wells").select(F.col("canonical_name").alias("well"))).drop("name"),
    "agg26_versions": lambda s, d: rounded(search.version_comparison(_versions(s, d)), 4),
    "agg28_hit_coverage": lambda s, d: search.hit_coverage(_hits(s, d)),
    "agg29_layer_coverage": lambda s, d: search.layer_coverage(_curve_spans(s, d), _hits(s, d)),
    "agg36_duplicates": lambda s, d: files(s, d).groupBy("well_key").agg(F.count("*").alias("n")).where("n > 1"),
    "agg32_readiness": lambda s, d: pm(s, d).groupBy("well_key").agg(F.countDistinct("month").alias("m")).agg(F.count("*").alias("wells"), F.count_if(F.col("m") >= 3).alias("three"), F.count_if(F.col("m") >= 12).alias("year"), F.count_if(F.col("m") >= 60).alias("five_years")),
    "agg38_statuses": lambda s, d: pm(s, d).groupBy("status").agg(F.count("*").alias("n")),
    "mdl09_horizon_detail": lambda s, d: rounded(search.horizon_detail(_hits(s, d).select("well", "layer", "md"), _perforations(s, d), _bottoms(s, d)), 4),
    "mdl38_project_identity": lambda s, d: search.project_identity(_named(s, d)),
    "join22_number_suggestions": lambda s, d: search.number_suggestions(table(s, d, "well_sources").where("well_id is null").select(F.col("id").alias("q"), F.col("normalized_name").alias("text")), _named(s, d).select("id", F.col("key").alias("name"))),
    "mdl40_unified_wells": lambda s, d: _unified(s, d),
    "mdl41_roles": lambda s, d: search.relationship_search(_texts(s, d), table(s, d, "wells").select(F.col("normalized_key").alias("key")), las(s, d).select(F.upper("mnemonic").alias("key")), table(s, d, "horizon_name_groups").select(F.col("canonical_key").alias("key"))),
    "hlp15_best_wells": lambda s, d: search.best_wells(table(s, d, "well_sources").where("id % 50 = 0").select(F.col("id").alias("q"), F.col("normalized_name").alias("text")), _evident(s, d)),
    "agg23_inventory": lambda s, d: search.seismic_inventory(table(s, d, "sources").select(F.regexp_replace("filename", r"_\d+", "").alias("name"), F.col("record_count").alias("size"))),
    "join06_deepest": lambda s, d: intervals(s, d).join(_bottoms(s, d).withColumnRenamed("md", "deepest"), "well").where("base = deepest").select("id", "well"),
    "join23_classes": lambda s, d: clustering.class_links(table(s, d, "sources").where("batch is not null").select("id", F.col("batch").alias("key"))),
    "join25_paths": lambda s, d: las(s, d).select("id", "source_id").join(table(s, d, "sources").select(F.col("id").alias("source_id"), "file_path", "filename"), "source_id", "left").select("id", F.coalesce("file_path", "filename").alias("path")),
    "join02_fan_out": lambda s, d: table(s, d, "wells").select(F.col("id").alias("well_id")).join(las(s, d).groupBy("well_id").agg(F.countDistinct("mnemonic").alias("mnemonics")), "well_id", "left").join(table(s, d, "well_sources").groupBy("well_id").agg(F.countDistinct("source_id").alias("sources")), "well_id", "left"),
    "join03_left_filtered": lambda s, d: table(s, d, "wells").select(F.col("id").alias("well_id")).join(las(s, d).where(~scalars.is_time_depth(F.col("mnemonic"))).groupBy("well_id").agg(F.count("*").alias("n")), "well_id", "left"),
    "set03_paths": lambda s, d: files(s, d).select("path").unionAll(table(s, d, "sources").where("file_path is not null").select("file_path")).dropDuplicates(["path"]),
    "set06_groups": lambda s, d: pm(s, d).where("oil_rate > 100").select("well_key").union(pm(s, d).where("water_rate > 100").select("well_key")).distinct(),
    "set08_subset": lambda s, d: las(s, d).where("well_id is not null").groupBy("well_id").agg(F.collect_set(F.upper("mnemonic")).alias("m")).where(F.size(F.array_except(F.array(F.lit("GR"), F.lit("RT")), "m")) == 0).select("well_id"),
    "srt01_order": lambda s, d: table(s, d, "horizon_name_aliases").orderBy(F.lower("alias_name"), "alias_name", "alias_id").select("alias_id"),
    "srt04_top_series": lambda s, d: las(s, d).groupBy(F.upper("mnemonic").alias("mnemonic")).agg(F.sum("sample_count").alias("n")).orderBy(F.desc("n"), "mnemonic").limit(24),
    "srt05_argmax": lambda s, d: las(s, d).where("well_id is not null").groupBy("well_id").agg(F.max_by("mnemonic", F.struct("sample_count", "mnemonic", "id")).alias("mnemonic")),
    "hlp11_export_scope": lambda s, d: table(s, d, "well_sources").where("well_id is not null").groupBy("well_id").agg(F.countDistinct("source_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi"), F.count("*").alias("wells")),
    "hlp13_old_prefix": lambda s, d: table(s, d, "sources").agg(F.count_if(F.lower("file_path").contains("/batch0")).alias("file_path"), F.count_if(F.lower("metadata_json").contains("/batch0")).alias("metadata_json")),
    "hlp17_type_lookup": lambda s, d: curves.typed(las(s, d), s.createDataFrame([("GR", "mine")], "mnemonic string, type string")).groupBy("how").agg(F.count("*").alias("n")),
    "hlp06_seeded_types": lambda s, d: s.createDataFrame([(t[0],) for t in curves.CURVE_TYPES], "type string").join(curves.typed(las(s, d)).select(F.col("curve_type").alias("type")).distinct(), "type", "left_anti"),
    "agg11_by_well": lambda s, d: rounded(curves.description(las(s, d).where("well_id is not null").select(F.col("well_id").alias("series"), F.col("value_max").alias("value")), "series", "value"), 4),
    "snk03_availability": lambda s, d: catalog.coverage({"heads": table(s, d, "well_head").select(well_key(F.col("well_name")).alias("k")), "wells": table(s, d, "wells").select(F.col("normalized_key").alias("k"))}, "k"),
    "set07_groups_by_rank": lambda s, d: rounded(clustering.group_statistics(pm(s, d).where("oil_rate is not null").select(F.coalesce("status", F.lit("none")).alias("grp"), F.col("well_key").alias("well"), F.col("oil_rate").alias("value")), "value"), 4),
}

_KEY = lambda c: f"regexp_replace(upper(trim({c})), '[^0-9A-Z一-鿿]', '', 'g')"
_CASE = " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in search.MODEL_ITEMS)
_PK = "pk AS (SELECT upper(well) AS well, facies AS name, CAST(row_no % 5 AS VARCHAR) AS file, top_md AS md FROM interpretation_v1 WHERE facies IS NOT NULL AND NOT isnan(top_md)), ht AS (SELECT well, upper(name) AS layer, min(md) AS md FROM pk GROUP BY ALL)"
_LK = "regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(name, '\\.[A-Za-z0-9]{1,4}$', '')), '[\\s_\\-.]*(V|VER|REV)\\s*\\d+$', ''), '[\\s_\\-.]*20\\d{2}$', ''), '[^0-9A-Z一-鿿]', '', 'g')"
_VR = "vr AS (SELECT p_brand AS layer, CAST(p_size AS VARCHAR) AS version, count(*) AS nodes, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL)"
_OKV = lambda c: f"{c} IS NOT NULL AND isfinite({c}) AND abs({c}) < 1e29 AND " + " AND ".join(f"abs({c} - ({x})) > 1e-6" for x in scalars.SENTINELS)
_PCT = ", ".join(f"round(quantile_cont(value, {q}), 4) AS {n}" for n, q in (("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))

_TYPED = CURVE_TYPE

_MKEY = "regexp_replace(upper(normalized_name), '[^0-9A-Z一-鿿]', '', 'g')"
ORACLE = {
    "mdl38_project_identity": f"""WITH {WELL_KEYS}, w AS (SELECT k.*, normalized_key AS key, x, y FROM k JOIN wells USING (id)), e AS (SELECT id, key, x, unnest(['d' || d, 'v' || v, 'p' || p]) AS bl FROM w),
 n AS (SELECT *, count(*) OVER (PARTITION BY bl) AS size, row_number() OVER (PARTITION BY bl ORDER BY key, id) AS q, row_number() OVER (PARTITION BY bl ORDER BY reverse(key), id) AS r, row_number() OVER (PARTITION BY bl ORDER BY coalesce(x, 0), id) AS u FROM e WHERE bl IS NOT NULL),
 c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM n a JOIN n b ON a.bl = b.bl AND a.id < b.id AND (a.size <= 100 OR abs(a.q - b.q) <= 6 OR abs(a.r - b.r) <= 6 OR abs(a.u - b.u) <= 6)),
 m AS (SELECT c.*, l.key AS ka, r.key AS kb, l.v = r.v AS bare, l.d = r.d AS digits, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) AS far FROM c JOIN w l ON l.id = a JOIN w r ON r.id = b),
 pr AS (SELECT row_number() OVER () AS pid, ka, kb FROM (SELECT DISTINCT ka, kb FROM m)), {pair_ratio('pr')}, {SIMILARITY}
 SELECT a, b, round(greatest(sim, CASE WHEN far <= 1 THEN 0.98 WHEN far <= 5 THEN 0.92 ELSE 0 END, CASE WHEN bare THEN 0.86 ELSE 0 END, CASE WHEN digits THEN 0.78 ELSE 0 END), 6) AS score FROM m JOIN sim USING (ka, kb) WHERE score >= 0.76 ORDER BY score DESC, a, b LIMIT 150""",
    "join22_number_suggestions": f"""WITH q AS (SELECT id AS q, normalized_name AS text, {_MKEY} AS ka FROM well_sources WHERE well_id IS NULL), w AS (SELECT id, normalized_key AS kb FROM wells),
 m AS (SELECT DISTINCT q, id, ka, kb FROM (SELECT *, unnest(regexp_extract_all(text, '[0-9]+')) AS t FROM q) JOIN (SELECT *, unnest(regexp_extract_all(kb, '[0-9]+')) AS t FROM w) USING (t)), pr AS (SELECT row_number() OVER () AS pid, ka, kb FROM (SELECT DISTINCT ka, kb FROM m)), {pair_ratio('pr', 18)}, {SIMILARITY},
 b AS (SELECT q, id, round(sim, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, id) AS n FROM m JOIN sim USING (ka, kb)) SELECT q, id, score FROM b WHERE n = 1 AND score >= 0.78""",
    "hlp15_best_wells": f"""WITH q AS (SELECT id AS q, {_MKEY} AS ka FROM well_sources WHERE id % 50 = 0), w AS (SELECT id, normalized_key AS kb, (SELECT count(DISTINCT source_id) FROM well_sources s WHERE s.well_id = wells.id) AS sources FROM wells), m AS (SELECT * FROM q, w),
 pr AS (SELECT row_number() OVER () AS pid, ka, kb FROM (SELECT DISTINCT ka, kb FROM m)), {pair_ratio('pr', 18)}, {SIMILARITY}, {MATCH_SCORE},
 b AS (SELECT q, id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, sources DESC, id) AS place FROM m JOIN score USING (ka, kb)) SELECT q, place, id, score FROM b WHERE place <= 6""",
    "hlp17_type_lookup": f"SELECT CASE WHEN upper(trim(mnemonic)) = 'GR' THEN 'confirmed' WHEN {_TYPED} IS NOT NULL THEN 'automatic' ELSE 'unclassified' END AS how, count(*) AS n FROM las_curves GROUP BY 1",
    "hlp06_seeded_types": f"SELECT type FROM (VALUES {', '.join(f'({chr(39)}{t[0]}{chr(39)})' for t in curves.CURVE_TYPES)}) v(type) WHERE type NOT IN (SELECT {_TYPED} FROM las_curves WHERE {_TYPED} IS NOT NULL)",
    "sc19_time_depth_evidence": f"WITH {FILES} SELECT path, CASE WHEN regexp_matches(lower(path), 'stack|migrat|cube|volume') THEN '' ELSE 'checkshot' END AS e FROM ct",
    "sc21_model_items": f"WITH {FILES} SELECT path, CASE {_CASE} ELSE 'other' END AS item FROM ct",
    "sc22_semantics": f"WITH {FILES} SELECT path, CASE WHEN regexp_matches(lower(path), 'line|2d') THEN '2d' ELSE '3d' END AS dimension, CASE WHEN regexp_matches(lower(path), 'depth|psdm|\\btvd') THEN 'depth' ELSE 'time' END AS domain FROM ct",
    "sc24_translated": "SELECT id, array_to_string(list_transform(regexp_split_to_array(lower(regexp_replace(filename, '\\..*$', '')), '[\\s_\\-]+'), lambda w: CASE w WHEN 'well' THEN 'pozo' WHEN 'head' THEN 'cabeza' WHEN 'production' THEN 'produccion' ELSE w END), ' ') AS name FROM sources",
    "sc17_core_depths": f"WITH {IV} SELECT id, round(top * 0.3048, 4) AS top, round(base * 0.3048, 4) AS base FROM iv",
    "sc29_affine": "SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS inline, CAST(p_size AS DOUBLE) AS crossline FROM part",
    "sc30_overlap_area": "SELECT p_partkey, CAST(greatest(0, least(25.0, p_size + 10.0) - greatest(0.0, p_size)) * 20 AS DOUBLE) AS area FROM part",
    "sc33_listed": "SELECT id AS q, canonical_name || '|gr|Quarrin Shale|nothing' AS parts FROM wells",
    "flt12_valid_samples": f"SELECT id FROM las_curves WHERE {_OKV('value_min')}",
    "flt08_windows": "WITH f AS (SELECT row_no, top_md * k AS t, base_md * k AS b FROM (SELECT *, CASE WHEN row_no % 2 = 0 THEN 0.3048 WHEN row_no % 3 = 0 THEN NULL ELSE 1.0 END AS k FROM interpretation_v1) WHERE isfinite(top_md) AND isfinite(base_md) AND k IS NOT NULL) SELECT row_no, round(least(t, b), 4) AS top_m, round(greatest(t, b), 4) AS base_m FROM f",
    "agg25_workbench": f"WITH {_PK}, r AS (SELECT *, {_LK} AS layer FROM pk) SELECT layer, count(DISTINCT r.well) AS wells, count(DISTINCT r.well) FILTER (w.id IS NOT NULL) AS hard_wells, count(DISTINCT file) AS files, min(md) AS top_md, max(md) AS base_md, count(DISTINCT name) AS spellings FROM r LEFT JOIN (SELECT DISTINCT canonical_name, 1 AS id FROM wells) w ON w.canonical_name = r.well GROUP BY layer",
    "agg26_versions": f"WITH {_VR}, b AS (SELECT layer, arg_min(version, ROW(-nodes, version)) AS bv FROM vr GROUP BY layer) SELECT v.layer, v.version, v.version = bv AS representative, v.nodes - x.nodes AS more_nodes, round(v.low - x.low, 4) AS low_off, round(v.high - x.high, 4) AS high_off FROM vr v JOIN b USING (layer) JOIN vr x ON x.layer = v.layer AND x.version = bv",
    "agg28_hit_coverage": f"WITH {_PK} SELECT layer, count(*) AS computed, count(*) FILTER (md < 2500) AS hits FROM ht GROUP BY layer",
    "agg29_layer_coverage": f"WITH {_PK}, {IV} SELECT layer, 'C' || id % 7 AS mnemonic, count(DISTINCT ht.well) AS wells FROM ht JOIN iv ON iv.well = ht.well AND md BETWEEN top AND base GROUP BY ALL",
    "agg36_duplicates": f"WITH {FILES} SELECT well_key, count(*) AS n FROM ct GROUP BY well_key HAVING count(*) > 1",
    "agg32_readiness": f"WITH {PM}, m AS (SELECT well_key, count(DISTINCT month) AS m FROM pm GROUP BY well_key) SELECT count(*) AS wells, count(*) FILTER (m >= 3) AS three, count(*) FILTER (m >= 12) AS year, count(*) FILTER (m >= 60) AS five_years FROM m",
    "agg38_statuses": f"WITH {PM} SELECT status, count(*) AS n FROM pm GROUP BY status",
    "mdl09_horizon_detail": f"""WITH {_PK}, {IV}, b AS (SELECT well, max(base) AS bottom FROM iv GROUP BY well), s AS (SELECT ht.*, bottom, coalesce(lead(md) OVER (PARTITION BY ht.well ORDER BY md, layer), bottom) AS base FROM ht LEFT JOIN b USING (well)), p AS (SELECT well, top AS pt, iv.base AS pb FROM iv)
 SELECT s.well, layer, round(md, 4) AS md, round(coalesce(sum(CASE WHEN pt IS NOT NULL AND s.base IS NOT NULL THEN greatest(0, least(s.base, pb) - greatest(md, pt)) END), 0), 4) AS perforated, round(any_value(bottom) - md, 4) AS drilled_below FROM s LEFT JOIN p ON p.well = s.well GROUP BY s.well, layer, md""",
    "mdl40_unified_wells": f"""WITH {PM}, e AS (SELECT {_KEY('well_name')} AS key, CASE WHEN NOT isnan(x) THEN x END AS x, CASE WHEN NOT isnan(y) THEN y END AS y, 'head' AS kind FROM well_head UNION ALL SELECT w.normalized_key, NULL, NULL, 'log' FROM las_curves c JOIN wells w ON w.id = c.well_id UNION ALL SELECT {_KEY('well')}, NULL, NULL, 'top' FROM interpretation_v1 UNION ALL SELECT well_key, NULL, NULL, 'production' FROM pm)
 SELECT key, min(x) AS x, min(y) AS y, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e WHERE key <> '' GROUP BY key""",
    "mdl41_roles": "SELECT id AS q, unnest([canonical_name, 'gr', 'Quarrin Shale', 'nothing']) AS part, unnest(['well', 'curve', 'layer', 'unknown']) AS role FROM wells",
    "agg23_inventory": "SELECT upper(regexp_replace(regexp_replace(filename, '_\\d+', '', 'g'), '\\.[A-Za-z0-9]+$', '')) AS volume, count(*) AS copies, max(record_count) AS size FROM sources GROUP BY 1",
    "join06_deepest": f"WITH {IV} SELECT id, well FROM iv WHERE base = (SELECT max(base) FROM iv j WHERE j.well = iv.well)",
    "join23_classes": "SELECT id, min(id) OVER (PARTITION BY batch) AS class_id, count(*) OVER (PARTITION BY batch) - 1 AS links FROM sources WHERE batch IS NOT NULL",
    "join25_paths": "SELECT c.id, coalesce(file_path, filename) AS path FROM las_curves c LEFT JOIN sources s ON s.id = c.source_id",
    "join02_fan_out": "SELECT w.id AS well_id, (SELECT nullif(count(DISTINCT mnemonic), 0) FROM las_curves c WHERE c.well_id = w.id) AS mnemonics, (SELECT nullif(count(DISTINCT source_id), 0) FROM well_sources m WHERE m.well_id = w.id) AS sources FROM wells w",
    "join03_left_filtered": "SELECT w.id AS well_id, (SELECT nullif(count(*), 0) FROM las_curves c WHERE c.well_id = w.id AND NOT regexp_matches(regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g'), '^(ONEWAYTIME|OWT|TWT|GENERALTIME|VELOCITY)')) AS n FROM wells w",
    "set03_paths": "SELECT DISTINCT file_path AS path FROM sources WHERE file_path IS NOT NULL",
    "set06_groups": f"WITH {PM} SELECT well_key FROM pm WHERE oil_rate > 100 UNION SELECT well_key FROM pm WHERE water_rate > 100",
    "set08_subset": "SELECT well_id FROM las_curves WHERE well_id IS NOT NULL GROUP BY well_id HAVING bool_or(upper(mnemonic) = 'GR') AND bool_or(upper(mnemonic) = 'RT')",
    "srt01_order": "SELECT alias_id FROM horizon_name_aliases ORDER BY lower(alias_name), alias_name, alias_id",
    "srt04_top_series": "SELECT upper(mnemonic) AS mnemonic, CAST(sum(sample_count) AS BIGINT) AS n FROM las_curves GROUP BY 1 ORDER BY n DESC, 1 LIMIT 24",
    "srt05_argmax": "SELECT well_id, arg_max(mnemonic, ROW(sample_count, mnemonic, id)) AS mnemonic FROM las_curves WHERE well_id IS NOT NULL GROUP BY well_id",
    "hlp11_export_scope": "WITH n AS (SELECT well_id, count(DISTINCT source_id) AS n FROM well_sources WHERE well_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (n > 1) AS multi, count(*) AS wells FROM n",
    "hlp13_old_prefix": "SELECT count(*) FILTER (contains(lower(file_path), '/batch0')) AS file_path, count(*) FILTER (contains(lower(metadata_json), '/batch0')) AS metadata_json FROM sources",
    "agg11_by_well": f"WITH v AS (SELECT well_id AS series, value_max AS value FROM las_curves WHERE well_id IS NOT NULL AND {_OKV('value_max')}) SELECT series, count(*) AS n, round(min(value), 4) AS low, {_PCT}, round(max(value), 4) AS high, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM v GROUP BY series",
    "set07_groups_by_rank": f"WITH {PM} SELECT coalesce(status, 'none') AS grp, count(DISTINCT well_key) AS wells, count(*) - count(DISTINCT well_key) AS repeats, round(quantile_cont(oil_rate, 0.1), 4) AS p10, round(quantile_cont(oil_rate, 0.5), 4) AS p50, round(quantile_cont(oil_rate, 0.9), 4) AS p90 FROM pm WHERE oil_rate IS NOT NULL GROUP BY 1",
    "snk03_availability": f"WITH h AS (SELECT DISTINCT {_KEY('well_name')} AS k FROM well_head WHERE well_name IS NOT NULL), f AS (SELECT coalesce(h.k, w.normalized_key) AS k, h.k IS NOT NULL AS a, w.id IS NOT NULL AS b FROM h FULL JOIN wells w ON w.normalized_key = h.k) SELECT count(*) FILTER (a) AS heads, count(*) FILTER (b) AS wells, count(*) FILTER (a AND b) AS heads_wells, count(*) FILTER (a AND b) AS every, count(*) AS \"any\" FROM f",
}
_EXACT = ("sc17_core_depths", "mdl38_project_identity", "join22_number_suggestions", "hlp15_best_wells")  # rounded inside their operators
ORACLE = {k: v if k in _EXACT else rounding_alike(v) for k, v in ORACLE.items()}

"""Ingest and inventory queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators import curves, ingest
from wellspring.plans.geometry_queries import _MC, _path
from wellspring.plans.relations import FILES, PM, ST, files, heads, pm, rounded, rounding_alike, stations
from wellspring.plans.relations import curves as las
from wellspring.tables import table


def _basis(s, d):
    p = pm(s, d)
    return ingest.production_basis(p.select("id", (F.col("id") % 2 == 0).alias("daily"), F.col("days_on").alias("days"), F.col("oil_rate").alias("oil"), F.col("water_rate").alias("water")))


def _aliases(s, d):
    h = table(s, d, "horizon_name_aliases")
    return h.select(F.col("alias_key").alias("alias"), F.col("alias_name").alias("canonical"), F.col("created_at").alias("saved_at"))


def _surveys(s, d):
    return stations(s, d).select("well", (F.col("id") % 20 + 1).alias("source_id"), "md", "id")


QUERIES = {
    "ing04_heads": lambda s, d: ingest.head_import(table(s, d, "well_head")),
    "ing05_deviation": lambda s, d: rounded(_path(s, d).join(heads(s, d).select("well", "kb"), "well").select("well", "md", (F.col("tvd") - F.col("kb")).alias("tvdss")), 4),
    "ing11_aliases": lambda s, d: ingest.with_aliases(_aliases(s, d).where("alias like '%S'"), _aliases(s, d).where("alias not like '%S'")),
    "ing15_basis": lambda s, d: rounded(_basis(s, d).select("id", "oil_rate", "oil_volume", "liquid", "cut"), 4),
    "ing16_perforations": lambda s, d: ingest.perforation_rows(table(s, d, "well_head"), ("well_name", "remark")).select("row_no"),
    "ing17_context": lambda s, d: ingest.with_context(table(s, d, "wells").select(F.col("normalized_key").alias("key"), F.lit("none").alias("field")), table(s, d, "curve_reference").select(F.col("curve_key").alias("key"), F.col("curve_name").alias("field"))),
    "ing18_first_filled": lambda s, d: table(s, d, "well_head").select("row_no", ingest.first_filled("remark", "field", "well_name").alias("v")),
    "ing19_catalogued": lambda s, d: ingest.catalogued_sources(table(s, d, "sources"), files(s, d).where("kind <> 'core'")),
    "sc11_attribute_types": lambda s, d: table(s, d, "curve_reference").select("curve_key", ingest.attribute_type(F.col("curve_name"))["type"].alias("type")),
    "sc26_extension_rank": lambda s, d: files(s, d).select("path", ingest.extension_rank(F.col("path")).alias("r")),
    "agg05_profile": lambda s, d: ingest.profile_statistics(las(s, d)),
    "flt07_curve_filter": lambda s, d: ingest.curve_filter(curves.typed(las(s, d)), ["gr", "RT "], None, "classified").select("id"),
    "flt14_found_in": lambda s, d: ingest.found_in(table(s, d, "sources"), ("filename", "batch", "warning"), "ROWS"). select("id"),
    "agg24_time_depth": lambda s, d: ingest.time_depth_inventory(las(s, d), table(s, d, "sources")),
    "win20_newest_survey": lambda s, d: ingest.newest_survey(_surveys(s, d), table(s, d, "sources")).select("well", "source_id", "id"),
    "geo01_hulls": lambda s, d: ingest.convex_hulls(table(s, d, "well_head").where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(F.coalesce("field", F.lit("?")).alias("survey"), "x", "y")),
    "src35_preflight": lambda s, d: ingest.preflight(files(s, d), ("batch02",)),
    "snk08_delivery": lambda s, d: ingest.delivery(table(s, d, "wells").select(F.col("normalized_key").alias("well_key"), F.lit("well_log").alias("kind")), files(s, d)),
    "srt07_sample": lambda s, d: ingest.seeded_sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 500),
    "mdl17_training_set": lambda s, d: ingest.training_set(table(s, d, "part").select("p_partkey", F.col("p_size").alias("records"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("f")), ["f", "p_partkey"], 4)[0].select("p_partkey"),
}

_OKX = "x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y)"
ORACLE = {
    "ing04_heads": f"SELECT count(*) AS n, count(*) FILTER ({_OKX}) AS located, count(*) FILTER (NOT coalesce({_OKX}, false)) AS missing FROM well_head",
    "ing05_deviation": f"WITH {_MC} SELECT well, md, round(tvd - 100, 4) AS tvdss FROM mc",
    "ing11_aliases": "SELECT alias_key AS alias, arg_max(alias_name, ROW(created_at, alias_name)) AS canonical FROM horizon_name_aliases GROUP BY 1",
    "ing15_basis": f"WITH {PM}, b AS (SELECT id, CASE WHEN id % 2 = 0 THEN oil_rate ELSE oil_rate / nullif(days_on, 0) END AS r, CASE WHEN id % 2 = 0 THEN oil_rate * days_on ELSE oil_rate END AS o, CASE WHEN id % 2 = 0 THEN water_rate * days_on ELSE water_rate END AS w FROM pm), l AS (SELECT *, CASE WHEN o IS NOT NULL OR w IS NOT NULL THEN coalesce(o, 0) + coalesce(w, 0) END AS l FROM b) SELECT id, round(r, 4) AS oil_rate, round(o, 4) AS oil_volume, round(l, 4) AS liquid, round(w / nullif(l, 0) * 100, 4) AS cut FROM l",
    "ing16_perforations": "SELECT row_no FROM well_head WHERE regexp_matches(lower(concat_ws(' ', well_name, remark)), 'perf|complet|open.?hole|射孔')",
    "ing17_context": "SELECT normalized_key AS key, coalesce(curve_name, 'none') AS field FROM wells LEFT JOIN curve_reference ON curve_key = normalized_key",
    "ing18_first_filled": "SELECT row_no, coalesce(nullif(trim(remark), ''), nullif(trim(field), ''), nullif(trim(well_name), '')) AS v FROM well_head",
    "ing19_catalogued": f"WITH {FILES}, l AS (SELECT file_path, arg_max(id, ROW(coalesce(imported_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), id)) AS id FROM sources WHERE file_path IS NOT NULL GROUP BY 1) SELECT l.file_path AS path, l.id, coalesce(ct.size, 0) AS size FROM l LEFT JOIN ct ON ct.path = l.file_path AND kind <> 'core'",
    "sc11_attribute_types": "SELECT curve_key, CASE " + " ".join(f"WHEN lower(trim(curve_name)) IN ({', '.join(chr(39) + w + chr(39) for w in ws.split('|'))}) THEN '{t}'" for t, ws in ingest.ATTRIBUTES) + " " + " ".join(f"WHEN regexp_matches(lower(trim(curve_name)), '{'|'.join(w for w in ws.split('|') if len(w) >= 3)}') THEN '{t}'" for t, ws in ingest.ATTRIBUTES) + " END AS type FROM curve_reference",
    "sc26_extension_rank": f"WITH {FILES} SELECT path, CASE ext WHEN 'las' THEN 0 WHEN 'dev' THEN 1 WHEN 'csv' THEN 2 WHEN 'xlsx' THEN 3 WHEN 'txt' THEN 4 ELSE 9 END AS r FROM ct",
    "agg05_profile": "WITH p AS (SELECT upper(trim(mnemonic)) AS mnemonic, well_id, sum(sample_count) AS s, min(value_min) FILTER (isfinite(value_min)) AS l, max(value_max) FILTER (isfinite(value_max)) AS h, count(*) AS f FROM las_curves WHERE well_id IS NOT NULL GROUP BY ALL) SELECT mnemonic, count(*) AS wells, CAST(sum(s) AS BIGINT) AS samples, max(f) AS most_files, min(l) AS low, max(h) AS high FROM p GROUP BY 1",
    "flt07_curve_filter": "SELECT id FROM las_curves WHERE upper(trim(mnemonic)) IN ('GR', 'RT')",
    "flt14_found_in": "SELECT id FROM sources WHERE contains(lower(filename), 'rows') OR contains(lower(batch), 'rows') OR contains(lower(warning), 'rows')",
    "agg24_time_depth": "SELECT upper(mnemonic) AS mnemonic, count(DISTINCT las_file_id) AS files, count(DISTINCT well_id) AS wells, count(*) AS curves FROM las_curves WHERE regexp_matches(regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g'), '^(ONEWAYTIME|OWT|TWT|GENERALTIME|VELOCITY)') AND source_id IN (SELECT id FROM sources WHERE status = 'ready') GROUP BY 1",
    "win20_newest_survey": f"WITH {ST}, s AS (SELECT well, id % 20 + 1 AS source_id, id FROM st), k AS (SELECT well, arg_max(source_id, ROW(coalesce(epoch_us(imported_at), 0), source_id)) AS source_id FROM s JOIN sources ON sources.id = source_id GROUP BY well) SELECT s.well, s.source_id, s.id FROM s JOIN k ON k.well = s.well AND k.source_id = s.source_id",
    "src35_preflight": f"WITH {FILES} SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ct WHERE NOT contains(path, '/batch02/') GROUP BY kind",
    "snk08_delivery": f"WITH {FILES}, b AS (SELECT well_key, kind, min(path) AS path, count(*) AS candidates FROM ct WHERE kind = 'well_log' GROUP BY ALL) SELECT normalized_key AS well_key, 'well_log' AS kind, path, candidates, path IS NULL AS missing FROM wells LEFT JOIN b ON b.well_key = normalized_key",
    "mdl17_training_set": "SELECT p_partkey FROM part WHERE p_size >= 3",
}
ORACLE = {k: rounding_alike(v) for k, v in ORACLE.items()}

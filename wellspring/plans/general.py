"""Queries of the general data-preparation operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators.grid import regular_grid
from wellspring.operators.intervals import interpretation_spans
from wellspring.operators.spikes import production_spikes
from wellspring.operators.units import converted, foreign_values, production_units, well_head_units
from wellspring.tables import table


def p1_grid(spark, d):
    """Monthly oil of each well on the calendar grid, missing months marked."""
    grid = regular_grid(table(spark, d, "production_corrected"), "wellkey", "productiondate", "monthlyoil")
    return grid.select("wellkey", "month", F.round("amount", 4).alias("monthlyoil"), F.coalesce("n_readings", F.lit(0)).alias("n_readings"), "missing")


def p1_counter(spark, d):
    """Cumulative oil differenced and spread over months."""
    grid = regular_grid(table(spark, d, "production_corrected"), "wellkey", "productiondate", "cumulativeoil", kind="counter")
    return grid.select("wellkey", "month", F.round("amount", 3).alias("oil"), F.round("covered_days", 3).alias("covered_days"), "n_resets", "missing")


def p1_found(spark, d):
    """Months between a well's first and last usable month without a usable reading."""
    grid = regular_grid(table(spark, d, "production_corrected"), "wellkey", "productiondate", "monthlyoil")
    return grid.where("missing").select("wellkey", F.col("month").alias("month_missing"))


def _units(spark, d, keep=()):
    return production_units(table(spark, d, "production_corrected"), table(spark, d, "sources"), table(spark, d, "unit_factors"), keep)


def p3_found(spark, d):
    """Values recorded in another unit than MPa, m3/d or m."""
    heads = well_head_units(table(spark, d, "well_head"), table(spark, d, "unit_factors"))
    return foreign_values(_units(spark, d), heads, "production_corrected", "well_head")


def p3_converted(spark, d):
    """All rates and pressures in m3/d and MPa."""
    f = table(spark, d, "unit_factors")
    rows = converted(_units(spark, d), "oil", "oil_unit", f, "oil_m3d")
    return converted(rows, "p", "pressure_unit", f, "pressure_mpa").select("id", "oil_m3d", "pressure_mpa")


def p3_heads(spark, d):
    """All well-head elevations in metres."""
    f = table(spark, d, "unit_factors")
    heads = converted(well_head_units(table(spark, d, "well_head"), f), "kb", "kb_unit", f, "kb_m")
    return heads.select("row_no", "kb_m")


def p6_found(spark, d):
    """Readings that cannot be right for their well."""
    rows = _units(spark, d, ("wellkey", "productiondate", "loaded_at", "dayson", "watercutpct"))
    return production_spikes(converted(rows, "oil", "oil_unit", table(spark, d, "unit_factors"), "oil_m3d"))


def p7_found(spark, d):
    """Covered spans of each well and the gaps between them."""
    return interpretation_spans(table(spark, d, "interpretation_v1"))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_counter": p1_counter, "p3_found": p3_found, "p3_converted": p3_converted, "p3_heads": p3_heads, "p6_found": p6_found, "p7_found": p7_found}

_USABLE = """usable AS (SELECT * FROM production_corrected WHERE wellkey IS NOT NULL AND productiondate >= TIMESTAMPTZ '1950-01-01 00:00:00+00'
 AND productiondate <= loaded_at AND {v} IS NOT NULL AND NOT isnan({v}) AND {v} >= 0)"""
_MONTHS = _USABLE.format(v="monthlyoil") + """, m AS (SELECT wellkey, CAST(date_trunc('month', productiondate AT TIME ZONE 'UTC') AS DATE) AS m,
 arg_max(monthlyoil, ROW(loaded_at, id, productiondate, monthlyoil)) AS v, count(*) AS n FROM usable GROUP BY ALL),
 g AS (SELECT wellkey, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM m GROUP BY wellkey)"""

ORACLE = {
    "p1_found": f"WITH {_MONTHS} SELECT wellkey, strftime(m, '%Y-%m') AS month_missing FROM g ANTI JOIN m USING (wellkey, m)",
    "p1_grid": f"WITH {_MONTHS} SELECT wellkey, strftime(m, '%Y-%m') AS month, round(v, 4) AS monthlyoil, coalesce(n, 0) AS n_readings, v IS NULL AS missing FROM g LEFT JOIN m USING (wellkey, m)",
    "p1_counter": f"""WITH {_USABLE.format(v="cumulativeoil")}, r AS (SELECT wellkey, productiondate AT TIME ZONE 'UTC' AS e, arg_max(cumulativeoil, ROW(loaded_at, id, cumulativeoil)) AS v FROM usable GROUP BY ALL),
 f AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM r WINDOW w AS (PARTITION BY wellkey ORDER BY e)), k AS (SELECT wellkey, e, v FROM f WHERE NOT coalesce(v < pv AND nv >= pv, false)),
 s AS (SELECT *, lag(e) OVER w AS b, lag(v) OVER w AS pv FROM k WINDOW w AS (PARTITION BY wellkey ORDER BY e)),
 i AS (SELECT wellkey, b, e, CASE WHEN v < pv THEN v ELSE v - pv END AS a, CAST(v < pv AS INT) AS rs FROM s WHERE b IS NOT NULL),
 c AS (SELECT *, unnest(generate_series(date_trunc('month', b), greatest(date_trunc('month', b), date_trunc('month', e - INTERVAL 1 MICROSECOND)), INTERVAL 1 MONTH)) AS m FROM i),
 o AS (SELECT *, epoch_us(least(e, m + INTERVAL 1 MONTH)) - epoch_us(greatest(b, m)) AS us FROM c)
 SELECT wellkey, strftime(m, '%Y-%m') AS month, round(sum(a * (us / CAST(epoch_us(e) - epoch_us(b) AS DOUBLE))), 3) AS oil, round(sum(us / 86400e6), 3) AS covered_days,
 CAST(sum(rs) AS BIGINT) AS n_resets, false AS missing FROM o GROUP BY wellkey, m""",
    "p7_found": """WITH r AS (SELECT regexp_replace(upper(trim(array_to_string(list_transform(string_split(well, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) = 12288 THEN ' ' ELSE c END), ''))), '[^\\p{L}\\p{N}]', '', 'g') AS k,
 CAST(round(top_md * 100) AS BIGINT) AS t, CAST(round(base_md * 100) AS BIGINT) AS b FROM interpretation_v1 WHERE NOT isnan(top_md) AND NOT isnan(base_md)),
 g AS (SELECT DISTINCT k, least(t, b) AS t, greatest(t, b) AS b FROM r WHERE k <> '' AND t >= 0 AND b >= 0 AND t <> b),
 l AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM g),
 i AS (SELECT *, sum(CASE WHEN pm IS NULL OR t > pm THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, b) AS isl FROM l)
 SELECT k AS well_key, 'span' AS kind, min(t) AS top_cm, max(b) AS base_cm FROM i GROUP BY k, isl
 UNION ALL SELECT k, 'gap', pm, t FROM l WHERE t > pm""",
}

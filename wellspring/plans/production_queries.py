"""Production queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators import clustering, production
from wellspring.plans.relations import CM, EV, PM, SC, cm, pm, rounded, rounding_alike, tests


def _corrected(s, d):
    return production.corrected(cm(s, d))


QUERIES = {
    "ing08_monthly_rows": lambda s, d: pm(s, d),
    "flt13_date_range": lambda s, d: pm(s, d).where(F.col("month").between("2000-01", "2010-12")).select("id", "well_key", "month", "oil_rate"),
    "win06_consolidated": lambda s, d: cm(s, d),
    "win07_derived": lambda s, d: rounded(production.derived(cm(s, d)).select("well_key", "month", "liquid_rate", "water_cut_pct", "gor")),
    "win08_running": lambda s, d: rounded(production.running(cm(s, d)).select("well_key", "month", "month_index", "days_so_far", "oil_so_far", "water_so_far"), 3),
    "win01_first_and_last": lambda s, d: production.first_and_last(pm(s, d)),
    "agg12_well_totals": lambda s, d: rounded(production.well_totals(pm(s, d)), 4),
    "agg13_dashboard": lambda s, d: rounded(production.dashboard(pm(s, d)), 4),
    "agg14_summary": lambda s, d: rounded(production.summary(cm(s, d)), 4),
    "win10_early_and_late": lambda s, d: rounded(production.early_and_late(cm(s, d))),
    "win11_stability": lambda s, d: rounded(production.stability(cm(s, d))),
    "ing09_status_changes": lambda s, d: production.status_changes(pm(s, d)),
    "ing10_on_stream": lambda s, d: production.on_stream(pm(s, d)),
    "win12_intervention_response": lambda s, d: rounded(production.intervention_response(cm(s, d), tests(s, d))),
    "win13_segments": lambda s, d: rounded(production.segments(cm(s, d), tests(s, d))),
    "mdl13_decline": lambda s, d: rounded(production.decline(cm(s, d)).select("well_key", "n_points", "b", "initial_rate"), 3),
    "mdl14_corrected": lambda s, d: rounded(_corrected(s, d).select("well_key", "month", "days", "inferred", "oil_volume", "water_volume", "gas_volume", "cut", "oil_total", "water_total"), 3),
    "mdl15_audit": lambda s, d: rounded(production.correction_audit(cm(s, d), _corrected(s, d)), 3),
    "agg37_correction_counts": lambda s, d: production.correction_counts(cm(s, d), _corrected(s, d)),
    "mdl16_features": lambda s, d: rounded(production.features(cm(s, d), tests(s, d)), 4),
    "agg33_coverage": lambda s, d: rounded(production.coverage(production.features(cm(s, d), tests(s, d)), ["mean_rate", "peak_rate", "mean_cut", "stability", "response_pct"])),
    "sc27_grades": lambda s, d: production.graded(production.features(cm(s, d), tests(s, d)), "mean_rate"),
    "agg34_weighted_rates": lambda s, d: rounded(clustering.weighted_rates(production.features(cm(s, d), tests(s, d)).select("oil_volume", "days", "mean_rate")), 3),
    "mdl26_parallel_axis": lambda s, d: rounded(clustering.parallel_axis(production.features(cm(s, d), tests(s, d)).where("mean_rate is not null").select("well_key", "mean_rate"), "mean_rate").select("well_key", "axis")),
    "mdl48_composition": lambda s, d: rounded(production.well_totals(pm(s, d)).select("well_key", *[(F.col(f"{p}_volume") / F.nullif(F.coalesce("oil_volume", F.lit(0.0)) + F.coalesce("water_volume", F.lit(0.0)), F.lit(0.0))).alias(f"{p}_part") for p in ("oil", "water")])),
}

_W = "OVER (PARTITION BY well_key ORDER BY month)"
_RUN = "OVER (PARTITION BY well_key ORDER BY month ROWS UNBOUNDED PRECEDING)"
_K = "ROW(month, id)"
_FL = f"""fl AS (SELECT well_key, arg_min(month, {_K}) FILTER (rated) AS first_month, arg_min(oil_rate, {_K}) FILTER (rated AND {_K} = ra) AS first_oil_rate, arg_max(month, {_K}) FILTER (rated) AS latest_month,
 arg_max(oil_rate, {_K}) FILTER (rated AND {_K} = rb) AS latest_oil_rate, arg_min(pressure, {_K}) FILTER (pressure IS NOT NULL) AS first_pressure, arg_max(pressure, {_K}) FILTER (pressure IS NOT NULL) AS last_pressure,
 min(pressure) AS min_pressure, max(pressure) AS max_pressure, arg_max(status, {_K}) FILTER (status IS NOT NULL) AS last_status, arg_max(cum_oil, {_K}) FILTER (cum_oil IS NOT NULL) AS last_cum_oil
 FROM (SELECT *, coalesce(oil_rate, water_rate, gas_rate) IS NOT NULL AS rated, min({_K}) FILTER (coalesce(oil_rate, water_rate, gas_rate) IS NOT NULL) OVER (PARTITION BY well_key) AS ra, max({_K}) FILTER (coalesce(oil_rate, water_rate, gas_rate) IS NOT NULL) OVER (PARTITION BY well_key) AS rb FROM pm) GROUP BY well_key)"""
_TOT = "tt AS (SELECT well_key, count(DISTINCT month) AS months, sum(days_on) FILTER (days_on > 0) AS days, " + ", ".join(f"sum(coalesce(monthly_{p}, {p}_rate * days_on)) AS {p}_volume, avg({p}_rate) AS mean_{p}_rate" for p in ("oil", "water", "gas")) + " FROM pm GROUP BY well_key)"
_R = lambda cols, n: ", ".join(f"round({c}, {n}) AS {c}" for c in cols.split())
_DAYS = "coalesce(day(last_day(try_strptime(month || '-01', '%Y-%m-%d'))), 30)"
_COR = f"""c0 AS (SELECT *, CASE WHEN days_on IS NULL AND oil_rate > 0 THEN CAST({_DAYS} AS DOUBLE) ELSE days_on END AS days FROM cm),
 c1 AS (SELECT *, days_on IS NULL AND days IS NOT NULL AS inferred, coalesce(oil_rate * days, monthly_oil) AS oil_volume, coalesce(water_rate * days, monthly_water) AS water_volume, coalesce(gas_rate * days, monthly_gas) AS gas_volume FROM c0),
 c2 AS (SELECT *, water_volume / nullif(oil_volume + water_volume, 0) * 100 AS cut, CASE WHEN count(oil_volume) {_RUN} > 0 THEN sum(coalesce(oil_volume, 0)) {_RUN} END AS oil_total, CASE WHEN count(water_volume) {_RUN} > 0 THEN sum(coalesce(water_volume, 0)) {_RUN} END AS water_total FROM c1)"""
_AUD = f"""{_COR}, b AS (UNPIVOT (SELECT well_key, coalesce(sum(days_on), 'nan') AS days, coalesce(sum(monthly_oil), 'nan') AS oil, coalesce(sum(monthly_water), 'nan') AS water, coalesce(sum(monthly_gas), 'nan') AS gas FROM cm GROUP BY well_key) ON days, oil, water, gas INTO NAME figure VALUE before),
 a AS (UNPIVOT (SELECT well_key, coalesce(sum(days), 'nan') AS days, coalesce(sum(oil_volume), 'nan') AS oil, coalesce(sum(water_volume), 'nan') AS water, coalesce(sum(gas_volume), 'nan') AS gas FROM c2 GROUP BY well_key) ON days, oil, water, gas INTO NAME figure VALUE after),
 au AS (SELECT well_key, figure, CASE WHEN isnan(before) THEN NULL ELSE before END AS before, CASE WHEN isnan(after) THEN NULL ELSE after END AS after FROM b JOIN a USING (well_key, figure)),
 ad AS (SELECT *, coalesce(abs(before - after) > greatest(1e-7, greatest(abs(before), abs(after)) * 1e-6), (before IS NULL) <> (after IS NULL)) AS changed FROM au)"""
_EL = f"""k AS (SELECT *, row_number() {_W} AS up, row_number() OVER (PARTITION BY well_key ORDER BY month DESC) AS down FROM cm WHERE oil_rate IS NOT NULL),
 el AS (SELECT well_key, avg(oil_rate) FILTER (up <= 3) AS initial_rate, avg(oil_rate) FILTER (down <= 3) AS late_rate FROM k GROUP BY well_key)"""
_STB = f"""p0 AS (SELECT *, lag(oil_rate) {_W} AS prev FROM cm WHERE oil_rate IS NOT NULL),
 sy AS (SELECT well_key, 100 * (1 - least(1.0, quantile_cont(abs(oil_rate - prev) / greatest(abs(prev), 1e-9), 0.5))) AS stability FROM p0 GROUP BY well_key HAVING count(*) >= 3)"""
_RSP = """ar AS (SELECT well_key, month, avg(oil_rate) OVER (PARTITION BY well_key ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b4, avg(oil_rate) OVER (PARTITION BY well_key ORDER BY month ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS af FROM cm WHERE oil_rate IS NOT NULL),
 rs AS (SELECT well_key, avg((af / b4 - 1) * 100) AS response_pct, count(*) AS n_events FROM ar SEMI JOIN ev USING (well_key, month) WHERE b4 > 0 GROUP BY well_key)"""
_FEAT = f"""{CM}, {EV}, {_EL}, {_STB}, {_RSP}, f0 AS (SELECT well_key, count(*) AS records, sum(monthly_oil) AS oil_volume, sum(monthly_water) AS water_volume, avg(oil_rate) AS mean_rate, max(oil_rate) AS peak_rate, avg(water_cut) AS mean_cut, avg(pressure) AS mean_pressure, sum(days_on) AS days,
 sum(monthly_oil + coalesce(monthly_gas, 0) / 6000.0) AS boe FROM cm GROUP BY well_key),
 ft AS (SELECT f0.*, initial_rate, late_rate, stability, response_pct, late_rate / nullif(initial_rate, 0) AS decline_ratio FROM f0 LEFT JOIN el USING (well_key) LEFT JOIN sy USING (well_key) LEFT JOIN rs USING (well_key))"""

ORACLE = {
    "ing08_monthly_rows": f"WITH {PM} SELECT * FROM pm",
    "flt13_date_range": f"WITH {PM} SELECT id, well_key, month, oil_rate FROM pm WHERE month BETWEEN '2000-01' AND '2010-12'",
    "win06_consolidated": f"WITH {CM} SELECT * FROM cm",
    "win07_derived": f"WITH {CM} SELECT well_key, month, round(oil_rate + water_rate, 6) AS liquid_rate, round(coalesce(CASE WHEN water_cut BETWEEN 0 AND 1 THEN water_cut * 100 ELSE water_cut END, water_rate / nullif(oil_rate + water_rate, 0) * 100), 6) AS water_cut_pct, round(gas_rate / nullif(oil_rate, 0), 6) AS gor FROM cm",
    "win08_running": f"WITH {CM} SELECT well_key, month, CAST(row_number() {_W} AS INT) AS month_index, round(sum(coalesce(days_on, 0)) {_RUN}, 3) AS days_so_far, round(coalesce(last_value(cum_oil IGNORE NULLS) {_RUN}, sum(coalesce(monthly_oil, 0)) {_RUN}), 3) AS oil_so_far, round(sum(coalesce(monthly_water, 0)) {_RUN}, 3) AS water_so_far FROM cm",
    "win01_first_and_last": f"WITH {PM}, {_FL} SELECT * FROM fl",
    "agg12_well_totals": f"WITH {PM}, {_TOT} SELECT well_key, months, {_R('days oil_volume water_volume gas_volume mean_oil_rate mean_water_rate mean_gas_rate', 4)} FROM tt",
    "agg13_dashboard": f"""WITH {PM}, {_TOT}, {_FL} SELECT well_key, months, {_R('days oil_volume water_volume gas_volume mean_oil_rate mean_water_rate mean_gas_rate', 4)}, first_month, round(first_oil_rate, 4) AS first_oil_rate, latest_month, {_R('latest_oil_rate first_pressure last_pressure min_pressure max_pressure', 4)},
 last_status, round(last_cum_oil, 4) AS last_cum_oil, round(last_pressure - first_pressure, 4) AS pressure_change, {", ".join(f"round({p}_volume / nullif(days, 0), 4) AS weighted_{p}_rate" for p in ("oil", "water", "gas"))} FROM tt LEFT JOIN fl USING (well_key)""",
    "agg14_summary": f"""WITH {CM}, r AS (SELECT *, coalesce(oil_rate, monthly_oil / nullif(days_on, 0)) AS rate FROM cm) SELECT well_key, min(month) FILTER (rate IS NOT NULL) AS initial_month, round(arg_min(rate, month) FILTER (rate IS NOT NULL), 4) AS initial_oil_rate, max(month) FILTER (rate IS NOT NULL) AS latest_month,
 round(arg_max(rate, month) FILTER (rate IS NOT NULL), 4) AS latest_oil_rate, round(max(rate), 4) AS peak_oil_rate, round(max(oil_rate + water_rate), 4) AS peak_liquid_rate, round(sum(monthly_oil), 4) AS oil_volume FROM r GROUP BY well_key""",
    "win10_early_and_late": f"WITH {CM}, {_EL} SELECT well_key, {_R('initial_rate late_rate', 6)} FROM el",
    "win11_stability": f"WITH {CM}, {_STB} SELECT well_key, round(stability, 6) AS stability FROM sy",
    "ing09_status_changes": f"WITH {PM}, {SC} SELECT * FROM sc",
    "ing10_on_stream": f"WITH {PM} SELECT well_key, min(month) AS on_stream FROM pm WHERE oil_rate > 0 OR monthly_oil > 0 GROUP BY well_key",
    "win12_intervention_response": f"WITH {CM}, {EV}, {_RSP} SELECT well_key, round(response_pct, 6) AS response_pct, n_events FROM rs",
    "win13_segments": f"""WITH {CM}, {EV}, f AS (SELECT well_key, min(month) AS e FROM ev GROUP BY well_key), g AS (SELECT well_key, CASE WHEN month < e THEN 'before' ELSE 'after' END AS segment, count(*) AS n, avg(oil_rate) AS m FROM cm JOIN f USING (well_key) GROUP BY ALL)
 SELECT well_key, segment, n, round(m, 6) AS mean_oil_rate FROM g WHERE well_key IN (SELECT well_key FROM g WHERE n >= 3 GROUP BY well_key HAVING count(*) = 2)""",
    "mdl13_decline": f"""WITH {CM}, i AS (SELECT well_key, CAST(row_number() {_W} - 1 AS DOUBLE) AS t, oil_rate AS q FROM cm), p AS (SELECT * FROM i WHERE q > 0 AND well_key IN (SELECT well_key FROM i WHERE q > 0 GROUP BY well_key HAVING count(*) >= 4)),
 x AS (SELECT p.*, b / 100 AS b, CASE WHEN b = 0 THEN ln(q) ELSE pow(q, -(b / 100)) END AS y FROM p, range(0, 201) r(b)),
 a AS (SELECT well_key, b, count(*) AS n, sum(t) AS t, sum(y) AS y, sum(t * t) AS tt, sum(t * y) AS ty FROM x GROUP BY ALL),
 f AS (SELECT well_key, b, n, (n * ty - t * y) / nullif(n * tt - t * t, 0) AS m, (y - (n * ty - t * y) / nullif(n * tt - t * t, 0) * t) / n AS c FROM a),
 e AS (SELECT well_key, b, any_value(n) AS n, any_value(c) AS c, sum(pow(q - CASE WHEN b = 0 THEN exp(c + m * t) WHEN c + m * t > 0 THEN pow(c + m * t, -1 / nullif(b, 0)) END, 2)) AS sse, count(CASE WHEN b = 0 OR c + m * t > 0 THEN 1 END) AS k FROM x JOIN f USING (well_key, b) GROUP BY ALL),
 g AS (SELECT *, row_number() OVER (PARTITION BY well_key ORDER BY sse, b) AS rn FROM e WHERE k = n)
 SELECT well_key, CAST(n AS INT) AS n_points, round(b, 3) AS b, round(CASE WHEN b = 0 THEN exp(c) ELSE pow(c, -1 / nullif(b, 0)) END, 3) AS initial_rate FROM g WHERE rn = 1""",
    "mdl14_corrected": f"WITH {CM}, {_COR} SELECT well_key, month, round(days, 3) AS days, inferred, {_R('oil_volume water_volume gas_volume cut oil_total water_total', 3)} FROM c2",
    "mdl15_audit": f"WITH {CM}, {_AUD} SELECT well_key, figure, round(before, 3) AS before, round(after, 3) AS after, changed FROM ad",
    "agg37_correction_counts": f"WITH {CM}, {_AUD} SELECT (SELECT count(*) FROM c2) AS n_rows, (SELECT count(DISTINCT well_key) FROM c2) AS n_wells, (SELECT count(*) FROM c2 WHERE inferred) AS n_inferred, (SELECT count(*) FROM ad WHERE changed) AS n_changed",
    "mdl16_features": f"WITH {_FEAT} SELECT well_key, records, {_R('oil_volume water_volume mean_rate peak_rate mean_cut mean_pressure days boe initial_rate late_rate stability response_pct decline_ratio', 4)} FROM ft",
    "agg33_coverage": f"""WITH {_FEAT}, n AS (SELECT count(*) AS n FROM ft), l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known FROM ft" for c in ("mean_rate", "peak_rate", "mean_cut", "stability", "response_pct"))})
 SELECT feature, known, round(known / n * 100, 6) AS pct, known >= greatest(2, ceil(n * 0.5)) AS used FROM l, n""",
    "sc27_grades": f"WITH {_FEAT}, c AS (SELECT quantile_cont(mean_rate, 1/3) AS p1, quantile_cont(mean_rate, 2/3) AS p2 FROM ft) SELECT well_key, CASE WHEN mean_rate <= p1 THEN 'low' WHEN mean_rate <= p2 THEN 'mid' ELSE 'high' END AS grade FROM ft, c WHERE mean_rate IS NOT NULL",
    "agg34_weighted_rates": f"WITH {_FEAT} SELECT round(sum(oil_volume), 3) AS oil_volume, round(sum(days), 3) AS days, round(coalesce(sum(oil_volume) / nullif(sum(days), 0), avg(mean_rate)), 3) AS rate FROM ft",
    "mdl26_parallel_axis": f"WITH {_FEAT}, p AS (SELECT quantile_cont(mean_rate, 0.02) AS lo, quantile_cont(mean_rate, 0.98) AS hi FROM ft) SELECT well_key, round(CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (mean_rate - lo) / (hi - lo))) ELSE 0.5 END, 6) AS axis FROM ft, p WHERE mean_rate IS NOT NULL",
    "mdl48_composition": f"WITH {PM}, {_TOT} SELECT well_key, " + ", ".join(f"round({p}_volume / nullif(coalesce(oil_volume, 0) + coalesce(water_volume, 0), 0), 6) AS {p}_part" for p in ("oil", "water")) + " FROM tt",
}

ORACLE = {k: rounding_alike(v) for k, v in ORACLE.items()}

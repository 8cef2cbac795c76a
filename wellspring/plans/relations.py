"""Domain relations on the given tables, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.operators import catalog, production
from wellspring.operators.curves import CURVE_TYPES, DESCRIBED, mnemonic_pattern
from wellspring.operators.wells import kind_of
from wellspring.tables import table


TIE = 1.3e-7  # added before rounding: sums that lie on a tie round alike in any order of adding


def rounded(df, n=6):
    """Doubles to n places, so that sums in another order compare equal."""
    return df.select(*[F.round(F.col(c) + TIE, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounding_alike(sql):
    """The same in SQL: TIE is added in every round(x, n)."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        depth, comma, j = 1, -1, at + 6
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        out.append(sql[i:at] + (f"round(({rounding_alike(sql[at + 6 : comma])}) + {TIE}, {sql[comma + 1 : j - 1].strip()})" if comma > 0 else f"round({rounding_alike(sql[at + 6 : j - 1])})"))
        i = j
    return "".join(out) + sql[i:]


def pm(spark, d):
    return production.monthly_rows(table(spark, d, "production_corrected"))


def cm(spark, d):
    return production.consolidated(pm(spark, d))


def tests(spark, d):
    """Interventions: months in which a well is shut in anew."""
    return production.status_changes(pm(spark, d)).where("status = 'shut in'").select("well_key", "month")


def stations(spark, d):
    """Survey stations: one per event of a user, 30 apart."""
    e = table(spark, d, "events")
    md = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 30.0
    return e.select(F.concat(F.lit("E"), F.col("user_id")).alias("well"), F.col("event_id").alias("id"), md.alias("md"), F.abs(F.col("event_id") % 60).cast("double").alias("inc"), F.abs(F.col("event_id") * 7 % 360).cast("double").alias("azi"))


def heads(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select(F.concat(F.lit("E"), F.col("user_id")).alias("well"), (F.col("user_id") * 10.0).alias("x"), (F.col("user_id") * 20.0).alias("y"), F.lit(100.0).alias("kb"))


def nodes(spark, d):
    """Grid nodes: 40 columns; every 37th value missing."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when(F.col("p_partkey") % 37 != 0, F.col("p_retailprice") / 100).alias("value"))


def curves(spark, d):
    return table(spark, d, "las_curves")


def spanned_curves(spark, d):
    """Curves with a depth range and step; every seventh without a step."""
    c = curves(spark, d)
    step = F.when(F.col("id") % 7 != 0, 0.1 + F.col("id") % 3 * 0.05)
    return c.withColumns({"start": 1000.0 + F.col("id") % 500, "step": step}).withColumn("stop", F.col("start") + F.col("sample_count") * F.coalesce("step", F.lit(0.1)) * (1 + F.col("id") % 4 / 10))


def samples(spark, d):
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series"), (F.col("l_extendedprice") / 100).alias("value"))


def files(spark, d):
    s = table(spark, d, "sources")
    return catalog.catalogued(s.where("file_path is not null").select(F.col("file_path").alias("path"), (F.col("record_count") * 100).alias("size")))


def intervals(spark, d):
    i = table(spark, d, "interpretation_v1")
    ok = "not isnan(top_md) and not isnan(base_md) and top_md >= 0 and base_md >= 0 and top_md <> base_md"
    return i.where(ok).select(F.col("row_no").alias("id"), F.upper("well").alias("well"), F.least("top_md", "base_md").alias("top"), F.greatest("top_md", "base_md").alias("base"))


def sources_kind(spark, d):
    return table(spark, d, "sources").select(F.col("id").alias("source_id"), kind_of(F.col("data_type")).alias("kind"))


def pair_ratio(pairs, most=16):
    """SQL: (pid, ratio) of table `pairs` (pid, ka, kb) of keys of `most` letters at most, matching blocks found again and
    again in what is left and right of the longest one."""
    return f"""mb AS (SELECT * FROM (WITH RECURSIVE mb(pid, al, ah, bl, bh, k) AS (SELECT pid, 1, length(ka) + 1, 1, length(kb) + 1, 0 FROM {pairs} UNION ALL
  SELECT pid, unnest([al, -m.i + m.k]), unnest([-m.i, ah]), unnest([bl, -m.j + m.k]), unnest([-m.j, bh]), unnest([m.k, 0]) FROM (
   SELECT pid, al, ah, bl, bh, max(struct_pack(k := CAST(g.k AS INT), i := CAST(-g.i AS INT), j := CAST(-g.j AS INT))) AS m FROM mb JOIN {pairs} USING (pid)
   JOIN (SELECT i, j, k FROM range(1, {most + 1}) a(i), range(1, {most + 1}) b(j), range(1, {most + 1}) c(k)) g ON g.i >= al AND g.i + g.k <= ah AND g.j >= bl AND g.j + g.k <= bh AND substr(ka, CAST(g.i AS INT), CAST(g.k AS INT)) = substr(kb, CAST(g.j AS INT), CAST(g.k AS INT)) GROUP BY ALL)) SELECT * FROM mb)),
 ratio AS (SELECT pid, 2.0 * sum(mb.k) / nullif(any_value(length(ka) + length(kb)), 0) AS ratio FROM mb JOIN {pairs} USING (pid) GROUP BY pid)"""


WELL_KEYS = """k AS (SELECT id, nullif(array_to_string(regexp_extract_all(normalized_key, '[0-9]+'), '-'), '') AS d, CASE WHEN length(regexp_replace(normalized_key, '[AEIOU]', '', 'g')) >= 3 THEN regexp_replace(normalized_key, '[AEIOU]', '', 'g') END AS v,
 CASE WHEN NOT isnan(x) AND NOT isnan(y) THEN CAST(round_even(x, 0) AS BIGINT) || '|' || CAST(round_even(y, 0) AS BIGINT) END AS p FROM wells)"""
_SAME = "regexp_matches(ka, '[0-9]') AND regexp_extract_all(ka, '[0-9]+') = regexp_extract_all(kb, '[0-9]+')"
_BARE = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]+', '', 'g'), '(EXP|DEV|LOGS?|TZ)$', ''), '[AEIOU]', '', 'g'), ''), regexp_replace(regexp_replace({c}, '[0-9]+', '', 'g'), '(EXP|DEV|LOGS?|TZ)$', ''))"
SIMILARITY = f"sim AS (SELECT ka, kb, CASE WHEN ka = kb THEN 1.0 WHEN {_SAME} THEN greatest(coalesce(ratio, 0), CASE WHEN starts_with(ka, kb) OR starts_with(kb, ka) THEN 0.9 ELSE 0.78 END) ELSE coalesce(ratio, 0) END AS sim FROM pr JOIN ratio USING (pid))"
MATCH_SCORE = f"""score AS (SELECT ka, kb, CASE WHEN ka = '' OR kb = '' THEN 0.0 WHEN {_SAME} THEN greatest(sim, CASE WHEN {_BARE('ka')} = {_BARE('kb')} AND {_BARE('ka')} <> '' THEN 0.96 WHEN {_BARE('ka')}[1] = {_BARE('kb')}[1] AND {_BARE('ka')} <> '' THEN 0.88 ELSE 0 END) ELSE sim END AS score FROM sim)"""


_FIN = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
PM = (
    "pm AS (SELECT id, source_id, wellkey AS well_key, strftime(productiondate AT TIME ZONE 'UTC', '%Y-%m') AS month, "
    + ", ".join(f"{_FIN(c)} AS {n}" for n, c in {"days_on": "dayson", "oil_rate": "oilrate", "water_rate": "waterrate", "gas_rate": "gasrate", "water_cut": "watercutpct", "monthly_oil": "monthlyoil", "monthly_water": "monthlywater", "monthly_gas": "monthlygas", "cum_oil": "cumulativeoil", "pressure": "pressure"}.items())
    + ", wellstatus AS status FROM production_corrected WHERE productiondate >= TIMESTAMPTZ '1950-01-01 00:00:00+00' AND productiondate <= loaded_at)"
)
_LAST = ", ".join(f"arg_max({f}, id) FILTER ({f} IS NOT NULL) AS {f}" for f in (*production.FIELDS, "cum_oil"))
CM = f"{PM}, cm AS (SELECT well_key, month, {_LAST}, count(*) AS n_rows FROM pm GROUP BY ALL)"
SC = "sm AS (SELECT well_key, month, arg_max(status, id) FILTER (status IS NOT NULL) AS status FROM pm GROUP BY ALL), sb AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY well_key ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sm), sc AS (SELECT well_key, month, status FROM sb WHERE status IS NOT NULL AND status IS DISTINCT FROM before)"
EV = f"{SC}, ev AS (SELECT well_key, month FROM sc WHERE status = 'shut in')"
ST = "st AS (SELECT 'E' || user_id AS well, event_id AS id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 30.0 AS DOUBLE) AS md, CAST(abs(event_id % 60) AS DOUBLE) AS inc, CAST(abs(event_id * 7 % 360) AS DOUBLE) AS azi FROM events)"
NODES = "nodes AS (SELECT CAST(p_partkey // 40 AS INT) AS row, CAST(p_partkey % 40 AS INT) AS col, CASE WHEN p_partkey % 37 <> 0 THEN p_retailprice / 100 END AS value FROM part)"
SAMPLES = "samples AS (SELECT l_returnflag || l_linestatus AS series, l_extendedprice / 100 AS value FROM lineitem)"
KIND = "CASE WHEN regexp_matches(t, 'well.?head|井头') THEN 'well_head' WHEN regexp_matches(t, 'dev|井斜') THEN 'deviation' WHEN regexp_matches(t, 'core') THEN 'core' WHEN regexp_matches(t, 'las') THEN 'las' WHEN regexp_matches(t, 'interp') THEN 'interpretation' WHEN regexp_matches(t, 'prod') THEN 'production' ELSE 'other' END"
SPANNED = "sc AS (SELECT *, start + sample_count * coalesce(step, 0.1) * (1 + id % 4 / 10) AS stop FROM (SELECT *, 1000.0 + id % 500 AS start, CASE WHEN id % 7 <> 0 THEN CAST(0.1 AS DOUBLE) + id % 3 * CAST(0.05 AS DOUBLE) END AS step FROM las_curves))"
CURVE_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(upper(mnemonic), '[^A-Z0-9]', '', 'g'), '{mnemonic_pattern(w)}') THEN '{t}'" for t, _, w in CURVE_TYPES) + " " + " ".join(f"WHEN regexp_matches(upper(coalesce(description, '')), '{w}') THEN '{t}'" for t, w in DESCRIBED) + " END"
SRC = f"src AS (SELECT *, {KIND} AS kind FROM (SELECT *, lower(coalesce(data_type, '')) AS t FROM sources))"
IV = "iv AS (SELECT row_no AS id, upper(well) AS well, least(top_md, base_md) AS top, greatest(top_md, base_md) AS base FROM interpretation_v1 WHERE NOT isnan(top_md) AND NOT isnan(base_md) AND top_md >= 0 AND base_md >= 0 AND top_md <> base_md)"
FILES = """fl AS (SELECT file_path AS path, record_count * 100 AS size, lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder,
 lower(regexp_replace(file_path, '^.*/', '')) AS name, upper(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\\.[A-Za-z0-9]{1,4}$', '')) AS stem FROM sources WHERE file_path IS NOT NULL),
 ct AS (SELECT path, size, ext, folder, regexp_replace(regexp_replace(stem, '[\\s_\\-]*(COPY|RUN\\s*\\d+|FINAL|V\\d+)$', ''), '[^0-9A-Z]', '', 'g') AS well_key,
 CASE WHEN ext = 'las' THEN 'well_log' WHEN ext IN ('sgy','segy') THEN 'seismic' WHEN ext IN ('dev','path') THEN 'deviation' WHEN regexp_matches(name, 'well.?head|wellhead') THEN 'well_head' WHEN regexp_matches(name, 'deviation|survey') THEN 'deviation'
 WHEN regexp_matches(name, 'production|prod') THEN 'production' WHEN regexp_matches(name, 'core') THEN 'core' WHEN regexp_matches(name, 'interp') THEN 'interpretation' WHEN ext IN ('csv','txt','xlsx') THEN 'table' ELSE 'other' END AS kind FROM fl)"""

"""Queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.llm import canonical, golden, matching, mixing, subjects, tokenizing
from wellspring.tables import table


def p2_found(spark, d):
    """The mention each field of a well survives from."""
    return golden.well_survivors(table(spark, d, "well_sources"), table(spark, d, "sources"), table(spark, d, "source_trust"))


def p2_golden(spark, d):
    """One surviving record per well with several mentions."""
    return golden.golden_wells(table(spark, d, "well_sources"), table(spark, d, "sources"), table(spark, d, "source_trust"))


def p4_found(spark, d):
    """The well each unresolved mention describes."""
    found = matching.well_matches(table(spark, d, "well_sources"), table(spark, d, "wells"))
    return found.select("mention_id", F.col("entity_id").alias("well_id"))


def p4_matches(spark, d):
    """The same with confidences."""
    return matching.well_matches(table(spark, d, "well_sources"), table(spark, d, "wells"))


def p5_found(spark, d):
    """Entry of curve_reference or horizon_name_groups meant by a free name."""
    curves = canonical.curve_entries(table(spark, d, "las_curves"), table(spark, d, "curve_reference"))
    horizons = canonical.horizon_entries(table(spark, d, "horizon_name_aliases"), table(spark, d, "horizon_name_groups"))
    named = lambda df, n: df.select(F.lit(n).alias("table_name"), "record_id", "canonical_key")
    return named(curves, "las_curves").unionByName(named(horizons, "horizon_name_aliases"))


def p8_ids(spark, d):
    """Every text as byte_bpe_50k ids."""
    return tokenizing.token_ids(table(spark, d, "documents"))


def p9_mix(spark, d):
    """Documents of the mix with their copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    """Target and reached share of each source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark, d):
    """Subjects of every document without labels."""
    return subjects.unlabelled_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p10_calibration(spark, d):
    """Agreement with the labelled sample at every threshold of each subject."""
    return subjects.calibrated_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"))


QUERIES = {
    "p2_found": p2_found, "p2_golden": p2_golden, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found,
    "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_calibration": p10_calibration,
}

_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(data_type)), '{w}') THEN '{t}'" for t, w in golden.TYPE_WORDS.items()) + " END"
_NO = ", ".join(str(p) for p in golden.PLACEHOLDERS)

_PICKED = f"""s AS (SELECT id AS source_id, status, imported_at, {_TYPE} AS ty FROM sources),
 st AS (SELECT s.*, trust_rank FROM s LEFT JOIN source_trust t ON t.data_type = s.ty),
 w AS (SELECT well_id FROM well_sources WHERE well_id IS NOT NULL GROUP BY well_id HAVING count(*) >= 2),
 v AS (SELECT id, well_id, source_id, 'kb_elevation' AS f, kb_elevation AS v FROM well_sources SEMI JOIN w USING (well_id) UNION ALL
  SELECT id, well_id, source_id, 'total_depth', total_depth FROM well_sources SEMI JOIN w USING (well_id)),
 g AS (SELECT * FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND v NOT IN ({_NO})),
 m AS (SELECT well_id, f, median(v) AS mid FROM g GROUP BY ALL),
 c AS (SELECT g.*, coalesce(trust_rank, 1000000) AS r, imported_at AS i FROM g JOIN m USING (well_id, f) JOIN st USING (source_id) WHERE status = 'ready' AND abs(v - mid) <= abs(mid) * 0.2 + 1e-9),
 b AS (SELECT *, row_number() OVER (PARTITION BY well_id, f ORDER BY r, i DESC NULLS LAST, id DESC) AS n FROM c),
 k AS (SELECT * FROM b WHERE n = 1), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY r, i DESC NULLS LAST, id DESC) AS q FROM k) WHERE q = 1)"""

ORACLE = {
    "p2_found": f"""WITH {_PICKED} SELECT well_id, f AS field_name, id AS mention_id FROM k UNION ALL SELECT well_id, 'preferred_source_id', id FROM p""",
    # identity is the most trusted mention that states an identifier, place the most trusted one that states no other
    "p2_golden": f"""WITH {_PICKED}, a AS (SELECT ws.*, nullif(rpad(regexp_replace(uwi, '[^0-9]', '', 'g'), 13, '0'), '0000000000000') AS uk, coalesce(trust_rank, 1000000) AS r, imported_at AS i FROM well_sources ws SEMI JOIN w USING (well_id) JOIN st USING (source_id) WHERE status = 'ready'),
 o AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY r, i DESC NULLS LAST, id DESC) AS n FROM a WHERE uk IS NOT NULL), d AS (SELECT * FROM o WHERE n = 1),
 x AS (SELECT a.*, row_number() OVER (PARTITION BY a.well_id ORDER BY a.r, a.i DESC NULLS LAST, a.id DESC) AS n FROM a LEFT JOIN d USING (well_id) WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND NOT isnan(a.x) AND NOT isnan(a.y) AND (a.uk IS NULL OR d.uk IS NULL OR a.uk = d.uk)), l AS (SELECT * FROM x WHERE n = 1),
 e AS (SELECT well_id FROM k UNION SELECT well_id FROM d UNION SELECT well_id FROM l)
 SELECT e.well_id, d.raw_name, d.uwi, l.x, l.y, l.crs, kb.v AS kb_elevation, td.v AS total_depth, p.source_id AS preferred_source_id
 FROM e LEFT JOIN d USING (well_id) LEFT JOIN l USING (well_id) LEFT JOIN (SELECT * FROM k WHERE f = 'kb_elevation') kb USING (well_id) LEFT JOIN (SELECT * FROM k WHERE f = 'total_depth') td USING (well_id) LEFT JOIN p USING (well_id)""",
}

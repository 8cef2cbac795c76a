"""Log curves: statistics, coverage, distributions, intervals, candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.functions.scalars import depth_factor, is_time_depth, similarity_of_ranges, valid_sample
from wellspring.functions.text import clean_text, finite
from wellspring.operators.ranks import quantiles

# fixed values: curve types in the order they are tried: key, role, mnemonics
CURVE_TYPES = (
    ("caliper", "CAL", "CAL|CALI|HCAL|DCAL"), ("sp", "SP", "SP|SSP"), ("gamma_ray", "GR", "GR|GAM|GRC|SGR|CGR"), ("neutron", "NPHI", "NPHI|TNPH|CNL|NPOR"), ("density", "RHOB", "RHOB|RHOZ|DEN|DENS|ZDEN"), ("sonic", "DT", "DTCO|DTC|DT|AC|SONIC"),
    ("resistivity_deep", "RT", "RILD|LLD|ILD|AT90|RT|RD"), ("resistivity_medium", "RM", "ILM|LLM|AT30|RM"), ("resistivity_shallow", "RS", "RILS|LLS|MSFL|RXO|AT10|RS"), ("laterolog", "RLL", "RLL|LL"),
)
# fixed values: what may follow a mnemonic, and words of descriptions in the order they are tried
AFTER_MNEMONIC = r"(?:\d+|DS|RAW|EDIT|NEW|OLD|MERGE|V\d+|$)"
DESCRIBED = (("gamma_ray", "GAMMA|伽马"), ("density", "DENSITY|密度"), ("neutron", "NEUTRON|中子"), ("sonic", "SONIC|声波"), ("caliper", "CALIPER|井径"), ("sp", "SPONTANEOUS|自然电位"), ("laterolog", "RESIST|电阻率|LATEROLOG"))
UNCLASSIFIED = "unclassified"


def mnemonic_pattern(words: str) -> str:
    return f"^(?:{words}){AFTER_MNEMONIC}"


def curve_rules(mnemonic: Column, description: Column) -> Column:
    """SC10: (type, confidence) by ordered mnemonic families, letters and digits only
    (0.94), then by description words (0.68); null without either."""
    m, d = F.regexp_replace(F.upper(mnemonic), "[^A-Z0-9]", ""), F.upper(F.coalesce(description, F.lit("")))
    answer = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    c = F.when(F.lit(False), answer("", 0.0))
    for name, _, words in CURVE_TYPES:
        c = c.when(m.rlike(mnemonic_pattern(words)), answer(name, 0.94))
    for name, words in DESCRIBED:
        c = c.when(d.rlike(words), answer(name, 0.68))
    return c


def curve_type(mnemonic: Column, description: Column) -> Column:
    """SC10: type of a curve."""
    return curve_rules(mnemonic, description)["type"]


def type_confidence(mnemonic: Column, description: Column) -> Column:
    """SC10: confidence of the type, null without one."""
    return curve_rules(mnemonic, description)["confidence"]


def created_types(types: DataFrame, new: DataFrame) -> DataFrame:
    """HLP07: types (type_key, name, role, created_at) with new ones (name, role,
    created_at): the key is the role or name in lower case, letters and digits joined by
    underscores, 'custom' if none are left; from the second of a key on it is numbered,
    in the order of creation, free numbers only."""
    slug = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce(F.nullif("role", F.lit("")), "name")), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("custom"))
    base = F.regexp_replace("type_key", r"_\d+$", "")
    taken = types.select(base.alias("slug"), F.coalesce(F.nullif(F.regexp_extract("type_key", r"_(\d+)$", 1), F.lit("")), F.lit("1")).cast("int").alias("number")).groupBy("slug").agg(F.max("number").alias("last"))
    rows = new.withColumn("slug", slug).withColumn("nth", F.row_number().over(W.partitionBy("slug").orderBy("created_at", "name"))).join(taken, "slug", "left")
    number = F.coalesce("last", F.lit(0)) + F.col("nth")
    key = F.when(number == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", number.cast("string")))
    return types.unionByName(rows.select(key.alias("type_key"), F.trim("name").alias("name"), F.coalesce("role", F.lit(None).cast("string")).alias("role"), "created_at"))


def assigned(assignments: DataFrame, new: DataFrame, types: DataFrame) -> DataFrame:
    """HLP07: type of each mnemonic (mnemonic, type_key, status, updated_at) after new
    decisions (mnemonic, type_key, updated_at): the latest decision is confirmed, none
    means unclassified; decisions for a type that does not exist are left out."""
    said = new.select(F.upper("mnemonic").alias("mnemonic"), F.coalesce(F.nullif("type_key", F.lit("")), F.lit(UNCLASSIFIED)).alias("type_key"), F.lit("confirmed").alias("status"), "updated_at")
    known = types.select("type_key").union(types.sparkSession.createDataFrame([(UNCLASSIFIED,)], "type_key string")).distinct()
    rows = assignments.select("mnemonic", "type_key", "status", "updated_at").unionByName(said.join(known, "type_key", "left_semi").select("mnemonic", "type_key", "status", "updated_at"))
    order = F.struct("updated_at", F.col("status") == "confirmed", "type_key")
    return rows.groupBy("mnemonic").agg(F.max_by(F.struct("type_key", "status", "updated_at"), order).alias("b")).select("mnemonic", "b.*")


def without_rivals(rivals: DataFrame, assignments: DataFrame) -> DataFrame:
    """HLP07, MDL46: assignments of the other pool without the mnemonics that are
    confirmed as a type of this one, so that no name belongs to both."""
    owned = assignments.where(f"status = 'confirmed' and type_key <> '{UNCLASSIFIED}'").select("mnemonic")
    return rivals.join(owned, "mnemonic", "left_anti")


def statistics(curves: DataFrame) -> DataFrame:
    """AGG03: per mnemonic distinct wells and files, units, samples and range."""
    unit = F.upper(F.trim(clean_text(F.col("unit"))))
    return curves.groupBy(F.upper(F.trim("mnemonic")).alias("mnemonic")).agg(
        F.countDistinct("well_id").alias("wells"), F.countDistinct("las_file_id").alias("files"), F.array_join(F.array_sort(F.collect_set(unit)), ",").alias("units"),
        F.sum("sample_count").alias("samples"), F.min(finite(F.col("value_min"))).alias("low"), F.max(finite(F.col("value_max"))).alias("high"),
    )


def typed(curves: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """MDL46: type of each curve: a decided one (mnemonic, type) before the suggested."""
    rows = curves.withColumns({"suggested": curve_type(F.col("mnemonic"), F.col("description")), "m": F.upper(F.trim("mnemonic"))})
    if decided is None:
        return rows.withColumns({"curve_type": F.col("suggested"), "how": F.when(F.col("suggested").isNotNull(), "automatic").otherwise("unclassified")})
    d = decided.select(F.upper("mnemonic").alias("m"), F.col("type").alias("decided"))
    how = F.when(F.col("decided").isNotNull(), "confirmed").when(F.col("suggested").isNotNull(), "automatic").otherwise("unclassified")
    return rows.join(d, "m", "left").withColumns({"curve_type": F.coalesce("decided", "suggested"), "how": how})


def type_coverage(curves: DataFrame) -> DataFrame:
    """AGG06: wells with each type, as a share of all wells with curves."""
    rows = typed(curves).where("well_id is not null")
    total = rows.agg(F.countDistinct("well_id").alias("n"))
    return rows.where("curve_type is not null").groupBy("curve_type").agg(F.countDistinct("well_id").alias("wells")).crossJoin(total).select("curve_type", "wells", F.round(F.col("wells") / F.col("n") * 100, 2).alias("pct"))


def modal(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """AGG07, SRT09: most frequent value; of equally frequent ones the first seen."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(by).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias("mode"), F.countDistinct(value).alias("kinds")).withColumn("mixed", F.col("kinds") > 1)


def description(samples: DataFrame, by: str, value: str) -> DataFrame:
    """AGG08: n, range, percentiles, mean and population deviation per series."""
    good = samples.where(valid_sample(F.col(value)))
    d = good.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return d.join(quantiles(good, value, [0.05, 0.25, 0.5, 0.75, 0.95], (by,)), by).select(by, "n", "low", *[F.col("p")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))], "high", "mean", "std")


def histogram(samples: DataFrame, by: str, value: str, bins: int = 28) -> DataFrame:
    """AGG09, AGG10: counts per bin over the 1st to 99th percentile, values beyond
    falling into the end bins, empty bins listed; one bin where all are equal.
    Bounds come from an aggregation and join back by the series."""
    good = samples.where(valid_sample(F.col(value)))
    lim = quantiles(good, value, [0.01, 0.99], (by,)).select(by, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))).otherwise(0)
    got = good.join(lim, by).groupBy(by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = lim.select(by, "lo", "hi", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))).alias("bin"))
    return every.join(got, [by, "bin"], "left").select(by, "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def with_conditions(wells: DataFrame, sets: dict[str, DataFrame], conditions: list[tuple[str, bool]], all_of: bool = True) -> DataFrame:
    """FLT05, FLT11: wells (well_key) meeting conditions (name of a set, whether
    the well must be in it), all of them or any."""
    df = wells.select("well_key")
    tests = []
    for i, (name, inside) in enumerate(conditions):
        df = df.join(sets[name].select("well_key").distinct().withColumn(f"has{i}", F.lit(True)), "well_key", "left")
        tests.append(F.col(f"has{i}").isNotNull() if inside else F.col(f"has{i}").isNull())
    test = F.lit(all_of)
    for t in tests:
        test = (test & t) if all_of else (test | t)
    return df.where(test).select("well_key")


def window_of(intervals: DataFrame, unit: Column) -> DataFrame:
    """FLT08: top and base in metres, put in order; rows without a known unit drop."""
    f = depth_factor(unit)
    a, b = finite(F.col("top")) * f, finite(F.col("base")) * f
    return intervals.withColumns({"top_m": F.least(a, b), "base_m": F.greatest(a, b)}).where(a.isNotNull() & b.isNotNull())


def within(points: DataFrame, intervals: DataFrame, key: str, bucket: float) -> DataFrame:
    """JOIN10, JOIN13: points (key, md) joined with the intervals (key, top, base)
    that hold them. Both sides meet in depth buckets, so a key of many points is
    spread and the join stays an equality join."""
    i = intervals.withColumn("bk", F.explode(F.sequence(F.floor(F.col("top") / bucket), F.floor(F.col("base") / bucket))))
    p = points.withColumn("bk", F.floor(F.col("md") / bucket))
    return p.join(i, [key, "bk"]).where(F.col("md").between(F.col("top"), F.col("base"))).drop("bk")


def overlaps(a: DataFrame, b: DataFrame, key: str, bucket: float) -> DataFrame:
    """JOIN11, JOIN12: pairs of intervals of a key that overlap, with the length
    shared and whether b covers a whole. Pairs meeting in several buckets count
    in the one where their overlap begins."""
    cut = lambda df, s: df.select(key, *[F.col(c).alias(f"{s}_{c}") for c in ("id", "top", "base")], F.explode(F.sequence(F.floor(F.col("top") / bucket), F.floor(F.col("base") / bucket))).alias("bk"))
    both = cut(a, "a").join(cut(b, "b"), [key, "bk"])
    lo, hi = F.greatest("a_top", "b_top"), F.least("a_base", "b_base")
    return both.where((lo < hi) & (F.floor(lo / bucket) == F.col("bk"))).select(key, "a_id", "b_id", (hi - lo).alias("shared"), ((F.col("b_top") <= F.col("a_top")) & (F.col("b_base") >= F.col("a_base"))).alias("covered"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """MDL35, SET04: wells of two curves (well_id, low, high): in both, in one, and
    the median similarity of their ranges in common wells."""
    x = a.groupBy("well_id").agg(F.min("low").alias("al"), F.max("high").alias("ah"))
    y = b.groupBy("well_id").agg(F.min("low").alias("bl"), F.max("high").alias("bh"))
    j = x.join(y, "well_id", "full")
    has_a, has_b = F.col("al").isNotNull(), F.col("bl").isNotNull()
    similar = quantiles(j, similarity_of_ranges(F.col("al"), F.col("ah"), F.col("bl"), F.col("bh")), [0.5]).select(F.col("p")[0].alias("similarity"))
    counts = j.agg(F.count_if(has_a & has_b).alias("both"), F.count_if(has_a & ~has_b).alias("only_a"), F.count_if(~has_a & has_b).alias("only_b"))
    return counts.crossJoin(similar)  # one row each


def focus(curves: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """MDL36, SRT05: best curve of each well and type of curves (id, well_id, mnemonic,
    description, unit, sample_count, start, stop, step, value_min, value_max): score of
    span against the longest .40, samples against those expected .34 (.55 of it where the
    number is unknown), canonical name .10, usual unit .06, range .06 and step .04; ties
    go to the longer span, then the later mnemonic, then the lower id. A decided curve
    (well_id, curve_type, id, excluded array) overrides the score."""
    rows = typed(curves).where("well_id is not null and curve_type is not null").where(~is_time_depth(F.col("mnemonic")))
    step = F.nullif(F.abs("step"), F.lit(0.0))
    rows = rows.withColumns({"unit_": F.nullif(F.upper(F.trim("unit")), F.lit("")), "span": F.greatest(F.lit(0.0), F.coalesce(F.col("stop") - F.col("start"), F.lit(0.0))), "step_": step})
    top = rows.groupBy("well_id", "curve_type").agg(F.max("span").alias("most"))
    common = modal(rows, "curve_type", "unit_", "id").select("curve_type", F.col("mode").alias("usual"))
    j = rows.join(top, ["well_id", "curve_type"]).join(common, "curve_type", "left")
    role = F.create_map(*[F.lit(x) for name, r, _ in CURVE_TYPES for x in (name, r)])[F.col("curve_type")]
    expected = F.col("span") / F.col("step_") + 1
    complete = F.when(F.col("sample_count").isNull(), 0.55).when(expected.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("sample_count") / expected))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    score = (
        0.40 * F.col("span") / F.coalesce(F.nullif("most", F.lit(0.0)), F.lit(1.0)) + 0.34 * complete + 0.10 * yes(F.regexp_replace(F.upper("mnemonic"), "[^A-Z0-9]", "") == role)
        + 0.06 * yes(F.col("usual").isNull() | F.col("unit_").isNull() | (F.col("unit_") == F.col("usual"))) + 0.06 * yes(F.col("value_max") > F.col("value_min")) + 0.04 * yes(F.col("step_").isNotNull())
    )
    j = j.withColumn("score", F.round(score * 100, 1))
    if decided is not None:
        j = j.join(decided.select("well_id", "curve_type", F.col("id").alias("chosen_id"), "excluded"), ["well_id", "curve_type"], "left").where(~F.coalesce(F.array_contains("excluded", F.col("id")), F.lit(False)))
        chosen = F.coalesce(F.col("chosen_id") == F.col("id"), F.lit(False))
    else:
        chosen = F.lit(False)
    best = F.max(F.struct(chosen.alias("c"), "score", "span", F.upper("mnemonic").alias("m"), (-F.col("id")).alias("i")))
    return j.groupBy("well_id", "curve_type").agg(best.alias("b"), F.count("*").alias("candidates")).select("well_id", "curve_type", (-F.col("b.i")).alias("curve_id"), F.col("b.score").alias("score"), "candidates")


def presence(rows: DataFrame, key: str) -> DataFrame:
    """AGG39: (key, well_id, wells, common): in which of all wells each key is present,
    in how many, and whether in all of them."""
    each = rows.where("well_id is not null").select(key, "well_id").distinct()
    total = each.agg(F.countDistinct("well_id").alias("all"))  # one row
    n = each.groupBy(key).agg(F.count("*").alias("wells")).crossJoin(total)
    return each.join(n, key).select(key, "well_id", "wells", (F.col("wells") == F.col("all")).alias("common"))


def time_depth_curves(curves: DataFrame) -> DataFrame:
    """HLP20: relation of each time-depth mnemonic."""
    m = F.regexp_replace(F.upper("mnemonic"), "[^A-Z0-9]", "")
    return curves.where(is_time_depth(F.col("mnemonic"))).select("id", F.when(m.startswith("TWT"), "twt").when(m.rlike("^(OWT|ONEWAYTIME)"), "owt").otherwise("time_depth").alias("relation"))


def unpivoted(table: DataFrame, keys: list[str]) -> DataFrame:
    """ING07: every other column as (attribute, text, number); nulls dropped."""
    values = [c for c in table.columns if c not in keys]
    long = table.select(*keys, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(keys, values, "attribute", "text")
    text = clean_text(F.col("text"))
    return long.withColumn("text", text).where("text is not null").withColumn("number", finite(F.col("text").try_cast("double")))

"""Quantities recorded in different units, brought to common units.

The unit of a value is, in this order: the one the row's own text states, the
one its source states, the one the row's other figures prove (a month's volume
against rate times days), or the one that fits the level of the entity's other
readings. Text is read by a multi-pattern automaton (functions.unit_text);
factors come from the unit table, a fixed list, which is broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.operators.ranks import quantiles
from wellspring.functions.text import finite
from wellspring.functions.unit_text import stated_unit

# ranges in common units that the readings here keep to (MPa), by kind
PRESSURE_RANGE = {"bh": (9.0, 34.0), "wh": (0.8, 5.7)}
WELLHEAD_WORDS = "whp|thp|wellhead|well head|tubing|油压|井口"
BOTTOM_WORDS = "bhp|pwf|bottom|井底"
_SLACK = 1.12  # values in no range are tried again with ranges widened by this factor

_STATED = T.StructType([T.StructField("oil", T.StringType()), T.StructField("pressure", T.StringType())])


def _each_distinct(texts: pd.Series, quantity: str) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    units = [stated_unit(t, quantity) for t in distinct] + [None]
    return pd.Series([units[c] for c in codes], dtype=object, index=texts.index)


@F.pandas_udf(_STATED)
def stated_rates(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Oil-rate and pressure unit stated by two texts, the first one winning."""
    pick = lambda q: _each_distinct(first, q).combine_first(_each_distinct(second, q))
    return pd.DataFrame({"oil": pick("oil rate").astype(object), "pressure": pick("pressure").astype(object)}).replace({float("nan"): None})


@F.pandas_udf(T.StringType())
def stated_length(remark: pd.Series, value: pd.Series) -> pd.Series:
    """Length unit stated by a remark for the value beside it."""
    return pd.Series([stated_unit(r, "length", None if v != v else float(v)) for r, v in zip(remark, value)], dtype=object)


def factors(unit_factors: DataFrame) -> dict[str, float]:
    """The fixed factor table (one row per unit) on the driver."""
    return {r["unit_code"]: r["to_common"] for r in unit_factors.select("unit_code", "to_common").collect()}


def _by_unit(unit: Column, f: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in f.items() for x in kv])[unit]


def _pressure_by_range(value: Column, kind: Column, f: dict[str, float], tenth: Column) -> Column:
    """Unit whose conversion puts an unstated pressure into the range of its kind."""
    def fits(unit: str, k: str, slack: float) -> Column:
        low, high = PRESSURE_RANGE[k]
        return (value * f[unit]).between(low / slack, high * slack)

    c = F.when(F.lit(False), F.lit(""))
    known = F.coalesce(kind, F.lit("?"))
    for slack in (1.0, _SLACK):
        for unit in ("MPa", "kPa", "psi", "bar"):
            own = (known != "wh") & fits(unit, "bh", slack) | (known != "bh") & fits(unit, "wh", slack)
            c = c.when(own, tenth if unit == "bar" else F.lit(unit))
    return c.otherwise("MPa")


def production_units(production: DataFrame, sources: DataFrame, unit_factors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the production table with oil_unit and pressure_unit.

    Unit columns are null where the value is null or NaN. Levels are built from
    sums per (well, month) with map-side combining, so a hot well arrives as
    one row per month; the window over them holds calendar months only. A well
    without any stated or proven unit is compared with itself. Repeated rows
    are judged each on their own and alike; rows of a null well count as one
    well; an empty table gives no rows. keep names further columns to carry.
    """
    f = factors(unit_factors)
    said = sources.select(F.col("id").alias("source_id"), stated_rates("metadata_json", "warning").alias("s"))
    said = said.groupBy("source_id").agg(F.max("s.oil").alias("s_oil"), F.max("s.pressure").alias("s_p"))
    ptype = F.lower(F.col("pressuretype"))
    rows = production.select(
        "id", "source_id", F.coalesce("wellkey", F.lit("")).alias("wk"), (F.year("productiondate") * 12 + F.month("productiondate")).alias("ym"),
        finite(F.col("oilrate")).alias("oil"), finite(F.col("waterrate")).alias("water"), finite(F.col("gasrate")).alias("gas"), finite(F.col("monthlyoil")).alias("vol"), finite(F.col("dayson")).alias("days"), finite(F.col("pressure")).alias("p"),
        F.when(ptype.rlike(WELLHEAD_WORDS), "wh").when(ptype.rlike(BOTTOM_WORDS), "bh").alias("kind"),
        stated_rates("pressuretype", "correctionnote").alias("r"), *keep,
    ).join(said, "source_id", "left")
    ratio = F.col("vol") / F.when((F.col("oil") > 0) & (F.col("days") > 0), F.col("oil") * F.col("days"))
    proven = F.when(F.abs(ratio / f["bbl/d"] - 1) < 0.01, "bbl/d").when(F.abs(ratio / f["Mbbl/d"] - 1) < 0.01, "Mbbl/d")
    known = F.coalesce(F.col("r.oil"), F.col("s_oil"), proven)
    rows = rows.select(*[c for c in rows.columns if c not in ("r", "s_oil", "s_p", "source_id", "vol", "days")], known.alias("oil_known"), F.coalesce(F.col("r.pressure"), F.col("s_p")).alias("p_known"))

    # gas is measured by itself: water against gas changes with the unit, but neither
    # with a spike of the oil rate nor with a workover; where there is no gas, water
    # and oil must both have changed
    water = F.when(F.col("water") > 0, F.ln("water"))
    levels = {"g": water - F.when(F.col("gas") > 0, F.ln("gas")), "w": water, "o": F.when(F.col("oil") > 0, F.ln("oil"))}
    shift = F.ln(_by_unit(F.col("oil_known"), f))
    new = F.col("oil_known").isNull()
    tally = lambda c: F.count_if(c)
    months = rows.groupBy("wk", "ym").agg(
        *[agg(c).alias(f"{n}_{k}") for k, v in levels.items() for part, c in (("k", v + shift), ("u", F.when(new, v))) for n, agg in ((f"s{part}", F.sum), (f"n{part}", F.count))],
        tally(F.col("kind") == "wh").alias("wh"), tally(F.col("kind") == "bh").alias("bh"),
        *[tally(F.col("p_known") == u).alias(n) for u, n in (("bar", "n1"), ("kgf/cm2", "n2"), ("atm", "n3"))],
    )
    order = W.partitionBy("wk").orderBy("ym")
    near, all_ = order.rangeBetween(-12, 12), W.partitionBy("wk")

    def around(c: str, months_off: int) -> Column:
        """Sum over the months around, as a difference of two growing sums: those cost
        one step a row, a sliding frame its whole width."""
        upto = lambda k: F.coalesce(F.sum(c).over(order.rangeBetween(W.unboundedPreceding, k)), F.lit(0))
        return upto(months_off) - upto(-months_off - 1)

    mean = lambda s, n, off: F.try_divide(around(s, off), around(n, off))
    tenths = [F.struct(F.sum(n).over(all_).alias("n"), F.lit(-i).alias("i"), F.lit(u).alias("u")) for i, (u, n) in enumerate((("bar", "n1"), ("kgf/cm2", "n2"), ("atm", "n3")))]
    half = F.ln(F.lit(1 / f["bbl/d"])) / 2

    def reference(k: str) -> Column:
        """Level of months near by: of known units first; else the low end of the
        unknown ones (where units are mixed, the common unit gives the smaller
        figures), set down where all of them lie a unit above known ones farther off."""
        known_near, known_far = mean(f"sk_{k}", f"nk_{k}", 12), mean(f"sk_{k}", f"nk_{k}", 60)
        low = F.min(f"low_{k}").over(near)
        block = F.when((low - known_far).between(half, half * 3), low - half * 2).otherwise(low)
        ref = F.coalesce(known_near, block, known_far)
        if k == "g":  # gas read only now and then has no level
            ref = F.when(around("nk_g", 12) + around("nu_g", 12) >= 3, ref)
        return ref

    # a month's level is the middle of three, so that a single odd month is no low end
    for k in levels:
        v = F.try_divide(f"su_{k}", f"nu_{k}")
        a, c = F.coalesce(F.lag(v).over(order), v), F.coalesce(F.lead(v).over(order), v)
        months = months.withColumn(f"low_{k}", F.greatest(F.least(a, v), F.least(F.greatest(a, v), c)))
    months = months.select(
        "wk", "ym", *[reference(k).alias(f"ref_{k}") for k in levels],
        F.when(F.sum("wh").over(all_) > F.sum("bh").over(all_), "wh").when(F.sum("bh").over(all_) > 0, "bh").alias("well_kind"), F.greatest(*tenths)["u"].alias("tenth"),
    )
    rows = rows.join(months.where("ym is not null"), ["wk", "ym"], "left")
    off = {k: v - F.col(f"ref_{k}") for k, v in levels.items()}
    up, down = F.coalesce(off["g"], F.least(off["w"], off["o"])), F.coalesce(off["g"], F.greatest(off["w"], off["o"]))
    big = F.ln(F.lit(f["Mbbl/d"]))
    guessed = F.when(up.between(half, half * 4), "bbl/d").when(down.between(-big * 1.3, -big * 0.7), "Mbbl/d").otherwise("m3/d")
    kind = F.coalesce("kind", "well_kind")
    by_range = _pressure_by_range(F.col("p"), kind, f, F.coalesce("tenth", F.lit("bar")))
    return rows.select(
        "id", "oil", F.when(F.col("oil").isNotNull(), F.coalesce("oil_known", guessed)).alias("oil_unit"), "p", F.when(F.col("p").isNotNull(), F.coalesce("p_known", by_range)).alias("pressure_unit"), *keep
    )


def well_head_units(well_head: DataFrame, unit_factors: DataFrame) -> DataFrame:
    """row_no, kb, kb_unit of the well-head sheet.

    An unstated unit is the one that brings the value nearest to the middle of
    its field; a row without a field takes the middle of its licence area (the
    second group of the uwi), or of the rows with its name's first letters.
    Rows that fit nowhere are metres. Null and NaN elevations have no unit.
    """
    f = factors(unit_factors)
    digits = F.regexp_replace("uwi", "[^0-9]", "")
    rows = well_head.select(
        "row_no", finite(F.col("kb_elevation")).alias("kb"), "field", F.when(F.length(digits) >= 7, F.substring(digits, 3, 5)).alias("area"),
        F.regexp_extract(F.upper("well_name"), "([A-Z]{2,})", 1).alias("letters"), stated_length("remark", "kb_elevation").alias("said"),
    )
    metres = F.when(F.col("kb") > 0, F.col("kb") * F.coalesce(_by_unit(F.col("said"), f), F.lit(1.0)))
    groups = ("field", "area", "letters")
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(g).alias("by"), F.col(g).alias("of")) for g in groups])).alias("g"), metres.alias("m")).where("g.of is not null")
    middles = quantiles(each.select("g.by", "g.of", "m"), "m", [0.5], ("by", "of"))
    for g in groups:
        rows = rows.join(middles.where(F.col("by") == g).select(F.col("of").alias(g), F.col("p")[0].alias(f"mid_{g}")), g, "left")
    mid = F.coalesce("mid_field", "mid_area", "mid_letters")
    far = lambda u: F.abs(F.ln(F.when(F.col("kb") > 0, F.col("kb") * f[u])) - F.ln(F.when(mid > 0, mid)))
    nearest = F.least(*[F.struct(far(u).alias("far"), F.lit(u).alias("u")) for u in ("m", "ft", "cm")])
    guessed = F.when(nearest["far"].isNotNull(), nearest["u"]).otherwise("m")
    return rows.select("row_no", "kb", F.when(F.col("kb").isNotNull(), F.coalesce("said", guessed)).alias("kb_unit"))


def converted(values: DataFrame, value: str, unit: str, unit_factors: DataFrame, out: str) -> DataFrame:
    """Value in its common unit. The factor table is a fixed list and broadcast."""
    small = F.broadcast(unit_factors.select(F.col("unit_code").alias(unit), F.col("to_common").alias("_to_common")))
    return values.join(small, unit, "left").withColumn(out, F.col(value) * F.col("_to_common")).drop("_to_common")


def foreign_values(units: DataFrame, heads: DataFrame, production_name: str, head_name: str) -> DataFrame:
    """Values neither null nor 0 in another unit than the common one (p3_found)."""
    cell = lambda field, v, u, common: F.when((F.col(v) != 0) & (F.col(u) != common), F.struct(F.lit(field).alias("field_name"), F.col(u).alias("unit_code")))
    both = units.select(F.lit(production_name).alias("table_name"), F.col("id").alias("row_id"), F.explode(F.array_compact(F.array(cell("oilrate", "oil", "oil_unit", "m3/d"), cell("pressure", "p", "pressure_unit", "MPa")))).alias("c"))
    head = heads.select(F.lit(head_name).alias("table_name"), F.col("row_no").alias("row_id"), F.explode(F.array_compact(F.array(cell("kb_elevation", "kb", "kb_unit", "m")))).alias("c"))
    return both.unionByName(head).select("table_name", "row_id", "c.field_name", "c.unit_code")

"""Production histories: consolidation, running totals, summaries, decline, correction.

All row-level choices (first, last, latest non-null) are aggregates with
map-side combining; windows run only over consolidated months, of which a well
has no more than the calendar gives, so a hot well is no hot task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.operators.ranks import quantiles
from wellspring.functions.scalars import GAS_PER_BOE, changed, days_in_month, water_cut_percent
from wellspring.functions.text import finite

PHASES = ("oil", "water", "gas")
RATES = tuple(f"{p}_rate" for p in PHASES)
VOLUMES = tuple(f"monthly_{p}" for p in PHASES)
FIELDS = ("days_on", *RATES, "water_cut", *VOLUMES, "pressure", "status")


def monthly_rows(production: DataFrame) -> DataFrame:
    """ING08: monthly rows of the production table under logical names; readings
    without a date, or dated before 1950 or after loading, are left out."""
    d = F.col("productiondate")
    named = {"days_on": "dayson", "oil_rate": "oilrate", "water_rate": "waterrate", "gas_rate": "gasrate", "water_cut": "watercutpct", "monthly_oil": "monthlyoil", "monthly_water": "monthlywater", "monthly_gas": "monthlygas", "cum_oil": "cumulativeoil", "pressure": "pressure"}
    rows = production.where(d.isNotNull() & (d >= F.lit("1950-01-01").cast("timestamp")) & (d <= F.col("loaded_at")))
    return rows.select("id", "source_id", F.col("wellkey").alias("well_key"), F.date_format(d, "yyyy-MM").alias("month"), *[finite(F.col(c)).alias(n) for n, c in named.items()], F.col("wellstatus").alias("status"))


def last_known(field: str, order: Column) -> Column:
    return F.max_by(F.col(field), F.when(F.col(field).isNotNull(), order))


def consolidated(rows: DataFrame) -> DataFrame:
    """WIN06: per well and month the last non-null of each field, by id."""
    return rows.groupBy("well_key", "month").agg(*[last_known(f, F.col("id")).alias(f) for f in (*FIELDS, "cum_oil")], F.count("*").alias("n_rows"))


def derived(months: DataFrame) -> DataFrame:
    """WIN07: liquid rate, water cut and gas-oil ratio where they can be made."""
    liquid = F.col("oil_rate") + F.col("water_rate")
    cut = F.coalesce(water_cut_percent(F.col("water_cut")), F.col("water_rate") / F.nullif(liquid, F.lit(0.0)) * 100)
    return months.withColumns({"liquid_rate": liquid, "water_cut_pct": cut, "gor": F.col("gas_rate") / F.nullif(F.col("oil_rate"), F.lit(0.0))})


def by_month(well: str = "well_key"):
    return W.partitionBy(well).orderBy("month")


def running(months: DataFrame) -> DataFrame:
    """WIN08, WIN09: month index, days and volumes so far; an explicit cumulative,
    once given, carries forward and replaces the running sum."""
    so_far = by_month().rowsBetween(W.unboundedPreceding, W.currentRow)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(so_far)
    return months.withColumns({
        "month_index": F.row_number().over(by_month()), "days_so_far": total("days_on"),
        "oil_so_far": F.coalesce(F.last("cum_oil", True).over(so_far), total("monthly_oil")), "water_so_far": total("monthly_water"),
    })


def first_and_last(rows: DataFrame) -> DataFrame:
    """WIN01-WIN05: first and latest month with a rate, first and last pressure,
    last status and cumulative, by (month, id), as plain aggregates."""
    key = F.struct("month", "id")
    rated = F.coalesce(*RATES).isNotNull()
    pressed = F.when(F.col("pressure").isNotNull(), key)
    return rows.groupBy("well_key").agg(
        F.min_by("month", F.when(rated, key)).alias("first_month"), F.min_by("oil_rate", F.when(rated, key)).alias("first_oil_rate"),
        F.max_by("month", F.when(rated, key)).alias("latest_month"), F.max_by("oil_rate", F.when(rated, key)).alias("latest_oil_rate"),
        F.min_by("pressure", pressed).alias("first_pressure"), F.max_by("pressure", pressed).alias("last_pressure"), F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"),
        last_known("status", key).alias("last_status"), last_known("cum_oil", key).alias("last_cum_oil"),
    )


def _volume(phase: str) -> Column:
    return F.coalesce(F.col(f"monthly_{phase}"), F.col(f"{phase}_rate") * F.col("days_on"))


def well_totals(rows: DataFrame) -> DataFrame:
    """AGG12: months, producing days, volumes (or rate times days) and mean rates per well."""
    return rows.groupBy("well_key").agg(
        F.countDistinct("month").alias("months"), F.sum(F.when(F.col("days_on") > 0, F.col("days_on"))).alias("days"),
        *[F.sum(_volume(p)).alias(f"{p}_volume") for p in PHASES], *[F.avg(f"{p}_rate").alias(f"mean_{p}_rate") for p in PHASES],
    )


def dashboard(rows: DataFrame) -> DataFrame:
    """AGG13: totals with first and latest figures and day-weighted rates, one aggregation."""
    both = well_totals(rows).join(first_and_last(rows), "well_key", "left")
    return both.withColumns({"pressure_change": F.col("last_pressure") - F.col("first_pressure"), **{f"weighted_{p}_rate": F.col(f"{p}_volume") / F.nullif("days", F.lit(0.0)) for p in PHASES}})


def summary(months: DataFrame) -> DataFrame:
    """AGG14: per-well summary over consolidated months; the initial month needs
    an oil rate or a volume over days, liquid needs both phases."""
    rate = F.coalesce("oil_rate", F.col("monthly_oil") / F.nullif("days_on", F.lit(0.0)))
    seen = F.when(rate.isNotNull(), F.col("month"))
    return months.groupBy("well_key").agg(
        F.min(seen).alias("initial_month"), F.min_by(rate, seen).alias("initial_oil_rate"), F.max(seen).alias("latest_month"), F.max_by(rate, seen).alias("latest_oil_rate"),
        F.max(rate).alias("peak_oil_rate"), F.max(F.col("oil_rate") + F.col("water_rate")).alias("peak_liquid_rate"), F.sum("monthly_oil").alias("oil_volume"),
    )


def early_and_late(months: DataFrame, n: int = 3) -> DataFrame:
    """WIN10: mean of the first and the last n non-null oil rates."""
    known = months.where("oil_rate is not null").withColumns({"up": F.row_number().over(by_month()), "down": F.row_number().over(W.partitionBy("well_key").orderBy(F.desc("month")))})
    return known.groupBy("well_key").agg(F.avg(F.when(F.col("up") <= n, F.col("oil_rate"))).alias("initial_rate"), F.avg(F.when(F.col("down") <= n, F.col("oil_rate"))).alias("late_rate"))


def stability(months: DataFrame) -> DataFrame:
    """WIN11: 100 less the median relative step of the oil rate; three rates at least."""
    known = months.where("oil_rate is not null").withColumn("prev", F.lag("oil_rate").over(by_month()))
    step = F.abs(F.col("oil_rate") - F.col("prev")) / F.greatest(F.abs("prev"), F.lit(1e-9))
    found = known.groupBy("well_key").agg(F.count("*").alias("n"), F.percentile(step, 0.5).alias("m"))
    return found.where("n >= 3").select("well_key", (100 * (1 - F.least(F.lit(1.0), "m"))).alias("stability"))


def status_changes(rows: DataFrame) -> DataFrame:
    """ING09, WIN15: months whose status differs from the last known one before;
    the first status counts as a change."""
    per_month = rows.groupBy("well_key", "month").agg(last_known("status", F.col("id")).alias("status"))
    before = F.last("status", True).over(by_month().rowsBetween(W.unboundedPreceding, -1))
    return per_month.withColumn("before", before).where(F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.col("before"))).select("well_key", "month", "status")


def on_stream(rows: DataFrame) -> DataFrame:
    """ING10: first month each well produced."""
    return rows.where("oil_rate > 0 or monthly_oil > 0").groupBy("well_key").agg(F.min("month").alias("on_stream"))


def intervention_response(months: DataFrame, events: DataFrame, n: int = 3) -> DataFrame:
    """WIN12: mean oil rate of n months before an event against n from it on, in
    per cent, averaged per well. events: well_key, month."""
    w = by_month()
    known = months.where("oil_rate is not null")
    around = known.select("well_key", "month", F.avg("oil_rate").over(w.rowsBetween(-n, -1)).alias("before"), F.avg("oil_rate").over(w.rowsBetween(0, n - 1)).alias("after"))
    hit = around.join(events.select("well_key", "month").distinct(), ["well_key", "month"], "left_semi").where("before > 0")
    return hit.groupBy("well_key").agg(F.avg((F.col("after") / F.col("before") - 1) * 100).alias("response_pct"), F.count("*").alias("n_events"))


def segments(months: DataFrame, events: DataFrame, least: int = 3) -> DataFrame:
    """WIN13: before and after a well's first event, where both sides have enough months."""
    first = events.groupBy("well_key").agg(F.min("month").alias("event"))
    cut = months.join(first, "well_key").withColumn("segment", F.when(F.col("month") < F.col("event"), "before").otherwise("after"))
    found = cut.groupBy("well_key", "segment").agg(F.count("*").alias("n"), F.avg("oil_rate").alias("mean_oil_rate"))
    good = found.where(F.col("n") >= least).groupBy("well_key").agg(F.count("*").alias("sides")).where("sides = 2")
    return found.join(good.select("well_key"), "well_key", "left_semi")


_FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("b", "initial_rate", "sse")])


def fit_decline(t: np.ndarray, q: np.ndarray, steps: int = 200) -> tuple[float, float, float] | None:
    """Exponent, initial rate and squared error of the best Arps decline."""
    b = np.arange(steps + 1) / 100
    with np.errstate(all="ignore"):
        y = np.where(b[:, None] == 0, np.log(q), q ** -b[:, None])
        n = len(q)
        m = (n * (y * t).sum(1) - t.sum() * y.sum(1)) / (n * (t * t).sum() - t.sum() ** 2)
        c = (y.sum(1) - m * t.sum()) / n
        line = c[:, None] + m[:, None] * t
        rate = np.where(b[:, None] == 0, np.exp(line), np.where(line > 0, line, np.nan) ** (-1 / np.where(b == 0, np.nan, b))[:, None])
        sse = ((q - rate) ** 2).sum(1)
    if np.isnan(sse).all():
        return None
    i = int(np.nanargmin(sse))
    return float(b[i]), float(np.exp(c[i]) if b[i] == 0 else c[i] ** (-1 / b[i])), float(sse[i])


@F.pandas_udf(_FIT)
def _fitted(t: pd.Series, q: pd.Series) -> pd.DataFrame:
    found = [fit_decline(np.asarray(a, float), np.asarray(b, float)) or (None, None, None) for a, b in zip(t, q)]
    return pd.DataFrame(found, columns=["b", "initial_rate", "sse"], dtype=float)


def decline(months: DataFrame) -> DataFrame:
    """MDL13: Arps decline by least squares in the transformed domain for every
    exponent b = 0, 0.01 .. 2; the one with the least squared error of the rates
    wins. At least four positive rates; time is the month index, gaps keep it.

    A well's months are two arrays (the calendar bounds them) on which all
    exponents are tried at once, batch by batch of wells."""
    indexed = months.withColumn("t", (F.row_number().over(by_month()) - 1).cast("double")).where("oil_rate > 0")
    series = indexed.groupBy("well_key").agg(F.array_sort(F.collect_list(F.struct("t", F.col("oil_rate").alias("q")))).alias("s")).where("size(s) >= 4")
    fit = series.select("well_key", F.size("s").alias("n_points"), _fitted("s.t", "s.q").alias("f"))
    return fit.where("f.sse is not null").select("well_key", "n_points", "f.b", "f.initial_rate", "f.sse")


def corrected(months: DataFrame) -> DataFrame:
    """MDL14: days inferred from the calendar where a positive rate lacks them,
    volumes rebuilt from rates, water cut remade, cumulatives run anew and null
    until a first volume."""
    days = F.when(F.col("days_on").isNull() & (F.col("oil_rate") > 0), days_in_month(F.col("month")).cast("double")).otherwise(F.col("days_on"))
    m = months.withColumns({"days": days, "inferred": F.col("days_on").isNull() & days.isNotNull()})
    for p in PHASES:
        m = m.withColumn(f"{p}_volume", F.coalesce(F.col(f"{p}_rate") * F.col("days"), F.col(f"monthly_{p}")))
    liquid = F.col("oil_volume") + F.col("water_volume")
    so_far = by_month().rowsBetween(W.unboundedPreceding, W.currentRow)
    run = lambda c: F.when(F.count(c).over(so_far) > 0, F.sum(F.coalesce(c, F.lit(0.0))).over(so_far))
    return m.withColumns({"cut": F.col("water_volume") / F.nullif(liquid, F.lit(0.0)) * 100, "oil_total": run("oil_volume"), "water_total": run("water_volume")})


def correction_audit(months: DataFrame, after: DataFrame) -> DataFrame:
    """MDL15: per well and figure the value before and after, and whether it changed."""
    figures = lambda df, days, vols: df.groupBy("well_key").agg(F.sum(days).alias("days"), *[F.sum(v).alias(p) for p, v in zip(PHASES, vols)]).unpivot("well_key", ["days", *PHASES], "figure", "value")
    old = figures(months, "days_on", VOLUMES).withColumnRenamed("value", "before")
    new = figures(after, "days", tuple(f"{p}_volume" for p in PHASES)).withColumnRenamed("value", "after")
    return old.join(new, ["well_key", "figure"], "full").withColumn("changed", changed(F.col("before"), F.col("after")))


def correction_counts(months: DataFrame, after: DataFrame) -> DataFrame:
    """AGG37: rows, wells, inferred days and changed figures of a correction."""
    a = after.agg(F.count("*").alias("n_rows"), F.countDistinct("well_key").alias("n_wells"), F.count_if("inferred").alias("n_inferred"))
    return a.crossJoin(correction_audit(months, after).agg(F.count_if("changed").alias("n_changed")))  # one row each


def features(months: DataFrame, events: DataFrame) -> DataFrame:
    """MDL16: features of a well for grouping by behaviour."""
    base = months.groupBy("well_key").agg(
        F.count("*").alias("records"), F.sum("monthly_oil").alias("oil_volume"), F.sum("monthly_water").alias("water_volume"), F.avg("oil_rate").alias("mean_rate"), F.max("oil_rate").alias("peak_rate"),
        F.avg("water_cut").alias("mean_cut"), F.avg("pressure").alias("mean_pressure"), F.sum("days_on").alias("days"), F.sum(F.col("monthly_oil") + F.coalesce("monthly_gas", F.lit(0.0)) / GAS_PER_BOE).alias("boe"),
    )
    for part in (early_and_late(months), stability(months), intervention_response(months, events).drop("n_events")):
        base = base.join(part, "well_key", "left")
    return base.withColumn("decline_ratio", F.col("late_rate") / F.nullif("initial_rate", F.lit(0.0)))


def coverage(feats: DataFrame, names: list[str]) -> DataFrame:
    """AGG33: share of wells with each feature and whether it is used by default:
    known for at least two and half of the wells."""
    total = feats.agg(F.count("*").alias("n"))
    long = feats.unpivot("well_key", names, "feature", "value").groupBy("feature").agg(F.count("value").alias("known"))
    return long.crossJoin(total).select("feature", "known", (F.col("known") / F.col("n") * 100).alias("pct"), (F.col("known") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.5))).alias("used"))


def graded(feats: DataFrame, name: str) -> DataFrame:
    """SC27: low, mid or high by terciles of all wells."""
    cut = quantiles(feats, name, [1 / 3, 2 / 3]).select(F.col("p")[0].alias("p1"), F.col("p")[1].alias("p2"))
    g = F.when(F.col(name) <= F.col("p1"), "low").when(F.col(name) <= F.col("p2"), "mid").otherwise("high")
    return feats.where(F.col(name).isNotNull()).crossJoin(cut).select("well_key", g.alias("grade"))

"""Irregular readings onto a regular calendar grid.

Readings become increments, each with the interval of time it accrued over;
increments are distributed over the grid cells in proportion to overlap; cells
between a source's first and last that no increment covers are marked.
A cumulative counter yields its increments by differencing (a fall is a reset:
the counter restarted at zero, so the reading itself is the increment, unless the
very next reading is back where the counter was: then the low one is a slip and does
not count); a period reading (a monthly volume dated on any day) accrued over its period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST_USABLE = "1950-01-01"


def usable(time: str, value: str, loaded: str) -> Column:
    """A dated reading of zero or more, dated 1950 or later and not after its loading."""
    t, v = F.col(time), F.col(value)
    return t.isNotNull() & (t >= F.lit(FIRST_USABLE).cast("timestamp")) & (t <= F.col(loaded)) & v.isNotNull() & ~F.isnan(v) & (v >= 0)


def _cell(t: Column) -> Column:
    """Months since year 0."""
    return F.year(t) * 12 + F.month(t) - 1


def _month_start(cell: Column) -> Column:
    return F.make_date(F.floor(cell / 12).cast("int"), (cell % 12 + 1).cast("int"), F.lit(1))


def period_increments(readings: DataFrame, key: str, time: str, value: str, version: list[str]) -> DataFrame:
    """Increments (key, start, end, amount, n, resets) of period volumes, one per
    key and month: of several readings of a month the latest version counts.
    Pre-aggregated by (key, month), so a hot key shuffles as partial results."""
    t = F.timestamp_seconds(F.unix_timestamp(F.trunc(F.col(time), "month").cast("timestamp")))
    best = F.max_by(value, F.struct(*version, F.col(time), F.col(value)))
    months = readings.where(F.col(key).isNotNull()).groupBy(F.col(key), t.alias("start")).agg(best.alias("amount"), F.count("*").alias("n"))
    return months.select(key, "start", (F.col("start") + F.expr("interval 1 month")).alias("end"), "amount", "n", F.lit(0).alias("resets"))


def _neighbours(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, yr, end, v) with the reading before and after them as prev and next.

    Windows are split by (key, year), so no task holds all of a hot key; the first
    reading of a year takes the last of the key's latest earlier year from per-year
    summaries, of which a key has as many as years, and the last one the first of the
    next."""
    reading = F.struct("end", "v")
    ends = rows.groupBy(key, "yr").agg(F.max(reading).alias("last"), F.min(reading).alias("first"))
    years = W.partitionBy(key).orderBy("yr")
    carried = ends.select(key, "yr", F.lag("last").over(years).alias("carried"), F.lead("first").over(years).alias("coming"))
    inner = W.partitionBy(key, "yr").orderBy("end")
    j = rows.join(carried, [key, "yr"])
    return j.withColumns({"prev": F.coalesce(F.lag(reading).over(inner), F.col("carried")), "next": F.coalesce(F.lead(reading).over(inner), F.col("coming"))}).drop("carried", "coming")


def counter_increments(readings: DataFrame, key: str, time: str, value: str, version: list[str]) -> DataFrame:
    """Increments of a cumulative counter between consecutive readings. A single reading
    below the one before, with the one after not below that, is a slip and left out."""
    best = F.max_by(value, F.struct(*version, F.col(value)))
    rows = readings.where(F.col(key).isNotNull()).groupBy(F.col(key), F.col(time).alias("end"), F.year(time).alias("yr")).agg(best.alias("v"), F.count("*").alias("n"))
    slip = F.coalesce((F.col("v") < F.col("prev.v")) & (F.col("next.v") >= F.col("prev.v")), F.lit(False))
    steps = _neighbours(_neighbours(rows, key).where(~slip).drop("prev", "next"), key).where("prev is not null")
    reset = F.col("v") < F.col("prev.v")
    return steps.select(key, F.col("prev.end").alias("start"), "end", F.when(reset, F.col("v")).otherwise(F.col("v") - F.col("prev.v")).alias("amount"), "n", reset.cast("int").alias("resets"))


def distribute(increments: DataFrame, key: str) -> DataFrame:
    """Split increments over month cells by share of overlap: one row per key
    and touched cell with amount, covered days, readings and resets."""
    last = F.greatest(_cell(F.col("start")), _cell(F.col("end") - F.expr("interval 1 microsecond")))
    cells = increments.withColumn("cell", F.explode(F.sequence(_cell(F.col("start")), last)))
    sec = lambda c: F.unix_micros(c.cast("timestamp"))
    low = F.greatest(sec(F.col("start")), sec(_month_start(F.col("cell"))))
    high = F.least(sec(F.col("end")), sec(_month_start(F.col("cell") + 1)))
    whole = sec(F.col("end")) - sec(F.col("start"))
    share = (high - low) / whole
    return cells.groupBy(key, "cell").agg(
        F.sum(F.col("amount") * share).alias("amount"), F.sum((high - low) / 86400e6).alias("covered_days"), F.sum("n").alias("n_readings"), F.sum("resets").alias("n_resets")
    )


def fill_cells(cells: DataFrame, key: str) -> DataFrame:
    """All cells from a key's first to its last; uncovered ones marked missing.

    The window runs over cells, of which a key has no more than calendar
    months; rows of a hot key were aggregated into them before."""
    after = F.coalesce(F.lead("cell").over(W.partitionBy(key).orderBy("cell")), F.col("cell") + 1)
    all_cells = cells.withColumn("to", after).withColumn("at", F.explode(F.sequence("cell", F.col("to") - 1)))
    here = F.col("at") == F.col("cell")
    kept = [F.when(here, F.col(c)).alias(c) for c in ("amount", "covered_days", "n_readings", "n_resets")]
    return all_cells.select(key, F.date_format(_month_start(F.col("at")), "yyyy-MM").alias("month"), *kept, (~here).alias("missing"))


def regular_grid(readings: DataFrame, key: str, time: str, value: str, kind: str = "period", loaded: str = "loaded_at", version: tuple = ("loaded_at", "id")) -> DataFrame:
    """One row per key and calendar month from the first to the last usable
    reading: amount, covered_days, n_readings, n_resets, missing.

    kind 'period': value is the volume of the reading's month. kind 'counter':
    value is a running total. Unusable readings (see usable) and null keys do
    not count; of equal times the latest version counts; a key with a single
    counter reading has no increment and gives no row; an empty table gives no
    rows; further columns are ignored.
    """
    good = readings.where(usable(time, value, loaded)).select(key, time, value, *version)
    make = {"period": period_increments, "counter": counter_increments}[kind]
    return fill_cells(distribute(make(good, key, time, value, list(version)), key), key)

"""The general data-preparation operators against brute force and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.functions.unit_text import stated_unit
from wellspring.operators import grid, intervals, spikes, units

UTC = dt.timezone.utc
READING = "id long, wellkey string, productiondate timestamp, monthlyoil double, loaded_at timestamp, cell string, start string"


def _day(s):
    return dt.datetime.fromisoformat(s).replace(tzinfo=UTC)


def test_grid_marks_missing_months(spark):
    rows = [
        (1, "A", _day("2001-01-31"), 10.0, _day("2001-03-01"), "clash", "clash"),
        (2, "A", _day("2001-04-02"), 0.0, _day("2001-05-01"), None, None),
        (3, "A", _day("2001-02-10"), -1.0, _day("2001-05-01"), None, None),  # placeholder
        (4, "A", _day("2001-03-10"), float("nan"), _day("2001-05-01"), None, None),
        (5, "A", _day("2009-01-01"), 5.0, _day("2001-05-01"), None, None),  # dated after loading
        (6, "A", _day("1900-01-01"), 5.0, _day("2001-05-01"), None, None),
        (7, "A", None, 5.0, _day("2001-05-01"), None, None),
        (8, None, _day("2001-01-01"), 5.0, _day("2001-05-01"), None, None),
        (9, "A", _day("2001-01-05"), 7.0, _day("2001-06-01"), None, None),  # later revision
        (9, "A", _day("2001-01-05"), 7.0, _day("2001-06-01"), None, None),
    ]
    df = spark.createDataFrame(rows, READING)
    out = {r["month"]: r for r in grid.regular_grid(df, "wellkey", "productiondate", "monthlyoil").collect()}
    assert sorted(out) == ["2001-01", "2001-02", "2001-03", "2001-04"]
    assert [out[m]["missing"] for m in sorted(out)] == [False, True, True, False]
    assert out["2001-01"]["amount"] == 7.0 and out["2001-01"]["n_readings"] == 3
    assert grid.regular_grid(df.limit(0), "wellkey", "productiondate", "monthlyoil").count() == 0


def test_counter_resets_and_shares(spark):
    rows = [(1, "A", _day("2001-01-11"), 100.0, _day("2002-01-01")), (2, "A", _day("2001-02-11"), 131.0, _day("2002-01-01")), (3, "A", _day("2001-02-21"), 10.0, _day("2002-01-01")), (4, "A", _day("2003-02-21"), 20.0, _day("2004-01-01"))]
    df = spark.createDataFrame(rows, "id long, wellkey string, productiondate timestamp, v double, loaded_at timestamp")
    out = {r["month"]: r for r in grid.regular_grid(df, "wellkey", "productiondate", "v", kind="counter").collect()}
    assert out["2001-01"]["amount"] == pytest.approx(21.0)  # 21 of 31 days
    assert out["2001-02"]["amount"] == pytest.approx(10.0 + 10.0 + 10.0 * 8 / 730)
    assert out["2001-02"]["n_resets"] == 1 and not any(r["missing"] for r in out.values())
    assert sum(r["amount"] for r in out.values()) == pytest.approx(31 + 10 + 10)


def test_one_low_reading_is_no_reset(spark):
    days = ("2001-11-01", "2001-12-01", "2002-01-01", "2002-02-01", "2002-03-01", "2002-04-01")
    for values, total, resets in (((100, 110, 5, 120, 130, 140), 40, 0), ((100, 110, 5, 15, 120, 130), 10 + 5 + 10 + 105 + 10, 1), ((100, 110, 120, 130, 140, 3), 40 + 3, 1), ((100, 3, 100, 100, 3, 110), 10, 0)):
        df = spark.createDataFrame([(i, "A", _day(d), float(v), _day("2003-01-01")) for i, (d, v) in enumerate(zip(days, values))], "id long, wellkey string, productiondate timestamp, v double, loaded_at timestamp")
        out = grid.regular_grid(df, "wellkey", "productiondate", "v", kind="counter").collect()
        assert sum(r["amount"] for r in out) == pytest.approx(total) and sum(r["n_resets"] for r in out) == resets


def _brute(rows):
    out = set()
    for k in {r[0] for r in rows if r[0]}:
        iv = sorted({(min(a, b), max(a, b)) for e, a, b in rows if e == k and a is not None and b is not None and min(a, b) >= 0 and a != b})
        last = None
        for a, b in iv:
            if last is not None and a <= last[1]:
                last = (last[0], max(last[1], b))
                continue
            if last is not None:
                out |= {(k, "span", *last), (k, "gap", last[1], a)}
            last = (a, b)
        if last:
            out.add((k, "span", *last))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_spans_match_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice("AAAAAAAB"), rnd.randrange(0, 4000), 0) for _ in range(300)]
    rows = [(k, a, a + rnd.randrange(-9, 30)) for k, a, _ in rows] + [("C", 5, 5), ("C", None, 7), (None, 1, 2), ("D", 9, 3), ("D", 9, 3), ("D", 3, 12), ("E", 0, 10), ("E", 10, 20), ("F", -5, 10)]
    df = spark.createDataFrame(rows, "entity string, top long, base long").withColumn("kind", F.lit("x"))
    got = [tuple(r) for r in intervals.spans_and_gaps(df, partitions).select("entity", "kind", "top", "base").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert intervals.spans_and_gaps(df.limit(0), partitions).count() == 0


def test_interpretation_keys(spark):
    rows = [("ＡＢ-1", 1.0, 2.0), ("ab 1 ", 2.0, 3.0), (None, 1.0, 2.0), ("--", 1.0, 2.0), ("X", float("nan"), 3.0)]
    out = intervals.interpretation_spans(spark.createDataFrame(rows, "well string, top_md double, base_md double")).collect()
    assert [tuple(r) for r in out] == [("AB1", "span", 100, 300)]


@pytest.mark.parametrize(
    "text, quantity, unit",
    [
        ("converted from stb/d", "oil rate", "m3/d"), ("psi gauge, converted to MPa", "pressure", "MPa"), ("bar to MPa applied", "pressure", "MPa"), ("was bbl/d before the 2011 migration, now m3/d", "oil rate", "m3/d"),
        ("oil rate, thousand barrels per day", "oil rate", "Mbbl/d"), ("oil rate: barrels per day", "oil rate", "bbl/d"), ("P кгс/см2", "pressure", "kgf/cm2"), ("WHP (kgf/cm²)", "pressure", "kgf/cm2"), ("日产油 吨/日; gauge psig", "oil rate", "t/d"),
        ("日产油 吨/日; gauge psig", "pressure", "psi"), ("plugged at 300 ft below surface", "length", None), ("RKB 442' above sea level", "length", "ft"), ("Elevation (FT) from rig sheet", "length", "ft"), ("KB checked", "length", None), ("", "length", None), (None, "length", None),
    ],
)
def test_stated_units(text, quantity, unit):
    assert stated_unit(text, quantity) == unit


def _factors(spark):
    rows = [("MPa", "pressure", 1.0), ("kPa", "pressure", 0.001), ("bar", "pressure", 0.1), ("psi", "pressure", 0.006895), ("kgf/cm2", "pressure", 0.098067), ("atm", "pressure", 0.101325), ("m3/d", "oil rate", 1.0), ("bbl/d", "oil rate", 0.158987), ("Mbbl/d", "oil rate", 158.987), ("t/d", "oil rate", 1.17), ("m", "length", 1.0), ("ft", "length", 0.3048), ("cm", "length", 0.01)]
    return spark.createDataFrame(rows, "unit_code string, quantity string, to_common double")


PRODUCTION = "id long, source_id long, wellkey string, productiondate timestamp, dayson double, oilrate double, waterrate double, monthlyoil double, pressure double, pressuretype string, correctionnote string, p string, gasrate double"


def test_production_units(spark):
    day = [_day(f"2001-{m:02d}-15") for m in range(1, 13)]
    rows = [(i, 1, "A", day[i], 30.0, 100.0, 50.0, 3000.0, 15.0, "BHP", None, "clash") for i in range(8)]
    rows += [
        (20, 1, "A", day[8], 30.0, 629.0, 314.5, 18870.0, 2200.0, "BHP", None, None),  # the level tells
        (21, 1, "A", day[9], 30.0, 629.0, 314.5, 3000.03, 150.0, "BHP bara", "rates in bbl/d", None),
        (22, 2, "A", day[9], None, 629.0, 314.5, None, None, None, None, None),  # its source tells
        (23, 9, None, None, None, None, None, None, float("nan"), None, None, None),
        (24, 1, "A", day[10], 30.0, 700.0, 50.0, 3000.0, 15.0, None, None, None),  # a spike, not a unit
    ]
    rows = [(*r, 9000.0 if r[0] == 20 else None) for r in rows]
    df = spark.createDataFrame(rows, PRODUCTION)
    src = spark.createDataFrame([(1, "{}", None), (2, '{"header": "Qo [STB/d]; P [psi]"}', None)], "id long, metadata_json string, warning string")
    out = {r["id"]: r for r in units.production_units(df, src, _factors(spark)).collect()}
    assert len(out) == len(rows)
    assert [out[i]["oil_unit"] for i in (0, 20, 21, 22, 23, 24)] == ["m3/d", "bbl/d", "bbl/d", "bbl/d", None, "m3/d"]
    assert [out[i]["pressure_unit"] for i in (0, 20, 21, 22, 23)] == ["MPa", "psi", "bar", None, None]
    assert units.production_units(df.limit(0), src, _factors(spark)).count() == 0


def test_head_units(spark):
    rows = [(i, f"AAA-{i}", None, 100.0 + i, "F", None) for i in range(8)]
    rows += [(10, "AAA-1", None, 335.0, "F", None), (11, "AAA-2", None, 10200.0, None, None), (12, "AAA-3", None, 101.0, "F", "was ft in the old sheet, now m"), (13, "AAA-4", None, None, "F", "KB ft"), (14, None, None, 55.0, None, None)]
    out = {r["row_no"]: r["kb_unit"] for r in units.well_head_units(spark.createDataFrame(rows, "row_no long, well_name string, uwi string, kb_elevation double, field string, remark string"), _factors(spark)).collect()}
    assert [out[i] for i in (0, 10, 11, 12, 13, 14)] == ["m", "ft", "cm", "m", None, "m"]


def _spike_rows(seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for w, n in (("A", 400), ("B", 60), ("C", 3)):
        for i in range(n):
            v = 100 * np.exp(-i / 300) * np.exp(rnd.normal(0, 0.04))
            rows.append([len(rows), w, i * 10, float(v), float(50 + rnd.normal(0, 1)), 20.0 + i % 7])
    for i, f in ((50, 8), (51, 1 / 9), (200, 4), (420, 5)):
        rows[i][3] *= f
    rows[100][4] = 90.0
    rows[130][4] = -5.0
    for i in range(300, 307):
        rows[i][3] = 33.0
    rows[303][3] = None
    rows[10][5] = 40.0
    rows.append([900, "A", 2000, rows[200][3], 50.0, None])  # a copy of the spike
    rows += [[901, None, 5, 1.0, 1.0, 1.0], [902, "A", None, 1.0, 1.0, 1.0]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("partitions", [1, 5])
def test_spikes(spark, partitions):
    df = spark.createDataFrame(_spike_rows(), "id long, src string, at long, oil double, cut double, days double").withColumn("shut", F.lit(1))
    fields = [spikes.Field("oil", ratio=3.0), spikes.Field("cut", points=30.0), spikes.Field("days")]
    bad = {"oil": F.col("oil") < 0, "cut": (F.col("cut") < 0) | (F.col("cut") > 100), "days": F.col("days") > 31}
    got = {tuple(r) for r in spikes.implausible(df, fields, bad, F.col("oil") == 0, partitions).collect()}
    want = {(i, "oil") for i in (50, 51, 200, 900, 420, *range(300, 303), *range(304, 307))} | {(100, "cut"), (130, "cut"), (10, "days")}
    assert got == want
    assert spikes.implausible(df.limit(0), fields, bad, F.col("oil") == 0, partitions).count() == 0


def test_phase_space_finds_what_the_exact_test_needs():
    rnd = np.random.default_rng(0)
    for n in (12, 80, 500):
        v = np.log(100 * np.exp(-np.arange(n) / 200) * np.exp(rnd.normal(0, 0.1, n)))
        hit = rnd.choice(np.arange(3, n - 3), max(1, n // 60), replace=False)
        v[hit] += 1.2
        assert spikes.phase_space_candidates(v, np.zeros(n, int))[hit].all()

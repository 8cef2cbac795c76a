"""Scalar column functions of the domain; JVM-side expressions only.

The inventory id of each function stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: physical constants and conversion rules
FOOT = 0.3048
BARRELS_PER_M3 = 6.28981077
GAS_PER_BOE = 6000.0
SENTINELS = (-999.25, -999.0, -9999.0, -9999.25, -99999.0, 999.25, 9999.0)
TIME_DEPTH_PREFIXES = ("ONEWAYTIME", "OWT", "TWT", "GENERALTIME", "VELOCITY")


def layer_key(name: Column) -> Column:
    """SC04: file stem, upper case, version and 20xx year endings dropped, letters and digits only."""
    stem = F.upper(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,4}$", ""))
    stem = F.regexp_replace(F.regexp_replace(stem, r"[\s_\-.]*(V|VER|REV)\s*\d+$", ""), r"[\s_\-.]*20\d{2}$", "")
    return F.regexp_replace(stem, "[^0-9A-Z一-鿿]", "")


def file_well_key(name: Column) -> Column:
    """SC05: well key of a file name: stem, a trailing copy or run mark dropped."""
    stem = F.upper(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,4}$", ""))
    stem = F.regexp_replace(stem, r"[\s_\-]*(COPY|RUN\s*\d+|FINAL|V\d+)$", "")
    return F.regexp_replace(stem, "[^0-9A-Z一-鿿]", "")


def water_cut_percent(c: Column) -> Column:
    """SC12: a value from 0 to 1 is a fraction; others are per cent already."""
    return F.when(c.between(0, 1), c * 100).otherwise(c)


def date_parts(text: Column, pad: int = 99) -> Column:
    """SC13: sortable (year, month, day) of free date text, missing parts padded."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    part = lambda i: F.coalesce(F.try_element_at(n, F.lit(i)), F.lit(pad))
    return F.when(F.size(n) > 0, F.concat_ws("-", F.lpad(part(1).cast("string"), 4, "0"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0"))).otherwise("9999-99-99")


def days_in_month(text: Column) -> Column:
    """SC14: days of the month of an ISO month or date, 30 where unreadable."""
    return F.coalesce(F.day(F.last_day(F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd"))), F.lit(30))


def changed(a: Column, b: Column) -> Column:
    """SC15: differs by more than 1e-6 of itself and 1e-7; null against a number is a change."""
    apart = F.abs(a - b) > F.greatest(F.lit(1e-7), F.greatest(F.abs(a), F.abs(b)) * 1e-6)
    return F.coalesce(apart, a.isNull() != b.isNull())


def depth_factor(unit: Column) -> Column:
    """SC16: factor to metres of a depth unit, null where unknown."""
    u = F.upper(F.trim(unit))
    return F.when(u.isin("M", "METER", "METRE", "METERS", "METRES"), 1.0).when(u.isin("F", "FT", "FEET", "FOOT"), FOOT)


def is_time_depth(mnemonic: Column) -> Column:
    """FLT09: mnemonic of a time-depth relation, separators aside."""
    return F.regexp_replace(F.upper(mnemonic), "[^A-Z0-9]", "").rlike("^(" + "|".join(TIME_DEPTH_PREFIXES) + ")")


def valid_sample(v: Column) -> Column:
    """FLT12: finite, below 1e29 and no sentinel."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e29)
    for s in SENTINELS:
        ok = ok & (F.abs(v - s) > 1e-6)
    return ok


def identity_class_score(hard: Column, spread: Column) -> Column:
    """SC09: score of a well identity from its hard evidence kinds and coordinate spread."""
    n = F.size(hard)
    return F.when(n == 0, 40).when(F.coalesce(spread, F.lit(0.0)) > 5, 68).when(n >= 2, F.least(F.lit(98), 84 + 4 * n)).otherwise(80)


def file_kind(path: Column) -> Column:
    """SC18/SC20: kind of a file by its ending, then by words in its name; first match."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    name = F.lower(F.regexp_replace(path, r"^.*[/\\]", ""))
    return (
        F.when(ext == "las", "well_log").when(ext.isin("sgy", "segy"), "seismic").when(ext == "zgy", "seismic_volume").when(ext.isin("dev", "path"), "deviation")
        .when(ext.isin("shp", "geojson"), "polygon").when(name.rlike("well.?head|wellhead"), "well_head").when(name.rlike("deviation|survey"), "deviation")
        .when(name.rlike("production|prod"), "production").when(name.rlike("core"), "core").when(name.rlike("interp"), "interpretation")
        .when(ext.isin("csv", "txt", "xlsx"), "table").when(ext.isin("jpg", "png", "pdf"), "document").otherwise("other")
    )


def extension(path: Column) -> Column:
    """Lower-case file ending, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def repointed(path: Column, old: str, new: str) -> Column:
    """SC25: path with its prefix replaced, ignoring case, at a folder boundary only."""
    low, n = F.lower(path), len(old)
    inside = (low == old.lower()) | low.startswith(old.lower() + "/")
    return F.when(inside, F.concat(F.lit(new), F.substring(path, F.lit(n + 1), F.length(path)))).otherwise(path)


def affine_xy(inline: Column, crossline: Column, a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[Column, Column]:
    """SC29: line numbers to coordinates."""
    return inline * a[0] + crossline * a[1] + a[2], inline * b[0] + crossline * b[1] + b[2]


def affine_lines(x: Column, y: Column, a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[Column, Column]:
    """SC29: coordinates to line numbers, through the determinant."""
    det = a[0] * b[1] - a[1] * b[0]
    return ((x - a[2]) * b[1] - (y - b[2]) * a[1]) / det, ((y - b[2]) * a[0] - (x - a[2]) * b[0]) / det


def overlap_area(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """SC30: area shared by two boxes (x0, y0, x1, y1)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def barrels_of_oil_equivalent(oil: Column, gas: Column) -> Column:
    """SC31: oil plus gas at 6,000 to one."""
    return oil + gas / GAS_PER_BOE


def listed(text: Column) -> Column:
    """SC33: parts of a list written with commas, semicolons or line ends, full-width ones too."""
    return F.filter(F.transform(F.split(text, "[,;\n，；、]"), lambda x: F.trim(x)), lambda x: x != "")


def signed_angle(a: Column) -> Column:
    """SC36: angle in degrees from -180 to 180."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def whole_angle(a: Column) -> Column:
    """SC36: angle in degrees from 0 to 360."""
    return F.pmod(a, F.lit(360.0))


def similarity_of_ranges(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """SC28: overlap of two ranges as a share of their union."""
    over = F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))
    known = lo1.isNotNull() & hi1.isNotNull() & lo2.isNotNull() & hi2.isNotNull()  # least() and greatest() pass over nulls
    return F.when(known, over / F.nullif(F.greatest(hi1, hi2) - F.least(lo1, lo2), F.lit(0.0)))


def core_depths(name: Column) -> tuple[Column, Column]:
    """SC17: top and base in metres of a core named like 1234.5-1240m; feet converted, ends put right."""
    pattern = r"(\d+(?:\.\d+)?)\s*[-_~]\s*(\d+(?:\.\d+)?)\s*(ft|m)?"
    low = F.lower(name)
    f = F.when(F.regexp_extract(low, pattern, 3) == "ft", FOOT).otherwise(1.0)
    a, b = F.regexp_extract(low, pattern, 1).try_cast("double") * f, F.regexp_extract(low, pattern, 2).try_cast("double") * f
    return F.round(F.least(a, b), 4), F.round(F.greatest(a, b), 4)


def line_name(name: Column) -> Column:
    """SC23: seismic line name without processing words."""
    return F.trim(F.regexp_replace(F.upper(name), r"[\s_\-]*(MIG|STACK|PSTM|PSDM|FINAL|RAW|V\d+)\b", ""))

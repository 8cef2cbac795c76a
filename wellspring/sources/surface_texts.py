"""Texts of surfaces, profiles and faults, and what a look at their heads tells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.sources.files import decoded, number, opened, parsed, text_lines

PROBED = 2 * 1024 * 1024  # bytes a surface is told from
POINTS = 4000  # points its range is told from
_SKIPPED = ("#", "!", "@", "->", "FS", "PROFILE", "SNAPPING", "FF")


def triplet(line: str) -> tuple[float, float, float] | None:
    """SRC18: the point of a line: its first three numbers, or the third to fifth where
    two line numbers come before coordinates."""
    s = line.strip()
    if not s or s.startswith(_SKIPPED):
        return None
    n = [v for t in s.replace(",", " ").split()[:8] if (v := number(t)) is not None]
    if len(n) < 3:
        return None
    return tuple(n[2:5]) if len(n) >= 5 and abs(n[0]) < 1000 and abs(n[2]) > 10000 and abs(n[3]) > 10000 else tuple(n[:3])


def grid_header(text: str) -> dict | None:
    """SRC15, SRC17: rows, columns, steps and limits of a regular surface from its first 80
    lines; null where there is none."""
    lines = text.splitlines()[:80]
    found = {k: [number(t) for t in line.split()[1:]] for line in lines for k in ("FSLIMI", "FSNROW", "FSXINC", "FSNULL") if line.strip().startswith(k)}
    if "FSLIMI" not in found or "FSNROW" not in found:
        return None
    limits, step = (found["FSLIMI"] + [None] * 6)[:6], (found.get("FSXINC", []) + [None, None])[:2]
    return {"rows": int(found["FSNROW"][0]), "cols": int(found["FSNROW"][1]), "dx": step[0], "dy": step[1], **dict(zip(("x_min", "x_max", "y_min", "y_max", "low", "high"), limits))}


def surface_kind(path: str, text: str) -> dict:
    """SRC19: kind of a surface and its range from the head of its text."""
    upper, points = text.upper(), []
    head = grid_header(text) if "FSASCI" in upper and "FSNROW" in upper else None
    if head:
        return {"kind": "regular_surface", "points": 0, **{k: head[k] for k in ("rows", "cols", "x_min", "x_max", "y_min", "y_max", "low", "high")}}
    for line in text.splitlines():
        if (p := triplet(line)) is not None:
            points.append(p)
            if len(points) == POINTS:
                break
    zmap = "ZMAP" in upper or path.lower().endswith((".zmap", ".zmap+"))
    kind = ("xyz_surface" if points else "zmap_grid") if zmap else "2d_profile" if "PROFILE" in upper else "xyz_surface" if points else "catalog_horizon"
    out = {"kind": kind, "points": len(points)}
    if points:
        for k, i, f in (("x_min", 0, min), ("x_max", 0, max), ("y_min", 1, min), ("y_max", 1, max), ("low", 2, min), ("high", 2, max)):
            out[k] = f(p[i] for p in points)
    return out


_META = "path string, kind string, points int, rows int, cols int, x_min double, x_max double, y_min double, y_max double, low double, high double"


def surface_metadata(spark: SparkSession, path: str | DataFrame, pattern: str = "*") -> DataFrame:
    """SRC19: kind, size and range of each surface file, told from its first two megabytes;
    of the files no more is read. Ranges of points are those of the first 4,000."""
    names = [c.split()[0] for c in _META.split(", ")]
    if isinstance(path, DataFrame):
        return parsed(spark, path, pattern, lambda p, content: [{"path": p, **surface_kind(p, decoded(content[:PROBED]))}], _META)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                with opened(p) as f:
                    rows.append({"path": p, **surface_kind(p, f.read(PROBED).decode("utf-8", errors="replace"))})
            yield pd.DataFrame(rows, columns=names)

    return listed.mapInPandas(run, _META)


def grid_scan(nodes: DataFrame) -> DataFrame:
    """SRC15: per grid (path, row, col, x, y, value) the nodes, those with a value, and the
    range of values."""
    return nodes.groupBy("path").agg(F.count("*").alias("nodes"), F.count("value").alias("valid"), F.min("value").alias("low"), F.max("value").alias("high"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def _parts(lines: DataFrame) -> DataFrame:
    return lines.select("path", F.trim("value").alias("line"), F.split(F.trim("value"), r"\s+").alias("p"))


def _at(i: int) -> Column:
    return F.try_element_at("p", F.lit(i + 1))


def _value(i: int) -> Column:
    return _at(i).try_cast("double")


def profile_points(spark: SparkSession, path: str | DataFrame, pattern: str = "*") -> DataFrame:
    """SRC20: points (path, profile_type, line, trace, x, y, z) of profile texts. The head
    PROFILE TYPE n of a file tells where z, trace and line name stand: of type 1 in the
    fifth, eighth and tenth column, else z in the third and the name is the file's."""
    lines = _parts(text_lines(spark, path, pattern))
    kind = lines.where(F.col("line").startswith("PROFILE")).groupBy("path").agg(F.max(F.regexp_extract("line", r"\bTYPE\s+(\d+)", 1).try_cast("int")).alias("profile_type"))
    body = lines.where(~F.col("line").rlike(r"^(PROFILE|SNAPPING|#|FFASCI|FFATTR|->)") & (F.size("p") >= 3) & _value(0).isNotNull() & _value(1).isNotNull())
    one = F.coalesce(F.col("profile_type") == 1, F.lit(False))
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*[/\\]", ""), r"\.[^.]*$", "")
    out = body.join(kind, "path", "left")
    return out.select("path", "profile_type", F.when(one & (F.size("p") > 9), _at(9)).otherwise(stem).alias("line"), F.when(one, _value(7).cast("int")).alias("trace"), _value(0).alias("x"), _value(1).alias("y"), F.when(one & (F.size("p") > 4), _value(4)).otherwise(_value(2)).alias("z"))


def fault_sticks(spark: SparkSession, path: str | DataFrame, pattern: str = "*") -> DataFrame:
    """SRC21: points (path, stick, x, y, z) of fault sticks: lines of eight columns that
    begin with a kind of line; the last column names the stick."""
    rows = _parts(text_lines(spark, path, pattern)).where((F.size("p") >= 8) & F.upper(_at(0)).rlike("^(INLINE|XLINE|CROSSLINE)"))
    return rows.where(_value(3).isNotNull() & _value(4).isNotNull() & _value(5).isNotNull()).select("path", F.element_at("p", -1).alias("stick"), _value(3).alias("x"), _value(4).alias("y"), _value(5).alias("z"))


def fault_model(spark: SparkSession, path: str | DataFrame, pattern: str = "*") -> DataFrame:
    """SRC21: faults and pillars of model texts: (path, kind, name, x, y, z)."""
    rows = _parts(text_lines(spark, path, pattern))
    name = F.nullif(F.regexp_extract("line", r'FAULT\s+"([^"]+)"', 1), F.lit(""))
    fault = rows.where(F.col("line").startswith("FAULT") & name.isNotNull()).select("path", F.lit("fault").alias("kind"), name.alias("name"), *[F.lit(None).cast("double").alias(c) for c in "xyz"])
    pillar = rows.where(F.col("line").startswith("PILLAR")).select("path", F.lit("pillar").alias("kind"), F.lit(None).cast("string").alias("name"), *[_value(i + 1).alias(c) for i, c in enumerate("xyz")])
    return fault.unionByName(pillar)


def faults_on_lines(spark: SparkSession, path: str | DataFrame, pattern: str = "*") -> DataFrame:
    """SRC21: points (path, line, x, y, z) of faults on 2D lines: five columns, the first
    of them the line."""
    rows = _parts(text_lines(spark, path, pattern)).where(~F.col("line").startswith("#") & (F.size("p") >= 5))
    return rows.where(_value(2).isNotNull() & _value(3).isNotNull() & _value(4).isNotNull()).select("path", _at(0).alias("line"), _value(2).alias("x"), _value(3).alias("y"), _value(4).alias("z"))


def point_summary(points: DataFrame, group: str) -> DataFrame:
    """SRC20, SRC21: per file the points, the distinct lines or sticks, and their range."""
    return points.groupBy("path").agg(F.count("*").alias("points"), F.countDistinct(group).alias("groups"), F.min("z").alias("low"), F.max("z").alias("high"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def crs_sidecar(text: Column) -> Column:
    """SRC22: (epsg, description) of the text of a CRS sidecar: the number after EPSG, and
    the content of its description, else of its name."""
    epsg = F.nullif(F.regexp_extract(text, r"(?i)EPSG[^0-9]{1,12}(\d{4,6})", 1), F.lit("")).try_cast("int")
    said = [F.nullif(F.trim(F.regexp_extract(text, rf"(?is)<\s*(?:\w+:)?{tag}[^>]*>([^<]+)<", 1)), F.lit("")) for tag in ("description", "name")]
    return F.struct(epsg.alias("epsg"), F.coalesce(*said).alias("description"))

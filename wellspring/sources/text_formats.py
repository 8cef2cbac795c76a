"""Text formats: logs, trajectories, well tops, checkshots, grids, perforations."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.sources.files import LOG_ENCODINGS, decoded, number, opened, parsed, text_lines

_LINE = re.compile(r"^\s*([^.\s]+)\s*\.(\S*)\s*(.*?)\s*(?::\s*(.*))?$")


def _las(content: bytes) -> tuple[dict, list[tuple[str, str, str]], np.ndarray]:
    """Header values, curves (mnemonic, unit, description) and the data matrix.
    A wrapped file is cut into rows by its number of curves; short rows drop."""
    section, head, curves, numbers = "", {}, [], []
    wrap = False
    for line in decoded(content, LOG_ENCODINGS).splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("~"):
            section = line.strip()[1:2].upper()
            continue
        if section in "VWP" and section:
            if m := _LINE.match(line):
                key, unit, value, text = m[1].upper(), m[2], m[3], m[4]
                head[key] = (value if value else text, unit)
                wrap |= key == "WRAP" and (value or "").upper().startswith("Y")
        elif section == "C":
            if m := _LINE.match(line):
                curves.append((m[1], m[2], (m[4] or "").strip()))
        elif section == "A":
            numbers.append([number(t) for t in line.split()])
    n = len(curves)
    if not n:
        return head, curves, np.zeros((0, 0))
    if wrap:
        flat = [x for r in numbers for x in r]
        rows = [flat[i : i + n] for i in range(0, len(flat) - n + 1, n)]
    else:
        rows = [r[:n] for r in numbers if len(r) >= n]
    data = np.array([[np.nan if x is None else x for x in r] for r in rows], float).reshape(len(rows), n)
    null = number(head.get("NULL", ("-999.25", ""))[0])
    if null is not None:
        data[np.abs(data - null) < 1e-10] = np.nan
    return head, curves, data


_HEADER = "path string, well string, uwi string, start double, stop double, step double, depth_unit string, place int, mnemonic string, unit string, description string"


def _header_rows(p: str, content: bytes) -> list[dict]:
    head, curves, _ = _las(content.split(b"~A")[0])
    get = lambda k: head.get(k, (None, None))
    return [{"path": p, "well": get("WELL")[0], "uwi": get("UWI")[0], "start": number(get("STRT")[0]), "stop": number(get("STOP")[0]), "step": number(get("STEP")[0]), "depth_unit": get("STRT")[1], "place": i, "mnemonic": m, "unit": u, "description": d} for i, (m, u, d) in enumerate(curves)]


def _head_of(path: str, chunk: int = 65536) -> bytes:
    """A log file up to its data section."""
    raw = b""
    with opened(path) as f:
        while b"~A" not in raw and (more := f.read(chunk)):
            raw += more
    return raw.split(b"~A")[0]


def las_headers(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC05: one row per curve of each LAS file: well, depth range, mnemonic, unit. Of
    files only the part before their data is read."""
    if isinstance(path, DataFrame):
        return parsed(spark, path, "", _header_rows, _HEADER)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sS]").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield pd.DataFrame(_header_rows(p, _head_of(p)), columns=[c.split()[0] for c in _HEADER.split(", ")])

    return listed.mapInPandas(run, _HEADER)


def las_header_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC08: the header lines of LAS files as they stand (path, place, section, line),
    for exports that keep them."""

    def rows(p: str, content: bytes) -> list[dict]:
        out, section = [], ""
        for i, line in enumerate(decoded(content.split(b"~A")[0], LOG_ENCODINGS).splitlines()):
            section = line.strip()[1:2].upper() if line.lstrip().startswith("~") else section
            out.append({"path": p, "place": i, "section": section, "line": line})
        return out

    return parsed(spark, path, "*.[lL][aA][sS]", rows, "path string, place int, section string, line string")


def curve_reservoir(samples: DataFrame, size: int = 2048, seed: int = 42) -> DataFrame:
    """SRC07: at most `size` samples of each file and curve (path, mnemonic, md, value),
    those of the least seeded hash of their depth: the same ones however the file is
    read. A sampling operator; a file's curve is its unit."""
    w = W.partitionBy("path", "mnemonic").orderBy(F.xxhash64(F.lit(seed), "md"), "md", "value")
    return samples.where("value is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).drop("n")


def las_samples(spark: SparkSession, path: str | DataFrame, mnemonics: tuple[str, ...] | None = None) -> DataFrame:
    """SRC06, SRC07: long samples (path, well, mnemonic, md, value) of LAS files, of
    some curves only if named; the depth is DEPT, DEPTH, MD or the first curve."""

    def rows(p: str, content: bytes) -> list[dict]:
        head, curves, data = _las(content)
        names = [c[0].upper() for c in curves]
        depth = next((names.index(d) for d in ("DEPT", "DEPTH", "MD", "TDEP") if d in names), 0)
        well = head.get("WELL", (None,))[0]
        return [
            {"path": p, "well": well, "mnemonic": names[i], "md": md, "value": None if v != v else v}
            for i in range(len(names)) if i != depth and (mnemonics is None or names[i] in mnemonics) for md, v in zip(data[:, depth].tolist(), data[:, i].tolist())
        ]

    return parsed(spark, path, "*.[lL][aA][sS]", rows, "path string, well string, mnemonic string, md double, value double")


def las_statistics(samples: DataFrame) -> DataFrame:
    """SRC06: per file and curve count, range, mean, deviation and percentiles."""
    s = samples.where("value is not null").groupBy("path", "mnemonic").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", [0.05, 0.5, 0.95]).alias("p"))
    return s.select("path", "mnemonic", "n", "low", "high", "mean", "std", *[F.col("p")[i].alias(c) for i, c in enumerate(("p05", "p50", "p95"))])


def dev_stations(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC10: stations (path, md, x, y, z, tvd) of trajectory files: lines of at
    least five numbers. Plain text, so large files split."""
    t = text_lines(spark, path, "*.dev").select("path", F.split(F.trim("value"), r"\s+").alias("p"))
    n = [F.try_element_at("p", F.lit(i + 1)).try_cast("double") for i in range(5)]
    ok = F.size("p") >= 5
    for c in n:
        ok = ok & c.isNotNull()
    return t.where(ok).select("path", *[c.alias(a) for c, a in zip(n, ("md", "x", "y", "z", "tvd"))])


def dev_summary(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC11: per trajectory file the well, head coordinates and datum its comment lines
    tell, and the number and range of its stations."""
    lines = text_lines(spark, path, "*.dev")
    told = lambda pattern: F.max(F.nullif(F.trim(F.regexp_extract("value", pattern, 1)), F.lit("")))
    num = r"[:=\s]\s*(-?\d+(?:\.\d+)?)"
    head = lines.groupBy("path").agg(
        told(r"(?i)^\s*#\s*WELL(?:\s+NAME)?\s*[:=\s]\s*(.+)$").alias("well"), told(r"(?i)^\s*#.*HEAD\s+X(?:-COORDINATE)?\s*" + num).try_cast("double").alias("x"),
        told(r"(?i)^\s*#.*HEAD\s+Y(?:-COORDINATE)?\s*" + num).try_cast("double").alias("y"), told(r"(?i)^\s*#.*(?:KB|DATUM)[^:=]*" + num).try_cast("double").alias("datum"),
    )
    body = dev_stations(spark, path).groupBy("path").agg(F.count("*").alias("stations"), F.min("md").alias("top_md"), F.max("md").alias("base_md"))
    return head.join(body, "path", "left").withColumn("stations", F.coalesce("stations", F.lit(0)))


def _header_table(text: str) -> list[dict]:
    """Rows of text tables with BEGIN HEADER / END HEADER column lists; a file may
    have several of them."""
    names: list[str] = []
    out, inside = [], False
    for line in text.splitlines():
        s = line.strip()
        if s.upper() == "BEGIN HEADER":
            names, inside = [], True
        elif s.upper() == "END HEADER":
            inside = False
        elif inside and s:
            names.append(s.lower())
        elif names and s and not s.startswith("#"):
            try:
                values = shlex.split(s)
            except ValueError:
                continue
            if len(values) >= len(names):
                out.append(dict(zip(names, values)))
    return out


def well_tops(spark: SparkSession, path: str | DataFrame, pattern: str = "*.tops") -> DataFrame:
    """SRC12, SRC13: picks (path, well, surface, type, md, x, y, z)."""

    def rows(p: str, content: bytes) -> list[dict]:
        return [{"path": p, "well": r.get("well"), "surface": r.get("surface"), "type": r.get("type"), **{k: number(r.get(k)) for k in ("md", "x", "y", "z")}} for r in _header_table(decoded(content))]

    return parsed(spark, path, pattern, rows, "path string, well string, surface string, type string, md double, x double, y double, z double")


def well_heads(spark: SparkSession, path: str | DataFrame, pattern: str = "*.wh") -> DataFrame:
    """SRC09: well heads (path, well, uwi, x, y, kb, td)."""

    def rows(p: str, content: bytes) -> list[dict]:
        pick = lambda r, *ks: next((r[k] for k in ks if r.get(k)), None)
        return [{"path": p, "well": pick(r, "name", "well"), "uwi": pick(r, "uwi"), "x": number(pick(r, "surface x", "x")), "y": number(pick(r, "surface y", "y")), "kb": number(pick(r, "kb", "datum value", "well datum value")), "td": number(pick(r, "td", "td (md)"))} for r in _header_table(decoded(content))]

    return parsed(spark, path, pattern, rows, "path string, well string, uwi string, x double, y double, kb double, td double")


def checkshots(spark: SparkSession, path: str | DataFrame, pattern: str = "*.cks") -> DataFrame:
    """SRC14: time-depth points (path, well, md, time)."""

    def rows(p: str, content: bytes) -> list[dict]:
        return [{"path": p, "well": r.get("well"), "md": number(r.get("md")), "time": number(r.get("time", r.get("twt")))} for r in _header_table(decoded(content))]

    return parsed(spark, path, pattern, rows, "path string, well string, md double, time double")


def _fsasci(text: str) -> tuple[np.ndarray, tuple]:
    head, _, body = text.partition("->")
    limits = [number(t) for t in re.search(r"FSLIMI\s+(.*)", head)[1].split()]
    rows, cols = (int(number(t)) for t in re.search(r"FSNROW\s+(.*)", head)[1].split()[:2])
    values = np.array([number(t) for t in body.split()][: rows * cols], float).reshape(rows, cols)[::-1]  # first row is the northern one
    null = number(m[1]) if (m := re.search(r"FSNULL\s+(\S+)", head)) else 1e30
    values[np.abs(values) >= 0.99 * abs(null)] = np.nan
    return values, tuple(limits[:4])


def _zmap(text: str) -> tuple[np.ndarray, tuple]:
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("!")]
    start = next(i for i, x in enumerate(lines) if x.lstrip().startswith("@"))
    null = number(lines[start + 1].split(",")[1])
    parts = [number(t) for t in lines[start + 2].split(",")]
    rows, cols = int(parts[0]), int(parts[1])
    end = next(i for i in range(start + 1, len(lines)) if lines[i].strip() == "@")
    flat = [number(t) for line in lines[end + 1 :] for t in line.split()][: rows * cols]
    values = np.array(flat, float).reshape(cols, rows).T[::-1]  # by column, each from north to south
    if null is not None:
        values[np.isclose(values, null, rtol=1e-7, atol=0)] = np.nan
    return values, tuple(parts[2:6])


def grid_nodes(spark: SparkSession, path: str | DataFrame, pattern: str = "*.{grd,zmap}") -> DataFrame:
    """SRC15-SRC17: nodes (path, row, col, x, y, value) of FSASCI and ZMAP+ grids, row
    0 in the south; null nodes have a null value."""

    def rows(p: str, content: bytes) -> list[dict]:
        text = decoded(content)
        values, (x0, x1, y0, y1) = _fsasci(text) if "FSLIMI" in text[:4000] else _zmap(text)
        r, c = values.shape
        dx, dy = (x1 - x0) / max(c - 1, 1), (y1 - y0) / max(r - 1, 1)
        return [{"path": p, "row": i, "col": j, "x": x0 + j * dx, "y": y0 + i * dy, "value": None if values[i, j] != values[i, j] else float(values[i, j])} for i in range(r) for j in range(c)]

    return parsed(spark, path, pattern, rows, "path string, row int, col int, x double, y double, value double")


def xyz_points(spark: SparkSession, path: str | DataFrame, pattern: str = "*.xyz") -> DataFrame:
    """SRC18: points (path, x, y, z): the last three numbers of lines of three or,
    with line numbers before them, five."""
    t = text_lines(spark, path, pattern).select("path", F.split(F.trim("value"), r"[\s,;]+").alias("p"))
    n = [F.try_element_at("p", F.lit(i)).try_cast("double") for i in (-3, -2, -1)]
    return t.where(F.size("p").isin(3, 5) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull()).select("path", *[c.alias(a) for c, a in zip(n, "xyz")])


def perforations(rows: DataFrame) -> DataFrame:
    """SRC36, WIN14, HLP22: details under block headers of a sheet (sheet, row_no, marker,
    name, kind, date, top, base) inherit the header's well; thickness; rows
    without kind or ends drop. Sheets are the unit a person can fill."""
    w = W.partitionBy("sheet").orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    dates = [F.try_to_timestamp("date", F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd")]
    filled = rows.withColumn("well", F.last(F.when(F.col("marker") == "WELL", F.col("name")), True).over(w)).where("coalesce(marker, '') <> 'WELL'")
    good = filled.where("kind is not null and top is not null and base is not null and well is not null")
    return good.select("sheet", "row_no", "well", "kind", F.coalesce(*dates).cast("date").alias("day"), "top", "base", (F.col("base") - F.col("top")).alias("thickness"), (F.col("base") <= F.col("top")).alias("not_positive"))

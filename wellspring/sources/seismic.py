"""SEG-Y files: header layouts, scans of trace headers, samples.

Files are listed without their contents. One task a file reads its head and up to
512 trace headers; files whose traces all have the same length, which is nearly
all, are then read in ranges of traces by as many tasks as needed, seeking from
header to header, so neither size nor number of traces is bounded by a task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.operators.ingest import convex_hulls
from wellspring.sources.files import opened

HEAD, TRACE, TEXT = 3600, 240, 3200
PROBED = 512  # trace headers a layout is told from
# fixed values: bytes per sample of the format codes of the standard, and their NumPy types
SAMPLE_BYTES = {1: 4, 2: 4, 3: 2, 5: 4, 6: 8, 7: 3, 8: 1, 9: 8, 10: 4, 11: 2, 12: 8, 15: 3, 16: 1}
_KINDS = {2: ">i4", 3: ">i2", 5: ">f4", 6: ">f8", 8: "i1", 9: ">i8", 10: ">u4", 11: ">u2", 12: ">u8", 16: "u1"}
# fixed values: byte places (from 1) of x, y, inline and crossline, whether coordinates are scaled, and the layout's weight
LAYOUTS = {
    "petrel_pep_swapped": (189, 193, 181, 185, True, 1.0),
    "segy_rev1": (181, 185, 189, 193, True, 4.0),
    "source_xy_petrel_grid": (73, 77, 181, 185, False, 0.0),
    "source_xy_rev1_grid": (73, 77, 189, 193, False, 0.0),
    "scaled_source_xy": (73, 77, 189, 193, True, 0.0),
    "source_xy_2d": (73, 77, None, None, False, -1.0),
}
TWO_D_WEIGHT = 5.0  # of the layout without line numbers where the text says 2D
_INLINES, _CROSSLINES = r"(?:INLINE|IN-LINE|IL)", r"(?:XLINE|CROSSLINE|CROSS-LINE|XL)"


def decode_samples(raw: bytes, code: int) -> np.ndarray:
    """SRC29: samples of a trace; code 1 is the hexadecimal float, 7 and 15 are
    24-bit integers with and without sign."""
    if code in (7, 15):
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int64)
        v = (b[:, 0] << 16) | (b[:, 1] << 8) | b[:, 2]
        return (np.where(v >= 1 << 23, v - (1 << 24), v) if code == 7 else v).astype(float)
    if code != 1:
        return np.frombuffer(raw, _KINDS[code]).astype(float)
    u = np.frombuffer(raw, ">u4").astype(np.uint64)
    sign = np.where(u >> np.uint64(31), -1.0, 1.0)
    power = ((u >> np.uint64(24)) & np.uint64(0x7F)).astype(float) - 64
    return sign * (u & np.uint64(0xFFFFFF)).astype(float) / 2**24 * 16.0**power


def header_text(raw: bytes) -> str:
    """The 3,200 bytes of text as ASCII or EBCDIC, whichever reads more like a header."""
    def likeness(text: str) -> float:
        words = len(re.findall(r"C01|SEG-?Y|INLINE|XLINE|SURVEY|SAMPLE", text.upper()))
        return 20 * words + sum(c.isalnum() or c in " .,:;_-/()" for c in text) / max(1, len(text))

    return max((raw.decode(e, errors="replace") for e in ("ascii", "cp500")), key=likeness)


def _stated_range(text: str, name: str) -> tuple[int, int] | None:
    m = re.search(name + r"\s*:?\s*(\d+)\s*[-–]\s*(\d+)", text, re.IGNORECASE)
    return tuple(sorted((int(m[1]), int(m[2])))) if m else None


def _numbers(headers: np.ndarray, at: int, kind: str = ">i4") -> np.ndarray:
    """A field of trace headers (one row each) by its byte place."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(headers[:, at - 1 : at - 1 + size]).view(kind)[:, 0].astype(np.int64)


def header_values(headers: np.ndarray, layout: str) -> dict[str, np.ndarray]:
    """x, y, inline and crossline of trace headers (one row of 240 bytes each)."""
    x, y, inline, crossline, scaled, _ = LAYOUTS[layout]
    s = _numbers(headers, 71, ">i2").astype(float)
    factor = np.where(s > 0, s, np.where(s < 0, 1 / np.where(s == 0, 1, np.abs(s)), 1.0)) if scaled else 1.0
    none = np.zeros(len(headers), np.int64)
    return {"x": _numbers(headers, x) * factor, "y": _numbers(headers, y) * factor, "inline": none if inline is None else _numbers(headers, inline), "crossline": none if crossline is None else _numbers(headers, crossline)}


def segy_layout(headers: list[bytes], text: str = "") -> str:
    """SRC27: the layout that fits best: coordinates of projected (weight 6) or
    geographic (2) size, line numbers within the range the text states (8, with a
    fiftieth of slack, five at least) or of plausible size (1), and its own weight."""
    rows = np.frombuffer(b"".join(headers), "u1").reshape(-1, TRACE)

    def fit(name: str) -> float:
        v = header_values(rows, name)
        located = (v["x"] != 0) | (v["y"] != 0)
        if not located.any():
            return -100.0
        x, y = np.abs(v["x"][located]), np.abs(v["y"][located])
        projected = ((x >= 1e4) & (x <= 1e8) & (y >= 1e4) & (y <= 1e8)).mean()
        total = 6 * projected + 2 * ((x <= 180) & (y <= 90)).mean() + LAYOUTS[name][5]
        if name == "source_xy_2d" and re.search(r"\b2D\b", text, re.IGNORECASE):
            total += TWO_D_WEIGHT - LAYOUTS[name][5]
        for column, pattern in (("inline", _INLINES), ("crossline", _CROSSLINES)):
            n = v[column][v[column] != 0]
            if not len(n):
                continue
            stated = _stated_range(text, pattern)
            slack = max(5, int((stated[1] - stated[0]) * 0.02)) if stated else 0
            total += 8 * ((n >= stated[0] - slack) & (n <= stated[1] + slack)).mean() if stated else (np.abs(n) < 1e7).mean()
        return total

    return max(LAYOUTS, key=fit)


def _walked(handle, start: int, size: int, samples: int, width: int, most: int) -> Iterator[tuple[int, bytes, int, bool]]:
    """(place, header, samples, whole) of at most `most` traces from a byte place on."""
    at = start
    while most and at + TRACE <= size:
        handle.seek(at)
        header = handle.read(TRACE)
        n = struct.unpack(">H", header[114:116])[0] or samples
        if n <= 0:
            return
        end = at + TRACE + n * width
        yield at, header, n, end <= size
        if end > size:
            return
        at, most = end, most - 1


_PROBE = "path string, size long, text string, code int, step_us int, head_samples int, start long, width int, layout string, fixed boolean, traces long, exact boolean, warning string"


def segy_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC28: one row a SEG-Y file from its head and first traces: text, format code,
    sample interval, layout, whether all traces seem of one length, the number of traces
    that gives, and whether it leaves no rest. Files that are none have only a warning."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{sgy,segy,SGY,SEGY}").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def probe(p: str, size: int) -> dict:
        out = {"path": p, "size": size}
        if size < HEAD:
            return out | {"warning": "shorter than the file header"}
        with opened(p) as handle:
            head = handle.read(HEAD)
            step, samples, code = (struct.unpack(">H", head[TEXT + at : TEXT + at + 2])[0] for at in (16, 20, 24))
            extended = struct.unpack(">h", head[TEXT + 304 : TEXT + 306])[0]
            out |= {"text": header_text(head[:TEXT]), "code": code, "step_us": step, "head_samples": samples, "warning": "number of extended headers unknown, taken as none" if extended < 0 else None}
            if code not in SAMPLE_BYTES:
                return out | {"warning": f"sample format {code} is not supported"}
            start, width = HEAD + max(extended, 0) * TEXT, SAMPLE_BYTES[code]
            first = list(_walked(handle, start, size, samples, width, PROBED))
        if not first:
            return out | {"warning": "no trace"}
        length = TRACE + first[0][2] * width
        same = len({n for _, _, n, _ in first}) == 1
        rest = (size - start) % length
        return out | {"start": start, "width": width, "layout": segy_layout([h for _, h, _, _ in first], out["text"]), "fixed": same and rest == 0, "traces": (size - start) // length, "exact": same and rest == 0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PROBE.split(", ")]
        for b in batches:
            rows = pd.DataFrame([probe(p, int(n)) for p, n in zip(b["path"], b["length"])], columns=names, dtype=object)
            yield rows

    return listed.mapInPandas(run, _PROBE)


_TRACE = "path string, trace long, inline int, crossline int, x double, y double, samples int, delay_ms int, step_us int, whole boolean, layout string, v array<double>"


def segy_traces(spark: SparkSession, path: str, with_samples: bool = False, each: int = 20_000) -> DataFrame:
    """SRC26, SRC29: one row a trace: numbers, place, times, and its samples if asked for.
    A file of traces of one length is read by ranges of `each` traces; one of traces of
    several lengths by a single task, as only walking it finds them. A number of 0 is
    null. Traces cut off by the end of the file are marked as not whole."""
    files = segy_files(spark, path).where("layout is not null")
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("traces") / each) - 1)
    ranges = files.select("*", F.explode(F.when(F.col("fixed"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(r) -> pd.DataFrame | None:
        length = (r.size - r.start) // r.traces if r.traces else 0
        first = int(r.part) * each if r.fixed else 0
        with opened(r.path) as handle:
            got = list(_walked(handle, int(r.start + first * length), int(r.size), int(r.head_samples), int(r.width), each if r.fixed else -1))
            if not got:
                return None
            v = header_values(np.frombuffer(b"".join(h for _, h, _, _ in got), "u1").reshape(-1, TRACE), r.layout)
            rows = np.frombuffer(b"".join(h for _, h, _, _ in got), "u1").reshape(-1, TRACE)
            out = pd.DataFrame({"path": r.path, "trace": np.arange(first, first + len(got)), "inline": v["inline"], "crossline": v["crossline"], "x": v["x"], "y": v["y"], "samples": [k for _, _, k, _ in got], "delay_ms": _numbers(rows, 109, ">i2"), "step_us": np.where((s := _numbers(rows, 117, ">u2")) > 0, s, r.step_us), "whole": [w for *_, w in got], "layout": r.layout})
            out["v"] = None
            if with_samples:
                data = []
                for at, _, k, whole in got:
                    handle.seek(at + TRACE)
                    raw = handle.read(k * int(r.width))
                    data.append(decode_samples(raw[: len(raw) // int(r.width) * int(r.width)], int(r.code)).tolist())
                out["v"] = data
        return out.astype({"inline": "Int32", "crossline": "Int32"}).assign(inline=lambda d: d["inline"].mask(d["inline"] == 0), crossline=lambda d: d["crossline"].mask(d["crossline"] == 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                out = read(r)
                if out is not None:
                    yield out

    return ranges.repartition(n, "path", "part").mapInPandas(run, _TRACE)


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(F.upper(text).rlike(pattern), F.lit(False))


def segy_scan(spark: SparkSession, path: str) -> DataFrame:
    """SRC26, HLP21: one row a file from all of its trace headers: number of traces,
    ranges of samples, times, places and lines, dimension (told by the text, else 3D
    where both line numbers vary), the hull of all places and its area, spacing of the
    grid of a 3D file by least squares, and warnings."""
    files = segy_files(spark, path)
    traces = segy_traces(spark, path)
    located = (F.col("x") != 0) | (F.col("y") != 0)
    end = F.col("delay_ms") + F.greatest(F.lit(0), F.col("samples") - 1) * F.col("step_us") / 1000
    span = lambda c, n, test=None: [f(F.when(test, c) if test is not None else c).alias(f"{n}_{w}") for f, w in ((F.min, "min"), (F.max, "max"))]
    totals = traces.groupBy("path").agg(
        F.count("*").alias("trace_count"), *span(F.col("samples"), "samples"), *span(F.col("delay_ms"), "delay_ms"), *span(end, "end_ms"), *span(F.col("x"), "x", located), *span(F.col("y"), "y", located),
        *span(F.col("inline"), "inline"), *span(F.col("crossline"), "crossline"), F.count_if(~F.col("whole")).alias("cut_off"),
    )
    corners = convex_hulls(traces.where(located).select(F.col("path").alias("survey"), "x", "y"))
    ring = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    hulls = corners.groupBy(F.col("survey").alias("path")).agg(ring.alias("ring"))
    nxt = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("ring", nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
    out = files.join(totals, "path", "left").join(hulls, "path", "left").join(grid_spacing(traces), "path", "left")
    varies = (F.col("inline_min") != F.col("inline_max")) & (F.col("crossline_min") != F.col("crossline_max"))
    two = _says(F.col("text"), r"(ESTUDIO|SURVEY|LINEA|LINE)\s*:?\s*2D|\b2D\b")
    three = _says(F.col("text"), r"(ESTUDIO|SURVEY)\s*:?\s*3D|\b3D\b") | F.coalesce(varies, F.lit(False))
    dimension = F.when(two, "2D").when(three, "3D").otherwise("2D")
    warnings = F.array_compact(F.array("warning", F.when(F.col("cut_off") > 0, "the last trace is cut off"), F.when(F.col("layout").isNotNull() & F.col("x_min").isNull(), "no coordinates at the usual places")))
    three_d = dimension == "3D"
    keep = [c for c in totals.columns if c not in ("path", "cut_off")]
    return out.select(
        "path", dimension.alias("dimension"), "layout", "code", "step_us", *keep, F.when(F.size("ring") > 2, area).otherwise(0.0).alias("footprint_area"), F.transform("ring", lambda c: F.struct(F.round(c["x"], 3).alias("x"), F.round(c["y"], 3).alias("y"))).alias("footprint"),
        F.when(three_d, F.round("inline_spacing", 4)).alias("inline_spacing"), F.when(three_d, F.round("crossline_spacing", 4)).alias("crossline_spacing"), F.substring("text", 1, 480).alias("text_preview"), F.array_join(warnings, "; ").alias("warnings"),
    )


def grid_spacing(traces: DataFrame) -> DataFrame:
    """(path, inline_spacing, crossline_spacing): steps of the affine grid of traces
    (path, inline, crossline, x, y), by the normal equations about the means, as two
    aggregations; null where the lines do not span a plane."""
    rows = traces.where("inline is not null and crossline is not null and (x <> 0 or y <> 0)")
    names = ("inline", "crossline", "x", "y")
    mean = rows.groupBy("path").agg(*[F.avg(n).alias(f"m_{n}") for n in names])
    i, c, x, y = ((F.col(n) - F.col(f"m_{n}")) for n in names)
    s = rows.join(mean, "path").groupBy("path").agg(*[F.sum(a * b).alias(n) for n, a, b in (("ii", i, i), ("ic", i, c), ("cc", c, c), ("ix", i, x), ("cx", c, x), ("iy", i, y), ("cy", c, y))])
    det = F.nullif(F.col("ii") * F.col("cc") - F.col("ic") * F.col("ic"), F.lit(0.0))
    along = lambda v: (F.col(f"i{v}") * F.col("cc") - F.col(f"c{v}") * F.col("ic")) / det
    across = lambda v: (F.col(f"c{v}") * F.col("ii") - F.col(f"i{v}") * F.col("ic")) / det
    return s.select("path", F.hypot(along("x"), along("y")).alias("inline_spacing"), F.hypot(across("x"), across("y")).alias("crossline_spacing"))

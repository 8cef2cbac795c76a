"""Binary and structured formats: shapefile polygons, GeoJSON, workbooks."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from wellspring.sources.files import decoded, parsed


def shapefile_rings(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC25: ring points (path, polygon, ring, seq, x, y) of polygon shapes, and of
    lines that close; rings of fewer than three points drop."""

    def rows(p: str, content: bytes) -> list[dict]:
        out, at = [], 100
        while at + 12 <= len(content):
            number, words = struct.unpack(">ii", content[at : at + 8])
            rec = content[at + 8 : at + 8 + words * 2]
            at += 8 + words * 2
            kind = struct.unpack("<i", rec[:4])[0]
            if kind not in (3, 5, 13, 15, 23, 25):
                continue
            parts, points = struct.unpack("<ii", rec[36:44])
            starts = [*struct.unpack(f"<{parts}i", rec[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(rec[44 + 4 * parts : 44 + 4 * parts + 16 * points], "<f8").reshape(-1, 2)
            ring = 0
            for a, b in zip(starts, starts[1:]):
                r = xy[a:b]
                closed = len(r) > 3 and np.abs(r[0] - r[-1]).max() <= 1e-7
                if len(r) < 3 or (kind in (3, 13, 23) and not closed):
                    continue
                r = r[:-1] if closed else r
                out += [{"path": p, "polygon": str(number), "ring": ring, "seq": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate(r)]
                ring += 1
        return out

    return parsed(spark, path, "*.shp", rows, "path string, polygon string, ring int, seq int, x double, y double")


def geojson_rings(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC23: ring points of polygons; parts of a multipolygon are polygons of their own."""

    def rows(p: str, content: bytes) -> list[dict]:
        doc = json.loads(decoded(content))
        out = []
        for n, f in enumerate(doc.get("features", [doc])):
            g = f.get("geometry") or f
            polygons = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else []
            name = (f.get("properties") or {}).get("name") or str(n)
            for k, rings in enumerate(polygons):
                for r, ring in enumerate(rings):
                    ring = ring[:-1] if len(ring) > 3 and ring[0] == ring[-1] else ring
                    out += [{"path": p, "polygon": name if len(polygons) == 1 else f"{name}#{k}", "ring": r, "seq": i, "x": float(c[0]), "y": float(c[1])} for i, c in enumerate(ring)]
        return out

    return parsed(spark, path, "*.geojson", rows, "path string, polygon string, ring int, seq int, x double, y double")


def workbook_cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """SRC02: cells (path, sheet, row_no, name, text) of workbooks under their column
    names; a blank name is COLUMN_n."""

    def rows(p: str, content: bytes) -> list[dict]:
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        z = zipfile.ZipFile(io.BytesIO(content))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        out = []
        for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            names: dict[int, str] = {}
            for r in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
                cells = {}
                for c in r.findall("m:c", ns):
                    col = 0
                    for ch in re.match(r"[A-Z]+", c.get("r"))[0]:
                        col = col * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" else v.text if v is not None else None
                    cells[col] = text
                if not names:
                    names = {k: (cells.get(k) or "").strip() or f"COLUMN_{k}" for k in range(1, max(cells, default=0) + 1)}
                    continue
                out += [{"path": p, "sheet": sheet.split("/")[-1], "row_no": int(r.get("r")), "name": names.get(k, f"COLUMN_{k}"), "text": v} for k, v in cells.items()]
        return out

    return parsed(spark, path, "*.xlsx", rows, "path string, sheet string, row_no int, name string, text string")
